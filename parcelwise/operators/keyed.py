"""One row per key: first wins, last wins, newest wins, first usable value wins.

Spark rows have no order, so every operator takes an explicit ``order_by``. Two shapes are used:

* whole rows through ``row_number() <= n``; Spark cuts each group to ``n`` rows inside the map
  tasks before shuffling, so a hot key costs no more than any other;
* single values through ``min_by`` / ``max_by``, which combine map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


Order = Sequence[Column | str]


def by_rows(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is as long as the input: never sent to the driver and every executor.

    Left to itself Spark broadcasts what is short as compressed files or shuffle blocks, which cells, counts and
    repeated facts are at any number of rows: a few megabytes of them are hundreds in the driver's memory.
    """
    return df.hint("merge")


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Order, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; ``rank`` keeps the position as a column."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).filter(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


def first_rows_together(df: DataFrame, keys: Sequence[str], order_by: Sequence[tuple[str, str]], n: int, rank: str) -> DataFrame:
    """:func:`first_rows` of a frame in which the rows of a key are together: in one partition, one after another.

    Nothing is shuffled or sorted beyond a few rows, and the rows stay together. ``order_by``: columns, each ``ascending`` or
    ``descending``; nulls come last.
    """
    names, order = df.columns, list(order_by)
    schema = T.StructType([*df.schema.fields, T.StructField(rank, T.IntegerType())])

    def first(t: pa.Table, starts: np.ndarray) -> pa.Table:
        """The first rows of the keys that begin at ``starts``."""
        group = np.zeros(t.num_rows, dtype="int64")
        group[starts[1:]] = 1
        group = np.cumsum(group)
        at = pc.sort_indices(t.append_column("_key", pa.array(group)), [("_key", "ascending"), *order]).to_numpy()
        place = np.arange(t.num_rows) - starts[group]
        kept = place < n
        return t.take(pa.array(at[kept])).append_column(rank, pa.array(place[kept] + 1, pa.int32()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(names)
            t = t if rest is None else pa.concat_tables([rest, t])
            new = np.zeros(t.num_rows, dtype=bool)
            new[0] = True
            for c in (t.column(k).combine_chunks() for k in keys):
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            # The last key may go on in the next batch.
            rest = t.slice(starts[-1])
            if len(starts) > 1:
                yield from first(t.slice(0, starts[-1]), starts[:-1]).combine_chunks().to_batches()
        if rest is not None:
            yield from first(rest, np.zeros(1, dtype="int64")).combine_chunks().to_batches()

    return df.mapInArrow(cut, schema)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Order) -> DataFrame:
    return first_rows(df, keys, order_by)


def newest_year(df: DataFrame, keys: Sequence[str], year: str = "tax_year", ties: Order = ()) -> DataFrame:
    """The row of the highest year per key."""
    return first_rows(df, keys, [F.col(year).desc_nulls_last(), *ties])


def _usable(value: Column, order: Column, usable: Column | None) -> tuple[Column, Column]:
    ok = value.isNotNull() if usable is None else usable & value.isNotNull()
    return value, F.when(ok, order)


def first_value(value: Column, order: Column, usable: Column | None = None) -> Column:
    """Aggregate: the earliest usable value (rows whose order is null are ignored)."""
    return F.min_by(*_usable(value, order, usable))


def last_value(value: Column, order: Column, usable: Column | None = None) -> Column:
    """Aggregate: the latest usable value."""
    return F.max_by(*_usable(value, order, usable))


def merge_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing rows of the same key, everything else is kept."""
    kept = existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Order) -> DataFrame:
    """Insert, ignoring keys that exist already; inside the incoming rows the first one wins."""
    fresh = first_per_key(incoming, keys, order_by).join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
