"""Load accounting and set-based updates shared by the table loads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOADED, SKIPPED, INVALID = "loaded", "skipped", "invalid"


def loaded(staged: DataFrame) -> DataFrame:
    """Rows that passed every test, without the bookkeeping column."""
    return staged.filter(F.col("outcome") == LOADED).drop("outcome")


def outcome_counts(staged: DataFrame) -> DataFrame:
    """One row: rows processed by outcome and the success rate in percent."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return staged.agg(
        F.count(F.lit(1)).alias("processed"),
        is_(LOADED).alias("loaded"),
        is_(INVALID).alias("invalid"),
        is_(SKIPPED).alias("skipped"),
    ).withColumn(
        "success_rate",
        F.when(F.col("processed") > 0, F.col("loaded") / F.col("processed") * 100.0).otherwise(F.lit(0.0)),
    )


class TooManyInvalidRows(RuntimeError):
    """A load met more invalid rows than it tolerates; nothing may be written."""


def require_valid(staged: DataFrame, max_invalid: int) -> DataFrame:
    """Return ``staged`` unchanged, or raise when it holds more than ``max_invalid`` invalid rows."""
    bad = staged.filter(F.col("outcome") == INVALID).count()
    if bad >= max_invalid:
        raise TooManyInvalidRows(f"{bad} invalid rows (tolerated: fewer than {max_invalid})")
    return staged


def with_parent(rows: DataFrame, parent: DataFrame, key: str = "account_number") -> DataFrame:
    """Add ``has_parent``: whether the key exists in the parent table."""
    known = parent.select(key).distinct().withColumn("has_parent", F.lit(True))
    return rows.join(known, key, "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))


def update_from(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    assign: Mapping[str, str] | Sequence[str],
    where: Column | None = None,
    keep_blank: Sequence[str] = (),
) -> DataFrame:
    """``UPDATE target SET .. FROM staged``: matched rows take the staged values, nulls included.

    ``where`` restricts which target rows may change; a blank staged value of a ``keep_blank`` column
    leaves the old value. ``staged`` holds one row per key. Adds ``matched``.
    """
    columns = dict(assign) if isinstance(assign, Mapping) else {c: c for c in assign}
    side = staged.select(*keys, *[F.col(s).alias(f"_new_{t}") for t, s in columns.items()], F.lit(True).alias("_hit"))
    joined = target.join(side, list(keys), "left")
    hit = F.coalesce("_hit", F.lit(False))
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    types = dict(target.dtypes)
    values = []
    for name in target.columns:
        if name in columns:
            new = F.col(f"_new_{name}")
            if name in keep_blank:
                new = F.coalesce(F.when(new != "", new), F.col(name))
            values.append(F.when(F.col("matched"), new.cast(types[name])).otherwise(F.col(name)).alias(name))
        else:
            values.append(F.col(name))
    return joined.withColumn("matched", hit).select(*values, "matched")


def match_counts(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: staged keys with and without a target row."""
    known = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return staged.join(known, list(keys), "left").agg(
        F.count("_hit").alias("matched"), F.count_if(F.col("_hit").isNull()).alias("unmatched")
    )


def deactivate_other_batches(rows: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Soft delete: rows of other batches become inactive; adds ``deactivated``."""
    # Rows without a batch id are not excluded by a batch test either.
    other = F.lit(True) if batch_id is None else ~F.col("import_batch_id").eqNullSafe(F.lit(batch_id))
    hit = F.col("is_active") & other
    return rows.withColumn("deactivated", hit).withColumn(
        "is_active", F.when(F.col("deactivated"), F.lit(False)).otherwise(F.col("is_active"))
    )
