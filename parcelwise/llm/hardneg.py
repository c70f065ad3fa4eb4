"""Hard negatives by threshold joins in the manner of L2AP.

A *window* asks for the ``k`` best rows of one anchor among those of its own label, or of other labels, whose
score (inner product of whole-numbered vectors) lies between two bounds. Rows and anchors are dealt into
blocks of bounded size; every block of rows meets every block of anchors in one group of a co-grouped Arrow call.
Inside a group:

* the inverted index lists, dimension block by dimension block, the rows that need it: for each row the
  last dimensions are left out whose norm, times the greatest norm of the anchors there, is under the lowest threshold;
* partial scores are accumulated along the index, and a pair is given up as soon as its partial score plus the
  product of the remaining norms stays under the anchor's threshold; what is left is scored whole;
* thresholds start near the window's upper bound and are lowered until the windows are full (or their lower bound,
  or the ``floor`` known from before, is reached), so a window's rows are never scored far below its last one.

The best ``k`` of each window and block are then ranked over all blocks. The first block of rows gives every
window a floor: its own ``k``-th best score, which the final one cannot be below; with it the other blocks
return few rows. Positives are the windows without bounds of the own label; each positive gives a window of
negatives in turn.

Components are ``floor(scale * x)``. Scores are exact while they are below 2**53, which holds for 64 dimensions of components below
2**23; beyond that they are those of double arithmetic, held inside the range of long.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. A vector shorter than
another counts as zero in the missing dimensions; an empty one scores zero. Rows are told apart by their
place, so a repeated row is another row, and may be the other's positive; equal scores go by smaller id, null ids
last, then by place. A null id is no anchor. An anchor without another row of its label has no positives, and a
positive whose window holds no row gives no row. Other columns are not carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import stage
from parcelwise.operators.keyed import first_rows

SCALE = 256
#: Numbers in the vectors of a block of rows or of windows: some megabytes.
BLOCK = 1_048_576
#: Dimensions that are accumulated between two prunings, and anchors that are scored side by side.
STEP, ABREAST = 16, 64
#: A threshold first falls by this part of the way to where it can fall at most, then by half as much again each time.
FALL = 0.0625
LONG_MAX = float(2**63 - 1024)


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``(r, block, id, label, v)`` of the rows that take part, with whole-numbered components; written once."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    given = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))).alias("v"),
    )
    return stage(given.filter("label IS NOT NULL AND v IS NOT NULL").withColumn("r", F.monotonically_increasing_id()))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    sizes = np.asarray(pa.compute.list_value_length(vectors))
    flat = np.asarray(vectors.flatten(), dtype="float64")
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Index:
    """Rows of a block, their dimensions in order of weight, with the norms of what follows each step."""

    def __init__(self, rows: np.ndarray, width: int):
        self.order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        self.rows = np.ascontiguousarray(rows[:, self.order])
        self.edges = [*range(0, width, STEP), width]
        self.rest = self.norms(self.rows)

    def norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of ``x`` from each step on; the last column is zero."""
        squares = np.add.reduceat(x * x, self.edges[:-1], axis=1) if x.shape[1] else np.zeros((len(x), 0))
        tail = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        # A little more, so that rounding cannot prune a pair.
        return np.hstack([np.sqrt(tail) * (1 + 1e-9), np.zeros((len(x), 1))])

    def above(self, anchors: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each anchor all rows that score at least ``least``, with their scores."""
        x = anchors[:, self.order]
        rest = self.norms(x)
        # The index: a row is listed for a step if what follows could still reach the lowest threshold. A row
        # listed for none is met by no anchor; one whose list ends keeps the bound of where it ends.
        listed = self.rest * rest.max(axis=0) >= least.min() - 1e-6
        alive = np.broadcast_to(listed[:, 0], (len(x), len(self.rows))).copy()
        partial = np.zeros(alive.shape)
        for s, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            rows = np.flatnonzero(listed[:, s] & alive.any(axis=0))
            partial[:, rows] += x[:, a:b] @ self.rows[rows, a:b].T
            remaining = rest[:, s + 1, None] * self.rest[rows, s + 1]
            alive[:, rows] &= partial[:, rows] + remaining >= least[:, None] - 1e-6
        out = []
        for k in range(len(x)):
            rows = np.flatnonzero(alive[k])
            scores = self.rows[rows] @ x[k]
            fit = scores >= least[k]
            out.append((rows[fit], scores[fit]))
        return out


def _fill(index: Index, anchors: np.ndarray, windows: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(window, rows, scores)``: the best ``k`` rows of every window in this block, as far as they reach its floor."""
    which, low, high = windows["anchor"], windows["low"], windows["high"]
    most = index.norms(anchors)[:, 0] * index.rest[:, 0].max(initial=0.0)
    # A threshold need not start above what a score or a window can be, nor fall under what they can be.
    top = np.full(len(anchors), -np.inf)
    np.maximum.at(top, which, np.minimum(high, most[which]))
    reach = np.maximum(low, -most[which] - 1)
    bottom = np.full(len(anchors), np.inf)
    np.minimum.at(bottom, which, reach)
    open_windows: list[list[int]] = [[] for _ in anchors]
    for w, a in enumerate(which):
        open_windows[a].append(w)
    for first in range(0, len(anchors), ABREAST):
        todo = np.arange(first, min(first + ABREAST, len(anchors)))
        todo, fall = todo[top[todo] >= bottom[todo]], FALL
        while len(todo):
            # The last round is at the bottom itself, below which no window has a row.
            final = fall >= 1.0
            least = bottom[todo] if final else np.maximum(top[todo] - fall * (top[todo] - bottom[todo]), bottom[todo])
            for a, t, (at, scores) in zip(todo, least, index.above(anchors[todo], least)):
                left = []
                for w in open_windows[a]:
                    fit = (scores >= low[w]) & (scores <= high[w]) & (rows["r"][at] != windows["r"][w])
                    fit &= (rows["label"][at] == windows["label"][w]) == windows["same"][w]
                    chosen = np.flatnonzero(fit)
                    if len(chosen) < k and reach[w] < t and not final:
                        left.append(w)
                        continue
                    best = chosen[np.lexsort((rows["r"][at[chosen]], rows["id"][at[chosen]], -scores[chosen]))[:k]]
                    yield w, at[best], scores[best]
                open_windows[a] = left
            fall = min(1.0, fall * 1.5)
            todo = todo[[bool(open_windows[a]) for a in todo]]


def _meet(windows: DataFrame, rows: DataFrame, k: int, blocks: tuple[int, int]) -> DataFrame:
    """``(window, r, id, score)``: the best ``k`` rows of each window in each block of rows.

    ``windows``: ``window, r, label, same, low, high, v`` with the anchor's row ``r``, label and vector.
    """

    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())]
        if left.num_rows and right.num_rows:
            longest = lambda t: pa.compute.max(pa.compute.list_value_length(t.column("v"))).as_py() or 0
            width = max(longest(left), longest(right), 1)
            vectors = lambda t: _matrix(t.column("v").combine_chunks(), width)
            number = lambda t, c: t.column(c).to_numpy()
            # Windows of one anchor share its row of the matrix.
            _, one, back = np.unique(number(left, "r"), return_index=True, return_inverse=True)
            given = {c: number(left, c) for c in ("label", "same", "low", "high", "r", "window")} | {"anchor": back}
            own = {c: number(right, c) for c in ("label", "r")}
            held = right.column("id")
            own["id"] = pa.compute.fill_null(held, 2**63 - 1).to_numpy()
            index = Index(vectors(right), width)
            found = list(_fill(index, vectors(left.take(pa.array(one))), given, own, k))
            if found:
                at = np.concatenate([f[1] for f in found])
                window = given["window"][np.repeat([f[0] for f in found], [len(f[1]) for f in found])]
                score = np.clip(np.concatenate([f[2] for f in found]), -LONG_MAX, LONG_MAX).astype("int64")
                out = [pa.array(window), pa.array(own["r"][at]), held.combine_chunks().take(pa.array(at)), pa.array(score)]
        return pa.table(out, names=["window", "r", "id", "score"])

    n_rows, n_windows = blocks
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # The block of rows leads the key; either side comes once for each block of the other.
    a = windows.withColumn("wb", spread("r", n_windows)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    b = rows.withColumn("rb", spread("r", n_rows)).withColumn("wb", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    return a.groupBy("rb", "wb").cogroup(b.groupBy("rb", "wb")).applyInArrow(join, "window long, r long, id long, score long")


def _blocks(rows: DataFrame, block: int) -> int:
    """How many blocks of about ``block`` numbers the vectors make."""
    return max(1, -(-(rows.agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0) // block))


def best_rows(windows: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``(window, r, id, score, rank)``: the first ``k`` rows of every window over all rows."""
    n_rows, n_windows = _blocks(rows, block), _blocks(windows, block)
    if n_rows > 1:
        first = rows.filter(F.pmod(F.xxhash64("r"), F.lit(n_rows)) == 0)
        seen = _meet(windows, first, k, (1, n_windows))
        floors = seen.groupBy("window").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        windows = stage(
            windows.join(floors.select("window", "floor"), "window", "left")
            .withColumn("low", F.greatest("low", F.coalesce("floor", "low")))
            .drop("floor")
        )
    met = _meet(windows, rows, k, (n_rows, n_windows))
    return first_rows(met, ["window"], [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("r")], k, rank="rank")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    least: int = 30,
    most: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` come from :func:`usable`. A negative scores between ``least`` and ``most`` percent of the positive.
    """
    wide = float(2**62)
    anchors = stage(rows.filter(is_anchor).select("id", "r", "label", "v"))
    asked = anchors.select(
        F.col("r").alias("window"), "r", "label", "v", F.lit(True).alias("same"), F.lit(-wide).alias("low"), F.lit(wide).alias("high")
    )
    positives = stage(best_rows(asked, rows, n_positives, block))
    share = lambda up, part: F.expr(f"CAST({up}(CAST(score AS DECIMAL(20, 0)) * {part} / 100) AS DOUBLE)")
    named = stage(
        positives.select(
            F.monotonically_increasing_id().alias("window"),
            F.col("window").alias("r"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            share("ceil", least).alias("low"),
            share("floor", most).alias("high"),
        )
    )
    windows = named.join(anchors.select("r", "label", "v"), "r").select(
        "window", "r", "label", "v", F.lit(False).alias("same"), "low", "high"
    )
    best = best_rows(stage(windows.filter("low <= high")), rows, n_negatives, block)
    return (
        best.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(named.select("window", "r", "positive_id", "positive_score"), "window")
        .join(anchors.select("r", F.col("id").alias("anchor_id")), "r")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
