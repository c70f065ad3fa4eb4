"""Near duplicates by DartMinHash signatures, banded joins and an exact check.

A document's words are read as a weighted set of five-word shingles. ``shingles.dart_signatures`` gives
every different text a signature of 120 values; 24 bands of five rows bring texts of similarity 0.8
together with probability 0.99993. What follows never writes all pairs of a bucket:

1. Equal texts are one class from the start; only one representative of each goes on.
2. In every bucket one text leads: the one whose buckets are fullest, which in a group of copies is their
   origin. All others are compared with the leader only, exactly, on their whole shingle sets.
3. Links make components. Buckets whose texts are all in one component are done. In the others, each text
   outside the bucket's largest component is compared with all texts of other components. An exact bound on
   the shingles they can share takes most of them out first; the rest are compared by signature in
   blocks of bounded size inside the tasks, and only pairs that look similar are written and checked
   exactly. So a link missed by the leaders is found, and a group of thousands of copies costs about one
   comparison each.

Classes are the connected components of the links, found by joins. Python runs in Arrow batches inside
partitions; groups are streamed in sorted order and split by a salt, so no group is held in one task.

Defined results: null and empty texts are equal texts. A text without words is linked to equal texts
only. Fewer than five words are one shingle. Repeated rows are copies. Classes are named by their
smallest ``doc_id`` (null last). Other columns, whatever their names, are carried through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep_whole, near, stage
from parcelwise.llm.shingles import band_hashes, dart_signatures, shingle_sets

VALUES = 120
BANDS = 24
SIMILARITY = 0.8
#: Texts compared in one go within a bucket, and members of a leader that go to one task.
BLOCK = 512
#: How often the exact bound is drawn again among the rows it left.
BOUNDINGS = 2
#: Bytes of text worked on in one go.
CHUNK = 1 << 20


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of at most ``CHUNK`` bytes and ``BLOCK`` texts (a longer text alone), with the number of the first."""
    at, held, size = 0, [], 0
    for i, value in enumerate(texts):
        text = (value.as_py() or "").encode()
        if held and (size + len(text) > CHUNK or len(held) == BLOCK):
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def sign(rows: DataFrame, values: int = VALUES, bands: int = BANDS, counted: bool = False) -> DataFrame:
    """``(r, n, bands, sig)`` of ``(r, t)``: different shingles, band hashes and the signature's bytes.

    ``counted`` weighs a shingle by how often the text holds it; else every shingle weighs one, and the
    signatures estimate the plain Jaccard similarity. Texts without words have no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column("t")):
                owner, element, count = shingle_sets(texts)
                weight = count if counted else np.ones(len(element), dtype=np.int64)
                filled, signature = dart_signatures(owner, element, weight, len(texts), values)
                hashes = band_hashes(signature, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("r").slice(at, len(texts)),
                        pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int64)),
                        pa.array([h.tolist() if f else [] for f, h in zip(filled, hashes, strict=True)], pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                    ],
                    names=["r", "n", "bands", "sig"],
                )

    return rows.mapInArrow(run, "r long, n long, bands array<long>, sig binary")


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of sorted batches that lie within one group of ``keys``, and whether the group is a new one."""
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        turn = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            yield batch.slice(a, b - a), key != last
            last = key


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``r`` is among ``ids``, picked before any shuffle where these are few."""
    return rows.join(near(stage(ids.distinct())), "r", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets reach the similarity, exactly; ``texts`` is ``(r, t)``.

    The text of ``a`` is sent once per ``BLOCK`` of its partners; partners stream past it.
    """
    pairs = stage(pairs)
    salted = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    right = pairs.join(salted, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b")
    left = salted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    wanted = stage(left.withColumn("r", F.col("a")).unionByName(right.withColumn("r", F.col("b"))))
    # Texts of rows in no pair stay where they are.
    rows = wanted.join(_only(texts, wanted.select("r")), "r").select("a", "salt", "b", "t")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(0, dtype=np.uint64)
        for part, new in _sorted_runs(batches, ["a", "salt"]):
            for at, chunk in _chunks(part.column("t")):
                owner, element, _ = shingle_sets(chunk)
                if new and at == 0:
                    whole = element[owner == 0]
                sizes = np.bincount(owner, minlength=len(chunk))
                common = np.bincount(owner[np.isin(element, whole)], minlength=len(chunk))
                union = sizes + len(whole) - common
                good = np.flatnonzero((common >= similarity * union - 1e-9 * union) & (union > 0)) + at
                rows = part.select(["a", "b"]).take(pa.array(good))
                yield rows.filter(rows.column("b").is_valid())

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(r, comp)`` of every linked row; ``comp`` is the smallest row number of its component.

    Each round takes the smallest label among the neighbours and then the label of that label, which
    halves the way to the smallest; rounds are written tables, so a lost executor costs no earlier round.
    """
    both = links.select(F.col("a").alias("r"), F.col("b").alias("s")).union(links.select("b", "a"))
    both = stage(both.where("r <> s").distinct())
    labels = stage(both.groupBy("r").agg(F.least(F.min("s"), F.col("r")).alias("comp")))
    while True:
        seen = labels.select(F.col("r").alias("s"), F.col("comp").alias("near"))
        least = both.join(seen, "s").groupBy("r").agg(F.min("near").alias("near"))
        step = labels.join(least, "r").select("r", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("r").alias("comp"), F.col("comp").alias("far"))
        after = stage(step.join(jump, "comp").select("r", "old", F.least("comp", "far").alias("comp")))
        moved = after.where("comp <> old").limit(1).count()
        labels = after.select("r", "comp")
        if not moved:
            return labels


def _alike(first: np.ndarray, second: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signatures that agree in at least ``least`` values."""
    same = np.zeros((len(first), len(second)), dtype=np.int16)
    for j in range(first.shape[1]):
        same += first[:, j, None] == second[None, :, j]
    return np.nonzero(same >= least)


def _first_band(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, bands: int) -> np.ndarray:
    """The first band in which each pair of places agrees, found in blocks of bounded size."""
    out = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), 1 << 14):
        same = first[i[k : k + (1 << 14)]] == second[j[k : k + (1 << 14)]]
        out[k : k + (1 << 14)] = same.reshape(len(same), bands, -1).all(axis=2).argmax(axis=1)
    return out


def _signatures(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, values)


def _least(similarity: float, values: int) -> int:
    """Agreements below which a pair of this similarity falls with a chance under one in a million."""
    return int(values * similarity - 5 * np.sqrt(values * similarity * (1 - similarity)))


def leader_pairs(buckets: DataFrame, signed: DataFrame, similarity: float, values: int) -> DataFrame:
    """``(a, b)``: every text with the leaders of its buckets, where the signatures look similar."""
    density = buckets.groupBy("r").agg(F.sum("n").alias("density"))
    weighed = buckets.join(density, "r")
    leader = weighed.groupBy("key").agg(F.max(F.struct("density", "r"))["r"].alias("a"))
    pairs = stage(buckets.join(leader, "key").where("a <> r").select("a", F.col("r").alias("b")).distinct())
    sig = stage(_only(signed.select("r", "sig"), pairs.select(F.explode(F.array("a", "b")).alias("r"))))
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    least = _least(similarity, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = _signatures(batch.column("sig_a"), values) == _signatures(batch.column("sig_b"), values)
                yield batch.select(["a", "b"]).filter(pa.array(same.sum(axis=1) >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows ``(key, r, comp)`` of the buckets with several components, with what their blocks need."""
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("n", "comp"))["comp"].alias("largest"), F.count("*").alias("comps"), F.sum("n").alias("all"), F.max("n").alias("most")
    )
    return stage(labelled.join(mixed.where("comps > 1").drop("comps"), "key"))


def can_link(rows: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(r, n, high)`` of those rows that can still have a link among each other, by an exact bound.

    Of its n shingles a text shares none of the u that no other row holds. A link to a text of m shingles needs
    at least ``s / (1 + s) * (n + m)`` in common, so m is at most ``high = (1 + s) / s * (n - u) - n``, and at least
    ``s * n``. In a group of copies that drops the ones which differ too much from all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in _chunks(batch.column("t")):
                owner, element, _ = shingle_sets(chunk)
                r = batch.column("r").slice(at, len(chunk)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(r[owner]), pa.array(element.view(np.int64))], names=["r", "h"])

    held = _only(texts, rows.select("r")).select("r", "t").mapInArrow(run, "r long, h long")
    single = held.groupBy("h").agg(F.count("*").alias("rows"), F.min("r").alias("r")).where("rows = 1")
    own = single.groupBy("r").agg(F.count("*").alias("u"))
    bounded = _only(signed.select("r", "n"), rows.select("r")).join(own, "r", "left")
    high = (1 + similarity) / similarity * (F.col("n") - F.coalesce("u", F.lit(0))) - F.col("n") + 1e-6
    return stage(bounded.select("r", "n", high.alias("high")).where(F.col("high") >= F.col("n") * similarity))


def remaining_pairs(buckets: DataFrame, comp: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float, values: int, bands: int) -> DataFrame:
    """``(a, b)`` of different components within a bucket that can be a link and whose signatures look similar.

    Blocks of texts outside the bucket's largest component meet blocks of the whole bucket inside a task. A
    pair is written in the first band that brings it together, once.
    """
    labelled = buckets.join(comp, "r", "left").select("key", "band", "r", F.coalesce("comp", "r").alias("comp"))
    held = labelled
    for _ in range(BOUNDINGS):
        # With rows gone, more shingles of the others are held by nobody else.
        able = can_link(_mixed(held), signed, texts, similarity)
        held = labelled.join(near(able), "r")
    rows = _mixed(held.select("key", "band", "r", "comp", F.col("n").alias("size"), "high"))
    rows = rows.join(_only(signed.select("r", "sig"), rows.select("r")), "r")
    block = lambda n: F.ceil(n / BLOCK).cast("int")
    outside, whole = block(F.col("all") - F.col("most")), block(F.col("all"))
    rows = rows.withColumn("out", F.col("comp") != F.col("largest"))
    columns = ["side", "band", "r", "comp", "out", "size", "high", "sig"]
    seek = rows.where("out").select(
        "*", F.pmod(F.hash("r"), outside).alias("x"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("y"), F.lit(0).alias("side")
    ).select("key", "x", "y", *columns)
    meet = rows.select(
        "*", F.explode(F.sequence(F.lit(0), outside - 1)).alias("x"), F.pmod(F.hash("r"), whole).alias("y"), F.lit(1).alias("side")
    ).select("key", "x", "y", *columns)
    dealt = seek.unionByName(meet).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    least = _least(similarity, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part, new in _sorted_runs(batches, ["key", "x", "y"]):
            if new:
                held = []
            side = part.column("side").to_numpy()
            if (side == 0).any():
                held.append(part.slice(0, int((side == 0).sum())))
            others = part.slice(int((side == 0).sum()))
            if not others.num_rows or not held:
                continue
            seen = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first, second = _signatures(seen.column("sig"), values), _signatures(others.column("sig"), values)
            i, j = _alike(first, second, least)
            a, b = seen.column("r").to_numpy()[i], others.column("r").to_numpy()[j]
            apart = seen.column("comp").to_numpy()[i] != others.column("comp").to_numpy()[j]
            # Two texts that both lie outside meet twice.
            apart &= (a < b) | ~others.column("out").to_numpy(zero_copy_only=False)[j]
            apart &= _first_band(first, second, i, j, bands) == part.column("band").to_numpy()[0]
            for one, i1, two, i2 in ((seen, i, others, j), (others, j, seen, i)):
                apart &= one.column("size").to_numpy()[i1] <= two.column("high").to_numpy()[i2]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def classes(numbered: DataFrame, similarity: float = SIMILARITY, values: int = VALUES, bands: int = BANDS, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership ``(r, rep, comp)`` of every row and the links between representatives.

    ``numbered`` is a written table ``(r, t)``. ``rep`` is the first row of equal text; ``comp`` names the
    connected component of ``rep``.
    """
    text = F.coalesce("t", F.lit(""))
    keys = stage(numbered.select("r", F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.octet_length(text).alias("h3")))
    first = keys.groupBy("h1", "h2", "h3").agg(F.min("r").alias("rep"))
    copies = stage(keys.join(first, ["h1", "h2", "h3"]).select("r", "rep"))
    repeats = copies.where("r <> rep").select("r")
    signed = stage(sign(numbered.join(near(repeats), "r", "left_anti"), values, bands, counted))
    flat = signed.select("r", F.posexplode("bands").alias("band", "hash"))
    flat = flat.select("r", "band", F.xxhash64("band", "hash").alias("key"))
    full = stage(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = stage(flat.join(near(full), "key"))

    links = stage(verified(leader_pairs(buckets, signed, similarity, values), numbered, similarity))
    comp = components(links)
    more = stage(verified(remaining_pairs(buckets, comp, signed, numbered, similarity, values, bands), numbered, similarity))
    if more.limit(1).count():
        links = links.unionByName(more)
        comp = components(links)
    member = copies.join(comp.select(F.col("r").alias("rep"), "comp"), "rep", "left")
    return member.select("r", "rep", F.coalesce("comp", "rep").alias("comp")), links


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    rows = stage(docs.select(F.monotonically_increasing_id().alias("r"), keep_whole(docs, "d")))
    return rows, rows.select("r", F.col(f"d.`{text}`").alias("t"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, class_id, class_size, n_texts)`` of every document."""
    rows, numbered = _numbered(docs, text)
    member, _ = classes(numbered, similarity)
    named = stage(member.join(rows.select("r", F.col(f"d.`{doc_id}`").alias("doc")), "r"))
    whole = named.groupBy("comp").agg(
        F.min("doc").alias("class_id"), F.count("*").alias("class_size"), F.sum(F.when(F.col("r") == F.col("rep"), 1).otherwise(0)).alias("n_texts")
    )
    return named.join(whole, "comp").select("doc", "class_id", "class_size", "n_texts")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every class, the one of the smallest id, with its own columns."""
    rows, numbered = _numbered(docs, text)
    member, _ = classes(numbered, similarity)
    ids = rows.select("r", F.col(f"d.`{doc_id}`").alias("doc"))
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "r")
    best = member.join(ids, "r").groupBy("comp").agg(F.min(order)["r"].alias("r"))
    return rows.join(best.select("r"), "r", "left_semi").select("d.*")

