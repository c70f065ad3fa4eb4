"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers read a text with one space before it, so that their tokens cut the same bytes. In each Arrow
batch the starts of either side find the covering token of the other side by ``pandas.merge_asof``, keyed by
document; the union of both directions is all overlaps. Overlapping tokens with equal ends cut the
document into groups: the smallest runs of tokens of either side that spell the same bytes.

Two tokens of one group are *linked*. :func:`count_links` counts, for every pair of ids, the documents that hold it
linked, and brings the counts back to the documents. Pairs held by so many documents that there can be only
``HEAVY`` of them are looked up where the documents lie, so no frequent pair gathers its documents in
one task; only links of the other pairs are shuffled.

Defined results: a document without tokens (text null or empty, or tokens of either side that spell other bytes, as
with U+2581 in the text) has zeros and empty lists. Control strings are ordinary text. Texts are read whole,
whatever their length. Repeated rows are documents of their own; a null id is kept. Other columns are not
carried along, so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import stage
from parcelwise.llm.packing import default_tokenizer, encoder

#: At most so many pairs of ids are sent to every executor: some megabytes.
HEAVY = 50_000
#: Texts of a slice that is aligned at once: rows, and characters unless one text has more.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000

SCHEMA = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
    "listing": "string", "pairs": "array<struct<a: int, b: int, n: long>>",
}
DETAIL = {"groups": "array<struct<a: array<int>, b: array<int>, end: long>>", "overlaps": "array<struct<a: int, b: int>>"}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """A byte-level vocabulary, given as ranks."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        size = self.encoder.encoding.max_token_value + 1
        self.bytes = [b""] * size
        for token in self.encoder.encoding.token_byte_values():
            self.bytes[self.encoder.encoding.encode_single_token(token)] = token
        self.sizes = np.array([len(b) for b in self.bytes], dtype="int64")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoder.encode(" " + text).astype("int64") for text in texts]

    def spell(self, ids: np.ndarray) -> bytes:
        return self.encoder.encoding.decode_bytes(ids.tolist())


class PieceTokens:
    """A piece vocabulary, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._spelled(i) for i in range(self.model.get_piece_size())]
        self.sizes = np.array([len(b) for b in self.bytes], dtype="int64")

    def _spelled(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype="int64") for ids in self.model.encode(texts, num_threads=1)]

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def _vocabularies(ranks: str, pieces: str) -> tuple[ByteTokens, PieceTokens, tuple[np.ndarray, np.ndarray]]:
    """Both sides and the names of their ids, loaded once in a Python worker."""
    a, b = ByteTokens(ranks), PieceTokens(pieces)
    return a, b, (_named(len(a.bytes)), _named(len(b.bytes)))


def _tokens(texts: list[str | None], a, b) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both sides; none where a text has none or is not spelled by both."""
    none = np.zeros(0, dtype="int64")
    held = [i for i, t in enumerate(texts) if t]
    out_a, out_b = [none] * len(texts), [none] * len(texts)
    given = [texts[i] for i in held]
    if not given:
        return out_a, out_b
    for i, x, y in zip(held, a.encode(given), b.encode(given)):
        whole = b" " + texts[i].encode()
        if a.spell(x) == whole and b.spell(y) == whole:
            out_a[i], out_b[i] = x, y
    return out_a, out_b


def _placed(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """One row per token: its document, its place there, id, and byte range. ``start`` grows over all documents."""
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype="int64")
    stop = np.cumsum(sizes[flat])
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1]
    return pd.DataFrame(
        {"start": stop - sizes[flat], "end": stop, "doc": doc, "at": np.arange(len(flat)) - first[doc], "id": flat, "row": np.arange(len(flat))}
    )


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of rows ``(row_a, row_b)`` whose byte ranges overlap."""
    left, right = a[["start", "doc", "row"]], b[["start", "doc", "row"]]
    forth = pd.merge_asof(left, right, on="start", by="doc", suffixes=("_a", "_b"))
    # Tokens that start together have found each other already.
    back = pd.merge_asof(right, left, on="start", by="doc", suffixes=("_b", "_a"))
    back = back[a["start"].to_numpy()[back["row_a"].to_numpy()] != back["start"].to_numpy()]
    return pd.concat([forth[["row_a", "row_b"]], back[["row_a", "row_b"]]], ignore_index=True)


def _named(size: int) -> np.ndarray:
    """Every id as text, each with the three marks that can follow it."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], dtype=object)


def _listings(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], names, docs: np.ndarray) -> list[str]:
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``; ``docs`` counts the tokens of both sides in each."""
    out = np.empty(len(ids[0]) + len(ids[1]), dtype=object)
    ends = np.cumsum(counts[0] + counts[1])
    before = ends - counts[0] - counts[1]
    for side, first in ((0, before), (1, before + counts[0])):
        g, n = groups[side], counts[side]
        within = np.arange(len(g)) - (np.cumsum(n) - n)[g]
        last = within == n[g] - 1
        size = len(names[side]) // 3
        out[first[g] + within] = names[side][ids[side] + np.where(last, size * (1 + side), 0)]
    flat, stops = out.tolist(), np.cumsum(docs)
    return ["".join(flat[a:b])[:-1] for a, b in zip(stops - docs, stops)]


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids of each group, in the order of groups, and how often each is there."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def _pairs(doc_of: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, sizes: tuple[int, int]):
    """Different linked pairs ``(doc, a, b, n)`` with the number of links, ordered."""
    (group, x, nx), (other, y, ny) = _distinct(ga, a, sizes[0]), _distinct(gb, b, sizes[1])
    width = np.bincount(other, minlength=len(doc_of))
    first = np.cumsum(width) - width
    each = width[group]
    left = np.repeat(np.arange(len(group)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first[group[left]]
    key = (doc_of[group[left]] * sizes[0] + x[left]) * sizes[1] + y[right]
    key, back = np.unique(key, return_inverse=True)
    n = np.bincount(back, weights=nx[left] * ny[right], minlength=len(key)).astype("int64")
    rest, y = key // sizes[1], key % sizes[1]
    return rest // sizes[0], rest % sizes[0], y, n


def align_texts(texts: list[str | None], a, b, names, detail: bool = False) -> list[pa.Array]:
    """The columns of ``SCHEMA``, and of ``DETAIL`` if asked for, for a slice of texts."""
    ids_a, ids_b = _tokens(texts, a, b)
    ta, tb = _placed(ids_a, a.sizes), _placed(ids_b, b.sizes)
    both = overlapping(ta, tb)
    ra, rb = both["row_a"].to_numpy(), both["row_b"].to_numpy()
    ends_a, ends_b = ta["end"].to_numpy(), tb["end"].to_numpy()
    flat_a, flat_b = ta["id"].to_numpy(), tb["id"].to_numpy()
    cut = ends_a[ra] == ends_b[rb]
    flag_a, flag_b = np.zeros(len(ta), dtype="int64"), np.zeros(len(tb), dtype="int64")
    flag_a[ra[cut]], flag_b[rb[cut]] = 1, 1
    ga, gb = np.cumsum(flag_a) - flag_a, np.cumsum(flag_b) - flag_b
    last = np.flatnonzero(flag_a)
    doc_of = ta["doc"].to_numpy()[last]
    n_docs, n_groups = len(texts), len(last)
    na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    size_a, size_b = np.array([len(x) for x in ids_a], dtype="int64"), np.array([len(x) for x in ids_b], dtype="int64")
    per_doc = np.bincount(doc_of, minlength=n_docs)
    links = np.bincount(doc_of, weights=(na * nb).astype("float64"), minlength=n_docs).astype("int64")
    listing = _listings((flat_a, flat_b), (ga, gb), (na, nb), names, size_a + size_b)
    doc, x, y, n = _pairs(doc_of, ga, flat_a, gb, flat_b, (len(a.bytes), len(b.bytes)))
    pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(n)], ["a", "b", "n"])
    out = [pa.array(size_a), pa.array(size_b), pa.array(per_doc), pa.array(links), pa.array(listing, pa.string())]
    out.append(_lists(pairs, np.bincount(doc, minlength=n_docs)))
    if detail:
        base = np.concatenate([[0], np.cumsum([int(a.sizes[x].sum()) for x in ids_a])])[:-1]
        held = [_lists(pa.array(flat_a, pa.int32()), na), _lists(pa.array(flat_b, pa.int32()), nb)]
        out.append(_lists(pa.StructArray.from_arrays([*held, pa.array(ends_a[last] - base[doc_of])], ["a", "b", "end"]), per_doc))
        order = np.lexsort((rb, ra))
        at_a, at_b = ta["at"].to_numpy()[ra[order]], tb["at"].to_numpy()[rb[order]]
        spans = pa.StructArray.from_arrays([pa.array(at_a, pa.int32()), pa.array(at_b, pa.int32())], ["a", "b"])
        out.append(_lists(spans, np.bincount(ta["doc"].to_numpy()[ra], minlength=n_docs)))
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded length; a text longer than the bound is a run of its own."""
    first = chars = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > first and (i - first >= SLICE_ROWS or chars + size > SLICE_CHARS):
            yield first, i
            first, chars = i, 0
        chars += size
    if first < len(texts):
        yield first, len(texts)


def align(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, pieces: str | None = None, detail: bool = False
) -> DataFrame:
    """``doc`` and the columns of ``SCHEMA``, with ``detail`` also those of ``DETAIL``.

    ``listing`` has the ids of both sides by group, as ``a1,a2|b1;a3|b2,b3``; ``pairs`` the different linked ids with their
    number of links; ``groups`` the ids as lists with the byte at which the group ends (the leading space is byte
    0); ``overlaps`` the places of overlapping tokens.
    """
    paths = ranks or default_tokenizer(), pieces or default_pieces()
    columns = SCHEMA | DETAIL if detail else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, names = _vocabularies(*paths)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for first, stop in _slices(texts):
                ids = batch.column("doc").slice(first, stop - first)
                out = align_texts(texts[first:stop], a, b, names, detail)
                yield pa.RecordBatch.from_arrays([ids, *out], names=["doc", *columns])

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = ", ".join(f"{name} {what}" for name, what in columns.items())
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).mapInArrow(run, f"doc {kind}, {fields}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: documents that hold the ids linked, and whether no id ``b`` has more for this ``a``."""
    counts = stage(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")))
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def count_links(aligned: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` over all links of a document, without ``pairs``.

    ``n_best``: links whose count is the highest of their ``a``; ``count_sum``: the sum of the links' counts.
    """
    rows = stage(aligned.withColumn("r", F.monotonically_increasing_id()))
    counts = stage(pair_counts(rows))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    # No more than ``heavy`` pairs can have this share of all.
    often = F.col("docs") * heavy > total
    frequent = F.broadcast(counts.filter(often))
    links = rows.select("r", F.inline("pairs"))
    sums = [F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")]
    here = links.join(frequent, ["a", "b"]).groupBy("r").agg(*sums)
    rare = links.join(frequent.select("a", "b"), ["a", "b"], "left_anti").join(counts.filter(~often), ["a", "b"])
    both = here.unionByName(rare.groupBy("r").agg(*sums)).groupBy("r").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = [c for c in rows.columns if c not in ("r", "pairs")]
    return rows.drop("pairs").join(both, "r", "left").select(*kept, zero("n_best"), zero("count_sum"))
