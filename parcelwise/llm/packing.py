"""Packing by concatenating and cutting.

Pass one tokenizes every text once and writes, per input partition, the ids of its documents with their
offset inside the partition. The totals of the partitions are then summed to the offset of each
partition (a table as short as the number of partitions). Pass two adds both offsets, which places every
document in one endless row of tokens, and cuts that row at every ``length`` tokens. A document that
crosses a cut gives one record per sequence, so only the last sequence can need padding.

Tokenizing needs Python; it runs in Arrow batches inside the partitions. Cutting is plain columns.

Defined results: a null or empty text is one end token. Repeated rows are packed each for itself. Texts
are read whole, whatever their length; control strings inside them are ordinary text, but with ``added`` the
vocabulary's added tokens are one id each. Other columns are
not carried along. An empty table packs to no sequence.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import stage

LENGTH = 2048
END = 1


class Encoder:
    """Ids of whole texts under a byte-level vocabulary.

    With ``added``, the added tokens of the vocabulary's JSON file, which lies beside the ranks, are one id each
    where a text holds them, as the ``tokenizers`` library has it by default; else they are ordinary text.

    The vocabulary is given as ranks. Its ids are those of the same vocabulary's JSON form, which a test
    holds against the ``tokenizers`` library; encoding by ranks takes a third of that library's time.
    """

    def __init__(self, path: str, added: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        special, self.json, self.added, self.whole = {}, os.path.splitext(path)[0] + ".json", added, None
        if added:
            with open(self.json, encoding="utf-8") as whole:
                special = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            # Runs of about a million blanks are beyond the pattern's stack; the slower library reads them.
            return self._encode_whole(text)

    def _encode_whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            import tokenizers

            self.whole = tokenizers.Tokenizer.from_file(self.json)
            self.whole.encode_special_tokens = not self.added
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    """The encoder of a vocabulary, loaded once in a Python worker, however many tasks it runs."""
    return Encoder(path, added)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, added: bool = False) -> DataFrame:
    """``(part, at, doc, n, ids)``: ids of each document with the end token, little-endian 32 bits.

    ``at`` is the offset inside the input partition ``part``.
    """
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = encoder(path, added), 0
        for batch in batches:
            # Small slices keep the ids of long texts from piling up.
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                ids = [np.append(known.encode(t.as_py() or ""), np.uint32(end)) for t in rows.column("t")]
                n = np.array([len(x) for x in ids], dtype="int64")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                coded = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("part"), pa.array(starts), rows.column("doc"), pa.array(n), coded],
                    names=["part", "at", "doc", "n", "ids"],
                )

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("doc", docs.schema[doc_id].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    return rows.mapInArrow(encode, schema)


def pack(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, added: bool = False) -> DataFrame:
    """Pieces ``(doc, n, ids, start, size, sequence_id, offset)``; ``ids`` holds the ids of the piece.

    ``start`` is the place of the piece in its document, ``offset`` its place in the sequence.
    """
    tokens = stage(tokenize(docs, doc_id, text, tokenizer, end, added))
    # One row per partition: the second pass over offsets is as short as the list of partitions.
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    base = totals.select(
        F.col("part").alias("p"), F.expr("sum(total) OVER (ORDER BY part) - total").alias("base")
    )
    placed = tokens.join(F.broadcast(base), F.col("part") == F.col("p")).withColumn("from", F.col("base") + F.col("at"))

    def window(position: Column) -> Column:
        return ((position - position % length) / length).cast("long")

    cut = placed.withColumn(
        "sequence_id", F.explode(F.sequence(window(F.col("from")), window(F.col("from") + F.col("n") - 1)))
    )
    first = F.greatest(F.col("sequence_id") * length, F.col("from"))
    stop = F.least((F.col("sequence_id") + 1) * length, F.col("from") + F.col("n"))
    start = (first - F.col("from")).cast("int")
    return cut.select(
        "doc",
        "n",
        F.substring("ids", start * 4 + 1, ((stop - first) * 4).cast("int")).alias("ids"),
        start.cast("long").alias("start"),
        (stop - first).cast("long").alias("size"),
        "sequence_id",
        (first - F.col("sequence_id") * length).cast("long").alias("offset"),
    )
