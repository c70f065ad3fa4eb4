"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet folder of ``(h1, h2, n_docs)`` sorted by the hashes: how many documents of some
batches hold a line key. New batches enter as level-0 runs; as soon as a level holds ``FANOUT`` runs they
are merged into one run of the next level, so a key lies in few runs however many batches came in. A
batch loses its lines by a sort-merge anti join with the runs.

A key is the line without ASCII blanks at both ends and with ``A-Z`` folded. It is stored as 96 bits of
hash, which no two of 10^12 different lines are expected to share with one of a million frequent keys.
DataFrame functions only; a key held by a third of all lines is summed before the shuffle, and its
side of the join is split by adaptive execution.

Defined results: a null or empty text is one empty line; its key has no code points and is never
counted or dropped. A line repeated within a document counts that document once. Repeated rows are
documents of their own. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import BLANKS, bind, fold, keep_whole, stage
from parcelwise.session import shared_folder

FANOUT = 4
BATCHES = 4


def line_keys(text: Column) -> Column:
    """Key of every line, in order."""
    return F.transform(F.split(fold(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


class LineRuns:
    """The runs of one corpus, in the session's shared folder unless ``path`` names another."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_folder(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _sorted(self, runs: DataFrame, path: str) -> None:
        runs.sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(path)

    def add(self, keys: DataFrame) -> None:
        """Take in batches: ``keys`` has one row ``(batch, h1, h2)`` per document and different line key.

        All batches of one call are counted and written in a single job, one level-0 run each.
        """
        path = f"{self.path}/0-{uuid.uuid4().hex}"
        counted = keys.groupBy("batch", "h1", "h2").agg(F.count("*").alias("n_docs"))
        counted.sortWithinPartitions("batch", "h1", "h2").write.option("compression", "zstd").partitionBy("batch").parquet(path)
        written = self.spark.read.schema("h1 long, h2 int, n_docs long, batch int").parquet(path)
        arrived = sorted(r[0] for r in written.select("batch").distinct().collect())
        for batch in arrived:
            self.levels[0].append(f"{path}/batch={batch}")
            self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            path = f"{self.path}/{level + 1}-{uuid.uuid4().hex}"
            self._sorted(self._merged(self.levels[level]), path)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(path)
            level += 1

    def _merged(self, paths: list[str]) -> DataFrame:
        runs = self.spark.read.schema("h1 long, h2 int, n_docs long").parquet(*paths)
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def counts(self) -> DataFrame:
        """Documents per key over all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            none = self.spark.range(0)
            return none.select(F.col("id").alias("h1"), F.col("id").cast("int").alias("h2"), F.col("id").alias("n_docs"))
        if len(paths) == 1:
            return self.spark.read.schema("h1 long, h2 int, n_docs long").parquet(paths[0])
        return self._merged(paths)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2")


def strip_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``doc`` (the whole row), ``n_lines``, ``n_dropped`` and ``kept`` text of every document.

    Lines whose key lies in at least ``min_docs`` documents go from every document. The table enters the
    runs as ``batches`` batches of whole documents. Rows get their number and their line hashes in one
    written pass; after that only hashes travel until the kept line numbers meet the texts.
    """
    keyed = docs.select(
        F.monotonically_increasing_id().alias("r"), keep_whole(docs, "doc"), line_keys(F.col(text)).alias("k")
    )
    base = stage(
        keyed.select(
            "r",
            "doc",
            F.transform("k", lambda k: F.when(F.length(k) > 0, hashed(k))).alias("keys"),
            F.transform(F.array_remove(F.array_distinct("k"), ""), hashed).alias("own"),
        )
    )
    runs = LineRuns(docs.sparkSession)
    batch = F.pmod(F.col("r"), F.lit(batches)).cast("int").alias("batch")
    runs.add(base.select(batch, F.explode("own").alias("k")).select("batch", "k.h1", "k.h2"))

    lines = base.select("r", F.posexplode("keys").alias("line", "k")).where("k IS NOT NULL").select("r", "line", "k.h1", "k.h2")
    stay = lines.join(runs.frequent(min_docs).hint("merge"), ["h1", "h2"], "left_anti")
    stay = stay.groupBy("r").agg(F.collect_list("line").alias("stay"))
    # Lines without a key always stay and never took part in the join.
    blank = F.array_compact(F.transform("keys", lambda k, i: F.when(k.isNull(), i)))
    joined = base.select("r", "doc", "keys").join(stay, "r", "left").select(
        "doc",
        F.split(F.coalesce(F.col(f"doc.`{text}`"), F.lit("")), "\n").alias("lines"),
        F.sort_array(F.concat(blank, F.coalesce("stay", F.array().cast("array<int>")))).alias("stay"),
    )
    return joined.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        bind(F.col("lines"), lambda a: F.array_join(F.transform("stay", lambda i: F.get(a, i)), "\n")).alias("kept"),
    )
