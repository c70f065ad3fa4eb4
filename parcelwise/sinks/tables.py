"""Table writes: replace a table, replace a slice, append, merge.

Tables are Parquet directories, year-scoped ones partitioned by ``county`` and ``tax_year``. A write
that must not leave a half-written table behind goes to a fresh directory first and is then moved
into place, so readers see the old rows or the new ones and a lost executor costs only a retry.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators.keyed import first_per_key, merge_upsert
from parcelwise.session import cut_lineage


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the whole table. The old rows stay until the new ones are completely written.

    Moving a folder into place is meant for file systems that rename folders in one step (HDFS, local
    disks). Between the two moves a reader may find no table for a moment; year-scoped tables, which
    are read while they are loaded, go through :func:`replace_slices`.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}__new_{uuid.uuid4().hex}"
    retired = f"{path.rstrip('/')}__old_{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(staging)
    new, fs = _hadoop(spark, staging)
    target, _ = _hadoop(spark, path)
    old, _ = _hadoop(spark, retired)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not retire {path}")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"could not move the new table to {path}")
    fs.delete(old, True)


def replace_slices(df: DataFrame, path: str, partition_by: Sequence[str] = ("county", "tax_year")) -> None:
    """Replace only the partitions that occur in ``df``; other years and counties are untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def insert_ignore(
    df: DataFrame, path: str, keys: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> None:
    """Append rows of new keys only; of repeated incoming keys the first one is kept.

    Of the table only the keys are read, and only new files are written. The table keeps its
    partitioning when ``partition_by`` names it.
    """
    spark = df.sparkSession
    fresh = first_per_key(df, keys, order_by)
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if partition_by and set(partition_by) <= set(keys):
            # A stored key can only lie in the partition of an equal incoming one.
            stored = stored.join(F.broadcast(fresh.select(*partition_by).distinct()), list(partition_by), "left_semi")
        fresh = fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Insert new keys and replace existing ones.

    Of a partitioned table only the partitions that occur in ``df`` are read and rewritten, so the
    partition columns have to belong to the key. An unpartitioned table is rewritten whole.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError(f"partition columns {list(partition_by)} have to be part of the key {list(keys)}")
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.partitionBy(*partition_by).parquet(path)
    elif not partition_by:
        replace_table(merge_upsert(spark.read.parquet(path), df, keys), path)
    else:
        touched = df.select(*partition_by).distinct()
        stored = spark.read.parquet(path).join(touched, list(partition_by), "left_semi")
        # Written aside first: a partition cannot be overwritten while it is read.
        replace_slices(cut_lineage(merge_upsert(stored, df, keys)), path, partition_by)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> tuple[DataFrame, str]:
    """``df`` with the hash of its key as a partition column, and that column's name.

    The number of buckets is part of the name, so that a table cannot be written with two numbers.
    """
    name = f"_bucket_{buckets}"
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), name


def _same_buckets(spark: SparkSession, path: str, name: str) -> None:
    if exists(spark, path):
        found = [c for c in spark.read.parquet(path).columns if c.startswith("_bucket_")]
        if found != [name]:
            raise ValueError(f"{path} has the buckets {found}, not {name}")


def upsert_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """:func:`upsert` into a table without natural partitions: only buckets with an incoming key are read and rewritten.

    A change of few keys touches few of many buckets; choose so many that a bucket is about a file.
    """
    rows, name = bucketed(df, keys, buckets)
    _same_buckets(df.sparkSession, path, name)
    # One task per bucket, so that a bucket is one file.
    upsert(rows.repartition(buckets, name), path, [*keys, name], [name])


def insert_ignore_buckets(df: DataFrame, path: str, keys: Sequence[str], order_by: Sequence[str], buckets: int) -> None:
    """:func:`insert_ignore` into such a table: of the stored keys only those of touched buckets are read."""
    rows, name = bucketed(df, keys, buckets)
    _same_buckets(df.sparkSession, path, name)
    insert_ignore(rows, path, [*keys, name], order_by, [name])


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed table without its bucket column."""
    stored = spark.read.parquet(path)
    return stored.drop(*[c for c in stored.columns if c.startswith("_bucket_")])


def store(df: DataFrame, path: str, *, dry_run: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write unless it is a dry run; returns the rows either way, so their counts can be reported."""
    if not dry_run:
        replace_table(df, path, partition_by)
    return df
