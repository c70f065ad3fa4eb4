"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import cut_lineage as stage  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_whole(df: DataFrame, name: str) -> Column:
    """All columns of ``df`` in one struct, so that no column of an operator can clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """``A-Z`` to lower case and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def plain_words(text: Column) -> Column:
    """Words of letters, digits and everything beyond ASCII, ``A-Z`` folded; null has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def count_char(text: Column, char: str) -> Column:
    """How often one ASCII character occurs."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


#: Rows of a few numbers or short words that may be sent to every executor: some tens of megabytes.
SMALL = 2_000_000


def small(df: DataFrame, rows: int = SMALL) -> bool:
    """Whether a frame has at most ``rows`` rows, and so may be sent to every executor."""
    return df.limit(rows + 1).count() <= rows


def near(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, marked for broadcast if it is counted and small; joins beyond that run as shuffles."""
    return F.broadcast(df) if small(df, rows) else df
