"""One scan over many delimited files, each with an encoding, a delimiter and a header of its own.

A first job groups all lines by file: one pass finds every file's header line, its delimiter, and whether its bytes are
UTF-8. That table has one row per file and is written once. The scan then reads all files as plain lines, meets each
line with the settings of its file, and decodes and cuts it there. So the number of jobs and the size of the plan do not grow
with the number of files, and a file of any size is cut into as many tasks as its size asks for.

Rules are those of :mod:`parcelwise.sources.delimited`: quotes are ordinary text, a tie of delimiters prefers tab, then pipe;
a file whose lines do not all decode as UTF-8 is ``cp1252`` if one of these lines holds a byte that only it
prints, else ``latin-1``; of several names for a column the first one in the header is taken, ignoring case.

Defined results: blank lines are no rows; short rows give nulls, surplus cells are left out, empty cells are null. A
line equal to its file's header is no row, wherever it stands (exports put together repeat it). A byte order mark before a
header is dropped. A file with a header only, or without a line, has no rows; a column that no header names is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import cut_lineage
from parcelwise.sources.delimited import DELIMITERS, ENCODINGS, SPARK_ENCODING, from_latin, position

MARK = "﻿"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # A blank line has nothing but a possible carriage return, which the text source has taken off already.
    return spark.read.text(list(paths)).select("value", position().alias("pos")).filter(F.col("value") != "")


def _decoded(value: Column, encoding: Column) -> Column:
    latin = F.decode(value.cast("binary"), SPARK_ENCODING["latin-1"])
    return F.when(encoding == "latin-1", latin).when(encoding == "cp1252", from_latin(latin)).otherwise(value)


def _cells(text: Column, delimiter: Column) -> Column:
    out = F.array(text)
    for d in DELIMITERS:
        out = F.when(delimiter == d, F.split(text, "[" + d + "]", -1)).otherwise(out)
    return out


def file_settings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, header, encoding, delimiter, names)`` of every file that has a line; ``header`` as its bytes are."""
    lines = _lines(spark, paths)
    broken = ~F.is_valid_utf8("value")
    # Of the lines that are not UTF-8, those with a byte that latin-1 has no printed character for.
    printed = broken & F.hex(F.col("value").cast("binary")).rlike("^(?:[0-9A-F]{2})*[89][0-9A-F]")
    seen = lines.groupBy(F.col("pos.path").alias("path")).agg(
        F.min_by("value", F.struct("pos.split", "pos.row")).alias("header"),
        F.count_if(broken).alias("broken"),
        F.count_if(printed).alias("printed"),
    )
    encoding = F.when(F.col("broken") == 0, ENCODINGS[0]).when(F.col("printed") > 0, ENCODINGS[2]).otherwise(ENCODINGS[1])
    named = seen.select("path", "header", encoding.alias("encoding"))
    text = F.regexp_replace(_decoded(F.col("header"), F.col("encoding")), f"^{MARK}", "")
    counts = {d: F.char_length(text) - F.char_length(F.translate(text, d, "")) for d in DELIMITERS}
    most = F.greatest(*counts.values())
    delimiter = F.coalesce(*[F.when(counts[d] == most, F.lit(d)) for d in DELIMITERS])
    with_delimiter = named.withColumn("delimiter", delimiter)
    return with_delimiter.withColumn("names", F.transform(_cells(text, F.col("delimiter")), F.lower))


def scan_aliased(spark: SparkSession, paths: Sequence[str], sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """All rows of all files as text under the names of ``sources``, with ``pos``.

    ``paths`` may be folders or patterns; settings are found for every file in them.
    """
    place = lambda alias: F.nullif(F.array_position("names", F.lit(alias.lower())), F.lit(0))
    found = [F.coalesce(*[place(a) for a in aliases]).cast("int").alias(f"at_{n}") for n, aliases in enumerate(sources.values())]
    settings = cut_lineage(file_settings(spark, paths).select("path", "header", "encoding", "delimiter", *found))
    lines = _lines(spark, paths).withColumn("path", F.col("pos.path"))
    met = lines.join(settings, "path").filter(F.col("value") != F.col("header"))
    cut = met.withColumn("cells", _cells(_decoded(F.col("value"), F.col("encoding")), F.col("delimiter")))
    columns = [F.nullif(F.get("cells", F.col(f"at_{n}") - 1), F.lit("")).alias(name) for n, name in enumerate(sources)]
    return cut.select(*columns, "pos")
