"""Delimited roll exports: header row, no quoting convention, aliases for column names."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import columns as K

# Delimiters, in order of preference on a tie, and encodings tried in turn.
DELIMITERS = ("\t", "|", ",")
ENCODINGS = ("utf-8", "latin-1", "cp1252")
#: Spark does not read cp1252; such files are read as latin-1 and then translated (:func:`from_latin`).
SPARK_ENCODING = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1"}
#: The bytes for which cp1252 has other characters than latin-1, as either reads them; five of them it does not have.
_HIGH = bytes(range(0x80, 0xA0))
_AS_LATIN, _AS_CP1252 = _HIGH.decode("latin-1"), _HIGH.decode("cp1252", "replace")


def from_latin(text: Column) -> Column:
    """A text of a cp1252 file that was read as latin-1."""
    return F.translate(text, _AS_LATIN, _AS_CP1252)


def position() -> Column:
    """A sortable file position: path, split start, row within the split.

    Splits of one file sort by their start offset and row ids rise inside a split, so this is the
    order of the lines however the file was cut.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """``utf-8`` when every line of the file decodes cleanly.

    Else ``cp1252`` when the lines that do not hold a byte that only it gives a printed character, and ``latin-1``
    otherwise. One distributed pass over the whole file.
    """
    lines = spark.read.text(path).filter(~F.is_valid_utf8("value")).select(F.hex(F.col("value").cast("binary")).alias("h"))
    printed = F.col("h").rlike("^(?:[0-9A-F]{2})*[89][0-9A-F]")
    seen = lines.agg(F.count(F.lit(1)).alias("broken"), F.count_if(printed).alias("printed")).first()
    return ENCODINGS[0] if not seen["broken"] else ENCODINGS[2] if seen["printed"] else ENCODINGS[1]


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent delimiter of the header line; a tie prefers tab, then pipe."""
    header = spark.read.text(path).first()
    line = header["value"] if header else ""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """All-text scan with a ``pos`` column. Quote characters are ordinary text, short rows give nulls.

    Delimiter and encoding are found for each path by itself. Several paths must share one header; files
    with different headers go through :func:`read_aliased`.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    return functools.reduce(DataFrame.unionByName, [_read_one(spark, p, delimiter, encoding) for p in listed])


def _read_one(spark: SparkSession, path: str, delimiter: str | None, encoding: str | None) -> DataFrame:
    delimiter = delimiter or sniff_delimiter(spark, path)
    encoding = encoding or sniff_encoding(spark, path)
    rows = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", "")
        .option("escape", "")
        .option("mode", "PERMISSIVE")
        .option("encoding", SPARK_ENCODING.get(encoding, encoding))
        .option("enforceSchema", False)
        .csv(path)
        .withColumn("pos", position())
    )
    if encoding != "cp1252":
        return rows
    named = {c: c.translate(str.maketrans(_AS_LATIN, _AS_CP1252)) for c in rows.columns if c != "pos"}
    return rows.select(*[from_latin(F.col(f"`{c}`")).alias(name) for c, name in named.items()], "pos")


@dataclass(frozen=True)
class Field:
    """One target column: where it comes from and how it is read.

    ``sources`` are header names tried in order, ignoring case; the first one present in the file is
    used, even when its cells are empty. ``transform`` and ``validators`` are column functions.
    """

    name: str
    sources: tuple[str, ...]
    kind: str = "str"
    max_length: int | None = None
    required: bool = False
    default: object = None
    transform: Callable[[Column], Column] | None = None
    validators: tuple[Callable[[Column], Column], ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = field(default=())


def _coerce(raw: Column, f: Field) -> Column:
    text = F.when(raw != "", K.collapse_spaces(raw))
    value = {
        "int": lambda: K.to_int(text),
        "float": lambda: K.to_double(text),
        "decimal": lambda: K.to_decimal(text),
        "bool": lambda: K.to_bool(text),
        "str": lambda: text,
        "date": lambda: text,
    }[f.kind]()
    return value if f.default is None else F.coalesce(value, F.lit(f.default))


def resolve(columns: Sequence[str], sources: Sequence[str]) -> str | None:
    """The first alias present among ``columns``, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[s.lower()] for s in sources if s.lower() in by_lower), None)


def pick(df: DataFrame, sources: Sequence[str]) -> Column:
    """The aliased column as text, null when the file does not have it."""
    found = resolve(df.columns, sources)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def apply_table(df: DataFrame, table: Table) -> DataFrame:
    """Typed columns of ``table`` plus ``errors``, an array of what failed per row, and ``pos``."""
    values, errors = [], []
    for f in table.fields:
        raw = pick(df, f.sources)
        value = _coerce(raw, f)
        if f.transform:
            value = f.transform(value)
        values.append(value.alias(f.name))
        empty = value.isNull() | (value.cast("string") == "")

        def problem(message: str, raw: Column = raw, name: str = f.name) -> Column:
            return F.struct(F.lit(name).alias("field"), raw.alias("value"), F.lit(message).alias("message"))

        if f.required:
            errors.append(F.when(empty, problem("Required field is empty")))
        if f.max_length:
            errors.append(F.when(F.length(value.cast("string")) > f.max_length, problem("Value is too long")))
        for check in f.validators:
            failed = ~F.coalesce(check(value), F.lit(False))
            errors.append(F.when(failed & ~empty if f.required else failed, problem("Validation failed")))
    kind = "array<struct<field:string,value:string,message:string>>"
    found = F.filter(F.array(*errors).cast(kind), lambda e: e.isNotNull()) if errors else F.array().cast(kind)
    extra = ["pos"] if "pos" in df.columns else []
    return df.select(*values, found.alias("errors"), *extra)


def valid_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without errors; ``limit`` is the load's own row limit."""
    good = df.filter(F.size("errors") == 0).drop("errors")
    return good.limit(limit) if limit else good


def aliased(raw: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Text columns under their target names, and ``pos``."""
    return raw.select(*[pick(raw, names).alias(name) for name, names in sources.items()], "pos")


def read_aliased(spark: SparkSession, paths: Sequence[str], sources: Mapping[str, Sequence[str]], **options) -> DataFrame:
    """Several files of one table. Headers may differ: names are resolved file by file, then the rows joined."""
    out = None
    for path in paths:
        rows = aliased(read_delimited(spark, path, **options), sources)
        out = rows if out is None else out.unionByName(rows)
    return out
