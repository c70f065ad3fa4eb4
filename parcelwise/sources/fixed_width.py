"""Fixed-width roll exports: a layout is data, a scan is substrings and casts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.sources.delimited import position


@dataclass(frozen=True)
class Slice:
    """Characters ``start`` (from 0) up to but not including ``end``."""

    name: str
    start: int
    end: int
    kind: str = "text"


READERS: dict[str, Callable[[Column], Column]] = {
    "text": K.collapse_spaces,
    "money2": lambda c: K.implied_decimal(c, 2),
    "quantity4": lambda c: K.implied_decimal(c, 4, "decimal(12,4)"),
    "decimal": lambda c: K.literal_decimal(c),
    "quantity": lambda c: K.literal_decimal(c, "decimal(12,2)"),
    "money": lambda c: K.literal_decimal(c),
    "int_or_null": K.int_or_null,
    "int_or_zero": K.int_or_zero,
}

# Record layouts.
LAND = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 12, 16, "int_or_null"),
    Slice("land_seq", 16, 28, "int_or_zero"),
    Slice("land_use_code", 28, 32),
    Slice("land_use_description", 38, 63),
    Slice("land_value", 140, 154, "money2"),
    Slice("acreage", 178, 184, "quantity4"),
)
IMPROVEMENT = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 12, 16, "int_or_null"),
    Slice("imp_id", 16, 28),
    Slice("improvement_type", 28, 31),
    Slice("improvement_description", 38, 49),
)
IMPROVEMENT_DETAIL = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 12, 16, "int_or_null"),
    Slice("imp_id", 16, 28),
    Slice("detail_seq", 28, 40, "int_or_zero"),
    Slice("detail_description", 50, 75),
    Slice("year_built", 85, 89, "int_or_null"),
    Slice("detail_quantity", 93, 108, "quantity"),
    Slice("detail_value", 108, 122, "decimal"),
    Slice("detail_unit", 122, 622),
)
DETAIL_ATTRIBUTE = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 12, 16, "int_or_null"),
    Slice("imp_id", 16, 28),
    Slice("detail_seq", 28, 40, "int_or_zero"),
    Slice("attribute_type", 52, 77),
    Slice("attribute_value", 77, 87),
)
ENTITY = (Slice("entity_id", 0, 12), Slice("entity_code", 12, 17))
ENTITY_INFO = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 12, 17, "int_or_null"),
    Slice("entity_id", 41, 53),
    Slice("tax_unit_code", 53, 63),
    Slice("tax_unit_name", 63, 113),
    Slice("assessed_value", 148, 163, "money"),
    Slice("taxable_value", 163, 178, "money"),
    Slice("hs_amt", 298, 313, "money"),
    Slice("ov65_amt", 313, 328, "money"),
    Slice("dp_amt", 328, 343, "money"),
    Slice("market_value", 388, 403, "money"),
    Slice("appraised_value", 403, 418, "money"),
)
ACCOUNT_INFO = (
    Slice("prop_id", 0, 12),
    Slice("tax_year", 17, 22, "int_or_null"),
    Slice("owner_name", 608, 678),
    Slice("mailing_address", 753, 873),
    Slice("mailing_city", 873, 923),
    Slice("mailing_state", 923, 925),
    Slice("mailing_zip5", 978, 983),
    Slice("mailing_zip4", 983, 987),
)

# File names of the export.
FILES = {
    "account": "APPRAISAL_INFO.TXT",
    "land": "APPRAISAL_LAND_DETAIL.TXT",
    "improvement": "APPRAISAL_IMPROVEMENT_INFO.TXT",
    "detail": "APPRAISAL_IMPROVEMENT_DETAIL.TXT",
    "attribute": "APPRAISAL_IMPROVEMENT_DETAIL_ATTR.TXT",
    "entity": "APPRAISAL_ENTITY.TXT",
    "entity_info": "APPRAISAL_ENTITY_INFO.TXT",
}


def slice_lines(lines: DataFrame, layout: Sequence[Slice], line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Cut the text column ``line`` into the layout's typed columns; blank lines are dropped."""
    # A carriage return at the end of the last field goes with its trailing white space.
    text = F.col(line)
    cut = [
        READERS[s.kind](F.substring(text, s.start + 1, s.end - s.start)).alias(s.name) for s in layout
    ]
    return lines.filter(F.trim(F.col(line)) != "").select(*cut, *keep)


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Slice]) -> DataFrame:
    """Scan one export file: the layout's columns, ``pos`` (line order) and ``source_file``."""
    lines = spark.read.text(path).select(
        "value", position().alias("pos"), F.col("_metadata.file_name").alias("source_file")
    )
    return slice_lines(lines, layout, keep=("pos", "source_file"))


def for_year(df: DataFrame, tax_year: int) -> DataFrame:
    """Rows of the requested year; rows that name no year are taken to be of it."""
    return df.filter(F.col("tax_year").isNull() | (F.col("tax_year") == tax_year)).withColumn(
        "tax_year", F.lit(tax_year)
    )


def other_year_rows(df: DataFrame, tax_year: int) -> DataFrame:
    """One row: how many rows :func:`for_year` leaves out."""
    return df.agg(F.count_if(F.col("tax_year") != tax_year).alias("other_year_rows"))
