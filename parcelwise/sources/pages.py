"""Figures published on web pages, read from a table of ``(url, html)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K

# Patterns of a tax year, a jurisdiction cell, an archive link and its wording.
YEAR = r"((?:19|20)[0-9]{2})"
JURISDICTION = r"^(\S+)\s*–\s*(.+)$"
ARCHIVE = r"(?i)\.zip"
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
TABLE = r"(?is)<table\b[^>]*>(.*?)</table>"
TABLE_ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|\z)"
TABLE_CELL = r"(?is)<t[hd]\b[^>]*>(.*?)(?=<t[hd]\b|</t[hd]>|</tr>|\z)"

# Character references that occur in the pages.
REFERENCES = {
    "&nbsp;": " ", "&#160;": " ", "&ndash;": "–", "&#8211;": "–", "&quot;": '"', "&#39;": "'",
    "&lt;": "<", "&gt;": ">", "&amp;": "&",
}


def plain_text(html: Column) -> Column:
    """Markup removed, character references resolved, outer space trimmed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, value in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return K.strip(text)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of each page: ``url, link_no, href, link_text``."""
    return (
        pages.select(
            "url",
            F.posexplode(
                F.arrays_zip(
                    F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"),
                    F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("body"),
                )
            ).alias("link_no", "link"),
        )
        .select("url", "link_no", F.col("link.href").alias("href"), plain_text(F.col("link.body")).alias("link_text"))
    )


def year_in(text: Column) -> Column:
    """First tax year mentioned in the text."""
    return F.regexp_extract(text, YEAR, 1).try_cast("int")


def archive_links(pages: DataFrame, wording: str | None = None) -> DataFrame:
    """Links to archives with the year named by their text or, failing that, their address."""
    links = page_links(pages).filter(F.col("href").rlike(ARCHIVE))
    if wording:
        links = links.filter(F.lower("link_text").contains(wording.lower()))
    return links.withColumn("year", F.coalesce(year_in(F.col("link_text")), year_in(F.col("href"))))


def newest_archive(pages: DataFrame, wording: str | None = None) -> DataFrame:
    """Per page the archive of the highest year; without any year the last one listed."""
    order = F.struct(F.coalesce("year", F.lit(0)), "link_no")
    return (
        archive_links(pages, wording)
        .groupBy("url")
        .agg(F.max_by(F.struct("href", "year"), order).alias("best"))
        .select("url", "best.href", "best.year")
    )


def adopted_rates(pages: DataFrame, year: int | None = None) -> DataFrame:
    """Rate rows of the first table of each page: ``url, tax_year, row_no, code, name, rate, outcome``.

    The table's first row is a heading that names the year, the second the column titles; a data row
    has a ``code – name`` cell and the total rate per 100 in its fourth cell. Rows of another shape
    keep the outcome ``skipped``.
    """
    table = F.regexp_extract("html", TABLE, 1)
    rows = pages.select("url", F.regexp_extract_all(table, F.lit(TABLE_ROW), F.lit(1)).alias("rows")).filter(
        F.size("rows") >= 3
    )
    heading = year_in(plain_text(F.element_at("rows", 1)))
    listed = rows.select(
        "url",
        (F.lit(year) if year else heading).cast("int").alias("tax_year"),
        F.posexplode(F.slice("rows", 3, F.size("rows"))).alias("row_no", "row"),
    )
    cells = F.transform(F.regexp_extract_all("row", F.lit(TABLE_CELL), F.lit(1)), plain_text)
    staged = listed.select("url", "tax_year", "row_no", cells.alias("cells"))
    # A missing cell is null.
    first, fourth = F.get("cells", F.lit(0)), F.get("cells", F.lit(3))
    rate = K.to_decimal(F.regexp_replace(fourth, r"^\$+", ""), "decimal(18,8)")
    good = first.rlike(JURISDICTION) & rate.isNotNull() & (F.size("cells") >= 4)
    return staged.select(
        "url",
        "tax_year",
        "row_no",
        F.when(good, F.trim(F.regexp_extract(first, JURISDICTION, 1))).alias("tax_unit_code"),
        F.when(good, F.trim(F.regexp_extract(first, JURISDICTION, 2))).alias("tax_unit_name"),
        F.when(good, K.rate_fraction(rate)).alias("adopted_rate"),
        F.when(good, "loaded").otherwise("skipped").alias("outcome"),
    )
