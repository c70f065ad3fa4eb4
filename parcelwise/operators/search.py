"""Property search: literal substring filters, stable sort, pages, enriched rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.functions.geo import has_location
from parcelwise.operators.facts import land_totals, newest_loaded_year, primary_building
from parcelwise.operators.features import profile_a

# Rows per page and the export rules.
PAGE_ROWS = 200
EXPORT_MIN_TEXT = 3


@dataclass(frozen=True)
class SearchSpec:
    """Search fields (argument to column), sortable columns, default sort and tie order."""

    fields: Mapping[str, str]
    sortable: tuple[str, ...]
    default_sort: str
    ties: tuple[str, ...]
    export_text: tuple[str, ...]
    export_zip: str = "zip_code"


SEARCH_A = SearchSpec(
    fields={
        "address": "address", "street_name": "street_name", "zip_code": "zipcode",
        "last_name": "owner_name", "first_name": "owner_name",
    },
    sortable=(
        "zipcode", "street_number", "street_name", "owner_name", "value", "assessed_value",
        "building_area", "land_area",
    ),
    default_sort="zipcode",
    ties=("street_number", "street_name"),
    export_text=("first_name", "last_name", "address", "street_name"),
)
SEARCH_B = SearchSpec(
    fields={"owner_name": "owner_name", "address": "situs_address", "zip_code": "situs_zip"},
    sortable=("prop_id", "owner_name", "situs_city", "situs_zip"),
    default_sort="owner_name",
    ties=("prop_id",),
    export_text=("owner_name", "address"),
)


def contains_text(c: Column, wanted: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` are ordinary characters."""
    return F.contains(F.lower(c), F.lower(F.lit(wanted)))


def _given(spec: SearchSpec, params: Mapping[str, object]) -> dict[str, str]:
    given = {name: str(params.get(name) or "").strip() for name in spec.fields}
    return {name: text for name, text in given.items() if text}


def search_filter(df: DataFrame, spec: SearchSpec, params: Mapping[str, object]) -> DataFrame:
    """All given filters together; without any filter nothing is found."""
    given = _given(spec, params)
    if not given:
        return df.filter(F.lit(False))
    for name, text in given.items():
        df = df.filter(contains_text(F.col(spec.fields[name]), text))
    return df


def search_order(spec: SearchSpec, params: Mapping[str, object]) -> list[Column]:
    """Whitelisted sort column, then the tie columns; nulls last going up and first going down."""
    wanted = str(params.get("sort") or "")
    primary = F.col(wanted if wanted in spec.sortable else spec.default_sort)
    first = primary.desc_nulls_first() if params.get("dir") == "desc" else primary.asc_nulls_last()
    return [first, *[F.col(t).asc_nulls_last() for t in spec.ties]]


def search_page(df: DataFrame, order: Sequence[Column], page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``page`` (from 1) of the ordered rows."""
    return df.orderBy(*order).offset((max(1, page) - 1) * rows).limit(rows)


def page_after(df: DataFrame, order: Sequence[str], last: Mapping[str, object] | None = None, rows: int = PAGE_ROWS) -> DataFrame:
    """The page that follows the row ``last``, by ascending columns ``order`` (nulls last) that end in a key.

    ``last`` holds those columns of the last row of the page before; None asks for the first page. A deep
    page costs no more than the first: earlier rows are filtered out and never sorted.
    """
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name in order:
            value = F.lit(last[name])
            higher = (F.col(name) > value) | F.col(name).isNull() if last[name] is not None else F.lit(False)
            beyond = beyond | (equal & F.coalesce(higher, F.lit(False)))
            equal = equal & F.col(name).eqNullSafe(value)
        df = df.filter(beyond)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(rows)


def page_or_last(found: DataFrame, order: Sequence[Column], page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """As :func:`search_page`, with a page beyond the end showing the last one (counts the matches)."""
    last = max(1, -(-found.count() // rows))
    return search_page(found, order, min(max(1, page), last), rows)


def may_export(spec: SearchSpec, params: Mapping[str, object]) -> bool:
    """Whether the filters are narrow enough for an export: a 5-digit ZIP, or three text characters."""
    zip_code = str(params.get(spec.export_zip) or "").strip()
    if len(zip_code) == 5 and zip_code.isdigit():
        return True
    return any(len("".join(str(params.get(n) or "").split())) >= EXPORT_MIN_TEXT for n in spec.export_text)


def require_export_filter(spec: SearchSpec, params: Mapping[str, object]) -> None:
    if not may_export(spec, params):
        raise ValueError("an export needs a 5-digit ZIP code or a text filter of at least three characters")


def search_rows_a(found: DataFrame, building: DataFrame, feature: DataFrame) -> DataFrame:
    """County A result rows with the first building and a short feature list."""
    first = primary_building(building).select("account_number", "bedrooms", "bathrooms", "quality_code")
    listed = profile_a(feature).select("account_number", F.col("features_5").alias("features"))
    assessed = K.first_nonzero(F.col("assessed_value"), F.col("value"))
    return (
        found.join(first, "account_number", "left")
        .join(listed, "account_number", "left")
        .select(
            "account_number",
            "owner_name",
            F.col("street_number").alias("address"),
            "street_name",
            F.col("zipcode").alias("zip_code"),
            assessed.alias("assessed_value"),
            "building_area",
            "land_area",
            K.value_per_area(assessed, F.col("building_area")).alias("ppsf"),
            "bedrooms",
            "bathrooms",
            "quality_code",
            "features",
        )
    )


def search_accounts_b(account: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """County B searches its newest loaded year only."""
    return search_filter(newest_loaded_year(account), SEARCH_B, params)


def search_rows_b(found: DataFrame, land: DataFrame) -> DataFrame:
    """County B result rows with land totals; ``has_location`` tells whether comps can be offered."""
    totals = land_totals(land).withColumnsRenamed({"land_value": "total_land", "acreage": "total_acreage"})
    return found.join(totals, ["prop_id", "tax_year"], "left").select(
        "prop_id",
        "owner_name",
        F.col("situs_address").alias("address"),
        F.col("situs_city").alias("city"),
        F.col("situs_zip").alias("zip_code"),
        F.col("total_land").alias("land_value"),
        F.col("total_acreage").alias("acreage"),
        has_location(F.col("latitude"), F.col("longitude")).alias("has_location"),
    )


def building_facets(
    building: DataFrame,
    *,
    is_active: bool | None = None,
    imported_from: str | None = None,
    building_type: str | None = None,
    building_style: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """List filters of the building table: activity, import date, type, style, account text."""
    df = building
    if is_active is not None:
        df = df.filter(F.col("is_active") == is_active)
    if imported_from is not None:
        df = df.filter(F.col("import_date") >= F.lit(imported_from).cast("timestamp"))
    if building_type is not None:
        df = df.filter(F.col("building_type") == building_type)
    if building_style is not None:
        df = df.filter(F.col("building_style") == building_style)
    if text:
        df = df.filter(contains_text(F.col("account_number"), text))
    return df


def property_facets(
    prop: DataFrame, *, city: str | None = None, zipcode: str | None = None, text: str | None = None
) -> DataFrame:
    """List filters of the property table: city, ZIP, and a text met by account, address or owner."""
    df = prop
    if city is not None:
        df = df.filter(F.col("city") == city)
    if zipcode is not None:
        df = df.filter(F.col("zipcode") == zipcode)
    if text:
        found = [contains_text(F.col(c), text) for c in ("account_number", "address", "owner_name")]
        df = df.filter(found[0] | found[1] | found[2])
    return df
