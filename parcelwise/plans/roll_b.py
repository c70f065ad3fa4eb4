"""County B table loads: fixed-width roll exports to account, land, improvement and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.jurisdiction import assessed_rollup, entity_rows
from parcelwise.operators.keyed import first_per_key, first_value
from parcelwise.operators.loading import update_from
from parcelwise.schemas import (
    ACCOUNT, ASSESSMENT_HISTORY, CHARACTERISTIC, COUNTY_B, FEATURE_LONG, IMPROVEMENT, IMPROVEMENT_DETAIL, LAND, conform,
)
from parcelwise.session import cut_lineage
from parcelwise.sources import files
from parcelwise.sources import fixed_width as W

# Attribute types that become columns; the plumbing text becomes two.
WIDE_ATTRIBUTES = {
    "Number of Bedrooms": "bedrooms",
    "Number of Rooms": "room_count",
    "Exterior Wall": "exterior_wall",
    "Foundation": "foundation",
    "Roof Covering": "roof_covering",
    "Heating/Cooling": "heating_cooling",
    "Interior Finish": "interior_finish",
    "Construction Style": "construction_style",
    "Flooring": "flooring",
}
COUNT_COLUMNS = ("bedrooms", "room_count")
PLUMBING = "Plumbing"
IMPROVEMENT_KEY = ["prop_id", "imp_id", "tax_year"]
MIN_SANE_SHARE = 0.90


def account_table(info: DataFrame) -> DataFrame:
    """Account rows of one year: owner and mailing address."""
    return conform(
        info.withColumn("mailing_zip", K.zip_plus_four(F.col("mailing_zip5"), F.col("mailing_zip4"))), ACCOUNT
    )


def land_table(rows: DataFrame) -> DataFrame:
    return conform(rows, LAND)


def year_built_rollup(detail: DataFrame) -> DataFrame:
    """Per improvement the construction year of its most valuable dated detail row; a tie goes to the
    earlier row, a missing value counts as zero.

    Keyed by property and improvement: improvement ids alone are not unique.
    """
    value = F.coalesce("detail_value", F.lit(0).cast(K.MONEY))
    return (
        detail.filter(F.col("year_built").isNotNull())
        .groupBy(*IMPROVEMENT_KEY)
        .agg(F.min_by("year_built", F.struct((-value).alias("v"), "pos")).alias("year_built"))
    )


def improvement_table(rows: DataFrame, detail: DataFrame) -> DataFrame:
    """Improvements with the construction year rolled up from their details."""
    return conform(rows.join(year_built_rollup(detail), IMPROVEMENT_KEY, "left"), IMPROVEMENT)


def detail_table(rows: DataFrame) -> DataFrame:
    return conform(rows, IMPROVEMENT_DETAIL)


def characteristics(attributes: DataFrame) -> DataFrame:
    """Attribute rows to one wide row per improvement; per column the first usable value in file order.

    An improvement whose plumbing text is not understood and that has no other mapped attribute does
    not appear. Bathrooms are the full baths only.
    """
    kind, value, pos = F.col("attribute_type"), F.col("attribute_value"), F.col("pos")
    is_plumbing = kind == PLUMBING
    # Reading the plumbing text costs four patterns: once per row, and only where it is plumbing.
    staged = attributes.withColumns(
        {
            "_full": F.when(is_plumbing, K.full_baths(value)),
            "_half": F.when(is_plumbing, K.half_baths(value)),
        }
    )
    baths, halves = F.col("_full"), F.col("_half")
    picks = []
    for name, column in WIDE_ATTRIBUTES.items():
        usable = K.to_strict_int(value) if column in COUNT_COLUMNS else F.when(value != "", value)
        picks.append(first_value(usable, pos, (kind == name) & usable.isNotNull()).alias(column))
    plumbing = baths.isNotNull()
    picks.append(first_value(baths, pos, plumbing).cast("decimal(4,2)").alias("bathrooms"))
    picks.append(first_value(halves, pos, plumbing).alias("half_baths"))
    # Whether anything usable or mapped was met is counted in the same pass: as a filter it would be
    # pushed below the patterns and have them run twice.
    known = F.count_if(kind.isin(*WIDE_ATTRIBUTES) | plumbing).alias("_known")
    wide = (
        staged.groupBy(*IMPROVEMENT_KEY)
        .agg(*picks, F.min("source_file").alias("source_file"), known)
        .filter("_known > 0")
    )
    text = [c for c in WIDE_ATTRIBUTES.values() if c not in COUNT_COLUMNS]
    return conform(wide.withColumns({c: F.coalesce(c, F.lit("")) for c in text}), CHARACTERISTIC)


def long_features(attributes: DataFrame) -> DataFrame:
    """Attribute rows that are neither mapped nor plumbing stay long, one row per feature."""
    kind = F.col("attribute_type")
    rest = attributes.filter(~kind.isin(*WIDE_ATTRIBUTES, PLUMBING))
    return conform(
        rest.withColumnsRenamed({"attribute_type": "feature_type", "attribute_value": "feature_value"}), FEATURE_LONG
    )


def unreadable_plumbing(attributes: DataFrame) -> DataFrame:
    """One row: how many plumbing texts were not understood."""
    lost = (F.col("attribute_type") == PLUMBING) & K.full_baths(F.col("attribute_value")).isNull()
    return attributes.agg(F.count_if(lost).alias("unreadable_plumbing"))


def update_assessed(account: DataFrame, entities: DataFrame) -> DataFrame:
    """Accounts take the first known assessed value of their entity rows."""
    rolled = assessed_rollup(entities).filter(F.col("assessed_value").isNotNull())
    return update_from(account, rolled, ["prop_id"], ["assessed_value"]).drop("matched")


PARCEL_COLUMNS = (
    "situs_address", "situs_state", "state_class", "latitude", "longitude", "living_area", "year_built", "class_code",
)


def update_parcels(account: DataFrame, staged: DataFrame) -> DataFrame:
    """Accounts of one year take situs, location and building attributes of their parcel; adds ``matched``."""
    return update_from(account, staged, ["prop_id"], PARCEL_COLUMNS)


# ------------------------------------------------------------------------------- history


def cap_flag(assessed: Column, appraised: Column) -> Column:
    """``Y`` when the appraised value lies above the assessed one."""
    return F.when(appraised > assessed, F.lit("Y")).otherwise(F.lit(""))


def history_rollup(entities: DataFrame, tax_year: int, accounts: DataFrame | None = None) -> DataFrame:
    """One history row per property out of its first entity row."""
    rows = entities.filter(F.col("prop_id") != "")
    if accounts is not None:
        rows = rows.join(accounts.select("prop_id").distinct(), "prop_id", "left_semi")
    first = first_per_key(rows, ["prop_id"], ["pos"])
    return conform(
        first.select(
            F.col("prop_id").alias("account_number"),
            F.lit(tax_year).alias("tax_year"),
            F.lit(COUNTY_B).alias("county"),
            "assessed_value",
            "appraised_value",
            "market_value",
            cap_flag(F.col("assessed_value"), F.col("appraised_value")).alias("cap_account"),
        ),
        ASSESSMENT_HISTORY,
    )


def sane_order(history: DataFrame) -> DataFrame:
    """One row: rows with a market value, and how many keep market >= appraised >= assessed."""
    market, appraised, assessed = (F.col(c) for c in ("market_value", "appraised_value", "assessed_value"))
    ordered = F.coalesce((market >= appraised) & (appraised >= assessed), F.lit(True))
    # A comparison with a missing value is null unless the other one already fails.
    ordered = F.when(appraised.isNull() | assessed.isNull(), F.lit(True)).otherwise(ordered)
    return history.filter(market.isNotNull()).agg(
        F.count(F.lit(1)).alias("checkable"), F.count_if(ordered).alias("sane")
    )


class ImplausibleYear(RuntimeError):
    """A year's values are out of order too often; its layout is not trusted and nothing is written."""


def require_sane_order(history: DataFrame, min_share: float = MIN_SANE_SHARE) -> DataFrame:
    """Return ``history`` unchanged, or raise when too few rows are plausibly ordered."""
    row = sane_order(history).first()
    if not row["checkable"]:
        raise ImplausibleYear("no row carries a market value")
    share = row["sane"] / row["checkable"]
    if share < min_share:
        raise ImplausibleYear(f"only {share:.1%} of the rows keep market >= appraised >= assessed")
    return history


def history_range(
    spark: SparkSession, root: str, start_year: int, end_year: int, accounts: DataFrame | None = None
) -> DataFrame:
    """All years under ``root/<year>/``, each passing the plausibility gate before any is returned."""
    out = None
    for year, directory in files.year_directories(root, start_year, end_year).items():
        one = history_of(spark, directory, year, accounts)
        files.require_files([] if one is not None else [W.FILES["entity_info"]], directory)
        # Written once: the gate and whoever stores the year read the same rows.
        one = require_sane_order(cut_lineage(one))
        out = one if out is None else out.unionByName(one)
    return out


def history_of(spark: SparkSession, directory: str, year: int, accounts: DataFrame | None = None) -> DataFrame | None:
    """The history rows of one export directory, None when it has no entity file."""
    path = files.newest_copy(files.list_files(spark, directory, ".TXT"), W.FILES["entity_info"])
    if not path:
        return None
    rows = W.for_year(W.read_fixed_width(spark, path, W.ENTITY_INFO), year)
    return history_rollup(rows, year, accounts)


# ------------------------------------------------------------------------------- whole roll


def load_roll(spark: SparkSession, root: str, tax_year: int) -> dict[str, DataFrame]:
    """Tables of one export directory for one tax year; files that are absent give no table."""
    paths = files.list_files(spark, root, ".TXT")

    def rows(name: str, layout) -> DataFrame | None:
        path = files.newest_copy(paths, W.FILES[name])
        return W.for_year(W.read_fixed_width(spark, path, layout), tax_year) if path else None

    out: dict[str, DataFrame] = {}
    info, land = rows("account", W.ACCOUNT_INFO), rows("land", W.LAND)
    improvement, detail = rows("improvement", W.IMPROVEMENT), rows("detail", W.IMPROVEMENT_DETAIL)
    attributes, entities = rows("attribute", W.DETAIL_ATTRIBUTE), rows("entity_info", W.ENTITY_INFO)
    if info is not None:
        account = account_table(info)
        out["account"] = account if entities is None else update_assessed(account, entities)
    if land is not None:
        out["land"] = land_table(land)
    if improvement is not None:
        out["improvement"] = (
            conform(improvement, IMPROVEMENT) if detail is None else improvement_table(improvement, detail)
        )
    if detail is not None:
        out["improvement_detail"] = detail_table(detail)
    if attributes is not None:
        out["building_characteristic"] = characteristics(attributes)
        out["extra_feature"] = long_features(attributes)
    if entities is not None:
        source = W.FILES["entity_info"]
        out["jurisdiction"] = entity_rows(entities, tax_year, COUNTY_B, source)
    return out
