"""Canonical property facts: one row per property with everything the analytics read.

Each county maps its own tables into the same columns, so comps, equity, reports and search are
written once. Every one-to-many side is reduced to one row per property before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.functions.geo import has_location
from parcelwise.operators.features import profile_a, profile_b
from parcelwise.operators.keyed import by_rows, first_per_key, newest_year
from parcelwise.operators.scoring import score_facts

#: Facts shown in reports.
DISPLAY_COLUMNS = (
    "address", "locality", "owner_name", "zip_code", "assessed_value", "living_area", "land_area",
    "bedrooms", "bathrooms", "year_built", "quality_code", "condition_code", "features_5",
    "features_10", "value_per_sqft", "has_location", "tax_year",
)


def _no_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("None")).alias(c)


def _finish(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "value_per_sqft": K.value_per_area(F.col("assessed_value"), F.col("living_area")),
            "has_location": has_location(F.col("latitude"), F.col("longitude")),
            "feature_codes": F.coalesce(F.col("feature_codes"), F.array().cast("array<string>")),
            "window_areas": F.coalesce(F.col("window_areas"), F.array().cast("array<double>")),
        }
    )
    return df.withColumn("facts", score_facts())


def primary_building(building: DataFrame) -> DataFrame:
    """The lowest-numbered active building of each account."""
    return first_per_key(building.filter("is_active"), ["account_number"], [F.col("building_number").asc_nulls_last()])


def building_areas(building: DataFrame) -> DataFrame:
    """Sorted distinct living areas of the active buildings of each account."""
    return (
        building.filter("is_active")
        .groupBy("account_number")
        .agg(F.array_sort(F.collect_set(F.col("heat_area").cast("double"))).alias("window_areas"))
    )


def facts_a(prop: DataFrame, building: DataFrame, feature: DataFrame) -> DataFrame:
    """County A: property, its first active building and its active features."""
    first = primary_building(building).select(
        "account_number",
        F.lit(True).alias("has_building"),
        F.col("heat_area").cast("double").alias("heat_area"),
        "bedrooms",
        F.col("bathrooms").cast("double").alias("bathrooms"),
        "year_built",
        K.first_nonzero(F.col("effective_year"), F.col("year_remodeled"), F.col("year_built")).alias("effective_year"),
        F.col("stories").cast("double").alias("stories"),
        "quality_code",
        "condition_code",
        F.col("building_style").alias("character_1"),
        F.col("building_type").alias("character_2"),
        F.col("building_class").alias("character_3"),
    )
    df = (
        prop.join(by_rows(first), "account_number", "left")
        .join(by_rows(building_areas(building)), "account_number", "left")
        .join(by_rows(profile_a(feature)), "account_number", "left")
    )
    living = F.coalesce(K.nonzero(F.col("heat_area")), K.nonzero(F.col("building_area").cast("double")))
    return _finish(
        df.select(
            F.col("account_number").alias("key"),
            F.lit(0).alias("scope"),
            "latitude",
            "longitude",
            F.trim(F.concat_ws(" ", "street_number", "street_name")).alias("address"),
            K.locality_line(F.col("city"), F.col("zipcode")).alias("locality"),
            "owner_name",
            F.col("zipcode").alias("zip_code"),
            K.first_nonzero(F.col("assessed_value"), F.col("value")).alias("assessed_value"),
            living.alias("living_area"),
            F.col("land_area").cast("double").alias("land_area"),
            F.col("land_area").cast("double").alias("land_size"),
            F.coalesce("has_building", F.lit(False)).alias("has_building"),
            "heat_area",
            "bedrooms",
            "bathrooms",
            "year_built",
            "effective_year",
            "stories",
            "quality_code",
            F.lit(None).cast("int").alias("quality_digit"),
            "condition_code",
            "character_1",
            "character_2",
            "character_3",
            "feature_codes",
            _no_text("features_5"),
            _no_text("features_10"),
            F.col("heat_area").alias("window_area"),
            "window_areas",
            F.lit(None).cast("int").alias("tax_year"),
        )
    )


def primary_improvement(improvement: DataFrame, characteristic: DataFrame) -> DataFrame:
    """Per property and year: the first residential improvement with characteristics, else the first one."""
    keys = ["prop_id", "tax_year", "imp_id"]
    known = characteristic.withColumn("has_building", F.lit(True))
    both = (
        improvement.filter(F.col("improvement_type") == "R")
        .select(*keys, F.col("year_built").alias("improvement_year"))
        .join(by_rows(known), keys, "left")
        .withColumn("has_building", F.coalesce("has_building", F.lit(False)))
    )
    return first_per_key(both, ["prop_id", "tax_year"], [F.col("has_building").desc(), F.col("imp_id")])


def second_floors(detail: DataFrame) -> DataFrame:
    """Improvements that list a second floor."""
    return (
        detail.filter(F.col("detail_description") == "SECOND FLOOR")
        .select("prop_id", "tax_year", "imp_id")
        .distinct()
        .withColumn("second_floor", F.lit(True))
    )


def land_totals(land: DataFrame) -> DataFrame:
    """Total land value and acreage per property and year; null when nothing is known."""
    return land.groupBy("prop_id", "tax_year").agg(
        F.sum("land_value").alias("land_value"), F.sum("acreage").alias("acreage")
    )


def facts_b(
    account: DataFrame,
    improvement: DataFrame,
    detail: DataFrame,
    characteristic: DataFrame,
    land: DataFrame,
    feature: DataFrame,
) -> DataFrame:
    """County B: account with its primary improvement, stories proxy, acreage and features, per tax year."""
    keys = ["prop_id", "tax_year"]
    main = (
        primary_improvement(improvement, characteristic)
        .join(by_rows(second_floors(detail)), [*keys, "imp_id"], "left")
        .select(
            *keys,
            "has_building",
            "improvement_year",
            "bedrooms",
            F.col("bathrooms").cast("double").alias("bathrooms"),
            F.when(F.col("second_floor"), F.lit(2.0)).otherwise(F.lit(1.0)).alias("stories"),
            F.col("exterior_wall").alias("character_1"),
            F.col("construction_style").alias("character_2"),
            F.col("foundation").alias("character_3"),
        )
    )
    df = (
        account.join(by_rows(main), keys, "left")
        .join(by_rows(land_totals(land).select(*keys, "acreage")), keys, "left")
        .join(by_rows(profile_b(feature)), keys, "left")
    )
    address = F.when(F.coalesce(F.col("situs_address"), F.lit("")) != "", F.col("situs_address"))
    return _finish(
        df.select(
            F.col("prop_id").alias("key"),
            F.col("tax_year").alias("scope"),
            "latitude",
            "longitude",
            F.coalesce(address, F.col("prop_id")).alias("address"),
            F.coalesce(address, F.lit("Address not on file")).alias("subject_address"),
            K.locality_line(F.col("situs_city"), F.col("situs_zip")).alias("locality"),
            "owner_name",
            F.col("situs_zip").alias("zip_code"),
            "assessed_value",
            K.nonzero(F.col("living_area").cast("double")).alias("living_area"),
            F.lit(None).cast("double").alias("land_area"),
            F.col("acreage").cast("double").alias("land_size"),
            F.coalesce("has_building", F.lit(False)).alias("has_building"),
            F.col("living_area").cast("double").alias("heat_area"),
            "bedrooms",
            "bathrooms",
            K.first_nonzero(F.col("improvement_year"), F.col("year_built")).alias("year_built"),
            K.first_nonzero(F.col("improvement_year"), F.col("year_built")).alias("effective_year"),
            "stories",
            F.col("class_code").alias("quality_code"),
            K.quality_digit(F.col("class_code")).alias("quality_digit"),
            F.lit(None).cast("string").alias("condition_code"),
            "character_1",
            "character_2",
            "character_3",
            "feature_codes",
            _no_text("features_5"),
            _no_text("features_10"),
            F.lit(None).cast("double").alias("window_area"),
            F.lit(None).cast("array<double>").alias("window_areas"),
            "tax_year",
        )
    )


def current_subjects(facts: DataFrame) -> DataFrame:
    """Each property as of its newest loaded year (county B keeps a row per year)."""
    return newest_year(facts, ["key"], "scope")


def newest_loaded_year(account: DataFrame, year: str = "tax_year") -> DataFrame:
    """Rows of the newest year present in the whole table."""
    newest = account.agg(F.max(year).alias("_newest"))
    return account.join(newest, F.col(year) == F.col("_newest"), "left_semi")
