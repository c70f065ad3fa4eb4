"""Room counts from fixture rows, per building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.keyed import last_value

# Fixture type codes.
BEDROOM, FULL_BATH, HALF_BATH = "RMB", "RMF", "RMH"

KEY = ["account_number", "building_number"]


def fixture_rows(raw: DataFrame, blank_units_are_zero: bool = False) -> DataFrame:
    """Typed room fixtures out of text columns ``acct, bld_num, type, units`` and ``pos``."""
    units = K.to_decimal(F.col("units"), "decimal(10,2)")
    if blank_units_are_zero:
        units = F.when(K.clean_text(F.col("units")) == "", F.lit(0).cast("decimal(10,2)")).otherwise(units)
    return raw.select(
        K.clean_text(F.col("acct")).alias("account_number"),
        K.to_strict_int(F.col("bld_num")).alias("building_number"),
        K.clean_text(F.col("type")).alias("type"),
        units.alias("units"),
        "pos",
    ).filter(
        F.col("type").isin(BEDROOM, FULL_BATH, HALF_BATH)
        & F.col("units").isNotNull()
        & F.col("building_number").isNotNull()
    )


def fixtures_pivot(rows: DataFrame) -> DataFrame:
    """One row per building; of repeated rows of a type the last one counts, they are not summed.

    A type that never occurs stays null.
    """
    of = lambda kind: last_value(F.col("units"), F.col("pos"), F.col("type") == kind)
    wide = rows.groupBy(*KEY).agg(
        of(BEDROOM).alias("_bedrooms"), of(FULL_BATH).alias("full_baths"), of(HALF_BATH).alias("_half")
    )
    return wide.select(
        *KEY,
        F.col("_bedrooms").cast("int").alias("bedrooms"),
        "full_baths",
        F.col("_half").alias("half_units"),
        F.col("_half").cast("int").alias("half_baths"),
    )


def total_baths(full: Column, half: Column) -> Column:
    """Full baths plus half a bath for each half bath; null when neither is known."""
    zero = F.lit(0).cast("decimal(10,2)")
    total = F.coalesce(full, zero) + F.coalesce(half, zero) * F.lit("0.5").cast("decimal(2,1)")
    return F.when(full.isNotNull() | half.isNotNull(), total).cast("decimal(10,2)")


def fixtures_statistics(pivot: DataFrame) -> DataFrame:
    """One row of building counts by what is known."""
    beds, full, half = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("bedrooms", "full_baths", "half_units"))
    return pivot.agg(
        F.count(F.lit(1)).alias("total_buildings"),
        F.count_if(beds).alias("with_bedrooms"),
        F.count_if(full).alias("with_full_baths"),
        F.count_if(half).alias("with_half_baths"),
        F.count_if(full | half).alias("with_bathrooms"),
        F.count_if(beds & (full | half)).alias("with_both"),
    )


def update_room_counts(building: DataFrame, pivot: DataFrame) -> DataFrame:
    """Active buildings with their room counts replaced where fixtures know them; adds ``rooms_changed``."""
    fx = pivot.select(
        *KEY,
        F.lit(True).alias("_found"),
        F.col("bedrooms").alias("_bedrooms"),
        total_baths(F.col("full_baths"), F.col("half_baths").cast("decimal(10,2)")).cast("decimal(4,2)").alias("_baths"),
        F.col("half_baths").alias("_half"),
    )
    joined = building.join(fx, KEY, "left")
    touched = F.col("is_active") & F.coalesce("_found", F.lit(False))
    new = {
        "bedrooms": F.col("_bedrooms"),
        "bathrooms": F.col("_baths"),
        "half_baths": F.col("_half"),
    }
    replaced = {n: F.when(touched, F.coalesce(v, F.col(n))).otherwise(F.col(n)) for n, v in new.items()}
    changed = F.lit(False)
    for n, v in new.items():
        changed = changed | (touched & v.isNotNull() & ~v.eqNullSafe(F.col(n)))
    out = joined.withColumn("rooms_changed", changed).withColumns(replaced)
    return out.select(*building.columns, "rooms_changed")


def room_update_counts(building: DataFrame, pivot: DataFrame) -> DataFrame:
    """One row: buildings with room data, buildings updated, room keys without an active building."""
    updated = update_room_counts(building, pivot).agg(F.count_if("rooms_changed").alias("buildings_updated"))
    active = building.filter("is_active").select(*KEY).distinct().withColumn("_active", F.lit(True))
    found = pivot.join(active, KEY, "left").agg(
        F.count(F.lit(1)).alias("buildings_with_rooms"),
        F.count_if(F.col("_active").isNull()).alias("buildings_not_found"),
    )
    # Two one-row tables side by side.
    one = F.lit(1).alias("_one")
    return found.select("*", one).join(updated.select("*", one), "_one").drop("_one")
