"""Parcel shapes as a table of rings: centroid in the planar system first, then to latitude/longitude."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.functions.geo import SYSTEMS, lambert_to_wgs84, parcel_centroids, with_ring_centroid
from parcelwise.sources.delimited import resolve

# Column names under which a parcel table may carry its account and parcel id.
ACCOUNT_COLUMNS = ("HCAD_NUM", "ACCT", "ACCOUNT", "ACCOUNT_NUM", "ACCT_NUM")
PARCEL_COLUMNS = ("PARCEL_ID", "PARCELID", "PRCL_ID", "HCAD_NUM")


def locate(parcels: DataFrame, crs: str, ring: str = "ring") -> DataFrame:
    """Add ``latitude`` and ``longitude`` of the parcel centroid; ``crs`` is the table's own system.

    The counties publish in different systems (A in EPSG:2278, B in EPSG:2277), so there is no default.
    """
    return _to_degrees(with_ring_centroid(parcels, ring, "_c"), crs)


def locate_rings(rings: DataFrame, keys: Sequence[str], crs: str, ring: str = "ring", hole: str | None = None) -> DataFrame:
    """``keys``, ``latitude``, ``longitude`` of parcels given as one row per ring: holes and separate parts count by area."""
    return _to_degrees(parcel_centroids(rings, keys, ring, hole, "_c"), crs)


def _to_degrees(centre: DataFrame, crs: str) -> DataFrame:
    system = SYSTEMS[crs]
    if system is not None:
        centre = centre.withColumn("_g", lambert_to_wgs84(F.col("_c.x"), F.col("_c.y"), system))
        return centre.withColumns({"latitude": F.col("_g.lat"), "longitude": F.col("_g.lon")}).drop("_c", "_g")
    return centre.withColumns({"latitude": F.col("_c.y"), "longitude": F.col("_c.x")}).drop("_c")


def _first_present(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first *file* column whose name is one of ``names``."""
    wanted = {n.upper() for n in names}
    return next((c for c in columns if c.upper() in wanted), None)


def staged_coordinates(located: DataFrame, order_by: str) -> DataFrame:
    """``account_number, latitude, longitude, parcel_id``; of repeated accounts the last row stands."""
    account = _first_present(located.columns, ACCOUNT_COLUMNS)
    if account is None:
        raise ValueError(f"no account number column among {located.columns}")
    parcel = _first_present(located.columns, PARCEL_COLUMNS)
    parcel_id = K.clean_text(F.col(parcel).cast("string")) if parcel else F.lit("")
    known = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    # Rows without a position are passed over inside the aggregate: as a filter the test would be
    # pushed below the geometry and have it computed twice.
    usable = known(F.col("latitude")) & known(F.col("longitude"))
    return (
        located.select(
            K.clean_text(F.col(account).cast("string")).alias("account_number"),
            "latitude",
            "longitude",
            parcel_id.alias("parcel_id"),
            F.col(order_by).alias("_order"),
        )
        .filter(F.col("account_number") != "")
        .groupBy("account_number")
        .agg(F.max_by(F.struct("latitude", "longitude", "parcel_id"), F.when(usable, F.col("_order"))).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .select("account_number", "_s.*")
    )


def _attr(df: DataFrame, name: str):
    found = resolve(df.columns, [name])
    return F.col(found) if found else F.lit(None).cast("string")


def staged_parcels(located: DataFrame, order_by: str) -> DataFrame:
    """Parcel attributes of county B by padded property id; of repeated ids the last row stands."""
    a = lambda name: _attr(located, name)
    area = a("living_are").cast("double")
    return (
        located.filter(a("PROP_ID").isNotNull() & ~F.isnan(a("PROP_ID").cast("double")))
        .select(
            K.padded_property_id(a("PROP_ID")).alias("prop_id"),
            F.struct(
                K.parcel_address(
                    [a("situs_num"), a("situs_stre"), a("situs_st_1"), a("situs_st_2")], a("situs_unit")
                ).alias("situs_address"),
                F.lit("TX").alias("situs_state"),
                K.parcel_text(a("state_cd")).alias("state_class"),
                F.col("latitude").cast("decimal(10,7)").alias("latitude"),
                F.col("longitude").cast("decimal(10,7)").alias("longitude"),
                F.when(~F.isnan(area), area).cast("decimal(10,2)").alias("living_area"),
                K.first_nonzero(a("yr_built").try_cast("int"), a("yr_blt").try_cast("int")).alias("year_built"),
                K.parcel_text(a("class_cd")).alias("class_code"),
            ).alias("_s"),
            F.col(order_by).alias("_order"),
        )
        .groupBy("prop_id")
        .agg(F.max_by("_s", "_order").alias("_s"))
        .select("prop_id", "_s.*")
    )
