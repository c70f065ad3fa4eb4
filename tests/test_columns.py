from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.functions import curves as C
from parcelwise.functions import geo as G


@pytest.mark.parametrize(
    "text, want",
    [("123.90", 123), (" 7 ", 7), ("-3.9", -3), ("", None), ("abc", None), (None, None), ("1d", None), ("99999999999", None)],
)
def test_to_int(value, text, want):
    assert value(lambda c: K.to_int(c.cast("string")), text) == want


@pytest.mark.parametrize(
    "text, want", [("$1,234.50", Decimal("1234.50")), ("", None), ("n/a", None), ("12", Decimal("12.00")), ("NaN", None)]
)
def test_to_decimal(value, text, want):
    assert value(lambda c: K.to_decimal(c), text) == want


@pytest.mark.parametrize(
    "text, full, half",
    [
        ("3/1", 3, 1), ("2.5", 2, 1), ("2 1/2", 2, 1), ("3-1/2", 3, 1), ("2,1/2", 2, 1), ("1 1/2 EA", 1, 1),
        ("2\\1", 2, 1), ("2", 2, 0), ("1 3/4", None, None), ("", None, None),
    ],
)
def test_bath_text(value, text, full, half):
    assert value(K.full_baths, text) == full
    assert value(K.half_baths, text) == half


@pytest.mark.parametrize("text, want", [("=2+2", "'=2+2"), ("@789", "'@789"), ("+Formula St", "'+Formula St"), ("plain", "plain"), ("\tx", "'\tx")])
def test_csv_safe(value, text, want):
    assert value(K.csv_safe, text) == want


def test_yoy_is_half_up(value):
    assert value(lambda a, b: K.percent_change(a.cast("decimal(14,2)"), b.cast("decimal(14,2)")), 355000, 340000) == Decimal("4.41")
    assert value(lambda a, b: K.percent_change(a.cast("decimal(14,2)"), b.cast("decimal(14,2)")), 355000, 0) is None


def test_implied_decimals(value):
    assert value(lambda c: K.implied_decimal(c, 2), "00000002833677") == Decimal("28336.77")
    assert value(lambda c: K.implied_decimal(c, 4, "decimal(12,4)"), "105024") == Decimal("10.5024")
    assert value(K.int_or_null, "0000") is None
    assert value(K.int_or_zero, "    ") == 0


def test_padded_id_keeps_long_ids(value):
    assert value(lambda c: K.padded_property_id(c), "42") == "000000000042"
    assert value(lambda c: K.padded_property_id(c), "1234567890123") == "1234567890123"


def test_parcel_address(value):
    make = lambda a, b, c: K.parcel_address([a, b, c], F.lit("NULL"))
    assert value(make, "5000", "NULL", "SILVER HILL RD") == "5000 SILVER HILL RD"


def test_quick_round_equals_round(spark):
    df = spark.range(0, 200001).select((F.col("id") / 200000.0 * 3).alias("x")).unionByName(
        spark.range(0, 3000).select((F.col("id") / 2000.0 + 0.0005).alias("x"))
    )
    for places in (1, 2, 3):
        assert df.filter(K.quick_round(F.col("x"), places) != F.round("x", places)).count() == 0


def test_clamp_argument():
    assert K.clamp_argument("abc", 10.0, 0.1, 50.0) == 10.0
    assert K.clamp_argument("99", 10.0, 0.1, 50.0) == 50.0
    assert K.clamp_argument("7", 20, 1, 100) == 7
    assert K.clamp_argument(None, 20, 1, 100) == 20


def test_curve_corners(value):
    at = lambda x: value(lambda c: C.curve(c, C.LIVING_AREA_CURVE), float(x))
    assert at(-1) == 1.0 and at(0) == 1.0 and at(9) == 0.0
    assert at(0.04) == pytest.approx(0.93)
    assert value(lambda c: C.curve(c, ()), 5.0) == 0.0
    # A vertical step takes the end value.
    assert value(lambda c: C.curve(c, ((0.0, 1.0), (1.0, 0.5), (1.0, 0.2))), 1.0) == 0.5


def test_code_similarities(value):
    assert value(C.categorical_similarity, "RANCH", "RAMBLER") == 0.65
    assert value(C.categorical_similarity, "R", "RX") == 0.4
    assert value(C.categorical_similarity, "", "RX") is None
    assert value(C.ranked_code_similarity, "a", " B") == 0.72
    assert value(C.ranked_code_similarity, "Q", "Q") == 1.0
    assert value(C.ranked_code_similarity, "Q", "A") is None
    assert value(C.condition_similarity, "Good", "Great") == 0.4


def test_distance_without_coordinates_is_null(spark):
    row = spark.sql("select cast(null as double) a, 1d b, 2d c, 3d d").select(
        G.haversine_miles(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h"),
        G.cosine_miles(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("c"),
    ).first()
    assert row["h"] is None and row["c"] is None


def test_projection_inverts_a_known_point(spark):
    """The false origin of the planar system is its latitude and longitude of origin."""
    m = 1200.0 / 3937.0
    row = spark.sql(f"select {700000.0 / m}D x, {3000000.0 / m}D y").select(
        G.lambert_to_wgs84(F.col("x"), F.col("y"), G.TEXAS_CENTRAL).alias("g")
    ).first()["g"]
    assert row["lat"] == pytest.approx(29.0 + 40 / 60, abs=1e-9)
    assert row["lon"] == pytest.approx(-(100 + 20 / 60), abs=1e-9)


@pytest.mark.parametrize("c, place", [(G.TEXAS_CENTRAL, (30.6280, -96.3344)), (G.TEXAS_SOUTH_CENTRAL, (29.7604, -95.3698))])
def test_projection_round_trip(spark, c, place):
    """Forward projection computed here in plain Python, inverse by the library."""
    import math

    f = 1 / c["inverse_flattening"]
    e = math.sqrt(2 * f - f * f)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(c[k]) for k in ("lat_origin", "parallel_1", "parallel_2"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    lat, lon = map(math.radians, place)
    rho, rho0 = c["semi_major_m"] * big * t(lat) ** n, c["semi_major_m"] * big * t(p0) ** n
    theta = n * (lon - math.radians(c["lon_origin"]))
    x = (rho * math.sin(theta) + c["false_easting_m"]) / c["metres_per_unit"]
    y = (rho0 - rho * math.cos(theta) + c["false_northing_m"]) / c["metres_per_unit"]
    got = spark.sql(f"select {x!r}D x, {y!r}D y").select(G.lambert_to_wgs84(F.col("x"), F.col("y"), c).alias("g")).first()["g"]
    assert got["lat"] == pytest.approx(place[0], abs=1e-8) and got["lon"] == pytest.approx(place[1], abs=1e-8)


def test_ring_centroid_shapes(spark):
    df = spark.sql(
        """select 1 id, array(named_struct('x',0d,'y',0d), named_struct('x',4d,'y',0d), named_struct('x',0d,'y',4d)) ring
           union all select 2, array(named_struct('x',5d,'y',6d))
           union all select 3, cast(array() as array<struct<x:double,y:double>>)
           union all select 4, cast(null as array<struct<x:double,y:double>>)"""
    )
    got = {r["id"]: r["centroid"] for r in G.with_ring_centroid(df, "ring").collect()}
    assert got[1]["x"] == pytest.approx(4 / 3) and got[1]["y"] == pytest.approx(4 / 3)
    assert (got[2]["x"], got[2]["y"]) == (5.0, 6.0)
    assert got[3] is None and got[4] is None
