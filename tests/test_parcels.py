"""Centroids of parcels with holes and separate parts, against areas added up by hand."""

import pytest

from parcelwise.functions.geo import parcel_centroids
from parcelwise.sources.parcels import locate_rings

RINGS = "k string, ring array<struct<x: double, y: double>>, hole boolean"


def box(x, y, side, back=False):
    points = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    points = [(float(a), float(b)) for a, b in points]
    return points[::-1] if back else points


FAR = 3_000_000.0
ROWS = [
    ("hole", box(FAR, 0, 100), False), ("hole", box(FAR + 50, 25, 40, True), True),
    ("parts", box(FAR, 0, 100), None), ("parts", box(FAR + 500, 0, 50), None), ("parts", [], None), ("parts", None, None),
    ("point", [(5.0, 7.0), (7.0, 7.0)], False), ("point", [(9.0, 1.0)], False),
    ("none", None, None), ("none", [], False), (None, box(0, 0, 2), False),
]


def centres(rows):
    return {r["k"]: tuple(r["centroid"]) if r["centroid"] else None for r in rows.collect()}


@pytest.mark.parametrize("hole", [None, "hole"])
def test_holes_and_parts(spark, hole):
    got = centres(parcel_centroids(spark.createDataFrame(ROWS, RINGS).repartition(3), ["k"], hole=hole))
    area = 100**2 - 40**2
    want = {
        "hole": ((100**2 * (FAR + 50) - 40**2 * (FAR + 70)) / area, (100**2 * 50 - 40**2 * 45) / area),
        "parts": ((100**2 * (FAR + 50) + 50**2 * (FAR + 525)) / (100**2 + 50**2), (100**2 * 50 + 50**2 * 25) / (100**2 + 50**2)),
        "point": (7.0, 5.0),
        None: (1.0, 1.0),
    }
    assert got.pop("none") is None and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_directions_do_not_matter_where_holes_are_named(spark):
    turned = [(k, r[::-1] if r else r, h) for k, r, h in ROWS if k in ("hole", "parts")]
    rows = spark.createDataFrame(turned, RINGS)
    same = centres(parcel_centroids(spark.createDataFrame(ROWS, RINGS), ["k"], hole="hole"))
    for k, centre in centres(parcel_centroids(rows, ["k"], hole="hole")).items():
        assert centre == pytest.approx(same[k], abs=1e-6)


def test_located(spark):
    got = locate_rings(spark.createDataFrame(ROWS, RINGS), ["k"], "EPSG:2278").filter("k = 'parts'").first()
    assert -110 < got["longitude"] < -90 and -90 < got["latitude"] < 90
    assert parcel_centroids(spark.createDataFrame([], RINGS), ["k"]).count() == 0
