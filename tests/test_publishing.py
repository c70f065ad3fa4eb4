"""Publishing by a manifest and merging by key buckets: what readers see, and which files stay."""

import os

import pytest
from pyspark.sql import functions as F

from parcelwise.sinks import manifest as M
from parcelwise.sinks import tables as T


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_tables_or_none(spark, tmp_path):
    out = str(tmp_path / "db")
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([("h", 2024, 1), ("h", 2025, 2)], "county string, tax_year int, n int")
    assert M.commit(spark, out, {"a": a, "b": b}, {"b": ("county", "tax_year")}) == 1
    broken = b.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    # The first table of the load is written whole before the second one fails.
    with pytest.raises(Exception, match="broken"):
        M.commit(spark, out, {"a": a.withColumn("v", F.lit("new")), "b": broken}, {"b": ("county", "tax_year")})
    assert M.current(spark, out)[0] == 1
    assert rows_of(M.read(spark, out, "a").fillna("-")) == [(1, "x"), (2, "-")] and rows_of(M.read(spark, out, "b")) == rows_of(b)
    left = M.clean(spark, out)
    assert len(left) == 2 and all(p.split("/")[0] in ("a", "b") for p in left)
    assert rows_of(M.read(spark, out, "b")) == rows_of(b)


def test_slices_replace_only_themselves(spark, tmp_path):
    out, by = str(tmp_path / "db"), {"t": ("county", "tax_year")}
    kind = "n int, county string, tax_year int"
    first = spark.createDataFrame([(1, "h", 2024), (2, "h", 2025), (3, "a b/c=d", 2025), (4, None, 2025)], kind)
    M.commit(spark, out, {"t": first}, by)
    M.commit(spark, out, {"t": spark.createDataFrame([(9, "h", 2025), (8, "h", 2026), (7, "a b/c=d", 2025)], kind)}, by)
    assert rows_of(M.read(spark, out, "t").fillna("-")) == [(1, "h", 2024), (4, "-", 2025), (7, "a b/c=d", 2025), (8, "h", 2026), (9, "h", 2025)]
    # An older manifest still names its rows.
    assert M.read(spark, out, "t", number=1).count() == 4
    M.commit(spark, out, {"t": spark.createDataFrame([], kind)}, by)
    assert M.read(spark, out, "t").count() == 5
    M.commit(spark, out, {"t": first.limit(0)})
    assert rows_of(M.read(spark, out, "t")) == [] and M.read(spark, out, "t").columns == first.columns


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    out, by = str(tmp_path / "db"), {"t": ("y",)}
    M.commit(spark, out, {"t": spark.createDataFrame([(0, 1)], "n int, y int")}, by)
    place, met = M._place, []

    def late(spark, folder, number, content):
        if not met:
            met.append(number)
            # Another load commits between reading the manifest and placing the own one.
            M.commit(spark, folder, {"t": spark.createDataFrame([(5, 2)], "n int, y int"), "u": spark.range(1)}, by)
        return place(spark, folder, number, content)

    monkeypatch.setattr(M, "_place", late)
    assert M.commit(spark, out, {"t": spark.createDataFrame([(7, 3)], "n int, y int")}, by) == 3
    assert rows_of(M.read(spark, out, "t")) == [(0, 1), (5, 2), (7, 3)] and M.read(spark, out, "u").count() == 1
    assert not [n for n in os.listdir(f"{out}/{M.MANIFESTS}") if "draft" in n and not n.startswith(".")]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    start = spark.range(400).select("id", (F.col("id") % 7).cast("int").alias("v"))
    T.upsert_buckets(start, path, ["id"], 16)
    before = files(path)
    assert len(before) == 16
    change = spark.createDataFrame([(5, 100), (1000, 100)], "id long, v int")
    T.upsert_buckets(change, path, ["id"], 16)
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) >= 14
    want = sorted([(i, i % 7) for i in range(400) if i != 5] + [(5, 100), (1000, 100)])
    assert rows_of(T.read_buckets(spark, path)) == want
    T.insert_ignore_buckets(spark.createDataFrame([(5, 1), (6, 1), (2000, 1), (2000, 2)], "id long, v int"), path, ["id"], ["v"], 16)
    assert rows_of(T.read_buckets(spark, path)) == sorted([*want, (2000, 1)])
    assert after.items() <= files(path).items()
    with pytest.raises(ValueError, match="buckets"):
        T.upsert_buckets(change, path, ["id"], 8)
