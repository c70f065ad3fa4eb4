from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import quality as Q
from parcelwise.operators import search as S
from parcelwise.operators.scoring import COUNTY_A_SPEC
from parcelwise.operators.facts import facts_a
from parcelwise.plans.report import SharedTables, protest_comps, protest_report
from parcelwise.sinks import exports as X
from parcelwise.sources.snapshot import read_snapshot
from tests.test_analytics import HIST, JUR, RATE, _a_tables, hist

D = Decimal


def test_protest_report_lines(spark):
    facts = facts_a(*_a_tables(spark))
    history = spark.createDataFrame(hist(dict(tax_year=2025, assessed_value=200000, appraised_value=200000), dict(tax_year=2024, assessed_value=190000)), HIST).withColumn("account_number", F.lit("0"))
    jur = spark.createDataFrame([("0", 2025, "harris", "U1", "n", "", "", None, None, D("200000"))], JUR)
    rate = spark.createDataFrame([(2025, "U1", "harris", "n", D("0.02"), "s")], RATE)
    comps = protest_comps(facts, facts, COUNTY_A_SPEC, 52)
    out = protest_report(facts, comps, SharedTables(history, rate, jur), "harris")
    lines = out["lines"].filter("key = '0'").first()["report_lines"]
    assert lines[:6] == [
        "Harris County Property Tax Protest Evidence Report", "Account Number: 0", "Property: 0 OAK", "Assessed Value: $200,000",
        "Living Area: 1,000 sqft", "Subject Value/Sqft: $200.00",
    ]
    assert "Assessment History" in lines and "2025: $200,000, YoY 5.26%, Within cap" in lines and "2024: $190,000, YoY -, Needs review" in lines
    assert lines[lines.index("Comparable Evidence") + 1].startswith("1 OAK: score ")
    assert "Tax Year Used: 2025 (complete)" in lines and "Current Taxes Owed: $4,000.00" in lines
    csv = out["comps_csv"].filter("subject_key = '0'").orderBy("display_rank").collect()
    assert csv[0]["living_area_sqft"] == "1000" and csv[0]["value_per_sqft"] == "210.00" and csv[0]["delta_vs_subject_per_sqft"] == "10.00"
    assert csv[0]["current_tax_owed"] == "4000.00" and csv[0]["tax_impact_completeness"] == "complete"


def test_csv_by_subject(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, "=x"), ("s2", 1, "y")], "subject_key string, display_rank int, address string")
    X.write_csv_by_subject(rows, str(tmp_path / "csv"), 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_search_is_literal_and_needs_a_filter(spark):
    df = spark.createDataFrame([("1", "50% OFF", "1 A", "77001", "2", "B"), ("2", "500 OFF", "2 A", "77002", "10", "B"), ("3", None, "3 A", None, None, "B")], "account_number string, owner_name string, address string, zipcode string, street_number string, street_name string")
    df = df.withColumns({c: F.lit(None).cast("decimal(14,2)") for c in ("value", "assessed_value", "building_area", "land_area")})
    find = lambda **p: [r["account_number"] for r in S.search_page(S.search_filter(df, S.SEARCH_A, p), S.search_order(S.SEARCH_A, p)).collect()]
    assert find(last_name="0%") == ["1"] and find(first_name="off", zip_code="77") == ["1", "2"]
    assert find() == [] and find(address="  ") == []
    assert find(address="A", dir="desc") == ["3", "2", "1"] and find(address="a") == ["1", "2", "3"]
    assert find(address="A", sort="street_number") == ["2", "1", "3"]
    assert find(address="A", sort="owner_name; drop") == ["1", "2", "3"]
    order = S.search_order(S.SEARCH_A, {})
    assert [r["account_number"] for r in S.page_or_last(df, order, page=9, rows=2).collect()] == ["3"]


def test_export_gate():
    assert S.may_export(S.SEARCH_A, {"zip_code": "77001"}) and not S.may_export(S.SEARCH_A, {"zip_code": "7700"})
    assert S.may_export(S.SEARCH_B, {"owner_name": " a b c "}) and not S.may_export(S.SEARCH_B, {"owner_name": "a b"})
    with pytest.raises(ValueError):
        S.require_export_filter(S.SEARCH_A, {})


def test_export_cap(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("prop_id"), *[F.lit(None).cast("string").alias(c) for c in ("owner_name", "address", "city", "zip_code", "land_value", "acreage")])
    out = X.search_export(df, X.EXPORT_B, [F.col("prop_id")], max_rows=1000)
    assert out.count() == 1000 and out.columns[0] == "Prop ID"
    assert X.search_export(df, X.EXPORT_B, [F.col("prop_id")]).count() == 1500


def test_snapshot_check(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[{"prop_id":"1","situs_address_full":"1 OAK ST, TOWN","owner_name":"A","assessed_value":100},'
                    '{"prop_id":"2","situs_address_full":"","owner_name":"B","assessed_value":7,"known_drift":{"assessed_value":"moved"}},'
                    '{"prop_id":"3","situs_address_full":"X","owner_name":"C","assessed_value":1}]')
    account = spark.createDataFrame([("1", "1 OAK ST", "A", D("100.90")), ("2", None, "BB", D("8"))], "prop_id string, situs_address string, owner_name string, assessed_value decimal(14,2)")
    snap = read_snapshot(spark, str(path))
    got = {(r["prop_id"], r["field"], r["verdict"]) for r in Q.snapshot_mismatches(snap, account).collect()}
    assert got == {("2", "owner_name", "failure"), ("2", "assessed_value", "known_drift"), ("3", "missing", "failure")}
    strict = Q.snapshot_mismatches(snap, account, strict=True)
    assert strict.filter("verdict = 'failure'").count() == 3


def _quality_tables(spark):
    prop = spark.createDataFrame(
        [("1", "A1", True, True, 29.0, -95.0), ("2", " a2", False, False, 29.0, -95.0), ("3", "F1", True, True, 29.0, -95.0), ("4", "A1", True, True, None, -95.0)],
        "account_number string, state_class string, is_residential boolean, is_data_ready boolean, latitude double, longitude double",
    )
    b = spark.createDataFrame(
        [("1", 1, 3, 2, "B", 900, True), ("2", 1, 3, None, "", None, True), ("2", 2, None, 2, "B", 900, True), ("4", 1, 3, 2, "B", 900, True), ("9", 1, 3, 2, "B", 900, True), ("9", 1, 3, 2, "B", 900, True)],
        "account_number string, building_number int, bedrooms int, bathrooms int, quality_code string, heat_area int, is_active boolean",
    )
    f = spark.createDataFrame([("1", "P", 1, True), ("9", "P", 1, True)], "account_number string, feature_code string, feature_number int, is_active boolean")
    return prop, b, f


def test_rooms_must_be_on_one_building(spark):
    prop, b, _ = _quality_tables(spark)
    ready = {r["account_number"]: r["is_data_ready"] for r in Q.refresh_readiness(prop, b).collect()}
    assert ready == {"1": True, "2": False, "3": False, "4": False}


def test_checks_and_reconciliation(spark):
    prop, b, f = _quality_tables(spark)
    checks = {r["check"]: (r["level"], r["missing"]) for r in Q.validate(prop, b, f).collect()}
    assert checks["duplicate_buildings"] == ("fail", 1) and checks["orphan_features"] == ("warn", 1) and checks["duplicate_properties"] == ("pass", 0)
    assert checks["residential_only"] == ("fail", 1) and checks["coordinates"] == ("fail", 1) and checks["active_buildings_present"] == ("pass", 0)
    p = Q.reconcile_preview(prop, b, f).first()
    assert (p["properties_examined"], p["state_classes_normalized"], p["residential_flags_synced"], p["effective_ready_properties"]) == (4, 1, 2, 1)
    assert (p["non_residential_properties"], p["incomplete_properties"], p["orphaned_buildings"], p["orphaned_features"]) == (1, 2, 2, 1)
    kept = Q.reconcile(prop, b, f)
    assert [r["account_number"] for r in kept["property"].collect()] == ["1"] and kept["building"].count() == 1 and kept["extra_feature"].count() == 1


@pytest.mark.parametrize("missing, level", [(0, "pass"), (1, "warn"), (2, "fail")])
def test_tolerance(spark, missing, level):
    row = spark.range(1).select(Q.grade_missing(F.lit(missing), F.lit(100), 1.0).alias("g")).first()
    assert row["g"] == level


def test_pages_by_key_equal_pages_by_number(spark):
    rows = [(f"k{i:02d}", [None, "a", "b"][i % 3], i % 4 or None) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, name string, n int")
    order = ["name", "n", "key"]
    last, seen = None, []
    while True:
        page = S.page_after(df, order, last, rows=7).collect()
        if not page:
            break
        seen += [r["key"] for r in page]
        last = page[-1].asDict()
    whole = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()
    assert seen == [r["key"] for r in whole]
