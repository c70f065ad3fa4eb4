from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import equity as E
from parcelwise.operators.comps import find_comps
from parcelwise.operators.facts import current_subjects, facts_a, facts_b
from parcelwise.operators.history import history_rows, history_trend
from parcelwise.operators.scoring import COUNTY_A_SPEC, COUNTY_B_SPEC, breakdown_text
from parcelwise.operators.tax import tax_impact

D = Decimal


def scored(spark, spec, subject, comp, distance=0.0):
    """Score one pair given as fact dictionaries."""
    from parcelwise.operators.scoring import score_facts, score_pairs

    kinds = {
        "has_building": "boolean", "heat_area": "double", "bedrooms": "int", "bathrooms": "double", "effective_year": "int",
        "stories": "double", "land_size": "double", "quality_digit": "int", "quality_code": "string", "condition_code": "string",
        "character_1": "string", "character_2": "string", "character_3": "string", "feature_codes": "array<string>",
    }
    base = {"has_building": False, "feature_codes": []}
    schema = "side string, " + ", ".join(f"{k} {t}" for k, t in kinds.items())
    rows = [(n, *[{**base, **f}.get(k) for k in kinds]) for n, f in (("s", subject), ("c", comp))]
    sides = spark.createDataFrame(rows, schema).select("side", score_facts().alias("f"))
    pair = sides.filter("side='s'").select(F.col("f").alias("subject")).crossJoin(
        sides.filter("side='c'").select(F.col("f").alias("comp"))
    ).withColumn("distance", F.lit(distance))
    from parcelwise.operators.scoring import with_score_breakdown

    out = with_score_breakdown(score_pairs(pair, spec, 10.0), spec)
    return out.withColumnRenamed("score_breakdown", "breakdown").first()


HOUSE = {
    "has_building": True, "heat_area": 2000.0, "bedrooms": 4, "bathrooms": 2.5, "effective_year": 2005, "stories": 2.0,
    "land_size": 8000.0, "quality_code": "B", "condition_code": "Good", "character_1": "RANCH", "feature_codes": ["POOL"],
    "quality_digit": 4,
}


def test_identical_houses_score_100(spark):
    for spec in (COUNTY_A_SPEC, COUNTY_B_SPEC):
        row = scored(spark, spec, HOUSE, HOUSE)
        assert row["similarity_score"] == 100.0 and row["mode"] == "residential"


def test_land_only_has_no_completeness_factor(spark):
    row = scored(spark, COUNTY_A_SPEC, {"land_size": 100.0}, {"land_size": 100.0})
    assert row["mode"] == "land_only" and row["similarity_score"] == 100.0
    assert [b["name"] for b in row["breakdown"]] == ["land_size", "features", "distance"]
    assert [b["weight"] for b in row["breakdown"]] == [80.0, 10.0, 10.0]
    assert row["breakdown"][1]["available"] is False


def test_mixed_pairs_differ_by_county(spark):
    a = scored(spark, COUNTY_A_SPEC, HOUSE, {"land_size": 8000.0, "feature_codes": ["POOL"]})
    assert len(a["breakdown"]) == 3 and a["similarity_score"] == 100.0
    b = scored(spark, COUNTY_B_SPEC, HOUSE, {"land_size": 8000.0, "feature_codes": ["POOL"]})
    # 18 of 100 points available: 0.8 + 0.2 * 0.18.
    assert len(b["breakdown"]) == 10 and b["similarity_score"] == 83.6


def test_missing_facts_lower_the_score(spark):
    partial = {k: v for k, v in HOUSE.items() if k not in ("bedrooms", "bathrooms")}
    row = scored(spark, COUNTY_A_SPEC, HOUSE, partial)
    assert row["available_weight"] == 74.0 and row["similarity_score"] == pytest.approx(94.8)


def _equity(spark, subject, comps):
    s = spark.createDataFrame([(0, "s", subject[0], subject[1])], "scope int, key string, assessed_value double, living_area double")
    s = s.withColumn("value_per_sqft", F.expr("assessed_value / living_area")).withColumn("has_location", F.lit(True))
    c = spark.createDataFrame([(0, "s", f"c{i}", 90.0, float(v)) for i, v in enumerate(comps)], "scope int, subject_key string, comp_key string, similarity_score double, value_per_sqft double")
    return s, c


def _joins_and_sources(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join "), plan.count("LogicalRDD") + plan.count("LocalRelation")


def test_equity_case(spark):
    s, c = _equity(spark, (370000.0, 2000.0), [160, 170])
    row = E.equity_summary(c, s).first()
    assert (row["subject_value_per_sqft"], row["median_comp_value_per_sqft"], row["equity_gap_per_sqft"]) == (185, 165, 20)
    assert row["estimated_savings"] == 40000 and row["median_assessed_value"] == D("330000") and row["comps_below_subject"] == 2


def test_equity_sorts_prices_in_one_join(spark):
    s, c = _equity(spark, (150000.0, 1000.0), [170, 150, 10, 160, 20])
    c = c.union(c.limit(1).withColumn("value_per_sqft", F.lit(None).cast("double")))
    # One join, of subjects with the prices of their comps; comps do not meet their subjects row by row.
    assert _joins_and_sources(E.equity_summary(c, s))[0] == 1
    row = E.equity_summary(c, s).first()
    assert (row["median_comp_value_per_sqft"], row["comps_below_subject"], row["qualifying_comp_count"]) == (150, 2, 5)


def test_equity_without_comps(spark):
    s, c = _equity(spark, (370000.0, 2000.0), [])
    row = E.equity_summary(c, s).first()
    assert row["median_comp_value_per_sqft"] is None and row["comps_below_subject"] == 0 and row["estimated_savings"] is None


@pytest.mark.parametrize("ppsf, level", [(150, "strong"), (120, "neutral"), (132, "moderate"), (100, "low")])
def test_recommendation_levels(spark, ppsf, level):
    s, c = _equity(spark, (ppsf * 1000.0, 1000.0), [100, 110, 120, 125, 130])
    row = E.recommend_protest(c, s).first()
    assert row["level"] == level and row["median"] == 120 and row["comparable_count"] == 5
    if level == "strong":
        assert row["reason"] == "Your price per sqft ($150.00) is about 25% above the median ($120.00) of 5 similar properties (avg match score 90)."


def test_recommendation_needs_three_comps(spark):
    s, c = _equity(spark, (150000.0, 1000.0), [100, 110])
    assert E.recommend_protest(c, s).count() == 0


def test_histogram_of_equal_values(spark):
    _, c = _equity(spark, (1.0, 1.0), [5, 5, 5])
    rows = E.ppsf_histogram(c, bins=2).orderBy("bin").collect()
    assert len(rows) == 4 and [r["comp_count"] for r in rows] == [3, 0, 0, 0] and rows[-1]["bin_high"] == 6.0


def test_histogram_makes_its_comps_once(spark):
    _, c = _equity(spark, (1.0, 1.0), [10, 11, 12, 19, 20, 20])
    c = c.union(c.select("scope", F.lit("t"), "comp_key", "similarity_score", F.lit(None).cast("double")))
    rows = E.ppsf_histogram(c, bins=5)
    assert _joins_and_sources(rows.where("subject_key = 's'")) == _joins_and_sources(c.where("subject_key = 's'"))
    assert [tuple(r) for r in rows.orderBy("bin").collect()] == [
        (0, "s", 0, 2, 10.0, 12.0), (0, "s", 1, 1, 12.0, 14.0), (0, "s", 2, 0, 14.0, 16.0), (0, "s", 3, 0, 16.0, 18.0), (0, "s", 4, 3, 18.0, 20.0),
    ]
    assert dict(rows.dtypes) == {"scope": "int", "subject_key": "string", "bin": "int", "comp_count": "bigint", "bin_low": "double", "bin_high": "double"}


HIST = "account_number string, tax_year int, county string, assessed_value decimal(14,2), appraised_value decimal(14,2), market_value decimal(14,2), prior_appraised_value decimal(14,2), prior_market_value decimal(14,2), new_construction_value decimal(14,2), cap_account string"


def hist(*rows):
    out = []
    for r in rows:
        base = dict(account_number="1", county="harris", assessed_value=None, appraised_value=None, market_value=None, prior_appraised_value=None, prior_market_value=None, new_construction_value=None, cap_account="")
        base.update(r)
        out.append(tuple(D(str(base[f.split()[0]])) if isinstance(base[f.split()[0]], (int, float)) and "decimal" in f else base[f.split()[0]] for f in HIST.split(", ")))
    return out


def status(spark, *rows, limit=5):
    out = history_rows(spark.createDataFrame(hist(*rows), HIST), limit).orderBy(F.desc("tax_year")).collect()
    return out


def test_homestead_over_limit(spark):
    got = status(spark, dict(tax_year=2025, appraised_value=341000, market_value=500000, prior_appraised_value=300000, new_construction_value=10000, cap_account=" y "))[0]["cap_status"]
    assert got["status"] == "over_limit" and got["allowed_value"] == D("340000.00") and got["cap_type"] == "homestead" and got["increase_percent"] == D("13.67")


def test_circuit_breaker_within_limit(spark):
    got = status(spark, dict(tax_year=2025, appraised_value=470000, prior_appraised_value=400000, cap_account="Pending"))[0]["cap_status"]
    assert got["status"] == "within_limit" and got["allowed_value"] == D("480000.00") and got["increase_percent"] == D("17.50") and got["limit_percent"] == 20


def test_other_county_has_unknown_cap(spark):
    got = status(spark, dict(tax_year=2025, county="brazos", appraised_value=110, prior_appraised_value=100, cap_account="Y"))[0]["cap_status"]
    assert got["status"] == "unknown" and got["cap_type"] == "unknown" and got["limit_percent"] is None and got["increase_percent"] == D("10.00")


def test_prior_row_fallbacks_and_limit(spark):
    rows = status(spark, dict(tax_year=2025, assessed_value=355000, appraised_value=355000), dict(tax_year=2024, assessed_value=340000), dict(tax_year=2022, assessed_value=100), limit=2)
    assert [r["tax_year"] for r in rows] == [2025, 2024]
    assert rows[0]["increase_percent"] == D("4.41") and rows[0]["cap_status"]["increase_percent"] == D("4.41")
    # The oldest kept year has no prior although an older row exists.
    assert rows[1]["increase_percent"] is None


def test_trend(spark):
    df = history_rows(spark.createDataFrame(hist(dict(tax_year=2024, assessed_value=5), dict(tax_year=2025, assessed_value=7)), HIST))
    row = history_trend(df).first()
    assert [p["year"] for p in row["points"]] == [2024, 2025] and row["amount_span"] == 2.0


JUR = "account_number string, tax_year int, county string, tax_unit_code string, tax_unit_name string, exemption_code string, exemption_description string, exemption_amount decimal(14,2), exemption_percent decimal(8,4), taxable_value decimal(14,2)"
SUBJ = "county string, account_number string, requested_year int, median_assessed_value decimal(14,2)"
RATE = "tax_year int, tax_unit_code string, county string, tax_unit_name string, adopted_rate decimal(12,8), source string"


def impact(spark, jur, rates, assessed, median, year=None):
    j = spark.createDataFrame([("1", 2025, "harris", u, "n", code, "", amt and D(str(amt)), pct and D(str(pct)), base and D(str(base))) for u, code, amt, pct, base in jur], JUR)
    r = spark.createDataFrame([(2025, u, "harris", "n", D(str(x)), "s") for u, x in rates], RATE)
    h = spark.createDataFrame(hist(*([dict(tax_year=2025, assessed_value=assessed)] if assessed else [])), HIST)
    s = spark.createDataFrame([("harris", "1", year, median and D(str(median)))], SUBJ)
    return tax_impact(s, j, r, h).first()


def test_tax_two_units(spark):
    row = impact(spark, [("U1", "", 40000, None, None), ("U2", "", None, 10, None)], [("U1", "0.02"), ("U2", "0.01")], 300000, 250000)
    assert (row["current_tax_owed"], row["median_tax_owed"], row["estimated_savings"]) == (D("7900.00"), D("6450.00"), D("1450.00"))
    assert row["completeness"] == "complete" and row["warnings"] == [] and row["effective_rate"] == D("0.015000")


def test_fixed_before_percent(spark):
    row = impact(spark, [("U1", "A", 10000, None, None), ("U1", "B", None, 10, None)], [("U1", "0.02")], 300000, 250000)
    assert (row["current_tax_owed"], row["median_tax_owed"], row["estimated_savings"]) == (D("5220.00"), D("4320.00"), D("900.00"))
    trail = row["exemptions_summary"][0]["trail"]
    assert [(t["before_current"], t["after_current"]) for t in trail] == [(D("300000.00"), D("290000.00")), (D("290000.00"), D("261000.00"))]


def test_missing_rate_is_partial(spark):
    row = impact(spark, [("U1", "", None, None, 300000), ("U2", "", None, None, 300000)], [("U1", "0.02")], 300000, 250000)
    assert row["completeness"] == "partial" and row["current_tax_owed"] == D("6000.00") and len(row["per_unit_breakdown"]) == 2
    assert row["warnings"][0].startswith("One or more jurisdiction rates")


def test_published_net_is_reproduced(spark):
    row = impact(spark, [("040", "", None, None, 693903), ("040", "EXEMPT", 188573, None, None)], [("040", "0.00878300")], 693903, 600000)
    assert row["current_tax_owed"] == D("4438.31") and row["median_tax_owed"] == D("3613.56")


def test_no_rows_and_no_year(spark):
    row = impact(spark, [], [], 300000, 250000)
    assert row["tax_year"] == 2025 and row["completeness"] == "missing" and "No jurisdiction" in row["warnings"][0]
    row = impact(spark, [], [], None, 250000)
    assert row["tax_year"] is None and "No assessment year" in row["warnings"][0]


def test_units_that_differ_in_blanks_count_once(spark):
    row = impact(spark, [(" U1", "", None, None, 1000), ("U1", "", None, None, 9999), ("  ", "", None, None, 5)], [(" U1", "0.1"), ("U1", "0.1")], 1, 1)
    assert row["current_tax_owed"] == D("100.00") and len(row["per_unit_breakdown"]) == 1


def _a_tables(spark):
    prop = spark.createDataFrame(
        [(f"{i}", "C", f"770{i:02d}", "OWN", D("0"), D(str(200000 + i * 10000)), D("0"), D("8000"), f"{i}", "OAK", 29.7 + i * 0.001, -95.4) for i in range(6)],
        "account_number string, city string, zipcode string, owner_name string, value decimal(14,2), assessed_value decimal(14,2), building_area decimal(14,2), land_area decimal(14,2), street_number string, street_name string, latitude double, longitude double",
    )
    building = spark.createDataFrame(
        [(f"{i}", n, "T", "STYLE", "K", "B", "Good", 2000, None, 0, D("1000") * (1 if n == 1 else 3), D("1"), 3, D("2"), True) for i in range(5) for n in (2, 1)],
        "account_number string, building_number int, building_type string, building_style string, building_class string, quality_code string, condition_code string, year_built int, year_remodeled int, effective_year int, heat_area decimal(10,2), stories decimal(4,2), bedrooms int, bathrooms decimal(4,2), is_active boolean",
    )
    feature = spark.createDataFrame([("0", "POOL", "Pool", True), ("0", "POOL", "Pool", True), ("1", "POOL", "", True), ("2", "GAR", "Garage", False)], "account_number string, feature_code string, feature_description string, is_active boolean")
    return prop, building, feature


def test_county_a_facts_and_comps(spark):
    facts = facts_a(*_a_tables(spark))
    rows = {r["key"]: r for r in facts.collect()}
    assert rows["0"]["features_5"] == "Pool (2)" and rows["1"]["features_5"] == "POOL" and rows["2"]["features_5"] == "None"
    assert rows["0"]["living_area"] == 1000.0 and rows["0"]["window_areas"] == [1000.0, 3000.0] and rows["5"]["living_area"] is None
    assert rows["0"]["effective_year"] == 2000 and rows["0"]["locality"] == "C, TX 77000"
    comps = find_comps(facts, facts, COUNTY_A_SPEC, 5.0, 3, 30.0)
    got = [(r["comp_key"], r["comp_rank"]) for r in comps.filter("subject_key = '0'").orderBy("comp_rank").collect()]
    assert got[0] == ("1", 1) and len(got) == 3
    # The property without a building has no area window and meets everybody.
    assert comps.filter("subject_key = '5'").count() == 3
    text = comps.filter("subject_key = '0' and comp_rank = 1").select(breakdown_text(F.col("score_breakdown")).alias("t")).first()["t"]
    assert text.startswith("Living Area: 24.0/24.0; Bedrooms: 14.0/14.0")


def test_county_b_uses_newest_year_and_primary_improvement(spark):
    account = spark.createDataFrame(
        [(p, y, "OWN", "1 OAK", "TOWN", "", D("300000"), 30.6, -96.3 + i * 0.001, D("1500"), 1990, "R4") for i, p in enumerate(("a", "b", "c")) for y in ((2024, 2025) if p != "c" else (2024,))],
        "prop_id string, tax_year int, owner_name string, situs_address string, situs_city string, situs_zip string, assessed_value decimal(14,2), latitude double, longitude double, living_area decimal(10,2), year_built int, class_code string",
    )
    imp = spark.createDataFrame([("a", 2025, "1", "R", 1980), ("a", 2025, "2", "R", 1999), ("b", 2025, "1", "C", 1950)], "prop_id string, tax_year int, imp_id string, improvement_type string, year_built int")
    ch = spark.createDataFrame([("a", 2025, "2", 3, D("2"), "BR", "S", "F")], "prop_id string, tax_year int, imp_id string, bedrooms int, bathrooms decimal(4,2), exterior_wall string, construction_style string, foundation string")
    detail = spark.createDataFrame([("a", 2025, "2", "SECOND FLOOR")], "prop_id string, tax_year int, imp_id string, detail_description string")
    land = spark.createDataFrame([("a", 2025, D("1"), D("0.25")), ("a", 2025, None, D("0.25"))], "prop_id string, tax_year int, land_value decimal(14,2), acreage decimal(12,4)")
    feat = spark.createDataFrame([("a", 2025, "Pool", "1"), ("a", 2025, "Pool", "1")], "prop_id string, tax_year int, feature_type string, feature_value string")
    facts = facts_b(account, imp, detail, ch, land, feat)
    row = facts.filter("key = 'a' and scope = 2025").first()
    assert row["effective_year"] == 1999 and row["stories"] == 2.0 and row["land_size"] == 0.5 and row["features_5"] == "Pool (1) x2"
    comps = find_comps(current_subjects(facts), facts, COUNTY_B_SPEC, 5.0)
    # c is known in 2024 only and is compared with the rows of that year.
    got = {(r["subject_key"], r["comp_key"], r["scope"]) for r in comps.collect()}
    assert got == {("a", "b", 2025), ("b", "a", 2025), ("c", "a", 2024), ("c", "b", 2024)}


def test_exemptions_are_folded_once(spark):
    """The fold is the work of the tax queries: the trail's plan holds it once."""
    from checks.catalog_years import exemption_trail

    plan = exemption_trail(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(records") == 1, plan
