from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import jurisdiction as J
from parcelwise.operators.loading import TooManyInvalidRows, outcome_counts, require_valid
from parcelwise.operators.rooms import fixture_rows, fixtures_pivot
from parcelwise.plans import publish as P
from parcelwise.sinks import manifest as M
from parcelwise.plans import roll_a as A
from parcelwise.plans import roll_b as B
from parcelwise.schemas import ACCOUNT, conform
from parcelwise.sinks import tables as T
from parcelwise.sources import files
from parcelwise.sources import fixed_width as W
from parcelwise.sources.delimited import Field, Table, apply_table, read_delimited, sniff_delimiter, sniff_encoding, valid_rows
from parcelwise.sources.pages import adopted_rates
from parcelwise.sources.parcels import locate, staged_coordinates, staged_parcels

D = Decimal


def put(path, text, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


ACCOUNT_HEAD = "acct\tmailto\tstr_num\tstr\tstr_sfx\tsite_addr_1\tsite_addr_2\tsite_addr_3\tstate_class\ttot_appr_val\tassessed_val\tbld_ar\tland_ar\n"


def account_line(acct, cls="A1", street='OAK "BIG', full=""):
    return f"{acct}\tOWNER é\t12\t{street}\tDR\t{full}\tHOUSTON\t77001\t{cls}\t$250,000\t240000\t1800\t7000\n"


def test_unbalanced_quotes_stay_in_their_row(spark, tmp_path):
    path = put(tmp_path / "real_acct.txt", ACCOUNT_HEAD + account_line("1") + account_line("2", street='"ELM') + account_line("3"))
    rows = A.property_table(A.stage_property(read_delimited(spark, path))).orderBy("account_number").collect()
    assert [r["account_number"] for r in rows] == ["1", "2", "3"]
    assert rows[0]["street_name"] == 'OAK "BIG DR' and rows[1]["address"] == '12 "ELM DR' and rows[0]["owner_name"] == "OWNER é"
    assert rows[0]["value"] == D("250000.00")


def test_property_outcomes_and_duplicates(spark, tmp_path):
    path = put(tmp_path / "real_acct.txt", ACCOUNT_HEAD + account_line("1", full="1 FIRST") + account_line("1", full="2 SECOND") + account_line("") + account_line("4", "F1") + "5\tshort\n")
    staged = A.stage_property(read_delimited(spark, path, "\t", "latin-1"))
    counts = outcome_counts(staged).first()
    assert (counts["processed"], counts["loaded"], counts["skipped"]) == (5, 2, 3)
    assert [r["address"] for r in A.property_table(staged).collect()] == ["1 FIRST"]


def test_sniffing(spark, tmp_path):
    assert sniff_delimiter(spark, put(tmp_path / "a.txt", "a|b|c\n1|2,5|3\n")) == "|"
    assert sniff_delimiter(spark, put(tmp_path / "b.txt", "a\tb,c\n")) == "\t"
    assert sniff_encoding(spark, put(tmp_path / "c.txt", "a\té\n", "utf-8")) == "utf-8"
    assert sniff_encoding(spark, put(tmp_path / "d.txt", "a\té\n", "latin-1")) == "latin-1"
    assert sniff_encoding(spark, put(tmp_path / "e.txt", "a\t\u20ac\n", "cp1252")) == "cp1252"
    late = put(tmp_path / "f.txt", "acct\towner\n" + "1\tX\n" * 100 + "2\tMUÑOZ\n", "latin-1")
    assert sniff_encoding(spark, late) == "latin-1"
    both = read_delimited(spark, [late, put(tmp_path / "g.txt", "acct|owner\n3|MUÑOZ\n", "utf-8")])
    assert {r["owner"] for r in both.where("acct > 1").collect()} == {"MUÑOZ"}


def test_long_keys_stay_apart(spark):
    long = "9" * 20
    rows = spark.createDataFrame([(long + "1", "A1", 1), (long + "2", "A1", 2)], "acct string, state_class string, pos int")
    assert A.property_table(A.stage_property(rows)).count() == 2


def test_field_errors(spark, tmp_path):
    path = put(tmp_path / "t.txt", "ACCT\tyear\n1\t1999\n\t2000\n3\t1200\n")
    table = Table("t", (Field("acct", ("account", "acct"), required=True), Field("year", ("year",), "int", validators=(lambda c: c > 1500,))))
    out = apply_table(read_delimited(spark, path, "\t", "utf-8"), table)
    assert {r["message"] for r in out.select(F.explode("errors").alias("e")).select("e.*").collect()} == {"Required field is empty", "Validation failed"}
    assert [r["acct"] for r in valid_rows(out).collect()] == ["1"]


def test_file_order_survives_small_splits(spark, tmp_path):
    lines = "".join(f"7\t1\tRMB\tRoom\t{i % 9}\n" for i in range(4000)) + "7\t1\tRMB\tRoom\t5\n7\t1\tRMF\tRoom\t2\n7\t1\tRMH\tRoom\t1\n7\t1\tRMH\tRoom\tx\n"
    path = put(tmp_path / "fixtures.txt", "acct\tbld_num\ttype\ttype_dscr\tunits\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_delimited(spark, path, "\t", "utf-8")
        assert raw.rdd.getNumPartitions() > 5
        row = fixtures_pivot(fixture_rows(raw).repartition(7)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # The last readable row of each type counts.
    assert (row["bedrooms"], row["full_baths"], row["half_baths"]) == (5, D("2.00"), 1)


def test_whole_roll_a(spark, tmp_path):
    root = tmp_path / "roll"
    put(root / "real_acct.txt", ACCOUNT_HEAD + account_line("1") + account_line("2", "F1"))
    put(root / "building_res.txt", "acct\tbld_num\timprv_type\tqa_cd\theat_ar\tbed_rm\tfull_bath\thalf_bath\n1\t\tT\tB\t1,500\t2\t1\t0\n1\t2\tT\tB\tx\t3\t1\t1\n9\t1\tT\tB\t1\t1\t1\t1\n")
    put(root / "fixtures.txt", "acct\tbld_num\ttype\ttype_dscr\tunits\n1\t1\tRMB\tx\t4\n1\t1\tRMF\tx\t2\n1\t1\tRMH\tx\t1\n")
    put(root / "extra_features.txt", "acct\tbld_num\tcount\tcd\tdscr\n1\t1\t1\tOLD\tsummary\n")
    put(root / "extra_features_detail1.txt", "acct\tcd\tdscr\tgrade\tbld_num\tunits\tasd_val\n1\tPOOL\tPool\tA\t1\t2\t5000\n1\tPOOL\tAgain\tA\t1\t2\t5000\n")
    put(root / "extra_features_detail2.txt", "acct\tcd\tdscr\tgrade\tbld_num\tunits\tasd_val\tl_dscr\n1\tGAR\tG\tA\t1\t2\t5\tGarage long\n")
    put(root / "desc_codes.txt", "x\n1\n")
    out = A.load_roll(spark, str(root))
    b = {r["building_number"]: r for r in out["building"].collect()}
    assert b[1]["bedrooms"] == 4 and b[1]["bathrooms"] == D("2.50") and b[1]["half_baths"] == 1 and b[1]["heat_area"] == D("1500.00")
    assert b[2]["bedrooms"] == 3 and b[2]["bathrooms"] == D("1.50") and b[2]["heat_area"] is None
    f = {r["feature_code"]: r for r in out["extra_feature"].collect()}
    assert set(f) == {"POOL", "GAR"} and f["POOL"]["feature_description"] == "Pool" and f["GAR"]["value"] == D("5.00")
    assert outcome_counts(out["staged_building"]).first()["invalid"] == 1
    with pytest.raises(TooManyInvalidRows):
        require_valid(out["staged_building"], 1)


def _small_roll(root):
    put(root / "real_acct.txt", ACCOUNT_HEAD + account_line("1") + account_line("2", "F1"))
    put(root / "building_res.txt", "acct\tbld_num\timprv_type\n1\t1\tT\n9\t1\tT\n")
    put(root / "fixtures.txt", "acct\tbld_num\ttype\ttype_dscr\tunits\n1\t1\tRMB\tx\t4\n")
    put(root / "extra_features.txt", "acct\tbld_num\tcount\tcd\tdscr\n1\t1\t1\tOLD\tsummary\n")
    put(root / "extra_features_detail1.txt", "acct\tcd\tdscr\tgrade\tbld_num\tunits\tasd_val\n1\tPOOL\tPool\tA\t1\t2\t5000\n")
    put(root / "extra_features_detail2.txt", "acct\tcd\tdscr\tgrade\tbld_num\tunits\tasd_val\n1\tGAR\tG\tA\t1\t2\t5\n")
    put(root / "desc_codes.txt", "x\n1\n")
    return str(root)


def test_published_only_past_the_gates(spark, tmp_path):
    root, out = _small_roll(tmp_path / "roll"), str(tmp_path / "out")
    with pytest.raises(TooManyInvalidRows):
        P.publish_roll_a(spark, root, out, max_invalid=1)
    assert not T.exists(spark, out)
    P.publish_roll_a(spark, root, out, max_invalid=2)
    assert M.read(spark, out, "building").count() == 1 and M.read(spark, out, "property").count() == 1


def test_jurisdictions_published_past_the_proof(spark, tmp_path):
    values = [("1", "040", "1,000", "800", 1), ("2", "040", "500", "500", 2)]
    table = lambda rows: spark.createDataFrame(rows, "acct string, tax_district string, appraised_val string, taxable_val string, pos int")
    exempt = spark.createDataFrame([("1", "040", "RES", "200", 1), ("1", "040", "NONE", "9", 2), ("1", "040", "OVR", "0", 3)], "acct string, tax_district string, exempt_cat string, exempt_val string, pos int")
    rates = spark.createDataFrame([("Real", "040", "County\x07", "0.5", 1)], "RP_TYPE string, tax_dist string, name string, published string, pos int")
    out = str(tmp_path / "jur")
    done = P.publish_jurisdictions_a(table(values), exempt, None, rates, None, 2025, out, "s")
    stored = {(r["account_number"], r["exemption_code"]): r for r in M.read(spark, out, "jurisdiction").collect()}
    assert set(stored) == {("1", ""), ("1", "RES"), ("2", "")} and stored["1", "RES"]["exemption_amount"] == D("200.00")
    assert stored["1", ""]["tax_unit_name"] == "County" and done["gaps"].first()["pairs"] == 2
    assert M.read(spark, out, "unit_rate").count() == 1
    # A net above the gross cannot be reproduced: nothing of the new year is stored.
    with pytest.raises(J.ProofFailed):
        P.publish_jurisdictions_a(table([("1", "040", "800", "1000", 1)]), exempt, None, rates, None, 2026, out, "s")
    assert M.read(spark, out, "jurisdiction").where("tax_year = 2026").count() == 0


def test_missing_files_are_named(spark, tmp_path):
    put(tmp_path / "r" / "real_acct.txt", ACCOUNT_HEAD)
    with pytest.raises(FileNotFoundError, match="building_res.txt, fixtures.txt, extra_features"):
        A.load_roll(spark, str(tmp_path / "r"))


def test_newest_copy():
    paths = ["/x/2025-07-23_002022_APPRAISAL_INFO.TXT", "/x/2025-08-01_000000_APPRAISAL_INFO.TXT", "/x/other.TXT"]
    assert files.newest_copy(paths, "APPRAISAL_INFO.TXT") == paths[1]
    assert files.newest_copy(paths, "NOPE.TXT") is None


def test_hearings_override_history(spark, tmp_path):
    root = tmp_path / "hist"
    head = "acct\tyr\tassessed_val\ttot_appr_val\ttot_mkt_val\tprior_tot_appr_val\tprior_tot_mkt_val\tnew_construction_val\tCap_acct\n"
    put(root / "2024/Real_acct_owner/real_acct.txt", head + "1\t2024\t280000\t300000\t310000\t\t\t0\tY\n2\t\t280000\t1\t1\t\t\t\tN\n")
    put(root / "2024/Hearing_files/arb_hearings_real.txt", "acct\tTax_Year\tFinal_Appraised_Value\n1\t2024\t999\n1\t2024\t295000\n2\t2024\t\n3\t2024\t210000\n")
    put(root / "2025/Real_acct_owner/real_acct.txt", head + "1\t2025\t300000\t1\t1\t\t\t\t\n")
    got = {(r["account_number"], r["tax_year"]): r for r in A.history_range(spark, str(root), 2024, 2025).collect()}
    assert got[("1", 2024)]["assessed_value"] == D("295000.00") and got[("1", 2024)]["appraised_value"] == D("300000.00")
    assert got[("2", 2024)]["assessed_value"] == D("280000.00")
    assert got[("3", 2024)]["assessed_value"] == got[("3", 2024)]["appraised_value"] == D("210000.00")
    assert ("1", 2025) in got and len(got) == 4
    with pytest.raises(FileNotFoundError):
        A.history_range(spark, str(root), 2023, 2024)


def cut(size, **at):
    """A fixed-width line from start offsets."""
    line = [" "] * size
    for start, text in at.values():
        line[start : start + len(text)] = text
    return "".join(line)


def test_fixed_width_lines(spark):
    land = cut(199, a=(0, "000000000042"), b=(12, "2025"), c=(16, "000000000001"), d=(28, "RES "), e=(38, "SINGLE  FAMILY"), f=(140, "00000002833677"), g=(178, "105024"))
    df = spark.createDataFrame([(land + "\r",), ("   ",)], "value string")
    row = W.slice_lines(df, W.LAND).collect()
    assert len(row) == 1 and row[0]["land_value"] == D("28336.77") and row[0]["acreage"] == D("10.5024")
    assert row[0]["land_use_description"] == "SINGLE FAMILY" and row[0]["prop_id"] == "000000000042" and row[0]["tax_year"] == 2025
    ent = spark.createDataFrame([(entity("000000000042", "02025", "G1", 242613, 167613, 75000, 676378, 243298),)], "value string")
    e = W.slice_lines(ent, W.ENTITY_INFO).first()
    assert (e["assessed_value"], e["taxable_value"], e["hs_amt"], e["market_value"], e["appraised_value"]) == tuple(D(x) for x in (242613, 167613, 75000, 676378, 243298))


def entity(prop, year, unit, assessed, taxable, hs, market, appraised, dp=0):
    n = lambda v: f"{v:015d}"
    return cut(500, a=(0, prop), b=(12, year), c=(41, "000000000007"), d=(53, unit), e=(63, f"Unit {unit}"), f=(148, n(assessed)), g=(163, n(taxable)), h=(298, n(hs)), i=(313, n(0)), j=(328, n(dp)), k=(388, n(market)), m=(403, n(appraised)))


def test_whole_roll_b(spark, tmp_path):
    root = tmp_path / "export" / "nested"
    p = "000000000042"
    put(root / "2025-07-01_000000_APPRAISAL_INFO.TXT", cut(1000, a=(0, p), b=(17, "02025"), c=(608, "MILLER  B & L"), d=(978, "77801"), e=(983, "1234")) + "\n" + cut(1000, a=(0, "000000000043"), b=(17, "02024"), c=(608, "OTHER YEAR")) + "\n")
    put(root / "2025-07-01_000000_APPRAISAL_IMPROVEMENT_INFO.TXT", cut(114, a=(0, p), b=(12, "2025"), c=(16, "9"), d=(28, "R")) + "\n")
    detail = lambda seq, year, value: cut(622, a=(0, p), b=(12, "2025"), c=(16, "9"), d=(28, f"{seq:012d}"), e=(50, "MAIN AREA"), f=(85, year), g=(93, "00001800.000000"), h=(108, value)) + "\n"
    put(root / "2025-07-01_000000_APPRAISAL_IMPROVEMENT_DETAIL.TXT", detail(1, "1980", "000000001000.0") + detail(2, "1998", "000000005000.0") + detail(3, "2001", "000000005000.0") + detail(4, "0000", "000000009000.0"))
    attr = lambda kind, val: cut(87, a=(0, p), b=(12, "2025"), c=(16, "9"), d=(28, "000000000001"), e=(52, kind), f=(77, val)) + "\n"
    put(root / "2025-07-01_000000_APPRAISAL_IMPROVEMENT_DETAIL_ATTR.TXT", attr("Exterior Wall", "CS") + attr("Exterior Wall", "BK") + attr("Number of Bedrooms", "x") + attr("Number of Bedrooms", "3") + attr("Plumbing", "1 3/4") + attr("Plumbing", "2 1/2") + attr("Fireplace", "1"))
    put(root / "2025-07-01_000000_APPRAISAL_ENTITY_INFO.TXT", entity(p, "02025", "G1", 200, 150, 50, 300, 250) + "\n" + entity(p, "02025", "S1", 200, 140, 0, 300, 250, dp=60) + "\n")
    out = B.load_roll(spark, str(tmp_path / "export"), 2025)
    account = out["account"].collect()
    assert len(account) == 1 and account[0]["owner_name"] == "MILLER B & L" and account[0]["mailing_zip"] == "77801-1234" and account[0]["assessed_value"] == D("200.00")
    assert out["improvement"].first()["year_built"] == 1998
    c = out["building_characteristic"].first()
    assert (c["exterior_wall"], c["bedrooms"], c["bathrooms"], c["half_baths"], c["foundation"]) == ("CS", 3, D("2.00"), 1, "")
    assert [r["feature_type"] for r in out["extra_feature"].collect()] == ["Fireplace"]
    jur = {(r["tax_unit_code"], r["exemption_code"]): r["exemption_amount"] for r in out["jurisdiction"].collect()}
    assert jur == {("G1", ""): None, ("G1", "HS"): D("50.00"), ("S1", ""): None, ("S1", "DP"): D("60.00")}


def test_history_b_gate(spark, tmp_path):
    put(tmp_path / "2025/a_APPRAISAL_ENTITY_INFO.TXT", entity("1", "02025", "G1", 200, 1, 0, 300, 250) + "\n" + entity("1", "02025", "G2", 999, 1, 0, 1, 1) + "\n")
    row = B.history_range(spark, str(tmp_path), 2025, 2025).first()
    assert row["assessed_value"] == D("200.00") and row["cap_account"] == "Y" and row["county"] == "brazos"
    put(tmp_path / "2024/a_APPRAISAL_ENTITY_INFO.TXT", entity("1", "02024", "G1", 200, 1, 0, 100, 250) + "\n")
    with pytest.raises(B.ImplausibleYear):
        B.history_range(spark, str(tmp_path), 2024, 2025)


def _staged(spark):
    base = spark.createDataFrame([("1", "040", D("693903"), D("505330"), 1), ("2", "040", D("296016"), D("0"), 2), ("3", "040", D("100"), D("100"), 3), ("4", "040", None, D("5"), 4)], "account_number string, tax_unit_code string, gross decimal(14,2), net decimal(14,2), pos int")
    ex = spark.createDataFrame([("1", "040", "RES", "Residential Homestead", D("1"), 1), ("1", "040", "HIS", "Historical", D("2"), 2), ("3", "040", "RES", "R", D("50"), 3)], "account_number string, tax_unit_code string, exemption_code string, description string, amount decimal(14,2), pos int")
    names = spark.createDataFrame([("040", "County")], "tax_unit_code string, tax_unit_name string")
    return base, ex, names


def test_jurisdiction_rows(spark):
    base, ex, names = _staged(spark)
    rows = J.jurisdiction_rows(base, ex, names, 2025, "harris", "src")
    got = {(r["account_number"], r["exemption_code"]): r for r in rows.collect()}
    assert got[("1", "HIS+RES")]["exemption_amount"] == D("188573.00") and got[("1", "HIS+RES")]["exemption_description"] == "Historical + Residential Homestead"
    assert got[("2", "EXEMPT")]["exemption_amount"] == D("296016.00")
    # Itemised but not applied: only the base row.
    assert [k for k in got if k[0] == "3"] == [("3", "")] and len(got) == 6
    gap = J.itemisation_gaps(base, ex).first()
    assert (gap["pairs"], gap["itemised_more"], gap["itemised_less"]) == (3, 1, 2)
    assert J.unproven_pairs(rows.filter("account_number <> '4'"), base.filter("account_number <> '4'")).count() == 0
    with pytest.raises(J.ProofFailed):
        J.require_proof(rows, base)


def test_staging_cleans_and_filters(spark):
    raw = spark.createDataFrame([("1\x00", " 040", "none", "5", 1), ("1", "040", "res", "0", 2), ("1", "040", "res\\", "$1,000", 3), ("", "040", "RES", "5", 4)], "acct string, tax_district string, exempt_cat string, exempt_val string, pos int")
    desc = spark.createDataFrame([("RES", "Homestead", 1)], "exempt_cat string, exemption_dscr string, pos int")
    rows = J.stage_exemptions(raw, desc).collect()
    assert [(r["exemption_code"], r["amount"], r["description"]) for r in rows] == [("RES", D("1000.00"), "Homestead")]


def test_rates_from_a_page(spark):
    html = "<table><tr><th colspan=4>2025 TAX RATES</th></tr><tr><th>JURISDICTION</th></tr><tr><td>G1 – County&nbsp;One</td><td>1</td><td>2</td><td>$0.419700</td></tr><tr><td>Total</td></tr></table>"
    rows = adopted_rates(spark.createDataFrame([("u", html)], "url string, html string")).orderBy("row_no").collect()
    assert (rows[0]["tax_unit_code"], rows[0]["adopted_rate"], rows[0]["tax_year"]) == ("G1", D("0.00419700"), 2025)
    assert rows[0]["adopted_rate"] * 200000 == D("839.40") and rows[1]["outcome"] == "skipped"


def test_parcels_of_both_counties(spark):
    ring = "array(named_struct('x',3540000d,'y',10210000d), named_struct('x',3540100d,'y',10210000d), named_struct('x',3540100d,'y',10210100d), named_struct('x',3540000d,'y',10210100d))"
    df = spark.sql(f"select 1 n, 42D PROP_ID, '5000' situs_num, 'NULL' situs_stre, 'SILVER HILL' situs_st_1, 'RD' situs_st_2, cast(null as string) situs_unit, 'A1' state_cd, 1500D living_are, 'R4' class_cd, 0 yr_built, 1998 yr_blt, {ring} ring")
    row = staged_parcels(locate(df, "EPSG:2277"), "n").first()
    assert row["prop_id"] == "000000000042" and row["situs_address"] == "5000 SILVER HILL RD" and row["year_built"] == 1998
    assert 30 < row["latitude"] < 31 and -97 < row["longitude"] < -96
    account = conform(spark.createDataFrame([("000000000042", 2025), ("000000000043", 2025)], "prop_id string, tax_year int"), ACCOUNT)
    updated = {r["prop_id"]: r for r in B.update_parcels(account, staged_parcels(locate(df, "EPSG:2277"), "n")).collect()}
    assert updated["000000000042"]["matched"] and updated["000000000042"]["class_code"] == "R4" and not updated["000000000043"]["matched"]
    twice = df.select("ring", F.lit("7").alias("ACCT"), F.lit("P").alias("PRCL_ID"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    assert staged_coordinates(locate(twice, "EPSG:2277"), "n").count() == 1


def test_table_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 2024, "harris", 1), ("a", 2025, "harris", 2), ("b", 2025, "brazos", 3)], "k string, tax_year int, county string, v int")
    T.replace_slices(df, path)
    T.replace_slices(spark.createDataFrame([("z", 2025, "harris", 9)], df.schema), path)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("z", 9)]
    flat = str(tmp_path / "flat")
    T.replace_table(df, flat)
    T.upsert(df.limit(0).unionByName(spark.createDataFrame([("a", 2025, "harris", 7)], df.schema)), flat, ["k", "tax_year"])
    T.insert_ignore(spark.createDataFrame([("a", 2025, "harris", 0), ("n", 1, "x", 5), ("n", 1, "x", 6)], df.schema), flat, ["k", "tax_year"], ["v"])
    assert sorted((r["k"], r["tax_year"], r["v"]) for r in spark.read.parquet(flat).collect()) == [("a", 2024, 1), ("a", 2025, 7), ("b", 2025, 3), ("n", 1, 5)]
    T.store(df, str(tmp_path / "dry"), dry_run=True)
    # Of a partitioned table only the touched partitions get new files.
    years = str(tmp_path / "years")
    T.upsert(df, years, ["k", "county", "tax_year"], ["county", "tax_year"])
    files = lambda: {r[0] for r in spark.read.parquet(years).select("_metadata.file_path").distinct().collect()}
    before = files()
    change = spark.createDataFrame([("a", 2025, "harris", 8), ("c", 2025, "harris", 4)], df.schema)
    T.upsert(change, years, ["k", "county", "tax_year"], ["county", "tax_year"])
    assert {f for f in before if "tax_year=2024" in f or "brazos" in f} < files()
    T.insert_ignore(change.withColumn("v", F.lit(0)).union(change.withColumn("k", F.lit("new"))), years, ["k", "county", "tax_year"], ["v"], ["county", "tax_year"])
    assert sorted((r["k"], r["tax_year"], r["v"]) for r in spark.read.parquet(years).collect()) == [
        ("a", 2024, 1), ("a", 2025, 8), ("b", 2025, 3), ("c", 2025, 4), ("new", 2025, 4),
    ]
    assert not T.exists(spark, str(tmp_path / "dry"))
    # A failing write leaves the old rows.
    with pytest.raises(Exception):
        T.replace_table(df.withColumn("v", F.raise_error(F.lit("broken")).cast("int")), flat)
    assert spark.read.parquet(flat).count() == 4
