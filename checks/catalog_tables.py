"""Registered queries: readiness, quality checks, reconciliation, search, features, exports, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog_comps import a_facts
from checks.registry import plain, query
from checks.catalog_years import _PAIRED, _UNITS, _r2
from checks.scoresql import (
    comps_ctes, curve_sql, difference_sql, half_up, jaccard_sql, percentage_sql, ranked_sql, category_sql, FACTS_A,
    Points as P,
)
from checks.views import duck_view as V
from checks.views import spark_view as view
from parcelwise.functions import columns as K
from parcelwise.functions import curves as C
from parcelwise.functions import geo as G
from parcelwise.operators import features as FE
from parcelwise.operators import quality as Q
from parcelwise.operators import search as S
from parcelwise.operators.comps import display_rank, ranked_comps, told, with_comp_facts
from parcelwise.operators.equity import PRICE, SUBJECT, comp_deltas
from parcelwise.plans.report import SharedTables, protest_comps, protest_report
from parcelwise.operators.scoring import COUNTY_A_SPEC
from parcelwise.session import cut_lineage
from parcelwise.sinks import exports as X


def _abf(spark, d):
    return view(spark, d, "v_property"), view(spark, d, "v_building"), view(spark, d, "v_feature")


# --------------------------------------------------------------------- readiness and quality

_READY = f"""
  rooms AS (SELECT DISTINCT account_number FROM {V('v_building')} b WHERE is_active AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL),
  act AS (SELECT DISTINCT account_number FROM {V('v_building')} b WHERE is_active),
  p AS (SELECT q.*, r.account_number IS NOT NULL AS has_rooms, a.account_number IS NOT NULL AS has_building,
               latitude IS NOT NULL AND longitude IS NOT NULL AS located
        FROM {V('v_property')} q LEFT JOIN rooms r ON r.account_number = q.account_number LEFT JOIN act a ON a.account_number = q.account_number)"""


@query("readiness_semi", f"WITH {_READY} SELECT account_number FROM p WHERE is_residential AND located AND has_rooms")
def readiness_semi(spark, d):
    p, b, _ = _abf(spark, d)
    return Q.ready_properties(p, b).select("account_number")


@query("readiness_flags", f"WITH {_READY} SELECT account_number, is_residential AND located AND has_rooms AS is_data_ready FROM p")
def readiness_flags(spark, d):
    p, b, _ = _abf(spark, d)
    return Q.refresh_readiness(p, b).select("account_number", "is_data_ready")


@query("missing_building_anti", f"WITH {_READY} SELECT account_number FROM p WHERE is_residential AND NOT has_building")
def missing_building_anti(spark, d):
    p, b, _ = _abf(spark, d)
    return Q.without_building(p, b).select("account_number")


@query("missing_rooms_anti", f"WITH {_READY} SELECT account_number FROM p WHERE is_residential AND NOT has_rooms")
def missing_rooms_anti(spark, d):
    p, b, _ = _abf(spark, d)
    return Q.without_rooms(p, b).select("account_number")


@query(
    "orphan_buildings",
    f"SELECT account_number, building_number FROM {V('v_building')} b WHERE account_number NOT IN (SELECT account_number FROM {V('v_property')} p)",
)
def orphan_buildings(spark, d):
    p, b, _ = _abf(spark, d)
    return Q.orphans(b, p).select("account_number", "building_number")


@query(
    "orphan_link_counts",
    f"""SELECT count(*) FILTER (WHERE account_number IN (SELECT account_number FROM {V('v_property')} p)) AS linked,
               count(*) FILTER (WHERE account_number NOT IN (SELECT account_number FROM {V('v_property')} p)) AS orphaned FROM {V('v_feature')} f""",
)
def orphan_link_counts(spark, d):
    p, _, f = _abf(spark, d)
    return Q.link_counts(f, p)


@query(
    "duplicate_keys",
    f"""SELECT count(*) AS duplicate_groups FROM (SELECT 1 FROM {V('v_feature')} f GROUP BY account_number, feature_code, feature_number HAVING count(*) > 1) t""",
)
def duplicate_keys(spark, d):
    return Q.duplicate_groups(view(spark, d, "v_feature"), ["account_number", "feature_code", "feature_number"])


_LEVEL = "CASE WHEN pct >= 90 THEN 'pass' WHEN pct >= 50 THEN 'warn' ELSE 'fail' END AS level"


@query(
    "completeness_grade",
    f"""WITH m AS (SELECT * FROM {V('v_building')} b WHERE is_active AND account_number IN (SELECT account_number FROM {V('v_property')} p WHERE is_residential)),
    c AS (SELECT 'bedrooms' AS column_name, count(*) FILTER (WHERE bedrooms IS NULL) AS missing, count(*) AS total FROM m
          UNION ALL SELECT 'bathrooms', count(*) FILTER (WHERE bathrooms IS NULL), count(*) FROM m
          UNION ALL SELECT 'quality_code', count(*) FILTER (WHERE coalesce(quality_code, '') = ''), count(*) FROM m
          UNION ALL SELECT 'heat_area', count(*) FILTER (WHERE heat_area IS NULL), count(*) FROM m),
    g AS (SELECT *, (1.0 - missing / CAST(total AS DOUBLE)) * 100.0 AS pct FROM c)
    SELECT column_name, missing, total, round(pct, 4) AS pct, {_LEVEL} FROM g""",
)
def completeness_grade(spark, d):
    p, b, _ = _abf(spark, d)
    return plain(Q.building_completeness(b, p), 4)


def _check(name: str, missing: str, total: str, level: str) -> str:
    return f"""SELECT '{name}' AS "check", {level} AS level, CAST({missing} AS BIGINT) AS missing, CAST({total} AS BIGINT) AS total FROM t"""


def _graded(missing: str, tolerance: float) -> str:
    return f"CASE WHEN {missing} = 0 THEN 'pass' WHEN {missing} / CAST(res AS DOUBLE) * 100 <= {tolerance} THEN 'warn' ELSE 'fail' END"


def _zero(missing: str, bad: str = "fail") -> str:
    return f"CASE WHEN {missing} = 0 THEN 'pass' ELSE '{bad}' END"


_CHECKS = " UNION ALL ".join(
    [
        _check("properties_present", "CASE WHEN n > 0 THEN 0 ELSE 1 END", "n", "CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END"),
        _check("residential_properties", "0", "res", "'info'"),
        _check("ready_properties", "0", "ready", "'info'"),
        _check("state_class", "no_class", "n", _zero("no_class")),
        _check("residential_only", "other", "n", _zero("other")),
        _check("active_building", "no_building", "res", _graded("no_building", 1.0)),
        _check("room_counts", "no_rooms", "res", _graded("no_rooms", 1.0)),
        _check("coordinates", "no_place", "res", _graded("no_place", 1.0)),
        _check("readiness", "not_ready", "res", _graded("not_ready", 1.0)),
        _check("coordinate_coverage", "no_place", "res", "CASE WHEN no_place = 0 THEN 'pass' WHEN (res - no_place) / CAST(res AS DOUBLE) * 100 >= 99 THEN 'warn' ELSE 'fail' END"),
        _check("duplicate_properties", "dp", "gp", _zero("dp")),
        _check("duplicate_buildings", "db", "gb", _zero("db")),
        _check("duplicate_features", "df", "gf", _zero("df")),
        _check("orphan_buildings", "ob", "nb", _zero("ob", "warn")),
        _check("orphan_features", "of_", "nf", _zero("of_", "warn")),
        _check("active_buildings_present", "CASE WHEN nb > 0 THEN 0 ELSE 1 END", "nb", "CASE WHEN nb > 0 THEN 'pass' ELSE 'fail' END"),
        *[
            _check(f"populated_{c}", f"m_{c}", "m", f"CASE WHEN (1 - m_{c} / CAST(m AS DOUBLE)) * 100 >= 90 THEN 'pass' WHEN (1 - m_{c} / CAST(m AS DOUBLE)) * 100 >= 50 THEN 'warn' ELSE 'fail' END")
            for c in ("bedrooms", "bathrooms", "quality_code", "heat_area")
        ],
    ]
)


@query(
    "validation_suite",
    f"""WITH {_READY},
    bld AS (SELECT * FROM {V('v_building')} b WHERE is_active), feat AS (SELECT * FROM {V('v_feature')} f WHERE is_active),
    mine AS (SELECT * FROM bld WHERE account_number IN (SELECT account_number FROM p WHERE is_residential)),
    t AS (SELECT
      (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM p WHERE is_residential) AS res, (SELECT count(*) FROM p WHERE is_data_ready) AS ready,
      (SELECT count(*) FROM p WHERE state_class = '') AS no_class, (SELECT count(*) FROM p WHERE NOT is_residential) AS other,
      (SELECT count(*) FROM p WHERE is_residential AND NOT is_data_ready) AS not_ready, (SELECT count(*) FROM p WHERE is_residential AND NOT has_building) AS no_building,
      (SELECT count(*) FROM p WHERE is_residential AND NOT has_rooms) AS no_rooms, (SELECT count(*) FROM p WHERE is_residential AND NOT located) AS no_place,
      (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY account_number HAVING count(*) > 1)) AS dp, (SELECT count(DISTINCT account_number) FROM p) AS gp,
      (SELECT count(*) FROM (SELECT 1 FROM bld GROUP BY account_number, building_number HAVING count(*) > 1)) AS db,
      (SELECT count(*) FROM (SELECT 1 FROM bld GROUP BY account_number, building_number)) AS gb,
      (SELECT count(*) FROM (SELECT 1 FROM feat GROUP BY account_number, feature_code, feature_number HAVING count(*) > 1)) AS df,
      (SELECT count(*) FROM (SELECT 1 FROM feat GROUP BY account_number, feature_code, feature_number)) AS gf,
      (SELECT count(*) FROM bld WHERE account_number NOT IN (SELECT account_number FROM p)) AS ob, (SELECT count(*) FROM bld) AS nb,
      (SELECT count(*) FROM feat WHERE account_number NOT IN (SELECT account_number FROM p)) AS of_, (SELECT count(*) FROM feat) AS nf,
      (SELECT count(*) FROM mine) AS m, (SELECT count(*) FROM mine WHERE bedrooms IS NULL) AS m_bedrooms, (SELECT count(*) FROM mine WHERE bathrooms IS NULL) AS m_bathrooms,
      (SELECT count(*) FROM mine WHERE quality_code = '') AS m_quality_code, (SELECT count(*) FROM mine WHERE heat_area IS NULL) AS m_heat_area),
    c AS ({_CHECKS})
    SELECT *, CASE WHEN total > 0 THEN round(missing / CAST(total AS DOUBLE) * 100, 4) END AS pct FROM c""",
)
def validation_suite(spark, d):
    return plain(Q.validate(*_abf(spark, d)), 4)


@query(
    "presence_check",
    f"""SELECT count(*) AS properties, count(latitude) AS located, count(*) = 0 AS needs_import, count(*) > 0 AND count(latitude) / greatest(count(*), 1) * 100.0 < 10 AS needs_coordinates FROM {V('v_property')} p""",
)
def presence_check(spark, d):
    return Q.presence(view(spark, d, "v_property"))


_RECON = f"""{_READY},
  r AS (SELECT *, upper(trim(state_class)) AS cls, upper(trim(state_class)) IN ('A1', 'A2', 'A4', 'E1') AS home FROM p)"""


@query(
    "reconcile_preview",
    f"""WITH {_RECON}
    SELECT count(*) AS properties_examined, count(*) FILTER (WHERE cls <> state_class) AS state_classes_normalized,
           count(*) FILTER (WHERE home <> is_residential) AS residential_flags_synced, count(*) FILTER (WHERE home AND has_rooms AND located) AS effective_ready_properties,
           count(*) FILTER (WHERE NOT home) AS non_residential_properties, count(*) FILTER (WHERE home AND NOT (has_rooms AND located)) AS incomplete_properties,
           count(*) FILTER (WHERE cls = '') AS missing_state_class,
           (SELECT count(*) FROM {V('v_building')} b WHERE account_number NOT IN (SELECT account_number FROM p)) AS orphaned_buildings,
           (SELECT count(*) FROM {V('v_feature')} f WHERE account_number NOT IN (SELECT account_number FROM p)) AS orphaned_features FROM r""",
)
def reconcile_preview(spark, d):
    return Q.reconcile_preview(*_abf(spark, d))


@query(
    "reconcile_kept",
    f"WITH {_RECON} SELECT account_number, cls AS state_class FROM r WHERE home AND has_rooms AND located",
)
def reconcile_kept(spark, d):
    return Q.reconcile(*_abf(spark, d))["property"].select("account_number", "state_class")


@query(
    "reconcile_kept_features",
    f"""WITH {_RECON} SELECT account_number, count(*) AS n FROM {V('v_feature')} f
        WHERE account_number IN (SELECT account_number FROM r WHERE home AND has_rooms AND located) GROUP BY 1""",
)
def reconcile_kept_features(spark, d):
    kept = Q.reconcile(*_abf(spark, d))["extra_feature"]
    return kept.groupBy("account_number").agg(F.count(F.lit(1)).alias("n"))


def _snapshot(spark, d):
    drift = F.create_map(F.lit("assessed_value"), F.lit("revalued"))
    empty = F.create_map().cast("map<string,string>")
    return view(spark, d, "v_snapshot").withColumn("known_drift", F.when(F.col("drifts"), drift).otherwise(empty))


@query(
    "snapshot_mismatches",
    f"""WITH a AS (SELECT * FROM {V('v_account_b')} a WHERE tax_year = 2024),
    j AS (SELECT s.prop_id, s.drifts, a.prop_id IS NOT NULL AS found, trim(coalesce(a.situs_address, '')) AS ours, coalesce(s.situs_address_full, '') AS theirs,
                 trim(a.owner_name) AS our_owner, trim(s.owner_name) AS owner, CAST(floor(CAST(a.assessed_value AS DOUBLE)) AS BIGINT) AS our_value, s.assessed_value AS val
          FROM {V('v_snapshot')} s LEFT JOIN a ON a.prop_id = s.prop_id),
    m AS (SELECT prop_id, drifts, 'situs_address' AS field, ours AS loaded, theirs AS published FROM j
            WHERE found AND CASE WHEN ours <> '' THEN NOT starts_with(theirs, ours) ELSE theirs <> '' END
          UNION ALL SELECT prop_id, drifts, 'owner_name', our_owner, owner FROM j WHERE found AND owner <> '' AND our_owner <> owner
          UNION ALL SELECT prop_id, drifts, 'assessed_value', CAST(our_value AS VARCHAR), CAST(val AS VARCHAR) FROM j WHERE found AND val IS NOT NULL AND our_value IS DISTINCT FROM val
          UNION ALL SELECT prop_id, drifts, 'missing', NULL, prop_id FROM j WHERE NOT found)
    SELECT prop_id, field, loaded, published, CASE WHEN drifts AND field = 'assessed_value' THEN 'revalued' END AS reason,
           CASE WHEN drifts AND field = 'assessed_value' THEN 'known_drift' ELSE 'failure' END AS verdict FROM m""",
)
def snapshot_mismatches(spark, d):
    account = view(spark, d, "v_account_b").filter("tax_year = 2024")
    return Q.snapshot_mismatches(_snapshot(spark, d), account)


# --------------------------------------------------------------------- search

_FOUND = f"(SELECT * FROM {V('v_property')} p0 WHERE contains(lower(owner_name), '#00000') AND contains(lower(address), 'elm 1'))"
_PARAMS = {"last_name": "#00000", "address": "Elm 1", "sort": "assessed_value", "dir": "desc"}


@query(
    "search_contains_sort",
    f"""SELECT account_number, owner_name, row_number() OVER (ORDER BY assessed_value DESC NULLS FIRST, street_number ASC NULLS LAST, street_name ASC NULLS LAST, account_number) AS nth
        FROM {_FOUND} p QUALIFY nth <= 200""",
)
def search_contains_sort(spark, d):
    found = S.search_filter(view(spark, d, "v_property"), S.SEARCH_A, _PARAMS)
    order = [*S.search_order(S.SEARCH_A, _PARAMS), F.col("account_number")]
    page = S.search_page(found, order)
    from pyspark.sql import Window

    # The page holds at most 200 rows.
    nth = F.row_number().over(Window.orderBy(*order)).cast("long")
    return page.select("account_number", "owner_name", nth.alias("nth"))


@query(
    "page_of_n",
    f"""SELECT account_number FROM (SELECT *, row_number() OVER (ORDER BY zipcode NULLS LAST, street_number NULLS LAST, street_name NULLS LAST, account_number) AS nth
        FROM {V('v_property')} p WHERE contains(zipcode, '7700')) t WHERE nth > 200 AND nth <= 400""",
)
def page_of_n(spark, d):
    params = {"zip_code": "7700"}
    found = S.search_filter(view(spark, d, "v_property"), S.SEARCH_A, params)
    order = [*S.search_order(S.SEARCH_A, params), F.col("account_number")]
    return S.search_page(found, order, page=2).select("account_number")


_FEATURE_TEXT = f"""
  lbl AS (SELECT account_number, coalesce(nullif(feature_description, ''), nullif(feature_code, ''), 'Unknown') AS label, count(*) AS n
          FROM {V('v_feature')} f WHERE is_active GROUP BY 1, 2),
  ord AS (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY label) AS nth FROM lbl),
  txt AS (SELECT account_number, string_agg(CASE WHEN n > 1 THEN concat(label, ' (', n, ')') ELSE label END, ', ' ORDER BY label) AS features
          FROM ord WHERE nth <= 5 GROUP BY 1)"""


@query(
    "search_rows_a",
    f"""WITH {_FEATURE_TEXT},
    fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY building_number) AS rn FROM {V('v_building')} b WHERE is_active) t WHERE rn = 1)
    SELECT p.account_number, p.street_number AS address, p.zipcode AS zip_code, CAST(coalesce(nullif(assessed_value, 0), nullif(value, 0)) AS DOUBLE) AS assessed_value,
           round(CASE WHEN coalesce(nullif(assessed_value, 0), nullif(value, 0)) <> 0 AND building_area > 0 THEN CAST(coalesce(nullif(assessed_value, 0), nullif(value, 0)) AS DOUBLE) / CAST(building_area AS DOUBLE) END, 4) AS ppsf,
           fb.bedrooms, CAST(fb.bathrooms AS DOUBLE) AS bathrooms, fb.quality_code, txt.features
    FROM {_FOUND} p LEFT JOIN fb ON fb.account_number = p.account_number LEFT JOIN txt ON txt.account_number = p.account_number""",
)
def search_rows_a(spark, d):
    p, b, f = _abf(spark, d)
    rows = S.search_rows_a(S.search_filter(p, S.SEARCH_A, _PARAMS), b, f)
    return plain(
        rows.select(
            "account_number", "address", "zip_code", "assessed_value", "ppsf", "bedrooms", "bathrooms", "quality_code", "features"
        ),
        4,
    )


@query(
    "search_rows_b",
    f"""WITH t AS (SELECT prop_id, tax_year, CAST(sum(land_value) AS DOUBLE) AS land_value, CAST(sum(acreage) AS DOUBLE) AS acreage FROM {V('v_land_b')} l GROUP BY 1, 2)
    SELECT a.prop_id, a.owner_name, a.situs_address AS address, a.situs_city AS city, a.situs_zip AS zip_code, t.land_value, t.acreage, true AS has_location
    FROM {V('v_account_b')} a LEFT JOIN t ON t.prop_id = a.prop_id AND t.tax_year = a.tax_year
    WHERE a.tax_year = (SELECT max(tax_year) FROM {V('v_account_b')} x) AND contains(lower(a.situs_address), '1 oak')""",
)
def search_rows_b(spark, d):
    found = S.search_accounts_b(view(spark, d, "v_account_b"), {"address": "1 OAK"})
    return plain(S.search_rows_b(found, view(spark, d, "v_land_b")), 4)


@query(
    "building_facets",
    f"SELECT account_number, building_number FROM {V('v_building')} b WHERE is_active AND building_style = 'PROMO' AND contains(account_number, '1')",
)
def building_facets(spark, d):
    out = S.building_facets(view(spark, d, "v_building"), is_active=True, building_style="PROMO", text="1")
    return out.select("account_number", "building_number")


@query(
    "property_facets",
    f"SELECT account_number FROM {V('v_property')} p WHERE city = 'CITY 3' AND (contains(lower(account_number), 'elm 1') OR contains(lower(address), 'elm 1') OR contains(lower(owner_name), 'elm 1'))",
)
def property_facets(spark, d):
    return S.property_facets(view(spark, d, "v_property"), city="CITY 3", text="Elm 1").select("account_number")


@query(
    "csv_safe_projection",
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY zipcode NULLS LAST, street_number NULLS LAST, street_name NULLS LAST, account_number) AS nth
                   FROM (SELECT *, concat(CASE WHEN length(account_number) % 2 = 0 THEN '=' ELSE '' END, owner_name) AS own FROM {V('v_property')} p WHERE contains(zipcode, '77')) q)
    SELECT account_number AS "Account Number", CASE WHEN substr(own, 1, 1) IN ('=', '+', '-', '@') THEN concat('''', own) ELSE own END AS "Owner",
           coalesce(CAST(assessed_value AS VARCHAR), '') AS "Assessed Value" FROM f""",
)
def csv_safe_projection(spark, d):
    params = {"zip_code": "77"}
    mark = F.when(F.length("account_number") % 2 == 0, F.lit("=")).otherwise(F.lit(""))
    found = S.search_filter(view(spark, d, "v_property"), S.SEARCH_A, params)
    found = found.withColumn("owner_name", F.concat(mark, "owner_name"))
    columns = [
        X.ExportColumn("Account Number", "account_number"), X.ExportColumn("Owner", "owner_name"),
        X.ExportColumn("Assessed Value", "assessed_value", "currency"),
    ]
    return X.search_export(found, columns, [*S.search_order(S.SEARCH_A, params), F.col("account_number")])


# --------------------------------------------------------------------- features


@query(
    "feature_counts",
    f"SELECT account_number, feature_code, count(*) AS feature_count FROM {V('v_feature')} f WHERE feature_code <> '' GROUP BY 1, 2",
)
def feature_counts(spark, d):
    return FE.feature_counts(view(spark, d, "v_feature"), ["account_number"])


@query("feature_list_text", f"WITH {_FEATURE_TEXT} SELECT account_number, features FROM txt")
def feature_list_text(spark, d):
    return FE.profile_a(view(spark, d, "v_feature")).select("account_number", F.col("features_5").alias("features"))


@query(
    "feature_list_text_b",
    f"""WITH lbl AS (SELECT prop_id, tax_year, CASE WHEN feature_value <> '' THEN concat(feature_type, ' (', feature_value, ')') ELSE feature_type END AS label, count(*) AS n
                     FROM {V('v_feature_b')} f GROUP BY 1, 2, 3),
    ord AS (SELECT *, row_number() OVER (PARTITION BY prop_id, tax_year ORDER BY label) AS nth FROM lbl)
    SELECT prop_id, tax_year, string_agg(CASE WHEN n > 1 THEN concat(label, ' x', n) ELSE label END, ', ' ORDER BY label) AS features FROM ord WHERE nth <= 5 GROUP BY 1, 2""",
)
def feature_list_text_b(spark, d):
    out = FE.profile_b(view(spark, d, "v_feature_b"))
    return out.select("prop_id", "tax_year", F.col("features_5").alias("features"))


@query(
    "jaccard_features",
    f"""WITH c AS (SELECT account_number, list_sort(list(DISTINCT feature_code)) AS codes FROM {V('v_feature')} f WHERE is_active AND feature_code <> '' GROUP BY 1)
    SELECT a.account_number, round({jaccard_sql('a.codes', 'b.codes')}, 6) AS similarity
    FROM c a JOIN c b ON CAST(b.account_number AS BIGINT) = CAST(a.account_number AS BIGINT) + 1""",
)
def jaccard_features(spark, d):
    codes = FE.profile_a(view(spark, d, "v_feature")).select(F.col("account_number").cast("long").alias("k"), "feature_codes")
    nxt = codes.select((F.col("k") - 1).alias("k"), F.col("feature_codes").alias("next_codes"))
    sim = C.jaccard(F.col("feature_codes"), F.col("next_codes"))
    return codes.join(nxt, "k").select(F.col("k").cast("string").alias("account_number"), F.round(sim, 6).alias("similarity"))


# --------------------------------------------------------------------- scalar functions

_GAP = "CAST(p_size AS DOUBLE) / 60"


@query(
    "curve_similarities",
    f"""SELECT p_partkey,
        {half_up(percentage_sql('p_retailprice', '(p_retailprice * (1 + ' + _GAP + '))', P.LIVING_AREA_CURVE), 6)} AS living_area,
        {half_up(percentage_sql('p_retailprice', '(p_retailprice * (1 + ' + _GAP + '))', P.LAND_CURVE), 6)} AS land,
        {half_up(difference_sql('p_size', '(p_size % 7)', P.BEDROOM_CURVE), 6)} AS bedrooms,
        {half_up(difference_sql('p_size / 10.0', '(p_size % 4)', P.BATHROOM_CURVE), 6)} AS bathrooms,
        {half_up(difference_sql('p_size', '0', P.AGE_CURVE), 6)} AS age,
        {half_up(difference_sql('p_size / 25.0', '0', P.STORY_CURVE), 6)} AS stories,
        {half_up(curve_sql(_GAP, P.DISTANCE_CURVE), 6)} AS distance,
        {ranked_sql("substr('XABCDEF', 1 + p_size % 7, 1)", "substr('FEDCBAZ', 1 + p_size % 5 + p_size % 3, 1)")} ::DOUBLE AS quality,
        {category_sql('p_type', 'p_brand')}::DOUBLE AS category
      FROM part""",
)
def curve_similarities(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    size, price, other = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("other")
    r = lambda c: F.round(c, 6)
    letter = F.substring(F.lit("XABCDEF"), 1 + F.col("p_size") % 7, F.lit(1))
    back = F.substring(F.lit("FEDCBAZ"), 1 + F.col("p_size") % 5 + F.col("p_size") % 3, F.lit(1))
    staged = part.select(
        "*",
        (price * (1 + size / 60)).alias("other"),
        letter.alias("letter"),
        back.alias("back"),
    )
    return staged.select(
        "p_partkey",
        r(C.percentage_similarity(price, other, C.LIVING_AREA_CURVE)).alias("living_area"),
        r(C.percentage_similarity(price, other, C.LAND_CURVE)).alias("land"),
        r(C.difference_similarity(size, F.col("p_size") % 7, C.BEDROOM_CURVE)).alias("bedrooms"),
        r(C.difference_similarity(size / 10, F.col("p_size") % 4, C.BATHROOM_CURVE)).alias("bathrooms"),
        r(C.difference_similarity(size, F.lit(0), C.AGE_CURVE)).alias("age"),
        r(C.difference_similarity(size / 25, F.lit(0), C.STORY_CURVE)).alias("stories"),
        r(C.distance_similarity(size / 60, 1.0)).alias("distance"),
        C.ranked_code_similarity(F.col("letter"), F.col("back")).alias("quality"),
        C.categorical_similarity(F.col("p_type"), F.col("p_brand")).alias("category"),
    )


_PLACE = f"SELECT account_number, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon FROM {V('v_property')} q"


@query(
    "haversine_pairs",
    f"""WITH p AS ({_PLACE})
    SELECT a.account_number, round(3959.0 * 2 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))), 4) AS haversine,
           round(CASE WHEN a.lat + b.lat IS NOT NULL THEN 3959.0 * acos(least(1.0, greatest(-1.0, cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon) - radians(a.lon)) + sin(radians(a.lat)) * sin(radians(b.lat))))) END, 4) AS cosine
    FROM p a JOIN p b ON CAST(b.account_number AS BIGINT) = CAST(a.account_number AS BIGINT) + 1""",
)
def haversine_pairs(spark, d):
    p = view(spark, d, "v_property").select(
        F.col("account_number").cast("long").alias("k"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")
    )
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    args = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return p.join(nxt, "k").select(
        F.col("k").cast("string").alias("account_number"),
        F.round(G.haversine_miles(*args), 4).alias("haversine"),
        F.round(G.cosine_miles(*args), 4).alias("cosine"),
    )


@query(
    "bbox_filter",
    f"""WITH p AS ({_PLACE}) SELECT account_number FROM p
        WHERE lat BETWEEN 29.7 - 5 / 69.0 AND 29.7 + 5 / 69.0 AND lon BETWEEN -95.4 - 5 / (69.0 * cos(radians(29.7))) AND -95.4 + 5 / (69.0 * cos(radians(29.7)))""",
)
def bbox_filter(spark, d):
    p = view(spark, d, "v_property")
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    inside = G.bounding_box(lat, lon, F.lit(29.7), F.lit(-95.4), F.lit(5.0))
    return p.filter(inside).select("account_number")


@query(
    "clean_columns",
    """SELECT c_custkey, upper(trim(concat(' ', lower(c_mktsegment), ' '))) AS state_class, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 1000 AS INT) END AS as_int,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1000.5 + c_custkey % 10 END::DOUBLE AS as_money, round(CAST(c_custkey AS DOUBLE) / 100, 2) AS implied,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INT) END AS nonzero_int, c_custkey % 2 = 0 AS flag,
         CASE WHEN c_custkey % 2 = 0 THEN '77001-1234' ELSE '77001' END AS zip, concat('a b', CAST(c_custkey % 4 AS VARCHAR)) AS squeezed,
         lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS padded, CAST(c_custkey % 10 AS INT) AS digit, concat('TOWN, TX ', CAST(77000 + c_nationkey AS VARCHAR)) AS locality,
         CASE WHEN c_custkey % 4 = 0 THEN concat('''=', c_name) ELSE c_name END AS csv, concat('$', format('{:,}', CAST(c_custkey * 1000 AS BIGINT))) AS money_text FROM customer""",
)
def clean_columns(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    text = k.cast("string")
    return plain(
        c.select(
            "c_custkey",
            K.state_class(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))).alias("state_class"),
            K.to_int(F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.concat((k % 1000).cast("string"), F.lit(".90")))).alias("as_int"),
            K.to_decimal(F.when(k % 5 == 0, F.lit("-")).otherwise(F.concat(F.lit("$1,00"), (k % 10).cast("string"), F.lit(".50")))).alias("as_money"),
            K.implied_decimal(F.lpad(text, 12, "0"), 2).alias("implied"),
            K.int_or_null(F.lpad((k % 7).cast("string"), 4, "0")).alias("nonzero_int"),
            K.to_bool(F.when(k % 2 == 0, F.lit(" Yes")).otherwise(F.lit("no"))).alias("flag"),
            K.zip_plus_four(F.lit("77001"), F.when(k % 2 == 0, F.lit("1234")).otherwise(F.lit(""))).alias("zip"),
            K.collapse_spaces(F.concat(F.lit("  a   b"), (k % 4).cast("string"), F.lit(" "))).alias("squeezed"),
            K.padded_property_id(k).alias("padded"),
            K.quality_digit(F.concat(F.lit("r"), (k % 10).cast("string"), F.lit("7"))).alias("digit"),
            K.locality_line(F.lit("TOWN"), (77000 + F.col("c_nationkey")).cast("string")).alias("locality"),
            K.csv_safe(F.concat(F.when(k % 4 == 0, F.lit("=")).otherwise(F.lit("")), F.col("c_name"))).alias("csv"),
            K.currency(k * 1000).alias("money_text"),
        )
    )


# --------------------------------------------------------------------- exports and reports


@query(
    "comps_export",
    f"""WITH {comps_ctes('a', 10.0, None, 10, 30.0)}
    SELECT c.subject_key, c.comp_key, c.address, format('{{:.1f}}', score) AS similarity_score, match_label AS similarity_label,
           coalesce(CAST(round(CAST(nullif(c.assessed, 0) AS DECIMAL(18,4)), 2)::DECIMAL(18,2) AS VARCHAR), '') AS assessed_value,
           coalesce(CAST(CAST({half_up('ppsf', 2)} AS DECIMAL(18,2)) AS VARCHAR), '') AS value_per_sqft
    FROM comps c""",
)
def comps_export(spark, d):
    facts = cut_lineage(a_facts(spark, d))
    comps = ranked_comps(facts, facts, COUNTY_A_SPEC, 10.0, 10, 30.0, shown=PRICE, asked=SUBJECT)
    # Two branches read it, and it is at the end of the whole search. Other facts and the breakdown follow where they are read.
    shown = cut_lineage(display_rank(comp_deltas(with_comp_facts(comps, facts, PRICE), facts), 10, together=True))
    out = X.comps_export(told(with_comp_facts(shown, facts), COUNTY_A_SPEC))
    keyed = shown.select("subject_key", "display_rank", "comp_key")
    return out.join(keyed, ["subject_key", "display_rank"]).select(
        "subject_key", "comp_key", "address", "similarity_score", "similarity_label", "assessed_value", "value_per_sqft"
    )


@query(
    "report_heads",
    f"""WITH {FACTS_A}
    SELECT key, CAST(n AS INT) AS line_no, CASE n WHEN 0 THEN 'Harris County Property Tax Protest Evidence Report' WHEN 1 THEN concat('Account Number: ', key)
             WHEN 2 THEN concat('Property: ', address)
             ELSE concat('Assessed Value: ', CASE WHEN assessed <> 0 THEN concat('$', format('{{:,}}', CAST(round_even(assessed, 0) AS BIGINT))) ELSE 'unavailable' END) END AS line
    FROM subjects CROSS JOIN (SELECT unnest(range(4)) AS n) r""",
)
def report_heads(spark, d):
    none = F.array()
    inputs = a_facts(spark, d).filter("has_location").select(
        "key", "address", "assessed_value", "living_area", "value_per_sqft",
        none.cast("array<struct<tax_year:int,assessed_value:double,increase_percent:double,cap_label:string>>").alias("history"),
        none.cast("array<struct<display_rank:int,address:string,similarity_score:double,value_per_sqft:double>>").alias("comps"),
        F.lit(None).cast("struct<tax_year:int,completeness:string,current_tax_owed:double,median_tax_owed:double,estimated_savings:double,warnings:array<string>>").alias("tax"),
    )
    return X.exploded_lines(X.report_lines(inputs, "harris")).filter("line_no < 4")


def _report_sql() -> str:
    """The lines of every report put together in SQL from the parts that have queries of their own."""
    units = (
        _UNITS.replace(f"FROM {V('v_tax_subject')} s", "FROM taxed s")
        .replace(V("v_tax_history"), "hist_a")
        .replace(V("v_jur"), "jur_a")
        .replace(V("v_unit_rate"), "rate_a")
    )
    paired = _PAIRED.replace(V("v_history"), "hist_a")
    return f"""WITH RECURSIVE {comps_ctes('a', 10.0, None, 50, 52.0)},
    hist_a AS (SELECT * FROM {V('v_history')} h WHERE county = 'harris'),
    jur_a AS (SELECT * FROM {V('v_jur')} j WHERE county = 'harris'),
    rate_a AS (SELECT * FROM {V('v_unit_rate')} r WHERE county = 'harris'),
    agg AS (SELECT c.subject_key, median(ppsf) AS med, count(ppsf) AS n FROM comps c JOIN priced p ON p.subject_key = c.subject_key GROUP BY 1),
    taxed AS (SELECT p.subject_key AS account_number, NULL::INT AS requested_year,
                     CASE WHEN sppsf IS NOT NULL AND n > 0 THEN CAST(CAST(med AS DECIMAL(20,10)) * CAST(living_area AS DECIMAL(16,4)) AS DECIMAL(24,6)) END AS median_assessed_value
              FROM priced p LEFT JOIN agg USING (subject_key)),
    {units.lstrip()},
    t AS (SELECT account_number, count(*) AS n_units, count(rate) AS known, count(warning) AS missing,
                 count(*) FILTER (WHERE warning = 'Missing taxable value') AS no_base, sum(cur_tax) AS cur_tax, sum(med_tax) AS med_tax FROM units GROUP BY 1),
    f AS (SELECT a.account_number, a.yr, a.median_assessed_value AS med0, t.n_units, t.known, t.missing, t.no_base, t.cur_tax, t.med_tax,
                 CASE WHEN t.n_units IS NULL OR known = 0 THEN 'missing' WHEN missing > 0 OR known < n_units THEN 'partial' ELSE 'complete' END AS comp
          FROM asked a LEFT JOIN t ON t.account_number = a.account_number),
    tax AS (SELECT *, coalesce({_r2('cur_tax')}, 0.0) AS c, coalesce({_r2('med_tax')}, 0.0) AS m,
             CASE WHEN yr IS NULL THEN 'No assessment year is available for this account.'
                WHEN n_units IS NULL THEN 'No jurisdiction/exemption rows were found for this account and year.'
                ELSE concat_ws(' | ',
                  CASE WHEN med0 IS NULL OR med0 < 0 THEN 'Median assessed value is missing; median tax scenario was not computed.' END,
                  CASE WHEN known < n_units THEN 'One or more jurisdiction rates are missing for this tax year.' END,
                  nullif(array_to_string(list_transform(range(no_base), lambda x: 'One or more units are missing current taxable/assessed value.'), ' | '), ''),
                  CASE WHEN comp <> 'complete' THEN 'Tax impact is partial because one or more required inputs were missing.' END) END AS warnings FROM f),
    {paired.lstrip()},
    b AS (SELECT *, coalesce(nullif(prior_appraised_value, 0), p_appraised, p_assessed) AS prior,
                 coalesce(nullif(appraised_value, 0), assessed_value) AS now, upper(trim(coalesce(cap_account, ''))) = 'Y' AS home FROM paired),
    capped AS (SELECT *, prior IS NOT NULL AND now IS NOT NULL AS judged,
                 round(least(CAST(prior AS DECIMAL(18,2)) * (CASE WHEN home THEN CAST('1.10' AS DECIMAL(3,2)) ELSE CAST('1.20' AS DECIMAL(3,2)) END)
                             + coalesce(new_construction_value, 0), CAST(market_value AS DECIMAL(18,2))), 2) AS allowed FROM b),
    years AS (SELECT account_number AS key, list(concat(tax_year, ': ',
                 CASE WHEN assessed_value <> 0 THEN concat('$', format('{{:,}}', CAST(round_even(assessed_value, 0) AS BIGINT))) ELSE '-' END, ', YoY ',
                 coalesce(CAST(CAST(round(CAST((CAST(assessed_value AS DOUBLE) - CAST(p_assessed AS DOUBLE)) / nullif(CAST(p_assessed AS DOUBLE), 0) * 100 AS DECIMAL(30, 8)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || '%', '-'),
                 ', ', CASE WHEN NOT judged THEN 'Needs review' WHEN now - allowed > 0 THEN 'Over cap' ELSE 'Within cap' END) ORDER BY tax_year DESC) AS lines
              FROM capped GROUP BY 1),
    shown AS (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY score DESC, shown_distance ASC NULLS LAST, ppsf ASC NULLS LAST, comp_key) AS nth FROM comps),
    evidence AS (SELECT subject_key AS key, list(concat(address, ': score ', format('{{:.1f}}', score), coalesce(', $' || format('{{:,.2f}}', ppsf) || '/sqft', '')) ORDER BY nth) AS lines
                 FROM shown WHERE nth <= 10 GROUP BY 1),
    whole AS (
      SELECT s.key,
        ['Harris County Property Tax Protest Evidence Report', concat('Account Number: ', s.key), concat('Property: ', s.address),
         concat('Assessed Value: ', CASE WHEN s.assessed <> 0 THEN concat('$', format('{{:,}}', CAST(round_even(s.assessed, 0) AS BIGINT))) ELSE 'unavailable' END)]
        || CASE WHEN s.living_area <> 0 THEN [concat('Living Area: ', format('{{:,}}', CAST(round_even(s.living_area, 0) AS BIGINT)), ' sqft')] ELSE [] END
        || CASE WHEN s.living_area <> 0 AND p.sppsf IS NOT NULL THEN [concat('Subject Value/Sqft: $', format('{{:,.2f}}', p.sppsf))] ELSE [] END
        || CASE WHEN y.lines IS NOT NULL THEN ['', 'Assessment History'] || y.lines ELSE [] END
        || CASE WHEN e.lines IS NOT NULL THEN ['', 'Comparable Evidence'] || e.lines ELSE [] END
        || CASE WHEN x.account_number IS NOT NULL THEN ['', 'Tax Impact (Estimated)', concat('Tax Year Used: ', coalesce(CAST(x.yr AS VARCHAR), '-'), ' (', x.comp, ')'),
             concat('Current Taxes Owed: $', format('{{:,.2f}}', x.c)), concat('Median-Scenario Taxes Owed: $', format('{{:,.2f}}', x.m)),
             concat('Estimated Annual Savings: $', format('{{:,.2f}}', round(greatest(0.0, x.c - x.m), 2)))] ELSE [] END
        || CASE WHEN x.warnings <> '' THEN [concat('Warnings: ', x.warnings)] ELSE [] END AS lines
      FROM subjects s JOIN priced p ON p.subject_key = s.key LEFT JOIN years y ON y.key = s.key LEFT JOIN evidence e ON e.key = s.key
           LEFT JOIN tax x ON x.account_number = s.key)
    SELECT key, CAST(unnest(range(len(lines))) AS INT) AS line_no, unnest(lines) AS line FROM whole"""


@query("report_lines", _report_sql())
def report_lines(spark, d):
    """Every line of every report, by the search at its default radius."""
    facts = cut_lineage(a_facts(spark, d))
    shared = SharedTables(view(spark, d, "v_history"), view(spark, d, "v_unit_rate"), view(spark, d, "v_jur"))
    comps = protest_comps(facts, facts, COUNTY_A_SPEC, 52)
    return X.exploded_lines(protest_report(facts, comps, shared, "harris")["lines"])
