"""Registered queries: table loads, rollups, pivots, updates."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from checks.registry import plain, query
from checks.views import duck_view as V
from checks.views import spark_view as view
from parcelwise.functions.geo import parcel_centroids
from parcelwise.operators import jurisdiction as J
from parcelwise.operators import rooms as R
from parcelwise.operators.facts import land_totals, newest_loaded_year, primary_building, primary_improvement
from parcelwise.operators.keyed import append_new, first_per_key, merge_upsert, newest_year
from parcelwise.operators.loading import deactivate_other_batches, match_counts, outcome_counts
from parcelwise.plans import roll_a as A
from parcelwise.plans import roll_b as B
from parcelwise.session import shared_folder
from parcelwise.sinks import manifest
from parcelwise.sinks.tables import insert_ignore_buckets, read_buckets, upsert_buckets
from parcelwise.sources import fixed_width as W
from parcelwise.sources.delimited import Field, Table, apply_table, read_delimited, valid_rows
from parcelwise.sources.many import scan_aliased
from parcelwise.sources.pages import adopted_rates, archive_links, newest_archive, page_links
from parcelwise.sources.parcels import locate, staged_coordinates

# --------------------------------------------------------------------- county A loads

_PROP = f"""
  raw AS (SELECT trim(acct) AS account_number, trim(mailto) AS owner_name, trim(str_num) AS street_number,
                 trim(concat_ws(' ', nullif(trim("str"), ''), nullif(trim(str_sfx), ''))) AS street_name,
                 trim(site_addr_1) AS full_addr, trim(site_addr_2) AS city, trim(site_addr_3) AS zipcode,
                 upper(trim(state_class)) AS state_class,
                 TRY_CAST(replace(replace(tot_appr_val, '$', ''), ',', '') AS DECIMAL(14,2)) AS value,
                 TRY_CAST(assessed_val AS DECIMAL(14,2)) AS assessed_value, TRY_CAST(bld_ar AS DECIMAL(14,2)) AS building_area
          FROM {V('v_raw_account')} r),
  prop AS (SELECT * FROM raw WHERE state_class IN ('A1', 'A2', 'A4', 'E1'))"""


def _prop(spark, d):
    return A.property_table(A.stage_property(view(spark, d, "v_raw_account")))


@query(
    "property_load",
    f"""WITH {_PROP}
    SELECT account_number, coalesce(nullif(full_addr, ''), trim(concat(street_number, ' ', street_name))) AS address, city, zipcode,
           owner_name, CAST(value AS DOUBLE) AS value, CAST(assessed_value AS DOUBLE) AS assessed_value,
           CAST(building_area AS DOUBLE) AS building_area, state_class, street_number, street_name FROM prop""",
)
def property_load(spark, d):
    return plain(
        _prop(spark, d).select(
            "account_number", "address", "city", "zipcode", "owner_name", "value", "assessed_value", "building_area",
            "state_class", "street_number", "street_name",
        )
    )


@query(
    "property_load_older",
    f"""WITH {_PROP}
    SELECT account_number, coalesce(nullif(trim(concat_ws(' ', nullif(street_number, ''), nullif(street_name, ''))), ''), full_addr) AS address,
           substr(zipcode, 1, 5) AS zipcode, CAST(value AS DOUBLE) AS value, CAST(assessed_value AS DOUBLE) AS assessed_value FROM prop""",
)
def property_load_older(spark, d):
    out = A.property_table(A.stage_property_older(view(spark, d, "v_raw_account")))
    return plain(out.select("account_number", "address", "zipcode", "value", "assessed_value"))


@query(
    "load_outcome_counts",
    f"""WITH {_PROP}
    SELECT count(*) AS processed, count(*) FILTER (WHERE state_class IN ('A1', 'A2', 'A4', 'E1')) AS loaded, 0 AS invalid,
           count(*) FILTER (WHERE state_class NOT IN ('A1', 'A2', 'A4', 'E1')) AS skipped,
           round(count(*) FILTER (WHERE state_class IN ('A1', 'A2', 'A4', 'E1')) / CAST(count(*) AS DOUBLE) * 100.0, 4) AS success_rate FROM raw""",
)
def load_outcome_counts(spark, d):
    return plain(outcome_counts(A.stage_property(view(spark, d, "v_raw_account"))), 4)


_FX = f"""
  fxr AS (SELECT acct AS account_number, 1 AS building_number, type, TRY_CAST(units AS DECIMAL(10,2)) AS units, pos
          FROM {V('v_raw_fixture')} f WHERE type IN ('RMB', 'RMF', 'RMH')),
  fx AS (SELECT account_number, building_number,
                CAST(arg_max(units, pos) FILTER (WHERE type = 'RMB' AND units IS NOT NULL) AS INT) AS bedrooms,
                arg_max(units, pos) FILTER (WHERE type = 'RMF' AND units IS NOT NULL) AS full_baths,
                arg_max(units, pos) FILTER (WHERE type = 'RMH' AND units IS NOT NULL) AS half_units
         FROM fxr WHERE units IS NOT NULL GROUP BY 1, 2)"""


def _pivot(spark, d):
    return R.fixtures_pivot(R.fixture_rows(view(spark, d, "v_raw_fixture")))


@query(
    "fixtures_pivot",
    f"""WITH {_FX} SELECT account_number, building_number, bedrooms, CAST(full_baths AS DOUBLE) AS full_baths,
        CAST(half_units AS DOUBLE) AS half_units, CAST(half_units AS INT) AS half_baths FROM fx""",
)
def fixtures_pivot(spark, d):
    return plain(_pivot(spark, d))


@query(
    "fixtures_statistics",
    f"""WITH {_FX} SELECT count(*) AS total_buildings, count(*) FILTER (WHERE bedrooms > 0) AS with_bedrooms,
        count(*) FILTER (WHERE full_baths > 0) AS with_full_baths, count(*) FILTER (WHERE half_units > 0) AS with_half_baths,
        count(*) FILTER (WHERE full_baths > 0 OR half_units > 0) AS with_bathrooms,
        count(*) FILTER (WHERE bedrooms > 0 AND (full_baths > 0 OR half_units > 0)) AS with_both FROM fx""",
)
def fixtures_statistics(spark, d):
    return R.fixtures_statistics(_pivot(spark, d))


@query(
    "building_load",
    f"""WITH {_PROP}, {_FX},
    b AS (SELECT acct AS account_number, coalesce(CAST(TRY_CAST(bld_num AS DOUBLE) AS INT), 1) AS building_number, trim(imprv_type) AS building_type,
                 trim(qa_cd) AS quality_code, CAST(date_erected AS INT) AS year_built, TRY_CAST(heat_ar AS DECIMAL(10,2)) AS heat_area,
                 CAST(bed_rm AS INT) AS rb, CAST(full_bath AS DECIMAL(10,2)) + CAST(half_bath AS INT) * 0.5 AS rt, CAST(half_bath AS INT) AS rh
          FROM {V('v_raw_building')} r WHERE acct IN (SELECT account_number FROM prop))
    SELECT b.account_number, b.building_number, building_type, quality_code, year_built, CAST(heat_area AS DOUBLE) AS heat_area,
           CASE WHEN fx.bedrooms > 0 THEN fx.bedrooms ELSE rb END AS bedrooms,
           CAST(CASE WHEN coalesce(full_baths, 0) + coalesce(half_units, 0) * 0.5 > 0 THEN coalesce(full_baths, 0) + coalesce(half_units, 0) * 0.5
                WHEN rt > 0 THEN rt END AS DOUBLE) AS bathrooms,
           CASE WHEN CAST(half_units AS INT) > 0 THEN CAST(half_units AS INT) ELSE rh END AS half_baths
    FROM b LEFT JOIN fx ON fx.account_number = b.account_number AND fx.building_number = b.building_number""",
)
def building_load(spark, d):
    staged = A.stage_buildings(view(spark, d, "v_raw_building"), _prop(spark, d), _pivot(spark, d))
    return plain(
        A.building_table(staged).select(
            "account_number", "building_number", "building_type", "quality_code", "year_built", "heat_area", "bedrooms",
            "bathrooms", "half_baths",
        )
    )


@query(
    "building_load_outcomes",
    f"""WITH {_PROP} SELECT count(*) AS processed, count(*) FILTER (WHERE acct IN (SELECT account_number FROM prop)) AS loaded,
        count(*) FILTER (WHERE acct NOT IN (SELECT account_number FROM prop)) AS invalid, 0 AS skipped FROM {V('v_raw_building')} r""",
)
def building_load_outcomes(spark, d):
    staged = A.stage_buildings(view(spark, d, "v_raw_building"), _prop(spark, d), _pivot(spark, d))
    return outcome_counts(staged).drop("success_rate")


_FEAT = f"""
    f AS (SELECT acct AS account_number, TRY_CAST(nullif(bld_num, '') AS INT) AS feature_number, cd AS feature_code, trim(dscr) AS feature_description,
                 TRY_CAST(units AS DECIMAL(10,2)) AS quantity, CAST(act_yr AS INT) AS year_built, TRY_CAST(asd_val AS DECIMAL(14,2)) AS value, pos
          FROM {V('v_raw_feature')} r WHERE acct IN (SELECT account_number FROM prop)),
    n AS (SELECT *, row_number() OVER (PARTITION BY account_number, feature_code, feature_number ORDER BY pos) AS rn FROM f)
    SELECT account_number, feature_number, feature_code, feature_description, CAST(quantity AS DOUBLE) AS quantity, year_built, CAST(value AS DOUBLE) AS value
    FROM n WHERE rn = 1 OR feature_number IS NULL"""


def _feature_columns(staged):
    return plain(
        A.feature_table(staged).select(
            "account_number", "feature_number", "feature_code", "feature_description", "quantity", "year_built", "value"
        )
    )


@query("feature_load", f"WITH {_PROP}, {_FEAT}")
def feature_load(spark, d):
    return _feature_columns(A.stage_features(view(spark, d, "v_raw_feature"), _prop(spark, d)))


@query("feature_load_older", f"WITH {_PROP}, {_FEAT}")
def feature_load_older(spark, d):
    return _feature_columns(A.stage_features_older(view(spark, d, "v_raw_feature"), _prop(spark, d)))


_ROOMS = """
    u AS (SELECT b.*, fx.account_number IS NOT NULL AND is_active AS hit, fx.bedrooms AS nb,
                 CASE WHEN full_baths IS NOT NULL OR half_units IS NOT NULL THEN coalesce(full_baths, 0) + coalesce(CAST(half_units AS INT), 0) * 0.5 END AS nt,
                 CAST(half_units AS INT) AS nh
          FROM bld b LEFT JOIN fx ON fx.account_number = b.account_number AND fx.building_number = b.building_number)"""


@query(
    "room_count_update",
    f"""WITH {_FX}, bld AS (SELECT * FROM {V('v_building')} b), {_ROOMS}
    SELECT account_number, building_number, CASE WHEN hit THEN coalesce(nb, bedrooms) ELSE bedrooms END AS bedrooms,
           CAST(CASE WHEN hit THEN coalesce(nt, bathrooms) ELSE bathrooms END AS DOUBLE) AS bathrooms,
           CASE WHEN hit THEN coalesce(nh, half_baths) ELSE half_baths END AS half_baths,
           hit AND ((nb IS NOT NULL AND nb IS DISTINCT FROM bedrooms) OR (nt IS NOT NULL AND nt IS DISTINCT FROM bathrooms)
                    OR (nh IS NOT NULL AND nh IS DISTINCT FROM half_baths)) AS rooms_changed FROM u""",
)
def room_count_update(spark, d):
    out = R.update_room_counts(view(spark, d, "v_building"), _pivot(spark, d))
    return plain(out.select("account_number", "building_number", "bedrooms", "bathrooms", "half_baths", "rooms_changed"))


@query(
    "room_update_counts",
    f"""WITH {_FX}, bld AS (SELECT * FROM {V('v_building')} b), {_ROOMS},
    act AS (SELECT DISTINCT account_number, building_number FROM bld WHERE is_active)
    SELECT (SELECT count(*) FROM fx) AS buildings_with_rooms,
           (SELECT count(*) FROM fx WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.account_number = fx.account_number AND a.building_number = fx.building_number)) AS buildings_not_found,
           (SELECT count(*) FROM u WHERE hit AND ((nb IS NOT NULL AND nb IS DISTINCT FROM bedrooms) OR (nt IS NOT NULL AND nt IS DISTINCT FROM bathrooms)
                    OR (nh IS NOT NULL AND nh IS DISTINCT FROM half_baths))) AS buildings_updated""",
)
def room_update_counts(spark, d):
    return R.room_update_counts(view(spark, d, "v_building"), _pivot(spark, d))


@query(
    "hearing_full_outer",
    f"""WITH roll AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY pos) AS rn FROM {V('v_raw_history')} r) t WHERE rn = 1),
    hear AS (SELECT acct, arg_max(Tax_Year, pos) AS hy, arg_max(Final_Appraised_Value, pos) AS fv FROM {V('v_raw_hearing')} h GROUP BY 1),
    j AS (SELECT coalesce(r.acct, h.acct) AS account_number, r.acct IS NOT NULL AS on_roll, nullif(TRY_CAST(nullif(r.yr, '') AS INT), 0) AS ry,
                 nullif(TRY_CAST(nullif(hy, '') AS INT), 0) AS hyear, TRY_CAST(replace(nullif(fv, ''), '$', '') AS DECIMAL(14,2)) AS fv,
                 TRY_CAST(assessed_val AS DECIMAL(14,2)) AS av, TRY_CAST(tot_appr_val AS DECIMAL(14,2)) AS ap, Cap_acct AS cap
          FROM roll r FULL OUTER JOIN hear h ON h.acct = r.acct)
    SELECT account_number, coalesce(ry, hyear, 1999) AS tax_year, CAST(coalesce(fv, av) AS DOUBLE) AS assessed_value,
           CAST(CASE WHEN on_roll THEN ap ELSE fv END AS DOUBLE) AS appraised_value, coalesce(cap, '') AS cap_account FROM j""",
)
def hearing_full_outer(spark, d):
    out = A.history_year(view(spark, d, "v_raw_history"), A.hearing_lookup(view(spark, d, "v_raw_hearing")), 1999)
    return plain(out.select("account_number", "tax_year", "assessed_value", "appraised_value", "cap_account"))


# --------------------------------------------------------------------- county B loads


@query(
    "attr_pivot_wide",
    f"""WITH a AS (SELECT *, regexp_full_match(attribute_value, '[0-9]+[\\s,-]+1/2\\s*(EA)?') AS frac,
                          regexp_full_match(attribute_value, '[0-9]+\\.5') AS half, regexp_full_match(attribute_value, '[0-9]+[/\\\\][0-9]+') AS slash,
                          regexp_full_match(attribute_value, '[0-9]+') AS num FROM {V('v_attribute')} v),
    p AS (SELECT *, CASE WHEN attribute_type = 'Plumbing' AND (frac OR half OR slash OR num) THEN CAST(regexp_extract(attribute_value, '^([0-9]+)', 1) AS INT) END AS full_b,
                 CASE WHEN attribute_type <> 'Plumbing' THEN NULL WHEN frac OR half THEN 1 WHEN slash THEN CAST(regexp_extract(attribute_value, '([0-9]+)$', 1) AS INT) WHEN num THEN 0 END AS half_b
          FROM a),
    m AS (SELECT * FROM p WHERE attribute_type IN ('Number of Bedrooms', 'Exterior Wall', 'Foundation', 'Flooring') OR full_b IS NOT NULL)
    SELECT prop_id, imp_id,
           arg_min(TRY_CAST(attribute_value AS INT), pos) FILTER (WHERE attribute_type = 'Number of Bedrooms' AND num) AS bedrooms,
           coalesce(arg_min(attribute_value, pos) FILTER (WHERE attribute_type = 'Exterior Wall' AND attribute_value <> ''), '') AS exterior_wall,
           coalesce(arg_min(attribute_value, pos) FILTER (WHERE attribute_type = 'Foundation' AND attribute_value <> ''), '') AS foundation,
           coalesce(arg_min(attribute_value, pos) FILTER (WHERE attribute_type = 'Flooring' AND attribute_value <> ''), '') AS flooring,
           CAST(arg_min(full_b, pos) FILTER (WHERE full_b IS NOT NULL) AS DOUBLE) AS bathrooms,
           arg_min(half_b, pos) FILTER (WHERE full_b IS NOT NULL) AS half_baths
    FROM m GROUP BY 1, 2""",
)
def attr_pivot_wide(spark, d):
    out = B.characteristics(view(spark, d, "v_attribute"))
    return plain(
        out.select("prop_id", "imp_id", "bedrooms", "exterior_wall", "foundation", "flooring", "bathrooms", "half_baths")
    )


@query(
    "attr_long_features",
    f"""SELECT prop_id, imp_id, tax_year, detail_seq, attribute_type AS feature_type, attribute_value AS feature_value
        FROM {V('v_attribute')} a WHERE attribute_type = 'Fireplace'""",
)
def attr_long_features(spark, d):
    return B.long_features(view(spark, d, "v_attribute")).drop("source_file")


@query(
    "unreadable_plumbing",
    f"SELECT count(*) AS unreadable_plumbing FROM {V('v_attribute')} a WHERE attribute_type = 'Plumbing' AND attribute_value = '1 3/4'",
)
def unreadable_plumbing(spark, d):
    return B.unreadable_plumbing(view(spark, d, "v_attribute"))


@query(
    "argmax_rollup",
    f"""SELECT prop_id, imp_id, tax_year, year_built FROM (
          SELECT *, row_number() OVER (PARTITION BY prop_id, imp_id, tax_year ORDER BY coalesce(detail_value, 0) DESC, detail_seq, year_built) AS rn
          FROM {V('v_detail_b')} d WHERE year_built IS NOT NULL) t WHERE rn = 1""",
)
def argmax_rollup(spark, d):
    detail = view(spark, d, "v_detail_b").withColumn("pos", F.struct("detail_seq", "year_built"))
    return B.year_built_rollup(detail)


@query(
    "primary_improvement",
    f"""SELECT prop_id, tax_year, imp_id, has_building FROM (
          SELECT i.prop_id, i.tax_year, i.imp_id, c.imp_id IS NOT NULL AS has_building,
                 row_number() OVER (PARTITION BY i.prop_id, i.tax_year ORDER BY (c.imp_id IS NULL), i.imp_id) AS rn
          FROM {V('v_improvement_b')} i LEFT JOIN {V('v_characteristic_b')} c ON c.prop_id = i.prop_id AND c.imp_id = i.imp_id AND c.tax_year = i.tax_year
          WHERE i.improvement_type = 'R') t WHERE rn = 1""",
)
def primary_improvement_query(spark, d):
    out = primary_improvement(view(spark, d, "v_improvement_b"), view(spark, d, "v_characteristic_b"))
    return out.select("prop_id", "tax_year", "imp_id", "has_building")


@query(
    "land_totals",
    f"""SELECT prop_id, tax_year, CAST(sum(land_value) AS DOUBLE) AS land_value, CAST(sum(acreage) AS DOUBLE) AS acreage
        FROM {V('v_land_b')} l GROUP BY 1, 2""",
)
def land_totals_query(spark, d):
    return plain(land_totals(view(spark, d, "v_land_b")), 4)


_ROLLUP = f"""
    first_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY pos) AS rn FROM {V('v_entity')} e) t WHERE rn = 1)"""


@query(
    "history_rollup_b",
    f"""WITH {_ROLLUP} SELECT prop_id AS account_number, CAST(assessed_value AS DOUBLE) AS assessed_value, CAST(appraised_value AS DOUBLE) AS appraised_value,
        CAST(market_value AS DOUBLE) AS market_value, CASE WHEN appraised_value > assessed_value THEN 'Y' ELSE '' END AS cap_account FROM first_row""",
)
def history_rollup_b(spark, d):
    out = B.history_rollup(view(spark, d, "v_entity"), 2025)
    return plain(out.select("account_number", "assessed_value", "appraised_value", "market_value", "cap_account"))


@query(
    "sane_order",
    f"""WITH {_ROLLUP} SELECT count(*) AS checkable, count(*) FILTER (WHERE appraised_value IS NULL OR assessed_value IS NULL
        OR (market_value >= appraised_value AND appraised_value >= assessed_value)) AS sane FROM first_row WHERE market_value IS NOT NULL""",
)
def sane_order(spark, d):
    return B.sane_order(B.history_rollup(view(spark, d, "v_entity"), 2025))


_LINES = """concat(lpad(cast(l_orderkey AS string), 12, '0'), lpad(cast(2024 + l_linenumber % 2 AS string), 4, '0'),
    lpad(cast(l_linenumber AS string), 12, '0'), rpad(l_returnflag, 4, ' '), '      ', rpad(concat('USE  ', l_linestatus), 25, ' '),
    rpad('', 77, ' '), lpad(cast(cast(round(l_extendedprice * 100) AS bigint) AS string), 14, '0'), rpad('', 24, ' '),
    CASE WHEN l_discount = 0 THEN '      ' ELSE lpad(cast(cast(l_quantity AS int) * 1000 AS string), 6, '0') END, rpad('', 15, ' '))"""


@query(
    "fixed_width_scan",
    """SELECT lpad(cast(l_orderkey AS string), 12, '0') AS prop_id, 2024 AS tax_year, l_linenumber AS land_seq, l_returnflag AS land_use_code,
              concat('USE ', l_linestatus) AS land_use_description, round(l_extendedprice, 2) AS land_value,
              CASE WHEN l_discount <> 0 THEN round(cast(cast(l_quantity AS int) AS double) / 10, 4) END AS acreage
       FROM lineitem WHERE l_linenumber % 2 = 0""",
)
def fixed_width_scan(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr(_LINES).alias("value"))
    return plain(W.for_year(W.slice_lines(lines, W.LAND), 2024), 4)


# --------------------------------------------------------------------- generic table work


@query(
    "schema_apply",
    f"""SELECT acct AS account_number, TRY_CAST(nullif(assessed_val, 'n/a') AS DECIMAL(14,2))::DOUBLE AS assessed,
              CAST(bld_ar AS INT) AS area, upper(trim(state_class)) IN ('A1', 'E1') AS is_home, coalesce(nullif(trim(land_ar), ''), '0') AS land
        FROM {V('v_raw_account')} r WHERE trim(state_class) <> '' AND CAST(bld_ar AS INT) >= 1100""",
)
def schema_apply(spark, d):
    table = Table(
        "roll",
        (
            Field("account_number", ("account_num", "ACCT"), required=True, max_length=20),
            Field("assessed", ("assessed_val",), "decimal"),
            Field("area", ("bldg_ar", "bld_ar"), "int", validators=(lambda c: c >= 1100,)),
            Field("is_home", ("state_class",), required=True, transform=lambda c: F.when(c.isNotNull(), F.upper(c).isin("A1", "E1"))),
            Field("land", ("land_ar",), default="0"),
        ),
    )
    return plain(valid_rows(apply_table(view(spark, d, "v_raw_account"), table)).drop("pos"))


@query(
    "dedupe_first",
    f"""SELECT account_number, tax_unit_code, CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net FROM (
          SELECT *, row_number() OVER (PARTITION BY account_number, tax_unit_code ORDER BY pos) AS rn FROM {V('v_base')} b) t WHERE rn = 1""",
)
def dedupe_first(spark, d):
    out = first_per_key(view(spark, d, "v_base"), ["account_number", "tax_unit_code"], ["pos"])
    return plain(out.drop("pos"))


@query(
    "newest_year",
    f"""SELECT prop_id, tax_year, owner_name FROM (SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY tax_year DESC) AS rn FROM {V('v_account_b')} a) t WHERE rn = 1""",
)
def newest_year_query(spark, d):
    return newest_year(view(spark, d, "v_account_b"), ["prop_id"]).select("prop_id", "tax_year", "owner_name")


@query(
    "newest_loaded_year",
    f"SELECT prop_id, tax_year FROM {V('v_account_b')} a WHERE tax_year = (SELECT max(tax_year) FROM {V('v_account_b')} b)",
)
def newest_loaded_year_query(spark, d):
    return newest_loaded_year(view(spark, d, "v_account_b")).select("prop_id", "tax_year")


@query(
    "first_building",
    f"""SELECT account_number, building_number, quality_code FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY building_number) AS rn
        FROM {V('v_building')} b WHERE is_active) t WHERE rn = 1""",
)
def first_building(spark, d):
    return primary_building(view(spark, d, "v_building")).select("account_number", "building_number", "quality_code")


def _latest_staged(spark, d):
    return first_per_key(view(spark, d, "v_staged"), ["account_number"], [F.col("event_id").desc()]).drop("event_id")


_STAGED = f"""
    st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY event_id DESC) AS rn FROM {V('v_staged')} s) t WHERE rn = 1)"""


@query(
    "update_from_join",
    f"""WITH {_STAGED}
    SELECT p.account_number, CASE WHEN hit THEN s.latitude ELSE p.latitude END::DOUBLE AS latitude, CASE WHEN hit THEN s.longitude ELSE p.longitude END::DOUBLE AS longitude,
           CASE WHEN hit AND s.parcel_id <> '' THEN s.parcel_id ELSE p.parcel_id END AS parcel_id, hit AS matched
    FROM (SELECT p0.*, s0.account_number IS NOT NULL AND p0.is_residential AS hit FROM {V('v_property')} p0 LEFT JOIN st s0 ON s0.account_number = p0.account_number) p
    LEFT JOIN st s ON s.account_number = p.account_number""",
)
def update_from_join(spark, d):
    out = A.update_coordinates(view(spark, d, "v_property"), _latest_staged(spark, d))
    return plain(out.select("account_number", "latitude", "longitude", "parcel_id", "matched"), 7)


@query(
    "update_match_counts",
    f"""WITH {_STAGED} SELECT count(*) FILTER (WHERE account_number IN (SELECT account_number FROM {V('v_property')} p)) AS matched,
        count(*) FILTER (WHERE account_number NOT IN (SELECT account_number FROM {V('v_property')} p)) AS unmatched FROM st""",
)
def update_match_counts(spark, d):
    return match_counts(view(spark, d, "v_property"), _latest_staged(spark, d), ["account_number"])


@query(
    "merge_upsert",
    f"""WITH old AS (SELECT account_number, tax_year, CAST(assessed_value AS DOUBLE) AS v FROM {V('v_history')} h),
    inc AS (SELECT account_number, 1999 AS tax_year, max(v) + 1 AS v FROM old GROUP BY 1)
    SELECT account_number, tax_year, round(v, 2) AS v FROM inc UNION ALL
    SELECT account_number, tax_year, v FROM old WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.account_number = old.account_number AND inc.tax_year = old.tax_year)""",
)
def merge_upsert_query(spark, d):
    old = view(spark, d, "v_history").select("account_number", "tax_year", F.col("assessed_value").cast("double").alias("v"))
    inc = old.groupBy("account_number").agg(F.lit(1999).alias("tax_year"), (F.max("v") + 1).alias("v"))
    return plain(merge_upsert(old, inc, ["account_number", "tax_year"]))


@query(
    "append_new",
    f"""WITH old AS (SELECT account_number, zipcode FROM {V('v_property')} p),
    inc AS (SELECT account_number, feature_code AS zipcode, row_number() OVER (PARTITION BY account_number ORDER BY feature_code) AS rn FROM {V('v_feature')} f)
    SELECT account_number, zipcode FROM old UNION ALL SELECT account_number, zipcode FROM inc WHERE rn = 1 AND account_number NOT IN (SELECT account_number FROM old)""",
)
def append_new_query(spark, d):
    old = view(spark, d, "v_property").select("account_number", "zipcode")
    inc = view(spark, d, "v_feature").select("account_number", F.col("feature_code").alias("zipcode"))
    return append_new(old, inc, ["account_number"], ["zipcode"])


@query(
    "soft_delete",
    f"""SELECT account_number, building_number, is_active AND import_batch_id IS DISTINCT FROM 'b1' AS deactivated,
               is_active AND import_batch_id = 'b1' AS is_active FROM {V('v_building')} b""",
)
def soft_delete(spark, d):
    out = deactivate_other_batches(view(spark, d, "v_building"), "b1")
    return out.select("account_number", "building_number", "deactivated", "is_active")


@query(
    "update_assessed_b",
    f"""WITH r AS (SELECT prop_id, arg_min(assessed_value, pos) FILTER (WHERE assessed_value IS NOT NULL) AS v FROM {V('v_entity')} e GROUP BY 1)
    SELECT a.prop_id, tax_year, CAST(coalesce(r.v, a.assessed_value) AS DOUBLE) AS assessed_value FROM {V('v_account_b')} a LEFT JOIN r ON r.prop_id = a.prop_id""",
)
def update_assessed_b(spark, d):
    out = B.update_assessed(view(spark, d, "v_account_b"), view(spark, d, "v_entity"))
    return plain(out.select("prop_id", "tax_year", "assessed_value"))


# --------------------------------------------------------------------- pages and parcels

_ANCHORS = """
    a AS (SELECT {url} AS url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
                 unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS body,
                 unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)))) AS link_no
          FROM {table} p),
    l AS (SELECT url, CAST(link_no AS INT) AS link_no, href,
                 trim(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS link_text FROM a)"""


@query("page_links", f"WITH {_ANCHORS.format(url='url', table='pages')} SELECT url, link_no, href, link_text FROM l")
def page_links_query(spark, d):
    return page_links(spark.read.parquet(f"{d}/pages.parquet"))


_ARCHIVES = f"""WITH {_ANCHORS.format(url='url', table=V('v_links'))},
    z AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(link_text, '((19|20)[0-9][0-9])', 1), '') AS INT),
                             TRY_CAST(nullif(regexp_extract(href, '((19|20)[0-9][0-9])', 1), '') AS INT)) AS year
          FROM l WHERE lower(href) LIKE '%.zip%')"""


@query("archive_links", f"{_ARCHIVES} SELECT url, link_no, href, link_text, year FROM z")
def archive_links_query(spark, d):
    return archive_links(view(spark, d, "v_links"))


@query(
    "newest_archive",
    f"""{_ARCHIVES} SELECT url, href, year FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(year, 0) DESC, link_no DESC) AS rn FROM z) t WHERE rn = 1""",
)
def newest_archive_query(spark, d):
    return newest_archive(view(spark, d, "v_links"))


@query(
    "adopted_rates",
    """WITH s AS (SELECT s_suppkey AS k, s_name FROM supplier)
    SELECT cast(k AS varchar) AS url, CAST(2000 + k % 20 AS INT) AS tax_year, 0 AS row_no, concat('G', cast(k AS varchar)) AS tax_unit_code,
           concat(s_name, ' & Co') AS tax_unit_name, round(CAST(concat('0.', lpad(cast(k % 1000 AS varchar), 4, '0'), '00') AS DOUBLE) / 100, 8) AS adopted_rate, 'loaded' AS outcome FROM s
    UNION ALL SELECT cast(k AS varchar), CAST(2000 + k % 20 AS INT), 1, NULL, NULL, NULL, 'skipped' FROM s
    UNION ALL SELECT cast(k AS varchar), CAST(2000 + k % 20 AS INT), 2, NULL, NULL, NULL, 'skipped' FROM s""",
)
def adopted_rates_query(spark, d):
    return plain(adopted_rates(view(spark, d, "v_pages_rates")), 8)


def _rings(spark, d):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    ring = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h), point(x0, y0))
    return view(spark, d, "v_ring").withColumn("ring", ring)


@query(
    "ring_centroids",
    f"SELECT event_id, round(y0 + h / 2, 3) AS latitude, round(x0 + w / 2, 3) AS longitude FROM {V('v_ring')} r",
)
def ring_centroids(spark, d):
    return plain(locate(_rings(spark, d), "EPSG:4326").select("event_id", "latitude", "longitude"), 3)


@query(
    "staged_coordinates",
    f"""SELECT ACCT AS account_number, round(arg_max(y0 + h / 2, event_id), 3) AS latitude, round(arg_max(x0 + w / 2, event_id), 3) AS longitude,
               arg_max(PARCEL_ID, event_id) AS parcel_id FROM {V('v_ring')} r GROUP BY 1""",
)
def staged_coordinates_query(spark, d):
    return plain(staged_coordinates(locate(_rings(spark, d), "EPSG:4326"), "event_id"), 3)


def _projected_sql(lat0: float, lon0: float, lat1: float, lat2: float, east: float, north: float) -> str:
    """The inverse projection in SQL, with its own constants and by iteration instead of a series."""
    f = 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    p0, p1, p2 = (math.radians(p) for p in (lat0, lat1, lat2))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    scale = 6378137.0 * m(p1) / (n * t(p1) ** n)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    iterated, last = "", "p"
    for i in range(7):
        iterated += f""",
    s{i} AS (SELECT *, pi() / 2 - 2 * atan(t * pow((1 - {d(e)} * sin(phi)) / (1 + {d(e)} * sin(phi)), {d(e / 2)})) AS next FROM {last}),
    q{i} AS (SELECT * EXCLUDE (phi, next), next AS phi FROM s{i})"""
        last = f"q{i}"
    return f"""WITH c AS (
      SELECT event_id, (x0 + w / 2) * 1200.0::DOUBLE / 3937 - {d(east)} AS x,
             {d(scale * t(p0) ** n)} - ((y0 + h / 2) * 1200.0::DOUBLE / 3937 - {d(north)}) AS y FROM {V('v_ring')} r),
    a AS (SELECT *, pow(sqrt(x * x + y * y) / {d(scale)}, {d(1 / n)}) AS t FROM c),
    p AS (SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM a){iterated}
    SELECT event_id, round(degrees(phi), 5) AS latitude, round(degrees(atan2(x, y)) / {d(n)} + {d(lon0)}, 5) AS longitude FROM {last}"""


@query("projected_centroids_a", _projected_sql(27 + 50 / 60, -99.0, 30 + 17 / 60, 28 + 23 / 60, 600000.0, 4000000.0))
def projected_centroids_a(spark, d):
    return plain(locate(_rings(spark, d), "EPSG:2278").select("event_id", "latitude", "longitude"), 5)


@query("projected_centroids_b", _projected_sql(29 + 40 / 60, -(100 + 20 / 60), 31 + 53 / 60, 30 + 7 / 60, 700000.0, 3000000.0))
def projected_centroids_b(spark, d):
    return plain(locate(_rings(spark, d), "EPSG:2277").select("event_id", "latitude", "longitude"), 5)


@query(
    "long_keys_kept",
    """SELECT concat('ACCOUNT-OF-MORE-THAN-TWENTY-CHARACTERS-', c_custkey) AS account_number, c_name AS owner_name FROM customer""",
)
def long_keys_kept(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("ACCOUNT-OF-MORE-THAN-TWENTY-CHARACTERS-"), F.col("c_custkey").cast("string")).alias("acct"),
        F.col("c_name").alias("mailto"),
        F.lit("A1").alias("state_class"),
        F.col("c_custkey").alias("pos"),
    )
    return A.property_table(A.stage_property(raw)).select("account_number", "owner_name")


@query(
    "long_code_list",
    """SELECT CAST(o_custkey AS VARCHAR) AS account_number, string_agg(DISTINCT concat('EXEMPTION-', o_orderkey), '+' ORDER BY concat('EXEMPTION-', o_orderkey)) AS code
       FROM orders GROUP BY 1""",
)
def long_code_list(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("account_number"),
        F.lit("U").alias("tax_unit_code"),
        F.concat(F.lit("EXEMPTION-"), F.col("o_orderkey").cast("string")).alias("exemption_code"),
        F.lit("").alias("description"),
    )
    return J.itemised_codes(rows).select("account_number", "code")


@query("late_encoding", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 99 THEN concat('MUÑOZ ', c_name) ELSE c_name END AS owner FROM customer")
def late_encoding(spark, d):
    """A file whose first byte beyond ASCII comes late, written, found to be latin-1 and read back."""
    k = F.col("c_custkey")
    owner = F.when(k % 100 == 99, F.concat(F.lit("MUÑOZ "), "c_name")).otherwise(F.col("c_name"))
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("c_custkey"), owner.alias("owner"))
    rows.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return read_delimited(spark, path).select(F.col("c_custkey").cast("long"), "owner")


@query(
    "mixed_files",
    """SELECT CAST(c_custkey AS VARCHAR) AS account,
              CASE WHEN c_custkey % 3 = 1 AND c_custkey % 100 = 99 THEN concat('MUÑOZ ', c_name) ELSE c_name END AS owner,
              CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS segment
       FROM customer""",
)
def mixed_files(spark, d):
    """All customers, dealt over files of three delimiters, two encodings and three headers, read in one scan."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").repartition(4)
    folder = f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    late = F.when(k % 100 == 99, F.concat(F.lit("MUÑOZ "), "c_name")).otherwise(F.col("c_name"))
    kinds = [
        ("\t", "UTF-8", [k.alias("ACCT"), F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("segment")]),
        ("|", "ISO-8859-1", [F.col("c_mktsegment").alias("Segment"), late.alias("Owner_Name"), k.alias("acct")]),
        (",", "UTF-8", [F.col("c_name").alias("OWNER"), k.alias("account_id")]),
    ]
    for n, (sep, encoding, columns) in enumerate(kinds):
        part = rows.filter(k % 3 == n).select(*columns)
        part.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(f"{folder}/{n}")
    sources = {"account": ("account_id", "acct"), "owner": ("owner", "owner_name"), "segment": ("segment",)}
    return scan_aliased(spark, [f"{folder}/{n}" for n in range(len(kinds))], sources).drop("pos")


@query(
    "published_slices",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS county, year(o_orderdate) AS tax_year FROM orders)
       SELECT 'orders' AS name, county, CAST(tax_year AS INT) AS tax_year, count(*) AS n,
              CAST(sum(CASE WHEN tax_year = 1995 AND county = 'a' THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS keys FROM t GROUP BY 2, 3
       UNION ALL SELECT 'customer', NULL, NULL, count(*), CAST(sum(2 * c_custkey) AS BIGINT) FROM customer""",
)
def published_slices(spark, d):
    """Orders by slices and customers as a whole, published by a manifest, one slice and the customers again, read back."""
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("county"),
        F.year("o_orderdate").alias("tax_year"),
    )
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    slices = {"orders": ("county", "tax_year")}
    manifest.commit(spark, folder, {"orders": orders, "customer": customers}, slices)
    again = orders.filter("tax_year = 1995 AND county = 'a'").withColumn("k", -F.col("k"))
    manifest.commit(spark, folder, {"orders": again, "customer": customers.select((2 * F.col("k")).alias("k"))}, slices)
    total = [F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys")]
    by_slice = manifest.read(spark, folder, "orders").groupBy("county", "tax_year").agg(*total)
    whole = manifest.read(spark, folder, "customer").agg(*total)
    null = lambda kind: F.lit(None).cast(kind)
    rows = by_slice.select(F.lit("orders").alias("name"), "county", "tax_year", "n", "keys")
    return rows.unionByName(whole.select(F.lit("customer").alias("name"), null("string").alias("county"), null("int").alias("tax_year"), "n", "keys"))


@query(
    "bucket_upsert",
    """SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'changed' ELSE c_name END AS owner FROM customer
       UNION ALL SELECT -c_custkey, c_name FROM customer WHERE c_nationkey = 7""",
)
def bucket_upsert(spark, d):
    """Customers in key buckets: those of one nation changed, new keys added, repeated ones ignored; read back."""
    path = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_name").alias("owner"), "c_nationkey")
    keep = ["c_custkey", "owner"]
    upsert_buckets(rows.select(*keep), path, ["c_custkey"], 16)
    upsert_buckets(rows.filter("c_nationkey = 5").withColumn("owner", F.lit("changed")).select(*keep), path, ["c_custkey"], 16)
    new = rows.filter("c_nationkey = 7").withColumn("c_custkey", -F.col("c_custkey")).select(*keep)
    known = rows.filter("c_nationkey = 5").select(*keep)
    insert_ignore_buckets(new.unionByName(known), path, ["c_custkey"], ["owner"], 16)
    return read_buckets(spark, path)


@query(
    "multi_ring_centroids",
    """WITH p AS (SELECT p_partkey, CAST(p_size + 100 AS DOUBLE) AS s, CAST(p_size % 2 = 0 AS INT) AS hole, CAST(p_size % 3 = 0 AS INT) AS part,
                         CAST(3000000 + p_partkey * 10 AS DOUBLE) AS x, CAST(13800000 + p_size * 7 AS DOUBLE) AS y FROM part),
            a AS (SELECT *, s * s - hole * s * s / 4 + part * 2500 AS area FROM p)
       SELECT p_partkey, round((s * s * (x + s / 2) - hole * s * s / 4 * (x + s / 2) + part * 2500 * (x + 525)) / area, 3) AS cx,
              round((s * s * (y + s / 2) - hole * s * s / 4 * (y + s * 3 / 8) + part * 2500 * (y + 25)) / area, 3) AS cy FROM a""",
)
def multi_ring_centroids(spark, d):
    """Square parcels, some with a square hole, some with a second part."""
    size, x, y = (F.col("p_size") + 100).cast("double"), (3000000 + F.col("p_partkey") * 10).cast("double"), (13800000 + F.col("p_size") * 7).cast("double")

    def square(left, low, side, turned):
        corners = [(left, low), (left + side, low), (left + side, low + side), (left, low + side), (left, low)]
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in (corners[::-1] if turned else corners)])

    rings = F.array_compact(
        F.array(
            square(x, y, size, True),
            F.when(F.col("p_size") % 2 == 0, square(x + size / 4, y + size / 8, size / 2, False)),
            F.when(F.col("p_size") % 3 == 0, square(x + 500, y, F.lit(50.0), True)),
        )
    )
    each = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(rings).alias("ring"))
    done = parcel_centroids(each, ["p_partkey"])
    return done.select("p_partkey", F.round("centroid.x", 3).alias("cx"), F.round("centroid.y", 3).alias("cy"))
