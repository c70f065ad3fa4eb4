"""Registered queries: yearly history, cap status, tax impact, jurisdiction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import plain, query
from checks.views import duck_view as V
from checks.views import spark_view as view
from parcelwise.operators import jurisdiction as J
from parcelwise.operators.history import history_rows, history_trend
from parcelwise.operators.tax import tax_impact, unit_breakdown

_PAIRED = f"""
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county, account_number ORDER BY tax_year DESC) AS rn
                          FROM {V('v_history')} h) t WHERE rn <= 5),
  paired AS (SELECT k.*, p.assessed_value AS p_assessed, p.appraised_value AS p_appraised
             FROM kept k LEFT JOIN kept p ON p.county = k.county AND p.account_number = k.account_number AND p.rn = k.rn + 1)"""


@query(
    "history_yoy",
    f"""WITH {_PAIRED}
    SELECT account_number, county, tax_year, CAST(assessed_value AS DOUBLE) AS assessed_value,
           CAST(round(CAST((CAST(assessed_value AS DOUBLE) - CAST(p_assessed AS DOUBLE)) / nullif(CAST(p_assessed AS DOUBLE), 0) * 100 AS DECIMAL(30, 8)), 2) AS DOUBLE) AS increase_percent
    FROM paired""",
)
def history_yoy(spark, d):
    rows = history_rows(view(spark, d, "v_history"), 5)
    return plain(rows.select("account_number", "county", "tax_year", "assessed_value", "increase_percent"))


@query(
    "cap_status",
    f"""WITH {_PAIRED},
    b AS (SELECT *, coalesce(nullif(prior_appraised_value, 0), p_appraised, p_assessed) AS prior,
                 coalesce(nullif(appraised_value, 0), assessed_value) AS cur,
                 county = 'harris' AS typed, upper(trim(coalesce(cap_account, ''))) = 'Y' AS home FROM paired),
    a AS (SELECT *, typed AND prior IS NOT NULL AND cur IS NOT NULL AS judged,
                 round(least(CAST(prior AS DECIMAL(18,2)) * (CASE WHEN home THEN CAST('1.10' AS DECIMAL(3,2)) ELSE CAST('1.20' AS DECIMAL(3,2)) END)
                             + coalesce(new_construction_value, 0), CAST(market_value AS DECIMAL(18,2))), 2) AS allowed FROM b)
    SELECT account_number, county, tax_year,
           CASE WHEN NOT judged THEN 'unknown' WHEN cur - allowed > 0 THEN 'over_limit' ELSE 'within_limit' END AS status,
           CASE WHEN NOT judged THEN 'Needs review' WHEN cur - allowed > 0 THEN 'Over cap' ELSE 'Within cap' END AS label,
           CASE WHEN NOT typed THEN 'unknown' WHEN home THEN 'homestead' ELSE 'circuit_breaker' END AS cap_type,
           CASE WHEN typed THEN CASE WHEN home THEN 10 ELSE 20 END END AS limit_percent,
           CASE WHEN prior > 0 THEN CAST(round(CAST((CAST(cur AS DOUBLE) - CAST(prior AS DOUBLE)) / CAST(prior AS DOUBLE) * 100 AS DECIMAL(30, 8)), 2) AS DOUBLE) END AS increase_percent,
           CASE WHEN judged THEN CAST(allowed AS DOUBLE) END AS allowed_value,
           CASE WHEN judged THEN CAST(cur - allowed AS DOUBLE) END AS overage
    FROM a""",
)
def cap_status(spark, d):
    rows = history_rows(view(spark, d, "v_history"), 5)
    return plain(rows.select("account_number", "county", "tax_year", "cap_status.*"))


@query(
    "history_trend",
    f"""WITH {_PAIRED}
    SELECT county, account_number, count(*) AS n_points, min(tax_year) AS first_year,
           CAST(min(assessed_value) AS DOUBLE) AS min_amount, CAST(max(assessed_value) AS DOUBLE) AS max_amount,
           round(greatest(CAST(max(assessed_value) AS DOUBLE) - CAST(min(assessed_value) AS DOUBLE), 1.0), 2) AS amount_span
    FROM paired WHERE assessed_value IS NOT NULL GROUP BY 1, 2""",
)
def history_trend_query(spark, d):
    out = history_trend(history_rows(view(spark, d, "v_history"), 5))
    return plain(
        out.select(
            "county", "account_number", F.size("points").cast("long").alias("n_points"),
            F.col("points")[0]["year"].alias("first_year"), "min_amount", "max_amount", "amount_span",
        )
    )


# --------------------------------------------------------------------- tax impact

# Records are folded one after the other by a recursive query.
_UNITS = f"""
  asked AS (
    SELECT s.*, coalesce(nullif(requested_year, 0), j.y, h.y) AS yr
    FROM {V('v_tax_subject')} s
    LEFT JOIN (SELECT account_number, max(tax_year) AS y FROM {V('v_jur')} q GROUP BY 1) j USING (account_number)
    LEFT JOIN (SELECT account_number, max(tax_year) AS y FROM {V('v_tax_history')} q GROUP BY 1) h USING (account_number)),
  rec AS (
    SELECT j.account_number, a.yr, a.median_assessed_value AS med0, j.tax_unit_code, j.exemption_code, j.exemption_amount AS amt, j.exemption_percent AS pct,
           j.taxable_value, row_number() OVER (PARTITION BY j.account_number, j.tax_unit_code ORDER BY j.exemption_code) AS n
    FROM {V('v_jur')} j JOIN asked a ON a.account_number = j.account_number AND a.yr = j.tax_year),
  base AS (
    SELECT r.account_number, r.yr, r.tax_unit_code, r.med0, x.adopted_rate AS rate, h.assessed_value AS hist,
           coalesce(r.taxable_value, h.assessed_value) AS start
    FROM rec r LEFT JOIN {V('v_unit_rate')} x ON x.tax_unit_code = r.tax_unit_code AND x.tax_year = r.yr
               LEFT JOIN {V('v_tax_history')} h ON h.account_number = r.account_number AND h.tax_year = r.yr
    WHERE r.n = 1),
  steps AS (
    SELECT b.*, 0 AS n, CAST(start AS DECIMAL(28,10)) AS cur, CAST(med0 AS DECIMAL(28,10)) AS med FROM base b WHERE rate IS NOT NULL AND start IS NOT NULL
    UNION ALL
    SELECT s.account_number, s.yr, s.tax_unit_code, s.med0, s.rate, s.hist, s.start, s.n + 1,
      CAST(CASE WHEN r.pct > 0 THEN greatest(0, CAST((CASE WHEN r.amt IS NULL THEN s.cur ELSE greatest(0, s.cur - r.amt) END) AS DECIMAL(20,8)) * CAST(1 - r.pct / CAST(100 AS DECIMAL(5,0)) AS DECIMAL(10,8)))
           WHEN r.amt IS NULL THEN s.cur ELSE greatest(0, s.cur - r.amt) END AS DECIMAL(28,10)),
      CAST(CASE WHEN s.med IS NULL THEN NULL WHEN r.pct > 0 THEN greatest(0, CAST((CASE WHEN r.amt IS NULL THEN s.med ELSE greatest(0, s.med - r.amt) END) AS DECIMAL(20,8)) * CAST(1 - r.pct / CAST(100 AS DECIMAL(5,0)) AS DECIMAL(10,8)))
           WHEN r.amt IS NULL THEN s.med ELSE greatest(0, s.med - r.amt) END AS DECIMAL(28,10))
    FROM steps s JOIN rec r ON r.account_number = s.account_number AND r.tax_unit_code = s.tax_unit_code AND r.n = s.n + 1),
  done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number, tax_unit_code ORDER BY n DESC) AS last FROM steps) t WHERE last = 1),
  units AS (
    SELECT b.account_number, b.yr, b.tax_unit_code, b.rate, b.start, b.hist, d.cur, d.med,
           CAST(d.cur AS DOUBLE) * CAST(b.rate AS DOUBLE) AS cur_tax,
           CASE WHEN d.cur IS NOT NULL THEN coalesce(CAST(d.med AS DOUBLE) * CAST(b.rate AS DOUBLE), 0.0) END AS med_tax,
           CASE WHEN b.rate IS NULL THEN 'Missing tax-unit rate' WHEN b.start IS NULL THEN 'Missing taxable value' END AS warning
    FROM base b LEFT JOIN done d ON d.account_number = b.account_number AND d.tax_unit_code = b.tax_unit_code)"""


def _r2(x: str, n: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 8)), {n}) AS DOUBLE)"


def _tax_inputs(spark, d):
    v = lambda n: view(spark, d, n)
    return v("v_tax_subject"), v("v_jur"), v("v_unit_rate"), v("v_tax_history")


@query(
    "tax_unit_breakdown",
    f"""WITH RECURSIVE {_UNITS}
    SELECT account_number, yr AS tax_year, tax_unit_code, CAST(rate AS DOUBLE) AS rate, {_r2('cur')} AS current_taxable,
           {_r2('med')} AS median_taxable, {_r2('cur_tax')} AS current_tax, {_r2('med_tax')} AS median_tax, warning FROM units""",
)
def tax_unit_breakdown(spark, d):
    out = unit_breakdown(*_tax_inputs(spark, d)).withColumn("rate", F.col("rate").cast("double"))
    r2 = lambda c: F.round(F.col(c).cast("decimal(28,8)"), 2).cast("double").alias(c)
    return out.select(
        "account_number", F.col("resolved_year").alias("tax_year"), "tax_unit_code", "rate", r2("current_taxable"),
        r2("median_taxable"), r2("current_tax"), r2("median_tax"), "warning",
    )


@query(
    "tax_impact",
    f"""WITH RECURSIVE {_UNITS},
    t AS (SELECT account_number, count(*) AS n_units, count(rate) AS known, count(warning) AS missing,
                 count(*) FILTER (WHERE warning = 'Missing taxable value') AS no_base, sum(rate) AS rate_total,
                 sum(cur_tax) AS cur_tax, sum(med_tax) AS med_tax, sum(cur) AS taxable, max(hist) AS hist FROM units GROUP BY 1),
    f AS (SELECT a.account_number, a.yr, a.median_assessed_value AS med0, t.*,
                 CASE WHEN t.n_units IS NULL OR known = 0 THEN 'missing' WHEN missing > 0 OR known < n_units THEN 'partial' ELSE 'complete' END AS comp
          FROM asked a LEFT JOIN t ON t.account_number = a.account_number),
    m AS (SELECT *, coalesce({_r2('cur_tax')}, 0.0) AS c, coalesce({_r2('med_tax')}, 0.0) AS m FROM f)
    SELECT account_number, yr AS tax_year, c AS current_tax_owed, m AS median_tax_owed,
           round(greatest(0.0, c - m), 2) AS estimated_savings,
           coalesce({_r2('CAST(rate_total AS DOUBLE) / greatest(known, 1)', 6)}, 0.0) AS effective_rate,
           CAST(hist AS DOUBLE) AS current_assessed_value, {_r2('nullif(taxable, 0)')} AS taxable_value_used, comp AS completeness,
           CASE WHEN yr IS NULL THEN 'No assessment year is available for this account.'
                WHEN n_units IS NULL THEN 'No jurisdiction/exemption rows were found for this account and year.'
                ELSE concat_ws(' | ',
                  CASE WHEN med0 IS NULL OR med0 < 0 THEN 'Median assessed value is missing; median tax scenario was not computed.' END,
                  CASE WHEN known < n_units THEN 'One or more jurisdiction rates are missing for this tax year.' END,
                  nullif(array_to_string(list_transform(range(no_base), lambda x: 'One or more units are missing current taxable/assessed value.'), ' | '), ''),
                  CASE WHEN comp <> 'complete' THEN 'Tax impact is partial because one or more required inputs were missing.' END) END AS warnings
    FROM m""".replace("a.median_assessed_value AS med0, t.*,", "a.median_assessed_value AS med0, t.n_units, t.known, t.missing, t.no_base, t.rate_total, t.cur_tax, t.med_tax, t.taxable, t.hist,"),
)
def tax_impact_query(spark, d):
    out = tax_impact(*_tax_inputs(spark, d))
    r = lambda c: F.col(c).cast("double").alias(c)
    return out.select(
        "account_number", "tax_year", r("current_tax_owed"), r("median_tax_owed"), r("estimated_savings"),
        r("effective_rate"), r("current_assessed_value"), r("taxable_value_used"), "completeness",
        F.array_join("warnings", " | ").alias("warnings"),
    )


@query(
    "exemption_trail",
    f"""WITH RECURSIVE {_UNITS}
    SELECT s.account_number, s.tax_unit_code, r.exemption_code, CAST(r.amt AS DOUBLE) AS fixed_amount, CAST(r.pct AS DOUBLE) AS percent,
           {_r2('p.cur')} AS before_current, {_r2('s.cur')} AS after_current, {_r2('p.med')} AS before_median, {_r2('s.med')} AS after_median
    FROM steps s JOIN steps p ON p.account_number = s.account_number AND p.tax_unit_code = s.tax_unit_code AND p.n = s.n - 1
                 JOIN rec r ON r.account_number = s.account_number AND r.tax_unit_code = s.tax_unit_code AND r.n = s.n
    WHERE r.amt IS NOT NULL OR r.pct IS NOT NULL""",
)
def exemption_trail(spark, d):
    # Outer: a plain ``inline`` puts a filter on the trail below itself, which folds every trail twice.
    out = unit_breakdown(*_tax_inputs(spark, d)).select("account_number", "tax_unit_code", F.inline_outer("trail"))
    out = out.filter("exemption_code IS NOT NULL")
    return plain(out.drop("description"))


# --------------------------------------------------------------------- jurisdiction tables

_FIRST_BASE = f"""
  first_base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number, tax_unit_code ORDER BY pos) AS rn
                                FROM {V('v_base')} b) t WHERE rn = 1)"""
_CODES = f"""
  codes AS (SELECT account_number, tax_unit_code, string_agg(DISTINCT exemption_code, '+' ORDER BY exemption_code) AS code,
                   string_agg(DISTINCT description, ' + ' ORDER BY description) AS descr
            FROM {V('v_exempt')} e GROUP BY 1, 2)"""


def _jur_rows(spark, d):
    base, exempt, names = (view(spark, d, n) for n in ("v_base", "v_exempt", "v_unit_name"))
    return J.jurisdiction_rows(base, exempt, names, 2025, "harris", "src"), base


@query(
    "jur_offset_rows",
    f"""WITH {_FIRST_BASE}, {_CODES},
    b AS (SELECT f.*, coalesce(n.tax_unit_name, '') AS unit_name FROM first_base f LEFT JOIN {V('v_unit_name')} n USING (tax_unit_code))
    SELECT account_number, 2025 AS tax_year, 'harris' AS county, tax_unit_code, unit_name AS tax_unit_name, '' AS exemption_code,
           '' AS exemption_description, CAST(NULL AS DOUBLE) AS exemption_amount, CAST(NULL AS DOUBLE) AS exemption_percent,
           CAST(gross AS DOUBLE) AS taxable_value, CAST(gross AS DOUBLE) AS assessed_value, 'src' AS source FROM b
    UNION ALL
    SELECT b.account_number, 2025, 'harris', b.tax_unit_code, unit_name, coalesce(c.code, 'EXEMPT'),
           coalesce(c.descr, 'Exemption applied by HCAD (category not itemised)'), CAST(gross - net AS DOUBLE), NULL, NULL, NULL, 'src'
    FROM b LEFT JOIN codes c ON c.account_number = b.account_number AND c.tax_unit_code = b.tax_unit_code
    WHERE gross > net""",
)
def jur_offset_rows(spark, d):
    return plain(_jur_rows(spark, d)[0])


@query(
    "jur_gap_report",
    f"""WITH {_FIRST_BASE},
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number, tax_unit_code, exemption_code ORDER BY pos) AS rn
                          FROM {V('v_exempt')} e) t WHERE rn = 1),
    it AS (SELECT account_number, tax_unit_code, sum(amount) AS itemised FROM dd GROUP BY 1, 2)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE coalesce(itemised, 0) > gross - net) AS itemised_more,
           count(*) FILTER (WHERE coalesce(itemised, 0) < gross - net) AS itemised_less
    FROM first_base f LEFT JOIN it ON it.account_number = f.account_number AND it.tax_unit_code = f.tax_unit_code
    WHERE gross IS NOT NULL AND net IS NOT NULL""",
)
def jur_gap_report(spark, d):
    return J.itemisation_gaps(view(spark, d, "v_base"), view(spark, d, "v_exempt"))


@query(
    "jur_proof_antijoin",
    f"""WITH {_FIRST_BASE}
    SELECT account_number, tax_unit_code, CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net
    FROM first_base WHERE net IS NOT NULL
      AND greatest(gross - CASE WHEN gross > net THEN gross - net ELSE 0 END, 0) IS DISTINCT FROM net""",
)
def jur_proof_antijoin(spark, d):
    rows, base = _jur_rows(spark, d)
    return plain(J.unproven_pairs(rows, base).select("account_number", "tax_unit_code", "gross", "net"))


@query(
    "jur_proof_wrong_rows",
    f"""WITH {_FIRST_BASE}
    SELECT account_number, tax_unit_code, CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net
    FROM first_base WHERE net IS NOT NULL
      AND greatest(gross - CASE WHEN gross > net THEN gross - net + CASE WHEN length(account_number) % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END, 0) IS DISTINCT FROM net""",
)
def jur_proof_wrong_rows(spark, d):
    """The proof sees rows whose exemption is a dollar too high."""
    rows, base = _jur_rows(spark, d)
    wrong = F.col("exemption_amount") + F.when(F.length("account_number") % 2 == 0, 1).otherwise(0)
    rows = rows.withColumn("exemption_amount", wrong.cast("decimal(14,2)"))
    return plain(J.unproven_pairs(rows, base).select("account_number", "tax_unit_code", "gross", "net"))


@query(
    "exemption_filter",
    """SELECT CAST(l_orderkey AS VARCHAR) AS account_number, CAST(l_suppkey AS VARCHAR) AS tax_unit_code,
              CASE l_returnflag WHEN 'A' THEN 'RES' ELSE 'HIS' END AS exemption_code, round(l_quantity, 2) AS amount
       FROM lineitem WHERE l_returnflag <> 'N' AND l_discount > 0""",
)
def exemption_filter(spark, d):
    """Placeholder categories and zero amounts go, control characters are taken out of texts."""
    k = F.col("l_returnflag")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("\x07")).alias("acct"),
        F.concat(F.lit("\x00"), F.col("l_suppkey").cast("string")).alias("tax_district"),
        F.when(k == "A", "res").when(k == "R", " his").otherwise("none").alias("exempt_cat"),
        F.when(F.col("l_discount") > 0, F.round("l_quantity", 2).cast("decimal(14,2)").cast("string")).otherwise(F.lit("0")).alias("exempt_val"),
        F.lit(1).alias("pos"),
    )
    return plain(J.stage_exemptions(rows).select("account_number", "tax_unit_code", "exemption_code", "amount"))


@query("codes_listagg", f"WITH {_CODES} SELECT account_number, tax_unit_code, code, descr FROM codes")
def codes_listagg(spark, d):
    return J.itemised_codes(view(spark, d, "v_exempt"))


@query(
    "rate_collapse",
    f"""WITH r AS (SELECT trim(tax_dist) AS code, name, TRY_CAST(nullif(published, '') AS DECIMAL(18,8)) AS pub, pos
                   FROM {V('v_rate_file')} f WHERE lower(trim(RP_TYPE)) = 'real')
    SELECT code AS tax_unit_code, arg_min(name, pos) AS tax_unit_name,
           round(CAST(arg_min(pub, pos) FILTER (WHERE pub IS NOT NULL) AS DOUBLE) / 100, 8) AS adopted_rate
    FROM r GROUP BY 1""",
)
def rate_collapse(spark, d):
    out = J.collapse_rates(view(spark, d, "v_rate_file"))
    return out.withColumn("adopted_rate", F.col("adopted_rate").cast("double"))


@query(
    "unpivot_exemptions",
    f"""WITH e AS (SELECT * FROM {V('v_entity')} v)
    SELECT prop_id AS account_number, tax_unit_code, '' AS exemption_code, CAST(NULL AS DOUBLE) AS exemption_amount, CAST(taxable_value AS DOUBLE) AS taxable_value FROM e
    UNION ALL SELECT prop_id, tax_unit_code, 'HS', CAST(hs_amt AS DOUBLE), CAST(taxable_value AS DOUBLE) FROM e WHERE hs_amt <> 0
    UNION ALL SELECT prop_id, tax_unit_code, 'OV65', CAST(ov65_amt AS DOUBLE), CAST(taxable_value AS DOUBLE) FROM e WHERE ov65_amt <> 0
    UNION ALL SELECT prop_id, tax_unit_code, 'DP', CAST(dp_amt AS DOUBLE), CAST(taxable_value AS DOUBLE) FROM e WHERE dp_amt <> 0""",
)
def unpivot_exemptions(spark, d):
    out = J.entity_rows(view(spark, d, "v_entity"), 2025, "brazos", "src")
    return plain(out.select("account_number", "tax_unit_code", "exemption_code", "exemption_amount", "taxable_value"))


@query(
    "first_non_null_rollup",
    f"""SELECT prop_id, CAST(arg_min(assessed_value, pos) FILTER (WHERE assessed_value IS NOT NULL) AS DOUBLE) AS assessed_value
        FROM {V('v_entity')} e GROUP BY 1""",
)
def first_non_null_rollup(spark, d):
    return plain(J.assessed_rollup(view(spark, d, "v_entity")))


@query(
    "scoped_accounts",
    f"""SELECT b.account_number, b.tax_unit_code, CAST(b.gross AS DOUBLE) AS gross FROM {V('v_base')} b
        WHERE account_number IN (SELECT account_number FROM {V('v_property')} p)""",
)
def scoped_accounts(spark, d):
    kept = J.scope_accounts(view(spark, d, "v_base"), view(spark, d, "v_property"))
    return plain(kept.select("account_number", "tax_unit_code", "gross"))
