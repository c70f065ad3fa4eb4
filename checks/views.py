"""Appraisal-roll shaped views over the driver tables.

Each view is one SQL text that both engines run: ``{name}`` is a table or another view. Money is cast
to a decimal before any sum and every literal that must be a double says so.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# A total order over lineitem rows: rows that tie are equal in every column.
LINE_POSITION = """concat_ws('|', lpad(cast(l_orderkey AS string), 19, '0'), lpad(cast(l_partkey AS string), 19, '0'), cast(l_suppkey AS string), cast(l_linenumber AS string),
                   cast(cast(round(l_quantity * 100) AS bigint) AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string),
                   cast(cast(round(l_discount * 100) AS bigint) AS string), cast(cast(round(l_tax * 100) AS bigint) AS string),
                   l_returnflag, l_linestatus, cast(cast(l_shipdate AS date) AS string))"""

VIEWS: dict[str, str] = {
    # ---- county A tables
    "v_property": """
        SELECT cast(c_custkey AS string) AS account_number,
               concat(cast(c_custkey % 900 AS string), ' ELM ', cast(c_custkey % 37 AS string)) AS address,
               concat('CITY ', cast(c_nationkey AS string)) AS city,
               cast(77000 + c_nationkey AS string) AS zipcode,
               c_name AS owner_name,
               cast(CASE WHEN c_acctbal < 0 THEN 5000 END AS decimal(14,2)) AS value,
               CASE WHEN c_acctbal > 0 THEN cast(c_acctbal * 100 AS decimal(14,2)) END AS assessed_value,
               cast(CASE WHEN c_custkey % 4 = 0 THEN 1500 ELSE 0 END AS decimal(14,2)) AS building_area,
               cast(4000 + (c_custkey % 61) * 150 AS decimal(14,2)) AS land_area,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'A1' WHEN 'HOUSEHOLD' THEN ' a2' WHEN 'FURNITURE' THEN 'E1'
                                 WHEN 'MACHINERY' THEN 'F1' ELSE '' END AS state_class,
               c_mktsegment <> 'MACHINERY' AS is_residential,
               c_custkey % 3 <> 0 AS is_data_ready,
               cast(c_custkey % 900 AS string) AS street_number,
               concat('ELM ', cast(c_custkey % 37 AS string)) AS street_name,
               '' AS source_url,
               CASE WHEN c_custkey % 2 = 0 THEN concat('P', cast(c_custkey AS string)) ELSE '' END AS parcel_id,
               CASE WHEN c_custkey % 50 <> 7 THEN
                   cast(cast(29.5 AS double) + cast(c_custkey % 97 AS double) * cast(0.005 AS double) AS decimal(10,7))
               END AS latitude,
               CASE WHEN c_custkey % 50 <> 7 THEN
                   cast(cast(-95.6 AS double) + cast(c_custkey % 89 AS double) * cast(0.005 AS double) AS decimal(10,7))
               END AS longitude
        FROM {customer}""",
    "v_building": """
        SELECT cast(p_partkey AS string) AS account_number,
               1 AS building_number,
               p_brand AS building_type, p_type AS building_style, substr(p_name, 1, 3) AS building_class,
               substr('XABCDEF', 1 + p_size % 7, 1) AS quality_code,
               CASE WHEN p_size % 4 = 0 THEN 'Good' ELSE substr('ABCDEF', 1 + p_size % 6, 1) END AS condition_code,
               1960 + p_size AS year_built,
               cast(NULL AS int) AS year_remodeled,
               CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1965 + p_size END AS effective_year,
               CASE WHEN p_size % 17 <> 0 THEN cast(p_retailprice * 2 AS decimal(10,2)) END AS heat_area,
               cast(1 + p_size % 2 AS decimal(4,2)) AS stories,
               CASE WHEN p_size % 13 <> 0 THEN 1 + p_size % 6 END AS bedrooms,
               cast(cast(2 + p_size % 5 AS double) / 2 AS decimal(4,2)) AS bathrooms,
               p_size % 2 AS half_baths,
               p_partkey % 19 <> 3 AND p_size % 10 <> 0 AS is_active,
               concat('b', cast(p_size % 3 AS string)) AS import_batch_id
        FROM {part}
        UNION ALL
        SELECT cast(p_partkey AS string), 2, p_brand, p_type, '', 'C', '', 1950, 1960, NULL,
               cast(p_retailprice * 3 AS decimal(10,2)), cast(1 AS decimal(4,2)), NULL, NULL, 0, p_partkey % 7 = 0, 'b9'
        FROM {part}""",
    "v_feature": """
        SELECT cast(l_partkey AS string) AS account_number,
               concat(l_returnflag, l_linestatus) AS feature_code,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('Feature ', l_returnflag) ELSE '' END AS feature_description,
               l_linenumber AS feature_number,
               l_tax < 0.08 AS is_active
        FROM {lineitem}""",
    # ---- county B tables
    "v_account_b": """
        SELECT lpad(cast(c_custkey AS string), 12, '0') AS prop_id,
               2024 + CASE WHEN c_custkey % 5 = 0 THEN -y ELSE y END AS tax_year,
               c_name AS owner_name,
               CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat(cast(c_custkey % 700 AS string), ' OAK') END AS situs_address,
               concat('TOWN ', cast(c_nationkey AS string)) AS situs_city,
               '' AS situs_zip,
               CASE WHEN c_acctbal > 0 THEN cast(c_acctbal * 100 AS decimal(14,2)) END AS assessed_value,
               cast(cast(30.5 AS double) + cast(c_custkey % 83 AS double) * cast(0.004 AS double) AS decimal(10,7)) AS latitude,
               cast(cast(-96.4 AS double) + cast(c_custkey % 79 AS double) * cast(0.004 AS double) AS decimal(10,7)) AS longitude,
               CASE WHEN c_custkey % 12 <> 0 THEN cast(900 + (c_custkey % 211) * 10 AS decimal(10,2)) END AS living_area,
               1970 + cast(c_custkey % 50 AS int) AS year_built,
               concat('R', cast(c_custkey % 6 AS string), 'x') AS class_code
        FROM {customer}""",
    "v_improvement_b": """
        SELECT lpad(cast(p_partkey AS string), 12, '0') AS prop_id,
               cast(n AS string) AS imp_id,
               2024 + y AS tax_year,
               CASE WHEN p_size % 8 = 0 THEN '' WHEN (p_size + n) % 5 = 0 THEN 'C' ELSE 'R' END AS improvement_type,
               CASE WHEN (p_size + n) % 3 = 0 THEN NULL ELSE 1960 + p_size END AS year_built
        FROM {part}""",
    "v_characteristic_b": """
        SELECT lpad(cast(p_partkey AS string), 12, '0') AS prop_id,
               CASE WHEN p_size % 9 = 1 THEN '9' ELSE cast(1 + p_size % 2 AS string) END AS imp_id,
               2024 + y AS tax_year,
               1 + p_size % 5 AS bedrooms,
               cast(1 + p_size % 3 AS decimal(4,2)) AS bathrooms,
               substr('BRVNSTFR', 1 + p_size % 7, 2) AS exterior_wall,
               p_type AS construction_style,
               'SLAB' AS foundation
        FROM {part}""",
    "v_detail_b": """
        SELECT lpad(cast(l_partkey AS string), 12, '0') AS prop_id,
               cast(1 + l_linenumber % 2 AS string) AS imp_id,
               2024 + l_linenumber % 2 AS tax_year,
               l_linenumber AS detail_seq,
               CASE WHEN l_tax > 0.07 THEN 'SECOND FLOOR' ELSE 'MAIN AREA' END AS detail_description,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE year(l_shipdate) END AS year_built,
               CASE WHEN l_linestatus = 'F' OR l_discount > 0.05 THEN cast(l_quantity AS decimal(14,2)) END AS detail_value
        FROM {lineitem}""",
    "v_land_b": """
        SELECT lpad(cast(l_partkey AS string), 12, '0') AS prop_id,
               2024 + l_linenumber % 2 AS tax_year,
               CASE WHEN l_discount < 0.09 THEN cast(l_extendedprice AS decimal(14,2)) END AS land_value,
               CASE WHEN l_discount > 0.01 THEN cast(l_quantity AS decimal(12,4)) END AS acreage
        FROM {lineitem}""",
    "v_feature_b": """
        SELECT lpad(cast(l_partkey AS string), 12, '0') AS prop_id,
               2024 + l_linenumber % 2 AS tax_year,
               concat('Type ', l_returnflag) AS feature_type,
               CASE WHEN l_linestatus = 'F' THEN cast(l_linenumber AS string) ELSE '' END AS feature_value
        FROM {lineitem}""",
    # ---- shared year tables
    "v_history": """
        SELECT cast(o_custkey AS string) AS account_number,
               year(o_orderdate) AS tax_year,
               CASE WHEN o_custkey % 5 = 0 THEN 'brazos' ELSE 'harris' END AS county,
               CASE WHEN o_custkey % 23 = 1 THEN NULL ELSE cast(sum(cast(o_totalprice AS decimal(14,2))) AS decimal(14,2)) END AS assessed_value,
               CASE WHEN o_custkey % 17 = 2 THEN cast(0 AS decimal(14,2)) ELSE max(cast(o_totalprice AS decimal(14,2))) END AS appraised_value,
               CASE WHEN o_custkey % 9 = 3 THEN NULL ELSE cast(sum(cast(o_totalprice AS decimal(14,2))) * cast('1.1' AS decimal(3,1)) AS decimal(14,2)) END AS market_value,
               CASE WHEN o_custkey % 3 = 0 THEN min(cast(o_totalprice AS decimal(14,2))) END AS prior_appraised_value,
               cast(NULL AS decimal(14,2)) AS prior_market_value,
               CASE WHEN o_custkey % 4 = 0 THEN cast(10000 AS decimal(14,2)) END AS new_construction_value,
               CASE min(o_orderstatus) WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE 'Pending' END AS cap_account
        FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "v_unit_rate": """
        SELECT CASE WHEN s_suppkey % 9 = 4 THEN 1999 ELSE 2000 END AS tax_year, cast(s_suppkey AS string) AS tax_unit_code, 'harris' AS county,
               s_name AS tax_unit_name,
               cast((s_suppkey % 97 + 1) AS decimal(12,8)) / 10000 AS adopted_rate_raw,
               cast(cast(s_suppkey % 97 + 1 AS double) / 10000 AS decimal(12,8)) AS adopted_rate
        FROM {supplier}""",
    "v_jur": """
        SELECT account_number, 2000 AS tax_year, 'harris' AS county, tax_unit_code, tax_unit_name, exemption_code,
               exemption_description, exemption_amount, exemption_percent, taxable_value
        FROM (
            SELECT cast(l_orderkey AS string) AS account_number,
                   cast(l_suppkey AS string) AS tax_unit_code,
                   concat('Unit ', cast(l_suppkey AS string)) AS tax_unit_name,
                   cast(l_linenumber AS string) AS exemption_code,
                   concat('Line ', cast(l_linenumber AS string)) AS exemption_description,
                   CASE WHEN l_tax > 0.01 THEN cast(l_quantity * 100 AS decimal(14,2)) END AS exemption_amount,
                   CASE WHEN l_tax < 0.06 THEN cast(l_discount * 100 AS decimal(8,4)) END AS exemption_percent,
                   CASE WHEN l_returnflag <> 'R' THEN cast(l_extendedprice AS decimal(14,2)) END AS taxable_value,
                   row_number() OVER (
                       PARTITION BY l_orderkey, l_suppkey, l_linenumber
                       ORDER BY l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
                   ) AS rn
            FROM {lineitem}
        ) AS numbered WHERE rn = 1""",
    "v_tax_subject": """
        SELECT 'harris' AS county, cast(o_orderkey AS string) AS account_number,
               CASE WHEN o_orderkey % 2 = 0 THEN 2000 WHEN o_orderkey % 13 = 1 THEN 1999 END AS requested_year,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_totalprice AS decimal(14,2)) END AS median_assessed_value
        FROM {orders}""",
    "v_tax_history": """
        SELECT 'harris' AS county, cast(o_orderkey AS string) AS account_number, 2000 AS tax_year,
               CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_totalprice AS decimal(14,2)) END AS assessed_value
        FROM {orders}""",
    # ---- raw, all-text rows as a file scan would give them
    "v_raw_account": """
        SELECT cast(c_custkey AS string) AS acct, concat('  ', c_name, ' ') AS mailto,
               cast(c_custkey % 900 AS string) AS str_num,
               concat('ELM ', cast(c_custkey % 37 AS string)) AS `str`,
               CASE WHEN c_custkey % 2 = 0 THEN 'DR' ELSE ' ' END AS str_sfx,
               CASE WHEN c_custkey % 3 = 0 THEN concat(cast(c_custkey AS string), ' FULL ADDR') ELSE '' END AS site_addr_1,
               concat('CITY ', cast(c_nationkey AS string)) AS site_addr_2,
               cast(77000 + c_nationkey AS string) AS site_addr_3,
               CASE c_mktsegment WHEN 'BUILDING' THEN ' a1' WHEN 'HOUSEHOLD' THEN 'A2 ' WHEN 'FURNITURE' THEN 'E1'
                                 WHEN 'MACHINERY' THEN 'F1' ELSE '' END AS state_class,
               concat('$1,', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '.50') AS tot_appr_val,
               CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE cast(c_custkey AS string) END AS assessed_val,
               cast(1000 + c_custkey % 500 AS string) AS bld_ar,
               '' AS land_ar,
               c_custkey AS pos
        FROM {customer}""",
    "v_raw_building": """
        SELECT cast(p_partkey AS string) AS acct,
               CASE WHEN p_size % 4 = 0 THEN '' ELSE '1.0' END AS bld_num,
               p_type AS imprv_type, p_brand AS bldg_class, substr('XABCDEF', 1 + p_size % 7, 1) AS qa_cd,
               cast(1960 + p_size AS string) AS date_erected,
               CASE WHEN p_size % 5 = 0 THEN '' ELSE cast(p_size * 50 AS string) END AS heat_ar,
               '2' AS sty, cast(p_size % 6 AS string) AS bed_rm,
               cast(p_size % 3 AS string) AS full_bath, cast(p_size % 2 AS string) AS half_bath,
               p_partkey AS pos
        FROM {part}""",
    "v_raw_fixture": """
        SELECT cast(l_partkey AS string) AS acct, '1' AS bld_num,
               CASE l_linenumber % 4 WHEN 0 THEN 'RMB' WHEN 1 THEN 'RMF' WHEN 2 THEN 'RMH' ELSE 'FPL' END AS type,
               CASE WHEN l_discount = 0 THEN 'x' ELSE cast(cast(l_quantity AS int) % 7 AS string) END AS units,
               [position] AS pos
        FROM {lineitem}""",
    "v_raw_feature": """
        SELECT cast(l_partkey AS string) AS acct, concat(l_returnflag, l_linestatus) AS cd,
               concat(' desc ', l_returnflag) AS dscr, 'C' AS grade,
               CASE WHEN l_linenumber = 7 THEN '' ELSE cast(l_linenumber AS string) END AS bld_num,
               cast(l_quantity AS string) AS units, cast(1990 + l_linenumber AS string) AS act_yr,
               cast(cast(l_extendedprice AS decimal(14,2)) AS string) AS asd_val,
               [position] AS pos
        FROM {lineitem}""",
    "v_raw_history": """
        SELECT cast(o_custkey AS string) AS acct,
               CASE WHEN o_orderkey % 4 = 0 THEN '0' WHEN o_orderkey % 4 = 1 THEN '' ELSE cast(year(o_orderdate) AS string) END AS yr,
               cast(cast(o_totalprice AS decimal(14,2)) AS string) AS assessed_val,
               cast(cast(o_totalprice * 2 AS decimal(14,2)) AS string) AS tot_appr_val,
               o_orderstatus AS Cap_acct,
               o_orderkey AS pos
        FROM {orders}""",
    "v_raw_hearing": """
        SELECT cast(s_suppkey * 3 AS string) AS acct,
               CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2001' END AS Tax_Year,
               CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('$', cast(s_suppkey * 1000 AS string)) END AS Final_Appraised_Value,
               s_suppkey AS pos
        FROM {supplier}
        UNION ALL
        SELECT cast(1000000 + n_nationkey AS string), '2002', '210000', n_nationkey FROM {nation}""",
    # ---- jurisdiction sources
    "v_base": """
        SELECT cast(l_orderkey AS string) AS account_number, cast(l_suppkey AS string) AS tax_unit_code,
               CASE WHEN l_tax < 0.08 THEN cast(l_extendedprice AS decimal(14,2)) END AS gross,
               CASE WHEN l_discount < 0.1 THEN cast(cast(l_extendedprice AS decimal(14,2)) - cast(l_discount * 100000 AS decimal(14,2)) AS decimal(14,2)) END AS net,
               [position] AS pos
        FROM {lineitem}""",
    "v_exempt": """
        SELECT cast(l_orderkey AS string) AS account_number, CASE WHEN l_linenumber % 2 = 0 THEN cast(l_suppkey AS string) ELSE '' END AS tax_unit_code,
               concat(l_returnflag, l_linestatus) AS exemption_code,
               concat('Exemption ', l_returnflag) AS description,
               cast(l_quantity * 100 AS decimal(14,2)) AS amount,
               [position] AS pos
        FROM {lineitem}""",
    "v_unit_name": """
        SELECT cast(s_suppkey AS string) AS tax_unit_code, CASE WHEN s_suppkey % 8 <> 0 THEN s_name ELSE '' END AS tax_unit_name FROM {supplier}""",
    "v_rate_file": """
        SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'Personal' ELSE ' real' END AS RP_TYPE,
               cast(l_suppkey AS string) AS tax_dist,
               concat('District ', cast(l_linenumber AS string)) AS name,
               CASE WHEN l_returnflag = 'A' THEN '' ELSE concat('0.', lpad(cast(l_orderkey % 10000 AS string), 4, '0')) END AS published,
               [position] AS pos
        FROM {lineitem}""",
    "v_entity": """
        SELECT lpad(cast(l_orderkey AS string), 12, '0') AS prop_id,
               cast(l_suppkey AS string) AS tax_unit_code, concat('Unit ', cast(l_suppkey AS string)) AS tax_unit_name,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE cast(l_extendedprice AS decimal(14,2)) END AS assessed_value,
               cast(cast(l_extendedprice AS decimal(14,2)) - cast(l_quantity AS decimal(14,2)) AS decimal(14,2)) AS taxable_value,
               CASE WHEN l_tax < 0.03 THEN cast(l_quantity * 10 AS decimal(14,2)) ELSE cast(0 AS decimal(14,2)) END AS hs_amt,
               CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS decimal(14,2)) END AS ov65_amt,
               cast(0 AS decimal(14,2)) AS dp_amt,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(cast(l_extendedprice AS decimal(14,2)) + CASE WHEN l_tax > 0.07 THEN 0 ELSE 1000 END AS decimal(14,2)) END AS market_value,
               cast(cast(l_extendedprice AS decimal(14,2)) + CASE WHEN l_linestatus = 'O' THEN 500 ELSE 0 END AS decimal(14,2)) AS appraised_value,
               [position] AS pos
        FROM {lineitem}""",
    "v_attribute": """
        SELECT lpad(cast(l_partkey AS string), 12, '0') AS prop_id, cast(l_suppkey % 3 AS string) AS imp_id, 2025 AS tax_year,
               l_linenumber AS detail_seq,
               CASE l_linenumber WHEN 1 THEN 'Number of Bedrooms' WHEN 2 THEN 'Exterior Wall' WHEN 3 THEN 'Plumbing'
                                 WHEN 4 THEN 'Foundation' WHEN 5 THEN 'Fireplace' WHEN 6 THEN 'Plumbing' ELSE 'Flooring' END AS attribute_type,
               CASE WHEN l_linenumber = 1 THEN CASE WHEN l_discount > 0.08 THEN 'n/a' ELSE cast(cast(l_quantity AS int) % 6 AS string) END
                    WHEN l_linenumber IN (3, 6) THEN
                        CASE cast(l_quantity AS int) % 8 WHEN 0 THEN '3/1' WHEN 1 THEN '2.5' WHEN 2 THEN '2 1/2' WHEN 3 THEN '3-1/2'
                             WHEN 4 THEN '1 3/4' WHEN 5 THEN '2' WHEN 6 THEN '1 1/2 EA' ELSE '2,1/2' END
                    ELSE CASE WHEN l_discount < 0.02 THEN '' ELSE concat(l_returnflag, l_linestatus) END END AS attribute_value,
               'attr' AS source_file,
               [position] AS pos
        FROM {lineitem}""",
    # ---- staged updates, snapshot, shapes
    "v_staged": """
        SELECT cast(user_id AS string) AS account_number,
               cast(cast(29 AS double) + value / 1000 AS decimal(10,7)) AS latitude,
               cast(cast(-95 AS double) - value / 1000 AS decimal(10,7)) AS longitude,
               CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS parcel_id,
               event_id
        FROM {events}""",
    "v_ring": """
        SELECT event_id, cast(user_id AS string) AS ACCT, event_type AS PARCEL_ID,
               cast(3000000 + user_id * 100 AS double) AS x0, cast(10000000 + event_id AS double) AS y0,
               cast(50 + value AS double) AS w, cast(30 + user_id AS double) AS h
        FROM {events}""",
    "v_snapshot": """
        SELECT lpad(cast(c_custkey AS string), 12, '0') AS prop_id,
               CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'ELSEWHERE'
                    ELSE concat(cast(c_custkey % 700 AS string), ' OAK, TOWN TX') END AS situs_address_full,
               CASE WHEN c_custkey % 15 = 2 THEN 'SOMEONE' ELSE c_name END AS owner_name,
               CASE WHEN c_acctbal > 0 THEN cast(floor(cast(cast(c_acctbal * 100 AS decimal(14,2)) AS double)) AS bigint) + CASE WHEN c_custkey % 20 = 3 THEN 1 ELSE 0 END END AS assessed_value,
               c_custkey % 20 = 3 AND c_custkey % 40 = 3 AS drifts
        FROM {customer}
        UNION ALL
        SELECT concat('MISSING', cast(n_nationkey AS string)), 'X', 'Y', 1, false FROM {nation}""",
    "v_pages_rates": """
        SELECT cast(s_suppkey AS string) AS url,
               concat('<html><table><tr><th>', cast(2000 + s_suppkey % 20 AS string), ' TAX RATES</th></tr><tr><td>JURISDICTION</td></tr>',
                      '<tr><td>G', cast(s_suppkey AS string), ' – ', s_name, ' &amp; Co</td><td>0.1</td><td>0.2</td><td>$0.',
                      lpad(cast(s_suppkey % 1000 AS string), 4, '0'), '00</td></tr>',
                      '<tr><td>no dash</td><td>1</td><td>2</td><td>3</td></tr><tr><td>short</td></tr></table></html>') AS html
        FROM {supplier}""",
    "v_links": """
        SELECT concat('p', cast(p_partkey AS string)) AS url,
               concat('<p><a href="/files/', CASE WHEN p_size % 4 = 0 THEN 'latest' ELSE cast(2000 + p_size % 25 AS string) END,
                      '.zip">Certified export', CASE WHEN p_size % 2 = 0 THEN concat(' ', cast(1990 + p_size AS string)) ELSE '' END,
                      '</a> <a class="x" href="/b_2010.ZIP"><b>Old</b> data</a> <a href="/about.html">2030</a></p>') AS html
        FROM {part}""",
}

# Views with a copy of every row per tax year (and improvement number): one branch per value.
for _view, _axes in {"v_account_b": ["y"], "v_improvement_b": ["y", "n"], "v_characteristic_b": ["y"]}.items():
    _branches = [VIEWS[_view]]
    for _axis in _axes:
        _values = (0, 1) if _axis == "y" else (1, 2)
        _branches = [re.sub(rf"\b{_axis}\b", str(v), b) for b in _branches for v in _values]
    VIEWS[_view] = " UNION ALL ".join(_branches)

_NAME = re.compile(r"\{(\w+)\}")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of ``sf_dir``."""
    return spark.sql(_expand(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def _expand(name: str, table) -> str:
    return _NAME.sub(
        lambda m: table(m.group(1)) if m.group(1) in TABLES else f"({_expand(m.group(1), table)})",
        VIEWS[name].replace("[position]", LINE_POSITION),
    )


def duck_view(name: str) -> str:
    """The view as a DuckDB subquery over the registered table names."""
    text = _expand(name, lambda t: t).replace("`str`", '"str"')
    return f"({text})"
