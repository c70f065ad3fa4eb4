"""Oracle SQL of the comps search and score: a brute-force self join, written independently of the engine."""

from __future__ import annotations

from checks.views import duck_view


class Points:
    """Fixed values, stated here once more, so that a wrong one in the engine shows: curve points (difference, similarity)."""

    LIVING_AREA_CURVE = (
        (0.0, 1.0), (0.03, 0.96), (0.05, 0.90), (0.10, 0.78), (0.20, 0.55), (0.30, 0.32), (0.40, 0.16), (0.50, 0.06), (0.75, 0.0),
    )
    BEDROOM_CURVE = ((0.0, 1.0), (1.0, 0.62), (2.0, 0.22), (3.0, 0.06), (4.0, 0.0))
    BATHROOM_CURVE = ((0.0, 1.0), (0.5, 0.76), (1.0, 0.40), (1.5, 0.14), (2.5, 0.0))
    AGE_CURVE = ((0.0, 1.0), (2.0, 0.90), (5.0, 0.76), (10.0, 0.42), (15.0, 0.22), (25.0, 0.08), (40.0, 0.0))
    STORY_CURVE = ((0.0, 1.0), (0.5, 0.70), (1.0, 0.35), (2.0, 0.0))
    LAND_CURVE = ((0.0, 1.0), (0.05, 0.90), (0.10, 0.76), (0.20, 0.54), (0.35, 0.28), (0.50, 0.12), (0.80, 0.0))
    RANK_CURVE = ((0.0, 1.0), (1.0, 0.72), (2.0, 0.42), (3.0, 0.18), (5.0, 0.0))
    DISTANCE_CURVE = ((0.0, 1.0), (0.1, 0.93), (0.25, 0.78), (0.5, 0.52), (0.75, 0.24), (1.0, 0.05))
    GRADE_RANK = {"X": 7, "A": 6, "B": 5, "C": 4, "D": 3, "E": 2, "F": 1}


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def curve_sql(x: str, points: tuple) -> str:
    arms = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {x} <= {dbl(points[0][0])} THEN {dbl(points[0][1])}"]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        arms.append(
            f"WHEN {x} <= {dbl(x1)} THEN {dbl(y0)} + {dbl(y1 - y0)} * (({x} - {dbl(x0)}) / {dbl(x1 - x0)})"
        )
    return f"(CASE {' '.join(arms)} ELSE {dbl(points[-1][1])} END)"


def half_up(x: str, n: int) -> str:
    """Half-up on the printed digits of a double, which is how Spark rounds one."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 17)), {n}) AS DOUBLE)"


def clamp01(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0.0 WHEN {x} > 1 THEN 1.0 ELSE {x} END)"


def percentage_sql(s: str, c: str, points: tuple) -> str:
    return curve_sql(f"(CASE WHEN {s} > 0 THEN abs({s} - {c}) / {s} END)", points)


def difference_sql(s: str, c: str, points: tuple) -> str:
    return curve_sql(f"abs(CAST({s} AS DOUBLE) - CAST({c} AS DOUBLE))", points)


def category_sql(s: str, c: str) -> str:
    s, c = f"nullif(upper(trim({s})), '')", f"nullif(upper(trim({c})), '')"
    return (
        f"(CASE WHEN {s} IS NULL OR {c} IS NULL THEN NULL WHEN {s} = {c} THEN 1.0 "
        f"WHEN length({s}) >= 2 AND length({c}) >= 2 AND substr({s}, 1, 2) = substr({c}, 1, 2) THEN 0.65 "
        f"WHEN substr({s}, 1, 1) = substr({c}, 1, 1) THEN 0.4 ELSE 0.0 END)"
    )


def _rank(c: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in Points.GRADE_RANK.items())
    return f"(CASE upper(trim({c})) {arms} END)"


def ranked_sql(s: str, c: str) -> str:
    gap = curve_sql(f"CAST(abs({_rank(s)} - {_rank(c)}) AS DOUBLE)", Points.RANK_CURVE)
    return f"(CASE WHEN trim({s}) <> '' AND upper(trim({s})) = upper(trim({c})) THEN 1.0 ELSE {gap} END)"


def jaccard_sql(a: str, b: str) -> str:
    either = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {either} > 0 THEN len(list_intersect({a}, {b})) / CAST({either} AS DOUBLE) END)"


FACTS_A = f"""
  b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY building_number) AS rn
                        FROM {duck_view('v_building')} b WHERE is_active) t WHERE rn = 1),
  ba AS (SELECT account_number, list_sort(list(DISTINCT CAST(heat_area AS DOUBLE)) FILTER (WHERE heat_area IS NOT NULL)) AS areas
         FROM {duck_view('v_building')} b WHERE is_active GROUP BY 1),
  fc AS (SELECT account_number, list_sort(list(DISTINCT feature_code)) AS codes
         FROM {duck_view('v_feature')} f WHERE is_active AND feature_code <> '' GROUP BY 1),
  facts AS (
    SELECT p.account_number AS key, 0 AS scope, CAST(p.latitude AS DOUBLE) AS lat, CAST(p.longitude AS DOUBLE) AS lon,
           trim(concat_ws(' ', p.street_number, p.street_name)) AS address, p.owner_name, p.zipcode,
           CAST(coalesce(nullif(p.assessed_value, 0), nullif(p.value, 0)) AS DOUBLE) AS assessed,
           coalesce(nullif(CAST(b1.heat_area AS DOUBLE), 0), nullif(CAST(p.building_area AS DOUBLE), 0)) AS living_area,
           CAST(p.land_area AS DOUBLE) AS land_size, b1.account_number IS NOT NULL AS has_building,
           CAST(b1.heat_area AS DOUBLE) AS heat_area, b1.bedrooms, CAST(b1.bathrooms AS DOUBLE) AS bathrooms,
           b1.year_built, coalesce(nullif(b1.effective_year, 0), nullif(b1.year_remodeled, 0), nullif(b1.year_built, 0)) AS eff,
           CAST(b1.stories AS DOUBLE) AS stories, b1.quality_code, b1.condition_code,
           b1.building_style AS ch1, b1.building_type AS ch2, b1.building_class AS ch3,
           coalesce(fc.codes, []) AS codes, coalesce(ba.areas, []) AS areas, nullif(CAST(b1.heat_area AS DOUBLE), 0) AS wanted
    FROM {duck_view('v_property')} p
    LEFT JOIN b1 ON b1.account_number = p.account_number
    LEFT JOIN ba ON ba.account_number = p.account_number
    LEFT JOIN fc ON fc.account_number = p.account_number),
  subjects AS (SELECT * FROM facts WHERE lat <> 0 AND lon <> 0)"""

_IMP = f"""
  chosen AS (SELECT * FROM (
      SELECT i.prop_id, i.tax_year, i.imp_id, i.year_built AS imp_year, c.imp_id IS NOT NULL AS has_building,
             c.bedrooms, CAST(c.bathrooms AS DOUBLE) AS bathrooms, c.exterior_wall, c.construction_style, c.foundation,
             row_number() OVER (PARTITION BY i.prop_id, i.tax_year ORDER BY (c.imp_id IS NULL), i.imp_id) AS rn
      FROM {duck_view('v_improvement_b')} i
      LEFT JOIN {duck_view('v_characteristic_b')} c
             ON c.prop_id = i.prop_id AND c.imp_id = i.imp_id AND c.tax_year = i.tax_year
      WHERE i.improvement_type = 'R') t WHERE rn = 1),
  floors AS (SELECT DISTINCT prop_id, tax_year, imp_id FROM {duck_view('v_detail_b')} d WHERE detail_description = 'SECOND FLOOR'),
  acres AS (SELECT prop_id, tax_year, CAST(sum(acreage) AS DOUBLE) AS acreage FROM {duck_view('v_land_b')} l GROUP BY 1, 2),
  fc AS (SELECT prop_id, tax_year, list_sort(list(DISTINCT feature_type)) AS codes FROM {duck_view('v_feature_b')} f GROUP BY 1, 2)"""

FACTS_B = f"""{_IMP},
  facts AS (
    SELECT a.prop_id AS key, a.tax_year AS scope, CAST(a.latitude AS DOUBLE) AS lat, CAST(a.longitude AS DOUBLE) AS lon,
           coalesce(nullif(a.situs_address, ''), a.prop_id) AS address, a.owner_name,
           CAST(a.assessed_value AS DOUBLE) AS assessed, nullif(CAST(a.living_area AS DOUBLE), 0) AS living_area,
           acres.acreage AS land_size, coalesce(c.has_building, false) AS has_building,
           CAST(a.living_area AS DOUBLE) AS heat_area, c.bedrooms, c.bathrooms,
           coalesce(nullif(c.imp_year, 0), nullif(a.year_built, 0)) AS eff,
           CASE WHEN c.prop_id IS NULL THEN NULL WHEN floors.prop_id IS NOT NULL THEN 2.0 ELSE 1.0 END AS stories,
           CAST(nullif(regexp_extract(a.class_code, '[0-9]'), '') AS INT) AS digit,
           c.exterior_wall AS ch1, c.construction_style AS ch2, c.foundation AS ch3,
           coalesce(fc.codes, []) AS codes, CAST([] AS DOUBLE[]) AS areas, CAST(NULL AS DOUBLE) AS wanted
    FROM {duck_view('v_account_b')} a
    LEFT JOIN chosen c ON c.prop_id = a.prop_id AND c.tax_year = a.tax_year
    LEFT JOIN floors ON floors.prop_id = c.prop_id AND floors.tax_year = c.tax_year AND floors.imp_id = c.imp_id
    LEFT JOIN acres ON acres.prop_id = a.prop_id AND acres.tax_year = a.tax_year
    LEFT JOIN fc ON fc.prop_id = a.prop_id AND fc.tax_year = a.tax_year),
  subjects AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scope DESC) AS newest FROM facts) t
               WHERE newest = 1 AND lat <> 0 AND lon <> 0)"""


def _measures(county: str, max_distance: float) -> dict[str, tuple[str, float, float | None, bool]]:
    """Component: similarity SQL, weight, land-only weight, needs a building."""
    ratio = clamp01(f"(distance / {dbl(max_distance)})")
    character = "coalesce(" + ", ".join(category_sql(f"s.ch{i}", f"c.ch{i}") for i in (1, 2, 3)) + ")"
    out = {
        "living_area": (percentage_sql("s.heat_area", "c.heat_area", Points.LIVING_AREA_CURVE), 24.0, None, True),
        "bedrooms": (difference_sql("s.bedrooms", "c.bedrooms", Points.BEDROOM_CURVE), 14.0, None, True),
        "bathrooms": (difference_sql("s.bathrooms", "c.bathrooms", Points.BATHROOM_CURVE), 12.0, None, True),
    }
    if county == "a":
        ranked = ranked_sql("s.quality_code", "c.quality_code")
        condition = f"coalesce({ranked_sql('s.condition_code', 'c.condition_code')}, {category_sql('s.condition_code', 'c.condition_code')})"
        out["quality"] = (ranked, 10.0, None, True)
        out["condition"] = (condition, 6.0, None, True)
    else:
        out["quality"] = (curve_sql("CAST(abs(s.digit - c.digit) AS DOUBLE)", Points.RANK_CURVE), 16.0, None, True)
    out["age"] = (difference_sql("s.eff", "c.eff", Points.AGE_CURVE), 8.0, None, True)
    out["stories"] = (difference_sql("s.stories", "c.stories", Points.STORY_CURVE), 4.0, None, True)
    out["building_character"] = (character, 4.0, None, True)
    out["land_size"] = (percentage_sql("s.land_size", "c.land_size", Points.LAND_CURVE), 10.0, 80.0, False)
    out["features"] = (jaccard_sql("s.codes", "c.codes"), 4.0, 10.0, False)
    out["distance"] = (curve_sql(ratio, Points.DISTANCE_CURVE), 4.0, 10.0, False)
    return out


def comps_ctes(county: str, max_distance: float, cap: int | None, max_results: int, min_score: float) -> str:
    """CTEs ending in ``comps``: every subject's ranked comps with sims, score and comp facts."""
    facts = FACTS_A if county == "a" else FACTS_B
    d = dbl(max_distance)
    measures = _measures(county, max_distance)
    cosine = "cos(radians(s.lat)) * cos(radians(c.lat)) * cos(radians(c.lon) - radians(s.lon)) + sin(radians(s.lat)) * sin(radians(c.lat))"
    half_lat, half_lon = "sin((radians(c.lat) - radians(s.lat)) / 2)", "sin((radians(c.lon) - radians(s.lon)) / 2)"
    haversine = f"3959.0 * 2 * asin(sqrt(least(1.0, {half_lat} * {half_lat} + cos(radians(s.lat)) * cos(radians(c.lat)) * {half_lon} * {half_lon})))"
    if county == "a":
        residential, mixed_possible = "mode = 'residential'", 18.0
    else:
        residential, mixed_possible = "mode <> 'land_only'", 100.0
    sims = ", ".join(
        (f"CASE WHEN {residential} THEN {sql} END AS sim_{n}" if building else f"{sql} AS sim_{n}")
        for n, (sql, _, _, building) in measures.items()
    )

    def weight(w: float, land: float | None) -> str:
        return dbl(w) if land is None else f"(CASE WHEN mode = 'land_only' THEN {dbl(land)} ELSE {dbl(w)} END)"

    weighted = " + ".join(
        f"coalesce({weight(w, land)} * {half_up(f'sim_{n}', 3)}, 0.0)" for n, (_, w, land, _) in measures.items()
    )
    available = " + ".join(
        f"(CASE WHEN sim_{n} IS NULL THEN 0.0 ELSE {weight(w, land)} END)" for n, (_, w, land, _) in measures.items()
    )
    return f"""{facts},
  near AS (
    SELECT s.key AS subject_key, s.scope AS scope, c.key AS comp_key,
           3959.0 * acos(least(1.0, greatest(-1.0, {cosine}))) AS distance,
           round({haversine}, 6) AS od, c.site AS csite
    FROM subjects s JOIN (SELECT *, min(key) OVER (PARTITION BY scope, lat, lon, areas) AS site FROM facts) c ON c.scope = s.scope AND c.key <> s.key
     AND c.lat BETWEEN s.lat - {d} / 69.0 AND s.lat + {d} / 69.0
     AND c.lon BETWEEN s.lon - {d} / (69.0 * cos(radians(s.lat))) AND s.lon + {d} / (69.0 * cos(radians(s.lat)))
     AND (s.wanted IS NULL OR len(list_filter(c.areas, lambda a: a >= s.wanted * 0.5 AND a <= s.wanted * 1.5)) > 0)),
  nearest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY od, csite, comp_key) AS nth
                   FROM near WHERE distance <= {d}) t WHERE {'true' if cap is None else f'nth <= {cap}'}),
  moded AS (
    SELECT n.subject_key, n.scope, n.comp_key, n.distance,
           CASE WHEN s.has_building AND c.has_building THEN 'residential'
                WHEN NOT s.has_building AND NOT c.has_building THEN 'land_only' ELSE 'mixed' END AS mode
    FROM nearest n JOIN facts s ON s.key = n.subject_key AND s.scope = n.scope
                   JOIN facts c ON c.key = n.comp_key AND c.scope = n.scope),
  measured AS (
    SELECT m.*, {sims} FROM moded m JOIN facts s ON s.key = m.subject_key AND s.scope = m.scope
                                    JOIN facts c ON c.key = m.comp_key AND c.scope = m.scope),
  weighed AS (
    SELECT *, {weighted} AS weighted, {available} AS available,
           CASE mode WHEN 'land_only' THEN 100.0 WHEN 'mixed' THEN {mixed_possible} ELSE 100.0 END AS possible
    FROM measured),
  scored AS (
    SELECT *, CASE WHEN available > 0 THEN {half_up("""least(100.0, greatest(0.0, weighted / available *
                (CASE WHEN mode = 'land_only' THEN 1.0 ELSE CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (available / possible) END) * 100.0))""", 1)}
              ELSE 0.0 END AS score, {half_up("distance", 2)} AS shown_distance
    FROM weighed),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY score DESC, shown_distance, comp_key) AS comp_rank
    FROM scored WHERE score >= {min_score}),
  comps AS (
    SELECT r.*, c.address, c.assessed, c.living_area, c.eff,
           CASE WHEN c.assessed <> 0 AND c.living_area > 0 THEN c.assessed / c.living_area END AS ppsf,
           CASE WHEN score >= 84 THEN 'Best match' WHEN score >= 70 THEN 'Highly similar' WHEN score >= 52 THEN 'Good match'
                WHEN score >= 36 THEN 'OK match' ELSE 'Broad match' END AS match_label
    FROM ranked r JOIN facts c ON c.key = r.comp_key AND c.scope = r.scope WHERE comp_rank <= {max_results}),
  priced AS (
    SELECT key AS subject_key, scope, assessed, living_area,
           CASE WHEN assessed <> 0 AND living_area > 0 THEN assessed / living_area END AS sppsf FROM subjects)"""


#: Component: label, weight, land-only weight, needs a building (for the breakdown oracle).
def breakdown_entries(county: str) -> list[tuple[str, float, float | None, bool]]:
    return [(n, w, land, b) for n, (_, w, land, b) in _measures(county, 1.0).items()]
