"""The registered queries again, as plain SQL over the raw test tables.

Written without the array and window shortcuts of the Spark side: curves are long tables,
spatial joins test every pair, medians and percentiles are SQL aggregates.
"""

from __future__ import annotations

# Exact multiples of cents fall on rounding ties that engines break differently.
NUDGE = "1e-7::DOUBLE"

A, FL, MILE = 6378137.0, 1 / 298.257223563, 1609.34

# (basin_name, code, title, states, lat, lon, miles, prefixes, kappas, ranges, formations)
BASINS = {
    "dj_basin": dict(
        code="dj", title="Denver Basin", states="('CO')", lat=(39.51, 42.19), lon=(-105.13, -101.99),
        miles=15.0, prefixes=("05",), kl=0.6, kp=0.2,
        ranges=((4000, 15000), (500, 3500), (20, 100)),
        formations=("Niobrara", "Niobrara A", "Niobrara B", "Niobrara C", "Codell", "Greenhorn",
                    "Shannon", "Sussex", "Turner", "Parkman", "Terry", "Hygiene"),
    ),
    "bakken": dict(
        code="bakken", title="Bakken", states="('ND', 'MT')", lat=(46.66, 48.99),
        lon=(-105.26, -102.0), miles=20.0, prefixes=("33", "25"), kl=0.55, kp=0.25,
        ranges=((5000, 12000), (600, 2500), (25, 70)),
        formations=("Bakken", "Middle Bakken", "Three Forks", "Three Forks 1st",
                    "Three Forks 2nd", "Three Forks 3rd"),
    ),
}


def per_basin(key, column="basin_name"):
    whens = " ".join(f"WHEN '{n}' THEN {b[key]}::DOUBLE" for n, b in BASINS.items())
    return f"(CASE {column} {whens} END)"


def well_id(k):
    return (
        f"(CASE WHEN {k} % 10 = 9 THEN '42' WHEN {k} % 2 = 0 THEN '05' WHEN {k} % 4 = 1 "
        f"THEN '33' ELSE '25' END || lpad(({k})::VARCHAR, 8, '0'))"
    )


def spud(k):
    return f"(DATE '1994-07-01' + (({k} * 37) % 1500)::INTEGER)"


def lat(k):
    return f"(CASE WHEN {k} % 2 = 0 THEN 40::DOUBLE ELSE 47.6::DOUBLE END + (({k} * 7919) % 1000) / 1000::DOUBLE * 0.6::DOUBLE)"


def lon(k):
    return f"(CASE WHEN {k} % 2 = 0 THEN (-104.8)::DOUBLE ELSE (-103.6)::DOUBLE END + (({k} * 104729) % 997) / 997::DOUBLE * 0.8::DOUBLE)"


def formation(k):
    return (
        f"CASE WHEN {k} % 2 = 0 AND ({k} // 10) % 2 = 0 THEN 'NIOBRARA' WHEN {k} % 2 = 0 THEN 'CODELL' "
        f"WHEN ({k} // 10) % 2 = 0 THEN 'BAKKEN' ELSE 'THREE FORKS' END"
    )


def fence(b, state, la, lo):
    return (
        f"({state} IN {b['states']} AND {la} BETWEEN {b['lat'][0]} AND {b['lat'][1]} "
        f"AND {lo} BETWEEN {b['lon'][0]} AND {b['lon'][1]})"
    )


HEADERS = f"""
SELECT s_suppkey AS k, {well_id('s_suppkey')} AS well_api, s_name AS well_name,
  CASE WHEN s_suppkey % 29 <> 28 THEN 'OP' || (s_nationkey % 6)::VARCHAR END AS operator_name,
  CASE WHEN s_suppkey % 10 = 9 THEN 'TX' WHEN s_suppkey % 2 = 0 THEN 'CO'
       WHEN s_suppkey % 4 = 1 THEN 'ND' ELSE 'MT' END AS state_abbr,
  'County ' || (s_suppkey % 7)::VARCHAR AS county,
  {lat('s_suppkey')} AS surface_lat, {lon('s_suppkey')} AS surface_lng,
  {spud('s_suppkey')} AS spud_date,
  CASE WHEN s_suppkey % 19 <> 18 THEN {spud('s_suppkey')} + 120 END AS completion_date,
  CASE WHEN s_suppkey % 3 = 2 THEN 'GAS' ELSE 'OIL' END AS well_type,
  CASE WHEN s_suppkey % 8 = 7 THEN 'Vertical' ELSE 'Horizontal' END AS drill_type,
  CASE WHEN s_suppkey % 17 <> 16 THEN {formation('s_suppkey')} END AS reservoir,
  CASE WHEN s_suppkey % 23 <> 22 THEN 8000 + (s_suppkey * 613) % 4000 END AS lateral_length,
  8000000 + (s_suppkey * 7561) % 12000000 AS proppant_lbs,
  (300000 + (s_suppkey * 977) % 400000)::DOUBLE AS water_gals
FROM supplier"""


def label(key):
    whens = " ".join(
        f"WHEN {fence(b, 'state_abbr', 'surface_lat', 'surface_lng')} THEN '{b['code'] if key == 'code' else n}'"
        for n, b in BASINS.items()
    )
    return f"(CASE {whens} END)"


def feed(flag, quantity):
    return f"""
SELECT {well_id('l_suppkey')} AS well_id, date_trunc('month', l_shipdate)::DATE AS prod_date,
  sum({quantity})::DOUBLE AS q
FROM lineitem WHERE l_returnflag <> '{flag}' AND l_shipdate >= {spud('l_suppkey')}
GROUP BY 1, 2"""


def unit(prefix, la, lo):
    beta = f"atan({1 - FL!r} * tan(radians({la})))"
    return (
        f"cos({beta}) * cos(radians({lo})) AS {prefix}x, cos({beta}) * sin(radians({lo})) AS {prefix}y, "
        f"sin({beta}) AS {prefix}z"
    )


def with_distance(inner):
    """Rows of ``inner`` (with t and c unit vectors) plus the spheroidal distance."""
    return f"""
SELECT * EXCLUDE (h, zm, zd, sg, sn, tx, ty, tz, cx, cy, cz),
  CASE WHEN h = 0 THEN 0::DOUBLE ELSE {A} * (sg - {FL / 2!r} * ((sg - sn) * zm * zm / (1 - h) + (sg + sn) * zd * zd / h)) / {MILE} END AS distance_mi
FROM (SELECT *, 2 * asin(sqrt(h)) AS sg, 2 * sqrt(h * (1 - h)) AS sn
  FROM (SELECT *, ((tx - cx) * (tx - cx) + (ty - cy) * (ty - cy) + (tz - cz) * (tz - cz)) / 4 AS h,
    (tz + cz) / 2 AS zm, (cz - tz) / 2 AS zd FROM ({inner}) AS i0) AS i1) AS i2"""


_SIDE = (
    "well_id AS {0}_id, basin_name AS {0}_basin, lat AS {0}_lat, lon AS {0}_lon, "
    "first_prod_date AS {0}_first, lateral_length AS {0}_lateral, proppant_per_ft AS {0}_ppf, "
    "fluid_per_ft AS {0}_fpf, operator_name AS {0}_operator, formation AS {0}_formation"
)
T_SIDE = f"(SELECT {_SIDE.format('target')}, {unit('t', 'lat', 'lon')} FROM {{}}) AS t"
C_SIDE = f"(SELECT {_SIDE.format('candidate')}, {unit('c', 'lat', 'lon')} FROM early) AS c"
T_EARLY = T_SIDE.format("early")
T_TEST = T_SIDE.format("test_set")


def pairs(targets, rule, radius, extra="*"):
    return f"""
SELECT {extra} FROM ({with_distance(f'SELECT * FROM {targets} JOIN {C_SIDE} ON {rule}')}) AS p
WHERE distance_mi <= {radius}"""


def nearest(inner, k):
    return f"""
SELECT *, analog_rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, candidate_id) AS analog_rank
FROM ({inner}) AS n0) AS n1 WHERE analog_rank <= {k}"""


REVENUE = [70 / (1 + 0.10 / 12) ** i for i in range(9)]
EARLY = [1 / 1.01**i for i in range(9)]
MAE = [3, 3, 2, 2, 1.5, 1.5, 1, 1, 1]


def weight(values, month="m"):
    total = sum(values)
    return f"(CASE {month} {' '.join(f'WHEN {i} THEN {v / total!r}::DOUBLE' for i, v in enumerate(values))} END)"


def clamp(expr, low=0.7, high=1.3):
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {expr}))"


_BEFORE = "c.candidate_first < t.target_first AND c.candidate_basin = t.target_basin AND c.candidate_formation = t.target_formation"

CTE = {
    "raw_wells": HEADERS,
    "labelled": f"""
SELECT *, {label('code')} AS basin, {label('name')} AS basin_name FROM raw_wells
WHERE spud_date >= DATE '1994-01-01' AND {label('code')} IS NOT NULL""",
    "wells": """
SELECT k, well_api AS well_id, well_name, operator_name AS operator, state_abbr AS state, county, basin,
  basin_name, surface_lat AS lat, surface_lng AS lon, spud_date, completion_date, well_type, drill_type,
  reservoir AS formation, lateral_length, proppant_lbs, water_gals AS fluid_gals FROM labelled""",
    "legacy": f"""
SELECT k, well_api AS well_id, 'DOC-' || k::VARCHAR AS universal_doc_no, surface_lat AS lat, surface_lng AS lon,
  operator_name AS operator, reservoir AS formation, well_name, state_abbr AS state, county,
  CASE WHEN k % 2 = 0 THEN 'Denver Basin' ELSE 'Williston' END AS basin, completion_date AS first_prod_date,
  lateral_length, proppant_lbs, water_gals AS fluid_gals, 15000 + (k * 31) % 6000 AS measured_depth,
  6000 + (k * 17) % 2000 AS tvd, drill_type, well_type,
  CASE WHEN k % 11 = 10 THEN 'SHUT IN' ELSE 'PRODUCING' END AS well_status, spud_date,
  CASE WHEN k % 13 <> 12 THEN spud_date - 60 END AS permit_date,
  CASE WHEN lateral_length > 0 THEN proppant_lbs::DOUBLE / lateral_length END AS proppant_per_ft,
  CASE WHEN lateral_length > 0 THEN water_gals / lateral_length END AS fluid_per_ft
FROM raw_wells WHERE completion_date >= DATE '1995-01-01' AND spud_date >= DATE '1995-01-01'
  AND (k % 13 = 12 OR spud_date - 60 >= DATE '1995-01-01')""",
    "feeds": f"""
SELECT well_id, prod_date, q AS oil, NULL::DOUBLE AS gas FROM ({feed('R', 'l_extendedprice::DECIMAL(18,2)')}) AS a
UNION ALL SELECT well_id, prod_date, NULL::DOUBLE, q FROM ({feed('A', 'l_quantity')}) AS b""",
    "monthly": """
SELECT well_id, prod_date, max(oil) AS oil_bbls, max(gas) AS gas_mcf FROM feeds
WHERE prod_date >= DATE '1994-01-01' AND well_id IN (SELECT well_id FROM wells) GROUP BY 1, 2""",
    "gated": """
SELECT * FROM monthly WHERE well_id IN
  (SELECT well_id FROM monthly GROUP BY 1 HAVING count(DISTINCT prod_date) >= 9)""",
    "indexed": """
SELECT g.*, f.true_first_prod_date, datediff('month', f.true_first_prod_date, prod_date) AS month_index
FROM gated g JOIN (SELECT well_id, min(prod_date) AS true_first_prod_date FROM gated GROUP BY 1) f USING (well_id)""",
    "peak": """
SELECT well_id, month_index AS peak_month, oil_bbls AS peak_oil FROM (SELECT *, row_number() OVER
  (PARTITION BY well_id ORDER BY oil_bbls DESC, prod_date) AS r FROM indexed
  WHERE month_index <= 6 AND oil_bbls > 0) AS x WHERE r = 1""",
    "prod": """
SELECT i.well_id, prod_date, month_index - peak_month AS prod_month, oil_bbls, gas_mcf, w.basin, w.basin_name
FROM indexed i JOIN peak USING (well_id) LEFT JOIN wells w USING (well_id) WHERE month_index >= peak_month""",
    "firsts": "SELECT well_id, min(prod_date) AS first_prod_date FROM prod GROUP BY 1",
    "model_wells": "SELECT w.*, f.first_prod_date FROM wells w LEFT JOIN firsts f USING (well_id)",
    "past": """
SELECT well_id, min(prod_date) AS first_prod_date, count(DISTINCT prod_month) AS months_available,
  sum(CASE WHEN coalesce(oil_bbls, 0) = 0 THEN 1 ELSE 0 END) AS zero_rows,
  sum(CASE WHEN prod_month BETWEEN 0 AND 8 THEN 1 ELSE 0 END) AS window_rows FROM prod GROUP BY 1""",
    "eligible": """
SELECT p.*, w.basin_name, w.operator AS operator_name, w.formation, w.lat, w.lon,
  w.lateral_length::DOUBLE AS lateral_length, w.proppant_lbs::DOUBLE AS proppant_used, w.fluid_gals AS water_used
FROM past p JOIN wells w USING (well_id) WHERE months_available >= 9 AND lateral_length > 0
  AND year(first_prod_date) >= 1995""",
    "all_months": """
SELECT e.well_id, m.m, coalesce(max(p.oil_bbls), 0) AS oil, coalesce(max(p.gas_mcf), 0) AS gas
FROM eligible e CROSS JOIN range(9) AS m(m) LEFT JOIN prod p ON p.well_id = e.well_id AND p.prod_month = m.m
GROUP BY 1, 2""",
    "all_sums": """
SELECT well_id, sum(CASE WHEN oil = 0 THEN 1 ELSE 0 END) AS zero_months_count, avg(oil) AS avg_oil,
  avg(gas) AS avg_gas, sum(oil) AS cum_oil, sum(gas) AS cum_gas, max(oil) AS peak_oil, max(gas) AS peak_gas,
  arg_min(m, (-oil, m)) + 1 AS peak_oil_month, arg_min(m, (-gas, m)) + 1 AS peak_gas_month,
  max(CASE WHEN m = 8 THEN oil END) AS last_oil, max(CASE WHEN m = 8 THEN gas END) AS last_gas
FROM all_months GROUP BY 1""",
    "early": """
SELECT e.* EXCLUDE (months_available, zero_rows, window_rows), s.* EXCLUDE (well_id),
  e.proppant_used / e.lateral_length AS proppant_per_ft, e.water_used / e.lateral_length AS fluid_per_ft
FROM eligible e JOIN all_sums s USING (well_id)
WHERE zero_rows <= 2 AND window_rows >= 9 AND zero_months_count <= 2""",
    "curve": "SELECT * FROM all_months WHERE well_id IN (SELECT well_id FROM early)",
    "peak_table": """
SELECT well_id, basin_name, peak_oil, peak_gas, peak_oil_month, peak_gas_month,
  peak_oil / (lateral_length / 1000) AS peak_oil_per_kft, peak_gas / (lateral_length / 1000) AS peak_gas_per_kft,
  peak_oil / (proppant_per_ft + 1) AS peak_oil_per_ppf,
  greatest(0, least(1, CASE WHEN peak_oil > 0 THEN (peak_oil - last_oil) / (peak_oil + 1) ELSE 0 END)) AS oil_decline_rate,
  greatest(0, least(1, CASE WHEN peak_gas > 0 THEN (peak_gas - last_gas) / (peak_gas + 1) ELSE 0 END)) AS gas_decline_rate
FROM early""",
    "base_pairs": pairs(
        T_EARLY,
        "c.candidate_basin = t.target_basin AND c.candidate_id <> t.target_id AND c.candidate_first <= t.target_first"
        " AND c.candidate_lateral BETWEEN t.target_lateral * (1 - 0.2::DOUBLE) AND t.target_lateral * (1 + 0.2::DOUBLE)",
        per_basin("miles", "target_basin"),
    ),
    "space": f"""
SELECT e.basin_name, e.well_id, count(CASE WHEN d <= 1 THEN 1 END) AS wells_within_1mi_at_start,
  count(CASE WHEN d <= 3 THEN 1 END) AS wells_within_3mi_at_start,
  coalesce(min(d), 999) AS distance_to_nearest_at_start,
  coalesce(max(CASE WHEN r = 2 THEN d END), 999) AS distance_to_second_nearest_at_start
FROM early e LEFT JOIN (SELECT target_id, distance_mi AS d,
    row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, candidate_id) AS r
  FROM ({pairs(T_EARLY, 'c.candidate_basin = t.target_basin AND c.candidate_id <> t.target_id AND c.candidate_first <= t.target_first', per_basin('miles', 'target_basin'))}) AS q)
  AS n ON n.target_id = e.well_id GROUP BY 1, 2""",
    "cand": """
SELECT p.target_id, p.candidate_id, p.target_basin AS basin_name, distance_mi,
  candidate_lateral / target_lateral AS length_ratio, candidate_lateral - target_lateral AS delta_length,
  CASE WHEN upper(candidate_formation) IS NOT DISTINCT FROM upper(target_formation) THEN 1 ELSE 0 END AS formation_match,
  CASE WHEN candidate_operator = target_operator THEN 1 ELSE 0 END AS same_operator,
  year(target_first) - year(candidate_first) AS vintage_gap_years,
  candidate_ppf / nullif(target_ppf, 0) AS ppf_ratio, candidate_fpf / nullif(target_fpf, 0) AS fpf_ratio,
  target_first, candidate_first, target_operator AS target_operator_name,
  candidate_operator AS candidate_operator_name, target_formation, candidate_formation,
  s.wells_within_1mi_at_start, s.wells_within_3mi_at_start, s.distance_to_nearest_at_start,
  s.distance_to_second_nearest_at_start
FROM base_pairs p JOIN space s ON s.well_id = p.candidate_id""",
    "train": """
SELECT c.*, t.lateral_length AS target_lateral, t.proppant_per_ft AS target_ppf, d.lateral_length AS candidate_lateral,
  d.proppant_per_ft AS candidate_ppf, t.cum_oil AS target_cum, d.cum_oil AS candidate_cum,
  pt.peak_oil AS target_peak_oil, pt.peak_gas AS target_peak_gas, pt.peak_oil_month AS target_peak_oil_month,
  pt.oil_decline_rate AS target_oil_decline_rate, pc.peak_oil AS candidate_peak_oil,
  pc.peak_gas AS candidate_peak_gas, pc.peak_oil_month AS candidate_peak_oil_month,
  pc.oil_decline_rate AS candidate_oil_decline_rate
FROM cand c JOIN early t ON t.well_id = c.target_id JOIN early d ON d.well_id = c.candidate_id
LEFT JOIN peak_table pt ON pt.well_id = c.target_id LEFT JOIN peak_table pc ON pc.well_id = c.candidate_id
WHERE formation_match = 1 AND year(t.first_prod_date) BETWEEN 1995 AND 1997""",
    "alt": """
SELECT c.*, t.lateral_length AS target_lateral, d.lateral_length AS candidate_lateral,
  t.proppant_per_ft AS target_ppf, d.proppant_per_ft AS candidate_ppf, t.fluid_per_ft AS target_fpf,
  d.fluid_per_ft AS candidate_fpf, t.cum_oil AS target_cum, d.cum_oil AS candidate_cum,
  t.cum_gas AS target_cum_gas, d.cum_gas AS candidate_cum_gas, t.avg_oil AS target_avg_oil,
  d.avg_oil AS candidate_avg_oil, year(t.first_prod_date) AS ty, month(t.first_prod_date) AS tm,
  year(d.first_prod_date) AS cy, month(d.first_prod_date) AS cm
FROM cand c JOIN early t ON t.well_id = c.target_id JOIN early d ON d.well_id = c.candidate_id
WHERE distance_mi <= 15 AND year(t.first_prod_date) < 1998""",
    "wide": """
SELECT *, candidate_ppf / (target_ppf + 1) AS proppant_ratio, candidate_fpf / (target_fpf + 1) AS fluid_ratio,
  ln(1 + length_ratio) AS log_lateral_ratio, ln(1 + candidate_ppf / (target_ppf + 1)) AS log_proppant_ratio,
  ln(1 + candidate_fpf / (target_fpf + 1)) AS log_fluid_ratio, target_cum / (target_lateral + 1) AS target_oil_per_ft,
  candidate_cum / (candidate_lateral + 1) AS candidate_oil_per_ft,
  (candidate_cum / (candidate_lateral + 1)) / (target_cum / (target_lateral + 1) + 1) AS oil_per_ft_ratio,
  CASE WHEN ty = cy THEN 1 ELSE 0 END AS vintage_match, abs(vintage_gap_years) AS vintage_gap_abs,
  abs(tm - cm) AS month_diff, CASE WHEN abs(tm - cm) <= 2 THEN 1 ELSE 0 END AS same_season FROM alt""",
    "scored_alt": f"""
SELECT a.target_id, a.candidate_id, g.gap / (t.avg_oil + 1) AS production_error,
  exp(-g.gap / (t.avg_oil + 1)) AS analog_score,
  CASE WHEN g.gap / (t.avg_oil + 1) < 0.2 THEN 1 ELSE 0 END AS is_good_analog
FROM alt a JOIN early t ON t.well_id = a.target_id JOIN (
  SELECT p.target_id, p.candidate_id, sum(abs(x.oil - y.oil) * {weight(EARLY, 'x.m')}) AS gap
  FROM alt p JOIN curve x ON x.well_id = p.target_id JOIN curve y ON y.well_id = p.candidate_id AND y.m = x.m
  GROUP BY 1, 2) g ON g.target_id = a.target_id AND g.candidate_id = a.candidate_id""",
    "graded": f"""
WITH e AS (SELECT p.target_id, p.candidate_id, any_value(p.distance_mi) AS distance_mi,
  sum(abs(x.oil - y.oil * {clamp('pow(p.length_ratio, 0.6)')} * {clamp('pow(p.target_ppf / (p.candidate_ppf + 1), 0.2)')})
    * {weight(REVENUE, 'x.m')}) AS revenue_error
  FROM train p JOIN curve x ON x.well_id = p.target_id JOIN curve y ON y.well_id = p.candidate_id AND y.m = x.m
  GROUP BY 1, 2),
 q AS (SELECT target_id, quantile_cont(revenue_error, 0.1) AS a, quantile_cont(revenue_error, 0.3) AS b,
  quantile_cont(revenue_error, 0.6) AS c FROM e GROUP BY 1)
SELECT e.*, CASE WHEN revenue_error <= a + 1e-9 THEN 3 WHEN revenue_error <= b + 1e-9 THEN 2
  WHEN revenue_error <= c + 1e-9 THEN 1 ELSE 0 END AS label FROM e JOIN q USING (target_id)""",
    "ranked_labels": """
SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, candidate_id) AS r,
  row_number() OVER (PARTITION BY target_id ORDER BY label DESC) AS best_r,
  CASE label WHEN 3 THEN 7 WHEN 2 THEN 3 ELSE label END AS gain FROM graded""",
    "rank_metrics": """
WITH h AS (SELECT *, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER
  (PARTITION BY target_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM ranked_labels)
SELECT target_id,
  CASE WHEN max(gain) > 0 THEN sum(CASE WHEN r <= 20 THEN gain / log2(r + 1) ELSE 0 END)
    / sum(CASE WHEN best_r <= 20 THEN gain / log2(best_r + 1) ELSE 0 END) ELSE 1 END AS ndcg,
  CASE WHEN max(gain) > 0 THEN sum(CASE WHEN r <= 20 AND label > 0 THEN hits::DOUBLE / r ELSE 0 END)
    / least(20, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END)) ELSE 1 END AS map
FROM h GROUP BY 1""",
    "knn": nearest(
        pairs(
            T_EARLY,
            _BEFORE + " AND c.candidate_lateral BETWEEN t.target_lateral * (1 - 0.2::DOUBLE) AND t.target_lateral * (1 + 0.2::DOUBLE)",
            per_basin("miles", "target_basin"),
        ),
        20,
    ),
    "median_fc": """
SELECT k.target_id, y.m, median(y.oil) AS p50_oil, count(*) AS n_analogs, avg(distance_mi) AS avg_distance_mi
FROM knn k JOIN curve y ON y.well_id = k.candidate_id GROUP BY 1, 2""",
    "mae": f"""
SELECT f.target_id, any_value(e.basin_name) AS basin_name, any_value(n_analogs) AS n_analogs,
  sum(abs(x.oil - p50_oil) * {weight(MAE, 'f.m')}) AS weighted_mae
FROM median_fc f JOIN early e ON e.well_id = f.target_id
JOIN curve x ON x.well_id = f.target_id AND x.m = f.m GROUP BY 1""",
    "requests": f"""
SELECT 'NEW' || c_custkey::VARCHAR AS target_id,
  CASE WHEN c_custkey % 50 = 49 THEN 35::DOUBLE ELSE {lat('c_custkey')} END AS lat,
  CASE WHEN c_custkey % 50 = 49 THEN (-99)::DOUBLE ELSE {lon('c_custkey')} END AS lon,
  {formation('c_custkey')} AS formation, (8000 + (c_custkey * 431) % 4000)::DOUBLE AS lateral_length,
  CASE WHEN c_custkey % 5 <> 4 THEN (900 + (c_custkey * 13) % 1200)::DOUBLE ELSE 2000 END AS ppf,
  CASE WHEN c_custkey % 6 <> 5 THEN (30 + c_custkey % 40)::DOUBLE ELSE 50 END AS fpf,
  CASE WHEN c_custkey % 4 <> 3 THEN 'OP' || (c_nationkey % 6)::VARCHAR END AS operator,
  CASE WHEN c_custkey % 3 <> 2 THEN DATE '1997-01-01' + (c_custkey % 1200)::INTEGER END AS planned_date
FROM customer""",
    "request_pairs": nearest(
        f"""SELECT *, target_lateral / candidate_lateral AS length_ratio,
  target_lateral - candidate_lateral AS delta_length,
  CASE WHEN upper(candidate_formation) = upper(target_formation) THEN 1 ELSE 0 END AS formation_match,
  target_ppf / nullif(candidate_ppf, 0) AS ppf_ratio, target_fpf / nullif(candidate_fpf, 0) AS fpf_ratio,
  2002 - year(candidate_first) AS vintage_years FROM ("""
        + pairs(
            "(SELECT target_id, lateral_length AS target_lateral, formation AS target_formation, ppf AS target_ppf, "
            "fpf AS target_fpf, operator AS target_operator_wanted, planned_date, "
            + unit("t", "lat", "lon")
            + " FROM requests) AS t",
            "(t.planned_date IS NULL OR c.candidate_first <= t.planned_date) AND c.candidate_lateral BETWEEN "
            "t.target_lateral * (1 - 0.2::DOUBLE) AND t.target_lateral * (1 + 0.2::DOUBLE)",
            15,
        )
        + ") AS z",
        500,
    ),
    "request_chosen": """
WITH a AS (SELECT *, -distance_mi AS score, row_number() OVER (PARTITION BY target_id, candidate_operator
  ORDER BY distance_mi, candidate_id) AS per_op FROM request_pairs),
 b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, candidate_id) AS rk
  FROM a WHERE per_op <= 3),
 c AS (SELECT *, exp((score - max(score) OVER (PARTITION BY target_id)) / 0.4) AS e FROM b WHERE rk <= 20)
SELECT *, e / sum(e) OVER (PARTITION BY target_id) AS weight FROM c""",
    "request_warped": f"""
SELECT q.target_id, q.candidate_id, q.weight, y.m, y.oil
  * {clamp('pow(target_lateral / candidate_lateral, ' + per_basin('kl', 'candidate_basin') + ')')}
  * {clamp('pow(target_ppf / (candidate_ppf + 1), ' + per_basin('kp', 'candidate_basin') + ')')} AS oil
FROM request_chosen q JOIN curve y ON y.well_id = q.candidate_id""",
    "request_curves": """
SELECT target_id, m, sum(oil * weight) AS p50_oil, quantile_cont(oil, 0.1) AS p10_oil,
  quantile_cont(oil, 0.9) AS p90_oil, count(*) AS n_analogs FROM request_warped GROUP BY 1, 2""",
    "request_fc": """
SELECT r.target_id AS well_id, r.lat, r.lon, r.formation, r.lateral_length, r.ppf AS proppant_per_ft,
  r.fpf AS fluid_per_ft, CASE WHEN s.n IS NULL THEN 'No suitable analog candidates found' END AS error,
  coalesce(s.n, 0) AS n_analogs, s.p10_cum_9mo, s.p50_cum_9mo, s.p90_cum_9mo, d.avg_distance_mi
FROM requests r LEFT JOIN (SELECT target_id, max(n_analogs) AS n, sum(p10_oil) AS p10_cum_9mo,
  sum(p50_oil) AS p50_cum_9mo, sum(p90_oil) AS p90_cum_9mo FROM request_curves GROUP BY 1) s USING (target_id)
LEFT JOIN (SELECT target_id, round(avg(distance_mi), 1) AS avg_distance_mi FROM request_chosen GROUP BY 1) d
  USING (target_id)""",
    "test_curve": """
SELECT p.well_id, row_number() OVER (PARTITION BY p.well_id ORDER BY prod_month, prod_date) - 1 AS m,
  coalesce(oil_bbls, 0) AS oil, coalesce(gas_mcf, 0) AS gas FROM prod p WHERE prod_month < 9
  AND well_id IN (SELECT well_id FROM prod WHERE prod_month < 9 GROUP BY 1 HAVING count(*) = 9)""",
    "test_set": """
SELECT w.well_id, w.operator AS operator_name, w.formation, w.lat, w.lon, w.basin_name,
  w.lateral_length::DOUBLE AS lateral_length, w.proppant_lbs::DOUBLE / w.lateral_length AS proppant_per_ft,
  w.fluid_gals / w.lateral_length AS fluid_per_ft, f.first_prod_date
FROM wells w JOIN firsts f USING (well_id) WHERE formation IS NOT NULL AND lateral_length > 0
  AND year(f.first_prod_date) = 1998 AND month(f.first_prod_date) <= 6
  AND w.well_id IN (SELECT well_id FROM test_curve)""",
    "eval_pairs": f"""
SELECT *, candidate_lateral / target_lateral AS length_ratio,
  candidate_lateral - target_lateral AS delta_length,
  CASE WHEN candidate_operator = target_operator THEN 1 ELSE 0 END AS same_operator,
  year(target_first) - year(candidate_first) AS vintage_gap_years,
  candidate_ppf / nullif(target_ppf, 0) AS ppf_ratio, candidate_fpf / nullif(target_fpf, 0) AS fpf_ratio
FROM ({nearest(pairs(T_TEST, _BEFORE, 20), 500)}) AS v""",
    "chosen": f"""
SELECT e.target_id, e.candidate_id, e.target_basin AS basin_name, e.distance_mi, e.analog_rank, y.m, y.oil
  * {clamp('pow(target_lateral / candidate_lateral, 0.6)')}
  * CASE WHEN target_ppf > 0 AND candidate_ppf > 0 THEN {clamp('pow(target_ppf / candidate_ppf, 0.2)')} ELSE 1 END AS oil
FROM eval_pairs e JOIN curve y ON y.well_id = e.candidate_id WHERE analog_rank <= 20""",
    "warped_fc": """
SELECT target_id, basin_name, m, avg(oil) AS p50_oil, count(*) AS n_analogs, avg(distance_mi) AS avg_distance_mi
FROM chosen GROUP BY 1, 2, 3""",
    "test_knn": nearest(
        pairs(
            T_TEST,
            _BEFORE + " AND c.candidate_lateral BETWEEN t.target_lateral * (1 - 0.2::DOUBLE) AND t.target_lateral * (1 + 0.2::DOUBLE)",
            per_basin("miles", "target_basin"),
        ),
        20,
    ),
    "test_median": """
SELECT k.target_id, k.target_basin AS basin_name, y.m, median(y.oil) AS p50_oil FROM test_knn k
JOIN curve y ON y.well_id = k.candidate_id GROUP BY 1, 2, 3""",
    "test_errors": f"""
SELECT 'baseline' AS model, f.target_id, f.basin_name, sum(abs(x.oil - p50_oil) * {weight(MAE, 'f.m')}) AS weighted_mae
FROM test_median f JOIN test_curve x ON x.well_id = f.target_id AND x.m = f.m GROUP BY 1, 2, 3
UNION ALL SELECT 'ranked', f.target_id, f.basin_name, sum(abs(x.oil - p50_oil) * {weight(MAE, 'f.m')})
FROM warped_fc f JOIN test_curve x ON x.well_id = f.target_id AND x.m = f.m GROUP BY 1, 2, 3""",
    "test_stats": """
SELECT model, basin_name, median(weighted_mae) AS median, avg(weighted_mae) AS mean,
  quantile_cont(weighted_mae, 0.1) AS p10, quantile_cont(weighted_mae, 0.9) AS p90, count(*) AS n_wells
FROM test_errors GROUP BY 1, 2""",
    "winners": """
SELECT b.basin_name, b.n_wells, CASE WHEN b.median < r.median THEN 'baseline' ELSE 'ranked' END AS winner,
  CASE WHEN b.median < r.median THEN (r.median - b.median) / r.median ELSE (b.median - r.median) / b.median END * 100
    AS improvement_pct
FROM test_stats b JOIN test_stats r ON r.basin_name = b.basin_name AND r.model = 'ranked' WHERE b.model = 'baseline'""",
}

CTE |= {
    # Log curves of the wells with enough producing months, standardised by month.
    "pca_input": " UNION ALL ".join(
        f"""
SELECT '{f}' AS fluid, well_id, m, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z
FROM (SELECT well_id, m, ln(1 + {f}) AS x FROM curve
  WHERE well_id IN (SELECT well_id FROM curve WHERE {f} > 0 GROUP BY 1 HAVING count(*) >= 7)) AS v{f}
WINDOW w AS (PARTITION BY m)"""
        for f in ("oil", "gas")
    ),
    # Eigenvectors of the correlations: a matrix squared thirty times (and scaled by its trace)
    # is the projection on its first one; take that part off and begin again.
    "pca_model": """
WITH RECURSIVE cell AS (
  SELECT a.fluid, a.m AS i, b.m AS j, avg(a.z * b.z) AS c
  FROM pca_input a JOIN pca_input b ON b.fluid = a.fluid AND b.well_id = a.well_id GROUP BY 1, 2, 3),
line AS (SELECT fluid, i, list(c ORDER BY j) AS l FROM cell GROUP BY 1, 2),
run(fluid, component, step, a, p) AS (
  SELECT fluid, 1, 0, list(l ORDER BY i), list(l ORDER BY i) FROM line GROUP BY 1
  UNION ALL
  SELECT fluid, component + (step = 30)::INT, CASE WHEN step = 30 THEN 0 ELSE step + 1 END,
    CASE WHEN step = 30 THEN rest ELSE a END, CASE WHEN step = 30 THEN rest ELSE squared END
  FROM (
    SELECT *, list_transform(a, lambda l, i: list_transform(l, lambda c, j: c - value * v[i] * v[j])) AS rest,
      list_transform(p, lambda l: list_transform(p, lambda k: list_dot_product(l, k) / trace)) AS squared
    FROM (
      SELECT *, list_dot_product(v, list_transform(a, lambda l: list_dot_product(l, v))) AS value
      FROM (
        SELECT *, list_transform(p[place], lambda c: c / sqrt(list_dot_product(p[place], p[place]))) AS v,
          list_sum(list_transform(p, lambda l: list_dot_product(l, l))) AS trace
        FROM (
          SELECT *, list_position(diagonal, list_max(diagonal)) AS place
          FROM (SELECT *, list_transform(p, lambda l, i: l[i]) AS diagonal FROM run WHERE component <= 4) AS r1
        ) AS r2) AS r3) AS r4) AS r5)
SELECT fluid, component, v, list_dot_product(v, list_transform(a, lambda l: list_dot_product(l, v))) / len(v) AS share
FROM (SELECT *, list_transform(p[place], lambda c: c / sqrt(list_dot_product(p[place], p[place]))) AS v
  FROM (SELECT *, list_position(diagonal, list_max(diagonal)) AS place
    FROM (SELECT *, list_transform(p, lambda l, i: l[i]) AS diagonal FROM run WHERE step = 30 AND component <= 4) AS f1
  ) AS f2) AS f3""",
    "pca_score": """
SELECT fluid, well_id, component, sum(z * v[m + 1]) AS pc FROM pca_input JOIN pca_model USING (fluid) GROUP BY 1, 2, 3""",
    "pca_oil": """
SELECT well_id, list(pc ORDER BY component) AS pcs FROM pca_score WHERE fluid = 'oil' GROUP BY 1""",
    # Similarity and differences of the two wells' components, 0 where one has none.
    "pca_pair": """
SELECT target_id, candidate_id, coalesce(list_dot_product(t.pcs, c.pcs)
    / (sqrt(list_dot_product(t.pcs, t.pcs)) * sqrt(list_dot_product(c.pcs, c.pcs)) + 1e-8), 0) AS embedding_similarity, """
    + ", ".join(f"coalesce(c.pcs[{i + 1}] - t.pcs[{i + 1}], 0) AS embedding_diff_{i}" for i in range(4))
    + """ FROM alt LEFT JOIN pca_oil t ON t.well_id = target_id LEFT JOIN pca_oil c ON c.well_id = candidate_id""",
}

_KEYS = list(CTE)


def _needs(sql):
    import re

    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in _KEYS if n in words]


def with_(sql):
    """Prefix a query with the CTEs it needs, in definition order."""
    needed, queue = set(), _needs(sql)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += [n for n in _needs(CTE[name]) if n != name]
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in _KEYS if n in needed)
    sql = off_ties(sql.strip())
    if not ctes:
        return sql
    return f"WITH {ctes},\n{sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes}\n{sql}"


def off_ties(sql):
    """Move every value off exact rounding ties before its final rounding (", 4" or ", 02")."""
    out, start = "", 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body = sql[at + 6 : end - 1]
        if body.endswith((", 4", ", 02")):
            value, digits = body.rsplit(", ", 1)
            body = f"({value}) + {NUDGE}, {int(digits)}"
        out, start = out + sql[start:at] + f"round({body})", end
    return out + sql[start:]


def r(*names, source="", digits="4"):
    return ", ".join(f"round({source}{n}, {digits}) AS {n}" for n in names)


def flog(x):
    return f"ln(greatest({x}, 0.1))"


_RANKING = f"""
SELECT target_id, candidate_id, {r('distance_mi')}, round(ln(1 + distance_mi), 4) AS log_distance,
  delta_length AS length_delta, round({flog('length_ratio')}, 4) AS log_length_ratio,
  round(abs({flog('length_ratio')}), 4) AS abs_log_length_ratio, {r('ppf_ratio')},
  round({flog('ppf_ratio')}, 4) AS log_ppf_ratio, same_operator, vintage_gap_years, """


def verdicts(wells, prod):
    """The five checks over a wells and a production relation, one row each."""
    return f"""
SELECT 'Basin Consistency Check' AS test_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL - ' || n || ' mismatched basins' END AS result, n AS n_bad
FROM (SELECT count(*) AS n FROM {wells} w JOIN {prod} p USING (well_id) WHERE w.basin <> p.basin OR w.basin_name <> p.basin_name)
UNION ALL SELECT 'First Prod Date Accuracy', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL - ' || n || ' wells have incorrect first_prod_date' END, n
FROM (SELECT count(*) AS n FROM {wells} w JOIN (SELECT well_id, min(prod_date) AS f FROM {prod} GROUP BY 1) p USING (well_id) WHERE w.first_prod_date <> p.f)
UNION ALL SELECT 'Peak Month Alignment', 'Peak months 0-6: ' || n || ' wells', 0
FROM (SELECT count(*) AS n FROM (SELECT well_id FROM {prod} GROUP BY 1 HAVING min(prod_month) BETWEEN 0 AND 6))
UNION ALL SELECT 'DJ Basin Geographic Bounds', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL - ' || n || ' DJ wells outside bounds' END, n
FROM (SELECT count(*) AS n FROM {wells} WHERE basin = 'dj' AND (state <> 'CO' OR lat NOT BETWEEN 39.51 AND 42.19 OR lon NOT BETWEEN -105.13 AND -101.99))
UNION ALL SELECT 'Bakken Geographic Bounds', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL - ' || n || ' Bakken wells outside bounds' END, n
FROM (SELECT count(*) AS n FROM {wells} WHERE basin = 'bakken' AND (state NOT IN ('ND', 'MT') OR lat NOT BETWEEN 46.66 AND 48.99 OR lon NOT BETWEEN -105.26 AND -102.0))
UNION ALL SELECT 'Production History Check', 'All wells have 9+ months: ' || CASE WHEN least >= 9 THEN 'PASS' ELSE 'FAIL - Min months: ' || least END, n
FROM (SELECT min(c) AS least, count(CASE WHEN c < 9 THEN 1 END) AS n FROM (SELECT well_id, count(DISTINCT prod_date) AS c FROM {prod} GROUP BY 1))"""


_HEADER_COLUMNS = """well_id, well_name, operator, state, county, basin, basin_name, round(lat, 4) AS lat,
  round(lon, 4) AS lon, spud_date, completion_date, well_type, drill_type, formation, lateral_length,
  proppant_lbs, round(fluid_gals, 4) AS fluid_gals"""

_BUCKET = """CASE WHEN distance_mi > 0 AND distance_mi <= 1 THEN '0-1mi' WHEN distance_mi > 1 AND distance_mi <= 3 THEN '1-3mi'
  WHEN distance_mi > 3 AND distance_mi <= 5 THEN '3-5mi' WHEN distance_mi > 5 AND distance_mi <= 10 THEN '5-10mi'
  WHEN distance_mi > 10 AND distance_mi <= 15 THEN '10-15mi' END"""
_LABELS = ("0-1mi", "1-3mi", "3-5mi", "5-10mi", "10-15mi")

_SCORED = """(SELECT *, round(CASE WHEN formation_match = 1 THEN 2 ELSE 0 END - abs(1 - length_ratio) * 10, 1) AS score FROM cand)"""

_MATRIX = [
    "distance_mi", "length_ratio", "log_lateral_ratio", "delta_length", "proppant_ratio", "fluid_ratio",
    "log_proppant_ratio", "log_fluid_ratio", "formation_match", "same_operator",
    "CASE WHEN candidate_operator_name IN (SELECT candidate_operator_name FROM alt WHERE candidate_operator_name IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) THEN 1 ELSE 0 END",
    "vintage_gap_years", "vintage_gap_abs", "vintage_match", "same_season", "month_diff", "candidate_oil_per_ft",
    "oil_per_ft_ratio", "target_lateral", "candidate_lateral", "target_ppf", "candidate_ppf", "ty", "cy",
    *[f"CASE WHEN ({_BUCKET}) = '{x}' THEN 1 ELSE 0 END" for x in _LABELS],
    "embedding_similarity", *[f"embedding_diff_{i}" for i in range(4)],
    "analog_score",
]

_PEAK_MEASURES = ("peak_oil", "peak_gas", "peak_oil_per_kft", "peak_gas_per_kft", "oil_decline_rate", "gas_decline_rate")


def _summary(c):
    return (
        f"SELECT '{c}' AS measure, count({c}) AS wells, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, "
        f"round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(stddev_samp({c}), 4) AS std FROM peak_table"
    )


def _rig():
    k = "c_custkey"
    s = f"(DATE '1998-01-01' + ({k} % 1500)::INTEGER)"
    return f"""
SELECT * FROM (SELECT CASE WHEN {k} % 31 <> 30 THEN 'R' || {k}::VARCHAR END AS rig_id, 'L' || ({k} % 400)::VARCHAR AS rig_location_id,
  c_name AS rig_name, round(CASE WHEN {k} % 13 <> 12 THEN 40::DOUBLE + ({k} % 500) / 500::DOUBLE END, 4) AS lat,
  round((-104.8)::DOUBLE + ({k} % 700) / 700::DOUBLE, 4) AS lon, 'OP' || (c_nationkey % 6)::VARCHAR AS operator,
  'Driller ' || ({k} % 9)::VARCHAR AS driller, {well_id(k)} AS well_id,
  CASE WHEN {k} % 2 = 0 THEN 'CO' ELSE 'ND' END AS state, 'County ' || ({k} % 7)::VARCHAR AS county,
  CASE WHEN {k} % 2 = 0 THEN 'Denver Basin' ELSE 'Williston' END AS basin, {s} + 30 AS last_reported,
  CASE WHEN {k} % 7 <> 6 THEN {s} END AS spud_date, {s} - 45 AS permit_date,
  CASE WHEN {k} % 5 = 4 THEN 'Vertical' ELSE 'Horizontal' END AS drill_type, {formation(k)} AS reservoir, 'feed' AS source,
  CASE WHEN {k} % 3 = 0 THEN 'field' ELSE 'office' END AS source_type, CASE WHEN {k} % 4 = 0 THEN 'Y' ELSE 'N' END AS pad_reported,
  'gps' AS coords_source, 'active' AS status FROM customer) AS g
WHERE rig_id IS NOT NULL AND lat IS NOT NULL AND (spud_date IS NULL OR spud_date >= DATE '2000-01-01')
  AND permit_date >= DATE '2000-01-01'"""


_FORMATIONS = " UNION ALL ".join(
    f"SELECT '{n}' AS basin_name, '{f}' AS target" for n, b in BASINS.items() for f in b["formations"]
)


def _range(i, column):
    whens = " ".join(
        f"WHEN '{n}' THEN CASE WHEN {column} BETWEEN {b['ranges'][i][0]} AND {b['ranges'][i][1]} THEN 1 WHEN {column} IS NULL THEN NULL ELSE 0 END"
        for n, b in BASINS.items()
    )
    return f"CASE basin_name {whens} END"


_QUERIES = {
    "basin_filter_label": f"SELECT well_api, state_abbr, {r('surface_lat', 'surface_lng')}, spud_date, basin, basin_name FROM labelled",
    "wells_standardised": f"SELECT {_HEADER_COLUMNS} FROM wells",
    "wells_by_basin": "SELECT basin, basin_name, count(*) AS wells FROM wells GROUP BY 1, 2",
    "legacy_well_clean": f"SELECT * EXCLUDE (k) REPLACE (round(lat, 4) AS lat, round(lon, 4) AS lon, round(proppant_per_ft, 4) AS proppant_per_ft, round(fluid_per_ft, 4) AS fluid_per_ft) FROM legacy",
    "rig_clean": _rig(),
    "legacy_denver_count": "SELECT count(DISTINCT well_id) AS wells FROM legacy WHERE state = 'CO' AND drill_type = 'Horizontal' AND spud_date >= DATE '1994-01-01' AND basin = 'Denver Basin'",
    "dj_view": f"SELECT well_id, {r('lat', 'lon')}, lateral_length, formation FROM legacy WHERE state = 'CO' AND drill_type = 'Horizontal' AND spud_date >= DATE '1994-01-01' AND (basin ILIKE '%DJ%' OR well_id LIKE '05%') AND lateral_length > 0 AND first_prod_date IS NOT NULL",
    "formation_match_score": f"SELECT well_id, target, CASE WHEN upper(formation) = upper(target) THEN 1.0 WHEN upper(formation) LIKE '%' || split_part(upper(target), ' ', 1) || '%' THEN 0.8 ELSE 0.0 END AS score FROM wells JOIN ({_FORMATIONS}) AS f USING (basin_name)",
    "completion_validity": f"SELECT well_id, {_range(0, 'lateral_length')} AS lateral_length_valid, {_range(1, 'proppant_lbs::DOUBLE / lateral_length')} AS proppant_valid, {_range(2, 'fluid_gals / lateral_length')} AS fluid_valid FROM wells",
    "api_and_state_match": "SELECT well_id, CASE WHEN basin = 'dj' THEN (well_id LIKE '05%')::INT ELSE (well_id LIKE '33%' OR well_id LIKE '25%')::INT END AS api_ok, (state IN ('CO', 'ND', 'MT'))::INT AS state_ok FROM wells",
    "production_union_max": f"SELECT well_id, prod_date, {r('oil_bbls', 'gas_mcf')} FROM monthly",
    "history_gate": f"SELECT well_id, prod_date, {r('oil_bbls', 'gas_mcf')} FROM gated",
    "month_index": "SELECT well_id, prod_date, true_first_prod_date, month_index FROM indexed",
    "peak_month": f"SELECT well_id, peak_month, {r('peak_oil')} FROM peak",
    "peak_distribution": "SELECT peak_month, count(*) AS wells FROM peak GROUP BY 1",
    "peak_aligned": f"SELECT well_id, prod_date, prod_month, {r('oil_bbls', 'gas_mcf')}, basin, basin_name FROM prod",
    "production_by_basin": "SELECT basin, basin_name, count(DISTINCT well_id) AS wells, count(*) AS records FROM prod GROUP BY 1, 2",
    "first_prod_update": "SELECT well_id, first_prod_date FROM model_wells",
    "early_eligible": f"SELECT well_id, first_prod_date, months_available, zero_rows, window_rows, basin_name, operator_name, formation, {r('lat', 'lon', 'lateral_length', 'proppant_used', 'water_used')} FROM eligible WHERE zero_rows <= 2",
    "early_newest": "SELECT well_id, first_prod_date, months_available FROM eligible WHERE zero_rows <= 2 ORDER BY first_prod_date DESC, well_id LIMIT 25",
    "early_rates_scalar": f"SELECT well_id, basin_name, operator_name, formation, first_prod_date, zero_months_count, {r('lat', 'lon', 'lateral_length', 'proppant_used', 'water_used', 'proppant_per_ft', 'fluid_per_ft', 'avg_oil', 'avg_gas', 'cum_oil', 'cum_gas')} FROM early",
    "early_rates_long": f"SELECT c.well_id, m + 1 AS month, {r('oil', 'gas', source='c.')}, round(c.oil * 1000 / lateral_length, 4) AS oil_norm, round(c.gas * 1000 / lateral_length, 4) AS gas_norm, round(ln(1 + c.oil), 4) AS oil_log, round(ln(1 + c.gas), 4) AS gas_log FROM curve c JOIN early USING (well_id)",
    "early_stats": "SELECT count(*) AS total_wells, count(DISTINCT operator_name) AS unique_operators, count(DISTINCT formation) AS unique_formations, round(avg(lateral_length), 4) AS avg_lateral_length, round(avg(cum_oil), 4) AS avg_cum_oil, round(avg(cum_gas), 4) AS avg_cum_gas, min(first_prod_date) AS earliest_prod, max(first_prod_date) AS latest_prod FROM early",
    "monthly_series": f"SELECT well_id, m + 1 AS month, {r('oil', 'gas')} FROM test_curve",
    "candidate_pairs": f"SELECT target_basin AS basin_name, target_id, candidate_id, {r('distance_mi')} FROM base_pairs",
    "candidate_measures": f"SELECT target_id, candidate_id, basin_name, formation_match, same_operator, vintage_gap_years, target_operator_name, candidate_operator_name, target_formation, candidate_formation, wells_within_1mi_at_start, wells_within_3mi_at_start, {r('distance_mi', 'length_ratio', 'delta_length', 'ppf_ratio', 'fpf_ratio', 'distance_to_nearest_at_start', 'distance_to_second_nearest_at_start')} FROM cand",
    "candidate_stats": "SELECT basin_name, count(DISTINCT target_id) AS unique_targets, count(DISTINCT candidate_id) AS unique_candidates, count(*) AS total_pairs, round(avg(distance_mi), 4) AS avg_distance_mi, round(median(distance_mi), 4) AS median_distance_mi, round(avg(formation_match) * 100, 4) AS pct_formation_match, round(avg(same_operator) * 100, 4) AS pct_same_operator, round(avg(vintage_gap_years), 4) AS avg_vintage_gap, round(min(distance_mi), 4) AS min_distance_mi, round(max(distance_mi), 4) AS max_distance_mi, round(avg(wells_within_1mi_at_start), 4) AS avg_wells_1mi, round(avg(wells_within_3mi_at_start), 4) AS avg_wells_3mi, round(avg(distance_to_nearest_at_start), 4) AS avg_nearest_mi, round(avg(distance_to_second_nearest_at_start), 4) AS avg_second_nearest_mi FROM cand GROUP BY 1",
    "candidates_per_target": "SELECT basin_name, round(avg(n), 4) AS avg_candidates_per_target, min(n) AS min_candidates, max(n) AS max_candidates, median(n) AS median_candidates FROM (SELECT basin_name, target_id, count(*) AS n FROM cand GROUP BY 1, 2) AS x GROUP BY 1",
    "candidate_top": "SELECT target_id, candidate_id, rank, round(distance_mi, 4) AS distance_mi, round(e.avg_oil, 4) AS candidate_avg_oil, round(e.avg_gas, 4) AS candidate_avg_gas, round(e.cum_oil, 4) AS candidate_cum_oil, round(e.cum_gas, 4) AS candidate_cum_gas FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, abs(1 - length_ratio), candidate_id) AS rank FROM cand) AS x JOIN early e ON e.well_id = x.candidate_id WHERE rank <= 100",
    "spacing_at_start": f"SELECT basin_name, well_id, wells_within_1mi_at_start, wells_within_3mi_at_start, {r('distance_to_nearest_at_start', 'distance_to_second_nearest_at_start')} FROM space",
    "knn_lookup": "SELECT target_id, candidate_id, analog_rank, round(distance_mi, 4) AS distance_mi, target_basin AS basin_name, target_formation AS formation, round(candidate_lateral / target_lateral, 4) AS length_ratio FROM knn",
    "newwell_lookup": f"SELECT target_id, candidate_id, analog_rank, formation_match, vintage_years, {r('distance_mi', 'length_ratio', 'delta_length', 'ppf_ratio', 'fpf_ratio')} FROM request_pairs",
    "eval_lookup": f"SELECT target_id, candidate_id, analog_rank, same_operator, vintage_gap_years, {r('distance_mi', 'length_ratio', 'ppf_ratio', 'fpf_ratio')} FROM eval_pairs",
    "training_pairs": f"SELECT target_id, candidate_id, {r('target_cum', 'candidate_cum')}, round(target_lateral, 4) AS target_lateral_length, round(candidate_ppf, 4) AS candidate_proppant_per_ft, target_peak_oil_month, candidate_peak_oil_month, {r(*[f'{s}_{c}' for s in ('target', 'candidate') for c in ('peak_oil', 'peak_gas', 'oil_decline_rate')])} FROM train",
    "training_targets": "SELECT DISTINCT target_id FROM train ORDER BY 1 LIMIT 20",
    "training_pairs_alt": "SELECT target_id, candidate_id, round(distance_mi, 4) AS distance_mi, ty AS target_vintage_year, tm AS target_vintage_month, round(target_fpf, 4) AS target_fluid_per_ft, round(target_cum_gas, 4) AS target_cum_gas, round(target_avg_oil, 4) AS target_avg_oil, cy AS candidate_vintage_year, cm AS candidate_vintage_month, round(candidate_fpf, 4) AS candidate_fluid_per_ft, round(candidate_cum_gas, 4) AS candidate_cum_gas, round(candidate_avg_oil, 4) AS candidate_avg_oil FROM alt",
    "nearest_topk": f"SELECT target_id, candidate_id, analog_rank, {r('distance_mi')} FROM ({nearest('SELECT * FROM cand', 20)}) AS x",
    "best_topk": f"SELECT target_id, candidate_id, analog_rank, {r('distance_mi')}, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, distance_mi, candidate_id) AS analog_rank FROM {_SCORED} AS s) AS x WHERE analog_rank <= 20",
    "operator_diverse_topk": f"SELECT target_id, candidate_id, analog_rank, {r('distance_mi')}, score, candidate_operator_name FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, distance_mi, candidate_id) AS analog_rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id, candidate_operator_name ORDER BY score DESC, distance_mi, candidate_id) AS per_op FROM {_SCORED} AS s) AS y WHERE per_op <= 3) AS x WHERE analog_rank <= 20",
    "major_operator_flag": "SELECT target_id, candidate_id, candidate_operator_name, CASE WHEN candidate_operator_name IN (SELECT candidate_operator_name FROM cand WHERE candidate_operator_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) THEN 1 ELSE 0 END AS is_major_operator FROM cand",
    "validate_suite": verdicts("model_wells", "prod"),
    "validate_broken": verdicts(
        "(SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN first_prod_date + 31 ELSE first_prod_date END AS first_prod_date, CASE WHEN k % 11 = 0 THEN 10::DOUBLE ELSE lat END AS lat) FROM model_wells)",
        "(SELECT * REPLACE (CASE WHEN substr(well_id, 3)::BIGINT % 13 = 0 THEN 'other' ELSE basin END AS basin) FROM prod WHERE substr(well_id, 3)::BIGINT % 17 <> 0 OR prod_month < 5)",
    ),
    "date_mismatches": "SELECT m.well_id, m.f AS first_prod_date, p.first_prod_date AS actual_first_prod FROM (SELECT well_id, min(prod_date) AS f FROM monthly GROUP BY 1) m JOIN firsts p USING (well_id) WHERE m.f <> p.first_prod_date",
    "volume_summary": "SELECT w.basin, w.basin_name, count(DISTINCT w.well_id) AS wells_total, count(DISTINCT p.well_id) AS wells_with_production, count(p.well_id) AS production_records, floor(count(p.well_id) / count(DISTINCT w.well_id)) AS avg_records_per_well FROM wells w LEFT JOIN prod p USING (well_id) GROUP BY 1, 2",
    "well_date_ranges": "SELECT basin_name, min(spud_date) AS earliest_spud, max(spud_date) AS latest_spud, min(first_prod_date) AS earliest_first_prod, max(first_prod_date) AS latest_first_prod FROM model_wells WHERE first_prod_date IS NOT NULL GROUP BY 1",
    "production_date_ranges": "SELECT basin_name, min(prod_date) AS earliest_prod_data, max(prod_date) AS latest_prod_data, count(DISTINCT date_trunc('month', prod_date)) AS months_of_data FROM prod GROUP BY 1",
    "completeness": "SELECT basin_name, count(*) AS total_wells, count(lateral_length) AS wells_with_lateral_length, count(proppant_lbs) AS wells_with_proppant, count(fluid_gals) AS wells_with_fluid, round(avg(lateral_length), 0) AS avg_lateral_length, round(avg(proppant_lbs), 0) AS avg_proppant_lbs FROM wells GROUP BY 1",
    "first_date_coverage": "SELECT 'before' AS status, count(*) AS total_wells, 0 AS wells_with_first_prod_date, count(*) AS wells_missing_first_prod_date FROM wells UNION ALL SELECT 'after', count(*), count(first_prod_date), count(*) - count(first_prod_date) FROM model_wells",
    "production_coverage": "SELECT w.basin, w.basin_name, count(DISTINCT w.well_id) AS total_wells, count(DISTINCT p.well_id) AS wells_with_production, count(DISTINCT w.well_id) - count(DISTINCT p.well_id) AS wells_without_production, round(100.0 * count(DISTINCT p.well_id) / count(DISTINCT w.well_id), 2) AS production_percentage FROM wells w LEFT JOIN prod p USING (well_id) GROUP BY 1, 2",
    "zero_month_impact": "SELECT basin_name, count(*) AS total_wells, count(CASE WHEN zero_months_count > 0 THEN 1 END) AS wells_to_remove, round(100.0 * count(CASE WHEN zero_months_count > 0 THEN 1 END) / count(*), 1) AS percent_removed FROM eligible JOIN all_sums USING (well_id) WHERE window_rows >= 9 GROUP BY 1",
    "wells_without_production": "SELECT basin, basin_name, count(*) AS wells_without_production FROM wells WHERE well_id NOT IN (SELECT well_id FROM prod) GROUP BY 1, 2",
    "outer_reconcile": "SELECT count(DISTINCT w.well_id) AS wells_in_model_wells, count(DISTINCT p.well_id) AS wells_in_model_prod, count(DISTINCT w.well_id) - count(DISTINCT p.well_id) AS wells_without_production FROM wells w FULL OUTER JOIN prod p ON w.well_id = p.well_id",
    "upsert_partial": """SELECT well_id, basin_name, CASE WHEN k % 2 = 0 THEN operator_name ELSE 'changed' END AS operator_name,
  round(CASE WHEN k % 3 <> 0 THEN cum_oil + 1 ELSE cum_oil END, 4) AS cum_oil, round(cum_gas, 4) AS cum_gas
FROM (SELECT *, substr(well_id, 3)::BIGINT AS k FROM early) AS x WHERE k % 2 = 0 OR k % 3 <> 0""",
    "partition_replace": "SELECT well_id, round(CASE WHEN basin_name = 'bakken' THEN 2 ELSE 1 END * cum_oil, 4) AS cum_oil, basin_name FROM early",
    "peak_features": f"SELECT well_id, basin_name, peak_oil_month, peak_gas_month, {r('peak_oil', 'peak_gas', 'peak_oil_per_kft', 'peak_gas_per_kft', 'peak_oil_per_ppf', 'oil_decline_rate', 'gas_decline_rate')} FROM peak_table",
    "peak_summary": " UNION ALL ".join(_summary(c) for c in _PEAK_MEASURES),
    "peak_by_basin": "SELECT basin_name, count(*) AS wells, count(CASE WHEN peak_oil_month <= 3 THEN 1 END) AS early_oil_peaks, count(CASE WHEN peak_gas_month <= 3 THEN 1 END) AS early_gas_peaks, round(100.0::DOUBLE * count(CASE WHEN peak_oil_month <= 3 THEN 1 END) / count(*), 4) AS early_oil_pct, round(100.0::DOUBLE * count(CASE WHEN peak_gas_month <= 3 THEN 1 END) / count(*), 4) AS early_gas_pct FROM peak_table GROUP BY 1",
    "peak_month_histogram": "SELECT 'oil' AS fluid, peak_oil_month AS month, count(*) AS wells FROM peak_table GROUP BY 2 UNION ALL SELECT 'gas', peak_gas_month, count(*) FROM peak_table GROUP BY 2",
    "wide_pair_features": f"SELECT target_id, candidate_id, vintage_match, vintage_gap_abs, month_diff, same_season, target_formation AS formation_group, {r('proppant_ratio', 'fluid_ratio', 'log_lateral_ratio', 'log_proppant_ratio', 'log_fluid_ratio', 'target_oil_per_ft', 'candidate_oil_per_ft', 'oil_per_ft_ratio')} FROM wide",
    "distance_bucket_onehot": f"SELECT target_id, candidate_id, {_BUCKET} AS distance_bucket, {', '.join(f'''CASE WHEN ({_BUCKET}) = '{x}' THEN 1 ELSE 0 END AS bucket_{i}''' for i, x in enumerate(_LABELS))} FROM cand",
    "training_matrix": f"SELECT target_id, count(*) AS pairs, {', '.join(f'round(avg({c}), 4) AS mean_{i:02d}' for i, c in enumerate(_MATRIX))} FROM wide JOIN scored_alt USING (target_id, candidate_id) JOIN pca_pair USING (target_id, candidate_id) GROUP BY 1",
    "group_sizes": "SELECT target_id, count(*) AS group_size FROM train GROUP BY 1",
    "ranking_features_17": _RANKING
    + f"""{r('candidate_peak_oil')}, round(CASE WHEN target_peak_oil > 0 THEN candidate_peak_oil / (target_peak_oil + 1) ELSE 1 END, 4) AS peak_oil_ratio,
  round(CASE WHEN target_peak_oil > 0 THEN {flog('candidate_peak_oil / (target_peak_oil + 1)')} ELSE 0 END, 4) AS log_peak_oil_ratio,
  round(coalesce(candidate_oil_decline_rate, 0.7) - coalesce(target_oil_decline_rate, 0.7), 4) AS decline_rate_diff,
  wells_within_1mi_at_start, wells_within_3mi_at_start, {r('distance_to_nearest_at_start', 'distance_to_second_nearest_at_start')} FROM train""",
    "ranking_features_no_peaks": _RANKING
    + """0 AS candidate_peak_oil, 1 AS peak_oil_ratio, 0 AS log_peak_oil_ratio, 0 AS decline_rate_diff, 0 AS wells_within_1mi_at_start,
  0 AS wells_within_3mi_at_start, 999 AS distance_to_nearest_at_start, 999 AS distance_to_second_nearest_at_start FROM eval_pairs""",
    "inference_features": """SELECT target_id, candidate_id, round(distance_mi, 4) AS distance_miles, (distance_mi <= 5)::INT AS dist_0_5,
  (distance_mi > 5 AND distance_mi <= 10)::INT AS dist_5_10, (distance_mi > 10 AND distance_mi <= 15)::INT AS dist_10_15,
  round(length_ratio, 4) AS length_ratio, round(ln(1 + length_ratio), 4) AS log_length_ratio, delta_length,
  target_lateral, candidate_lateral, round(coalesce(ppf_ratio, 1), 4) AS ppf_ratio, round(coalesce(fpf_ratio, 1), 4) AS fpf_ratio,
  round(ln(1 + coalesce(ppf_ratio, 1)), 4) AS log_ppf_ratio, round(ln(1 + coalesce(fpf_ratio, 1)), 4) AS log_fpf_ratio, formation_match,
  coalesce((candidate_operator = target_operator_wanted)::INT, 0) AS same_operator, vintage_years AS vintage_gap,
  vintage_years * vintage_years AS vintage_gap_squared, (vintage_years <= 2)::INT AS recent_vintage, 2002 AS target_year,
  2002 - vintage_years AS candidate_year, round(formation_match * distance_mi, 4) AS formation_distance,
  round(coalesce((candidate_operator = target_operator_wanted)::INT, 0) * distance_mi, 4) AS operator_distance FROM request_pairs""",
    "legacy_features_20": f"""SELECT target_id, candidate_id, {r('distance_mi')}, round(distance_mi * 1.60934::DOUBLE, 4) AS distance_km,
  round(ln(1 + distance_mi), 4) AS log_distance, round(length_ratio, 4) AS length_ratio, delta_length AS length_delta,
  round({flog('length_ratio')}, 4) AS log_length_ratio, round(abs({flog('length_ratio')}), 4) AS abs_log_length_ratio,
  round(target_ppf / (candidate_ppf + 1), 4) AS ppf_ratio, round({flog('target_ppf / (candidate_ppf + 1)')}, 4) AS log_ppf_ratio,
  formation_match AS same_formation, same_operator, vintage_gap_years, abs(vintage_gap_years) AS abs_vintage_gap,
  {', '.join(f'round(coalesce(pcs[{i}], 0), 4) AS embedding_pc{i}' for i in range(1, 5))},
  round(distance_mi * formation_match, 4) AS distance_x_formation, round(distance_mi * same_operator, 4) AS distance_x_operator,
  round(abs({flog('length_ratio')}) * {flog('target_ppf / (candidate_ppf + 1)')}, 4) AS length_x_ppf,
  candidate_peak_oil_month - target_peak_oil_month AS peak_month_diff, (candidate_peak_oil_month <= 3)::INT AS early_peak
  FROM train LEFT JOIN pca_oil ON well_id = candidate_id""",
    "embedding_cosine": """
WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS d(i)),
 f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY 1),
 p AS (SELECT a.vec_id, a.label, a.i, a.x AS c, b.x AS t FROM v a JOIN f USING (label) JOIN v b ON b.vec_id = f.first_id AND b.i = a.i)
SELECT label, vec_id, round(sum(c * t) / (sqrt(sum(c * c)) * sqrt(sum(t * t)) + 1e-8), 4) AS embedding_similarity,
  round(max(CASE WHEN i = 1 THEN c - t END), 4) AS embedding_diff_0, round(max(CASE WHEN i = 2 THEN c - t END), 4) AS embedding_diff_1,
  round(max(CASE WHEN i = 3 THEN c - t END), 4) AS embedding_diff_2, round(max(CASE WHEN i = 4 THEN c - t END), 4) AS embedding_diff_3
FROM p GROUP BY 1, 2""",
    "curve_validity": " UNION ALL ".join(
        f"SELECT '{f}' AS fluid, well_id, m + 1 AS month, round(ln(1 + {f}), 4) AS curve FROM curve WHERE well_id IN (SELECT well_id FROM curve WHERE {f} > 0 GROUP BY 1 HAVING count(*) >= 7)"
        for f in ("oil", "gas")
    ),
    "pca_embedding": "SELECT well_id, "
    + ", ".join(
        f"round(max(CASE WHEN fluid = '{f}' AND component = {c} THEN pc END), 4) AS {f}_pc{c}"
        for f in ("oil", "gas")
        for c in range(1, 5)
    )
    + """, (SELECT round(sum(share), 4) FROM pca_model WHERE fluid = 'oil') AS oil_explained_var,
  CASE WHEN count(CASE WHEN fluid = 'gas' THEN 1 END) > 0 THEN (SELECT round(sum(share), 4) FROM pca_model WHERE fluid = 'gas') END AS gas_explained_var
FROM pca_score GROUP BY 1 HAVING count(CASE WHEN fluid = 'oil' THEN 1 END) > 0""",
    "embedding_summary": """
SELECT fluid, component, count(*) AS wells, round(avg(pc), 4) AS mean, round(stddev_pop(pc), 4) AS std, round(min(pc), 4) AS min, round(max(pc), 4) AS max
FROM pca_score WHERE well_id IN (SELECT well_id FROM pca_score WHERE fluid = 'oil') GROUP BY 1, 2""",
    "pca_top_months": """
SELECT m AS month, round(w, 4) AS weight FROM (SELECT i AS m, abs(v[i]) AS w FROM pca_model, range(1, 10) AS x(i) WHERE fluid = 'oil' AND component = 1) AS t
ORDER BY w DESC, m LIMIT 3""",
    "request_round_trip": f"""SELECT target_id AS well_id, {r('lat', 'lon')}, formation, lateral_length, ppf AS proppant_per_ft, fpf AS fluid_per_ft, operator, planned_date FROM requests""",
    "pair_score_labels": f"SELECT target_id, candidate_id, {r('production_error', 'analog_score')}, is_good_analog FROM scored_alt",
    "good_pair_share": "SELECT count(*) AS pairs, round(avg(is_good_analog), 4) AS good_share, round(avg(analog_score), 4) AS mean_score FROM scored_alt",
    "graded_labels": f"SELECT target_id, candidate_id, {r('revenue_error')}, label FROM graded",
    "train_valid_split": "WITH t AS (SELECT target_id, row_number() OVER (ORDER BY target_id) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT target_id FROM train)) SELECT target_id, candidate_id, CASE WHEN p <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM train JOIN t USING (target_id)",
    "ranking_metrics": f"SELECT target_id, {r('ndcg', 'map')} FROM rank_metrics",
    "ranking_metrics_mean": "SELECT count(*) AS targets, round(avg(ndcg), 4) AS ndcg, round(avg(map), 4) AS map FROM rank_metrics",
    "lambda_gradients": """
WITH g AS (SELECT target_id, candidate_id, -distance_mi AS s, CASE label WHEN 3 THEN 7 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS gain,
  row_number() OVER (PARTITION BY target_id ORDER BY distance_mi, candidate_id) AS r, row_number() OVER (PARTITION BY target_id ORDER BY label DESC) AS b FROM graded),
 i AS (SELECT target_id, sum(CASE WHEN b <= 20 THEN gain / log2(b + 1) ELSE 0 END) AS ideal FROM g GROUP BY 1),
 p AS (SELECT x.target_id, x.candidate_id AS better, y.candidate_id AS worse, 1 / (1 + exp(x.s - y.s)) AS rho,
   (x.gain - y.gain) * abs(CASE WHEN x.r <= 20 THEN 1 / log2(x.r + 1) ELSE 0 END - CASE WHEN y.r <= 20 THEN 1 / log2(y.r + 1) ELSE 0 END) / ideal AS d
  FROM g x JOIN g y ON y.target_id = x.target_id AND x.gain > y.gain AND least(x.r, y.r) <= 20 JOIN i ON i.target_id = x.target_id),
 m AS (SELECT target_id, better AS candidate_id, d * rho AS l, d * rho * (1 - rho) AS c FROM p
  UNION ALL SELECT target_id, worse, -d * rho, d * rho * (1 - rho) FROM p)
SELECT target_id, candidate_id, round(coalesce(sum(l), 0), 4) AS lam, round(coalesce(sum(c), 0), 4) AS curvature FROM g LEFT JOIN m USING (target_id, candidate_id) GROUP BY 1, 2""",
    "baseline_median_forecast": f"SELECT target_id, m + 1 AS month, n_analogs, 100 AS formation_match_pct, {r('p50_oil', 'avg_distance_mi')} FROM median_fc",
    "baseline_batch": "SELECT well_id, basin_name, coalesce(f.n_analogs, 0) AS n_analogs, round(f.avg_distance_mi, 4) AS avg_distance_mi, CASE WHEN f.target_id IS NOT NULL THEN 100 END AS formation_match_pct, CASE WHEN f.target_id IS NULL THEN 'No candidates found' END AS error, round(p50_cum, 4) AS p50_cum FROM early e LEFT JOIN (SELECT target_id, max(n_analogs) AS n_analogs, max(avg_distance_mi) AS avg_distance_mi, sum(p50_oil) AS p50_cum FROM median_fc GROUP BY 1) f ON f.target_id = e.well_id",
    "idw_forecast": "SELECT k.target_id, y.m + 1 AS month, round(sum(y.oil * pow(greatest(distance_mi, 0.1), -2)) / sum(pow(greatest(distance_mi, 0.1), -2)), 4) AS p50_oil, count(*) AS n_analogs, round(avg(distance_mi), 4) AS avg_distance_mi FROM knn k JOIN curve y ON y.well_id = k.candidate_id GROUP BY 1, 2",
    "warped_curves": "SELECT target_id, candidate_id, m + 1 AS month, round(oil, 4) AS warped_oil FROM chosen",
    "warped_mean_forecast": f"SELECT target_id, m + 1 AS month, n_analogs, 100 AS formation_match_pct, {r('p50_oil', 'avg_distance_mi')} FROM warped_fc",
    "bootstrap_interval": """
WITH n AS (SELECT target_id, count(DISTINCT candidate_id) AS n FROM chosen GROUP BY 1 HAVING count(DISTINCT candidate_id) > 1),
 d AS (SELECT target_id, n, s, md5('42:' || target_id || ':' || s || ':0') || md5('42:' || target_id || ':' || s || ':1') || md5('42:' || target_id || ':' || s || ':2') AS h
   FROM n CROSS JOIN range(1, 101) AS x(s)),
 p AS (SELECT target_id, s, ('0x' || substr(h, j::INT * 4 + 1, 4))::BIGINT % n + 1 AS pick FROM d JOIN range(20) AS y(j) ON y.j < d.n),
 m AS (SELECT p.target_id, p.s, c.m, avg(c.oil) AS mean FROM p JOIN chosen c ON c.target_id = p.target_id AND c.analog_rank = p.pick GROUP BY 1, 2, 3)
SELECT target_id, m + 1 AS month, round(quantile_cont(mean, 0.1), 4) AS p10_oil, round(quantile_cont(mean, 0.9), 4) AS p90_oil FROM m GROUP BY 1, 2""",
    "softmax_forecast": "SELECT target_id, n_analogs, round(c.p10, 02) AS p10_cum_9mo, round(c.p50, 02) AS p50_cum_9mo, round(c.p90, 02) AS p90_cum_9mo, m + 1 AS month, round(p10_oil, 02) AS p10_oil, round(p50_oil, 02) AS p50_oil, round(p90_oil, 02) AS p90_oil FROM request_curves JOIN (SELECT target_id, sum(p10_oil) AS p10, sum(p50_oil) AS p50, sum(p90_oil) AS p90 FROM request_curves GROUP BY 1) c USING (target_id)",
    "analog_details": """
SELECT q.target_id, g.mean_distance_mi, g.formation_match_pct, g.avg_vintage_gap, rk AS analog_rank, candidate_id AS well_id,
  round(distance_mi, 1) AS distance_mi, round(score, 2) AS score, candidate_operator AS operator,
  candidate_formation AS formation, candidate_lateral AS lateral_length, year(candidate_first) AS vintage_year, round(weight * 100, 1) AS weight
FROM request_chosen q JOIN (SELECT target_id, round(avg(distance_mi), 1) AS mean_distance_mi, round(avg(formation_match) * 100, 1) AS formation_match_pct,
  round(avg(vintage_years), 1) AS avg_vintage_gap FROM request_chosen GROUP BY 1) g USING (target_id) WHERE rk <= 10""",
    "batch_forecast": f"SELECT well_id, formation, proppant_per_ft, fluid_per_ft, error, n_analogs, {r('p10_cum_9mo', 'p50_cum_9mo', 'p90_cum_9mo', digits='02')}, avg_distance_mi FROM request_fc",
    "forecast_long_export": "SELECT well_id, round(lat, 02) AS lat, round(lon, 02) AS lon, formation, lateral_length, f.n_analogs, m + 1 AS month, round(p10_oil, 02) AS p10_oil, round(p50_oil, 02) AS p50_oil, round(p90_oil, 02) AS p90_oil FROM request_fc f JOIN request_curves c ON c.target_id = f.well_id",
    "forecast_summary": "SELECT count(*) AS processed, count(CASE WHEN error IS NULL THEN 1 END) AS success, count(error) AS failures, round(avg(p50_cum_9mo), 02) AS avg_p50_cum_9mo FROM request_fc",
    "test_wells": f"SELECT t.well_id, operator_name, formation, basin_name, first_prod_date, m + 1 AS month, {r('lat', 'lon', 'lateral_length', 'proppant_per_ft', 'fluid_per_ft', 'oil', 'gas')} FROM test_set t JOIN test_curve c USING (well_id)",
    "weighted_mae": f"SELECT target_id, basin_name, n_analogs, {r('weighted_mae')} FROM mae",
    "error_stats": "SELECT basin_name, round(median(weighted_mae), 4) AS median, round(avg(weighted_mae), 4) AS mean, round(stddev_pop(weighted_mae), 4) AS std, round(quantile_cont(weighted_mae, 0.1), 4) AS p10, round(quantile_cont(weighted_mae, 0.9), 4) AS p90, count(*) AS n_wells FROM mae GROUP BY 1",
    "outcome_counts": "SELECT basin_name, count(f.target_id) AS successful, count(*) - count(f.target_id) AS failed, count(*) - count(f.target_id) AS no_analogs FROM early e LEFT JOIN (SELECT DISTINCT target_id FROM knn) f ON f.target_id = e.well_id GROUP BY 1",
    "model_compare": """
SELECT w.basin_name, metric, round(baseline, 4) AS baseline, round(ranked, 4) AS ranked, round(ranked - baseline, 4) AS difference,
  round((ranked - baseline) / baseline * 100, 4) AS difference_pct, n_wells, winner, round(improvement_pct, 4) AS improvement_pct
FROM winners w JOIN (SELECT b.basin_name, metric, baseline, ranked FROM
  (UNPIVOT (SELECT basin_name, median, mean, p10, p90 FROM test_stats WHERE model = 'baseline') ON median, mean, p10, p90 INTO NAME metric VALUE baseline) b
  JOIN (UNPIVOT (SELECT basin_name, median, mean, p10, p90 FROM test_stats WHERE model = 'ranked') ON median, mean, p10, p90 INTO NAME metric VALUE ranked) r
  USING (basin_name, metric)) x ON x.basin_name = w.basin_name""",
    "hybrid_choice": """
SELECT target_id, basin_name, m + 1 AS month, CASE WHEN b IS NOT NULL AND (winner = 'baseline' OR r IS NULL) THEN 'baseline' ELSE 'ranked' END AS model,
  round(CASE WHEN winner = 'baseline' THEN coalesce(b, r) ELSE coalesce(r, b) END, 4) AS p50_oil
FROM (SELECT target_id, basin_name, m, b.p50_oil AS b, w.p50_oil AS r FROM test_median b FULL JOIN warped_fc w USING (target_id, basin_name, m)) AS z
LEFT JOIN winners USING (basin_name)""",
}

_QUERIES["training_round_trip"] = _QUERIES["ranking_features_17"]
_QUERIES["forecast_json_round_trip"] = _QUERIES["batch_forecast"]

ORACLE = {name: with_(sql) for name, sql in _QUERIES.items()}
