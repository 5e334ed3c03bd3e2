"""DuckDB SQL twins of the registered queries (correctness oracle).

Written independently of the Spark code, straight from the operator
the caller.  ``R(x, n)`` is the shared rounding rule (fix to 12 decimals,
then round half-up), identical to ``solstice.functions.sround``.
"""

from __future__ import annotations

# Fixed values (same as solstice.schemas).
WINDOW_DAYS = (1, 3, 5, 7, 10, 14, 21, 28, 30, 45, 60, 75, 90, 180, 365)
CLIMATOLOGY_WINDOWS = (1, 3, 5, 7, 10, 14, 21, 28, 30, 45, 60, 90)
LATEST_WINDOWS = (1, 7, 14, 30)
METRICS = ("tavg_c", "tmax_c", "tmin_c", "prcp_mm")
QN = ("p02", "p10", "p25", "p50", "p75", "p90", "p98")
QV = (0.02, 0.10, 0.25, 0.50, 0.75, 0.90, 0.98)
AS_OF = "2001-11-05"


def R(x: str, n: int) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


OBS = """obs AS (
  SELECT n_name AS station_id, CAST(l_shipdate AS DATE) AS obs_date,
         MIN(l_quantity) - 25 AS tmin_c, MAX(l_quantity) - 25 AS tmax_c,
         AVG(l_quantity) - 25 AS tavg_c, SUM(l_discount) * 10 AS prcp_mm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""

OBS_NULLS = """obs_nulls AS (
  SELECT station_id, obs_date, tmin_c, tmax_c,
         CASE WHEN dayofmonth(obs_date) % 11 = 0 THEN NULL ELSE tavg_c END AS tavg_c, prcp_mm
  FROM obs)"""


def long_of(src: str, metrics=METRICS) -> str:
    return " UNION ALL ".join(
        f"SELECT station_id, obs_date, '{m}' AS metric_id, {m} AS value FROM {src}" for m in metrics)


def rolled_sql(src: str, windows, frame: str, keys=("station_id", "metric_id"), date="obs_date") -> str:
    """Rows with (keys, date, window_days, value) for each window, one frame semantics."""
    part = ", ".join(keys)
    parts = []
    for w in windows:
        where = "WHERE value IS NOT NULL" if frame == "rows_nonnull" else ""
        spec = f"(PARTITION BY {part} ORDER BY {date} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        if frame in ("rows_nonnull", "rows_nullable"):
            v = f"CASE WHEN COUNT(value) OVER {spec} = {w} THEN AVG(value) OVER {spec} END"
        else:
            v = f"AVG(value) OVER {spec}"
        parts.append(f"SELECT {part}, {date}, {w} AS window_days, {v} AS value FROM ({src}) {where}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


def clim_sql(rolled: str, keys=("station_id", "metric_id", "window_days"), h=7, min_n=10) -> str:
    k = ", ".join(keys)
    qs = ", ".join(f"{R(f'quantile_cont(value, {q})', 4)} AS {n}" for q, n in zip(QV, QN))
    return f"""
    SELECT {k}, CAST(end_doy AS INTEGER) AS end_doy, {h} AS doy_window_halfwidth, {qs},
           COUNT(value) AS n_samples, CAST(MIN(fy) AS INTEGER) AS first_year, CAST(MAX(ly) AS INTEGER) AS last_year
    FROM (
      SELECT {k}, value, fy, ly, (((dayofyear(obs_date) - 1 + off) % 366) + 366) % 366 + 1 AS end_doy
      FROM (SELECT *, MIN(year(obs_date)) OVER (PARTITION BY {k}) AS fy,
                      MAX(year(obs_date)) OVER (PARTITION BY {k}) AS ly FROM ({rolled})) r,
           range(-{h}, {h + 1}) t(off))
    GROUP BY {k}, end_doy HAVING COUNT(value) >= {min_n}"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


Q: dict[str, str] = {}

Q["a6_daily_series"] = with_(OBS) + f"""
SELECT station_id, obs_date, tmin_c, tmax_c, {R('tavg_c', 4)} AS tavg_c, {R('prcp_mm', 4)} AS prcp_mm FROM obs"""


def _recent():
    wmax = max(WINDOW_DAYS)
    parts = []
    for w in WINDOW_DAYS:
        spec = f"(PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"""SELECT station_id, {w} AS window_days, obs_date AS end_date, obs_date - {w - 1} AS start_date,
          {R(f'AVG(tavg_c) OVER {spec}', 4)} AS tavg_c_mean, {R(f'AVG(tmin_c) OVER {spec}', 4)} AS tmin_c_mean,
          {R(f'AVG(tmax_c) OVER {spec}', 4)} AS tmax_c_mean, {R(f'SUM(prcp_mm) OVER {spec}', 4)} AS prcp_mm_sum,
          {R(f'COUNT(tavg_c) OVER {spec} / {float(w)}', 4)} AS coverage_ratio, last_date
        FROM hist""")
    return with_(OBS, f"""hist AS (SELECT o.*, l.last_date FROM obs o JOIN
        (SELECT station_id, MAX(obs_date) AS last_date FROM obs GROUP BY 1) l USING (station_id)
        WHERE o.obs_date >= l.last_date - {400 + wmax})""") + f"""
SELECT station_id, window_days, end_date, start_date, tavg_c_mean, tmin_c_mean, tmax_c_mean, prcp_mm_sum, coverage_ratio
FROM ({' UNION ALL '.join(parts)}) WHERE end_date >= last_date - 400"""


Q["e1_recent_windows"] = _recent()

Q["e2_rolling_nonnull"] = with_(OBS, OBS_NULLS) + f"""
SELECT station_id, metric_id, obs_date, window_days, {R('value', 4)} AS value
FROM ({rolled_sql(long_of('obs_nulls', ['tavg_c']), WINDOW_DAYS, 'rows_nonnull')})"""

Q["e3_rolling_nullable"] = with_(OBS, OBS_NULLS) + f"""
SELECT station_id, metric_id, obs_date, window_days, {R('value', 4)} AS value
FROM ({rolled_sql(long_of('obs_nulls', ['tavg_c']), WINDOW_DAYS, 'rows_nullable')})"""


def _calendar():
    parts = []
    for w in LATEST_WINDOWS:
        spec = (f"(PARTITION BY station_id, metric_id ORDER BY obs_date "
                f"RANGE BETWEEN INTERVAL {w - 1} DAYS PRECEDING AND CURRENT ROW)")
        parts.append(f"""SELECT station_id, metric_id, obs_date AS end_date, {w} AS window_days,
            obs_date - {w - 1} AS start_date, {R(f'AVG(value) OVER {spec}', 4)} AS value,
            COUNT(value) OVER {spec} AS n_valid, {R(f'COUNT(value) OVER {spec} / {w}', 4)} AS coverage_ratio
            FROM lg""")
    return with_(OBS, OBS_NULLS, f"lg AS ({long_of('obs_nulls')})") + " UNION ALL ".join(parts)


Q["e4_calendar_windows"] = _calendar()

Q["d5_climatology"] = with_(OBS, f"lg AS ({long_of('obs')})") + clim_sql(
    rolled_sql("SELECT * FROM lg", CLIMATOLOGY_WINDOWS, "rows_nonnull"))


def _records():
    metrics = ("tavg_c", "tmax_c", "tmin_c")
    rolled = rolled_sql("SELECT * FROM lg", WINDOW_DAYS, "rows_nonnull")
    return with_(OBS, f"lg AS ({long_of('obs', metrics)})",
                 """span AS (SELECT station_id, metric_id, CAST(MAX(year(obs_date)) - MIN(year(obs_date)) + 1 AS INTEGER) AS n_years_considered
                    FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)""",
                 f"rl AS ({rolled})") + f"""
SELECT station_id, metric_id, window_days, record_type, {R('value', 4)} AS value,
       end_date - (window_days - 1) AS start_date, end_date, n_years_considered
FROM (
  SELECT station_id, metric_id, window_days, 'highest' AS record_type, value, obs_date AS end_date,
         row_number() OVER (PARTITION BY station_id, metric_id, window_days ORDER BY {R('value', 9)} DESC, obs_date) AS rn
  FROM rl
  UNION ALL
  SELECT station_id, metric_id, window_days, 'lowest', value, obs_date,
         row_number() OVER (PARTITION BY station_id, metric_id, window_days ORDER BY {R('value', 9)} ASC, obs_date)
  FROM rl) x JOIN span USING (station_id, metric_id)
WHERE rn = 1"""


Q["d10_records"] = _records()


def _pct_sql(v: str, q: str = "") -> str:
    """H5 on a full breakpoint set (climatology never stores null breakpoints)."""
    p = [f"{q}{n}" for n in QN]
    pts = (2, 10, 25, 50, 75, 90, 98)
    segs = " ".join(
        f"WHEN {v} <= {p[i + 1]} THEN {pts[i]} + ({v} - {p[i]}) / ({p[i + 1]} - {p[i]}) * {pts[i + 1] - pts[i]}"
        for i in range(6))
    return (f"CASE WHEN {v} IS NULL OR {p[0]} IS NULL THEN NULL "
            f"WHEN {v} <= {p[0]} THEN CASE WHEN {p[0]} <> 0 THEN 2 * ({v} / {p[0]}) ELSE 0.0 END "
            f"WHEN {v} >= {p[6]} THEN 99.0 {segs} ELSE 50.0 END")


def _severity_sql(p: str, cov_ratio: str | None = None, cov_years: str | None = None) -> str:
    lvl = f"(CASE WHEN {p} < 5 OR {p} > 95 THEN 3 WHEN {p} <= 15 OR {p} >= 85 THEN 2 WHEN {p} <= 35 OR {p} >= 65 THEN 1 ELSE 0 END"
    if cov_years:
        lvl += f" - CASE WHEN {cov_years} < 30 THEN 1 ELSE 0 END"
    if cov_ratio:
        lvl += f" - CASE WHEN {cov_ratio} < 0.5 THEN 1 ELSE 0 END"
    lvl += ")"
    return (f"CASE WHEN {p} IS NULL THEN 'insufficient_data' ELSE CASE greatest({lvl}, 0) "
            f"WHEN 3 THEN 'extreme' WHEN 2 THEN 'unusual' WHEN 1 THEN 'a_bit' ELSE 'normal' END END")


def _direction_sql(p: str, metric: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN 'neutral' WHEN {p} > 50 THEN CASE WHEN starts_with({metric}, 'prcp') THEN 'wet' ELSE 'warm' END "
            f"WHEN {p} < 50 THEN CASE WHEN starts_with({metric}, 'prcp') THEN 'dry' ELSE 'cold' END ELSE 'neutral' END")


def _label_sql(w: str) -> str:
    return (f"CASE WHEN {w} = 1 THEN 'day' WHEN {w} = 7 THEN 'week' WHEN {w} = 30 THEN '30-day period' "
            f"WHEN {w} = 365 THEN 'year' ELSE CAST({w} AS VARCHAR) || '-day period' END")


def _primary_sql(w: str, sev: str, d: str, rec: str | None = None) -> str:
    lab = _label_sql(w)
    comp = (f"CASE {d} WHEN 'warm' THEN 'warmer' WHEN 'cold' THEN 'colder' WHEN 'wet' THEN 'wetter' "
            f"WHEN 'dry' THEN 'drier' ELSE 'different' END")
    adj = f"CASE WHEN {d} = 'neutral' THEN '' ELSE {d} END"
    body = (f"CASE WHEN {sev} = 'normal' THEN 'This ' || {lab} || ' is near normal.' "
            f"WHEN {sev} = 'insufficient_data' THEN 'Not enough climatology data to classify this ' || {lab} || '.' "
            f"WHEN {sev} = 'a_bit' THEN 'This ' || {lab} || ' is a bit ' || {comp} || '.' "
            f"WHEN {sev} = 'extreme' THEN 'This ' || {lab} || ' is extremely ' || {adj} || '.' "
            f"WHEN {sev} = 'unusual' THEN 'This ' || {lab} || ' is unusually ' || {adj} || '.' "
            f"ELSE 'This ' || {lab} || ' is ' || {adj} || '.' END")
    if rec is None:
        return body
    return f"CASE WHEN {rec} IS NOT NULL THEN 'This ' || {lab} || ' is the ' || {rec} || ' on record.' ELSE {body} END"


def _supporting_sql(w: str, p: str, d: str, cov_years: str, first_year: str, since: str | None, cur_year: str | None) -> str:
    pp = f"coalesce({p}, 50.0)"
    comp = (f"CASE WHEN {pp} <= 50 THEN (CASE WHEN {d} IN ('wet','dry') THEN 'Drier' ELSE 'Colder' END) || ' than ' || printf('%.0f', 100 - {pp}) || '%' "
            f"ELSE (CASE WHEN {d} IN ('wet','dry') THEN 'Wetter' ELSE 'Warmer' END) || ' than ' || printf('%.0f', {pp}) || '%' END")
    rng = f"'since ' || CAST({first_year} AS VARCHAR)"
    if since is not None:
        rng = f"CASE WHEN {since} IS NOT NULL THEN CAST({since} AS VARCHAR) || '–' || CAST({cur_year} AS VARCHAR) ELSE {rng} END"
    return (f"{comp} || ' of historical ' || {_label_sql(w)} || 's (' || {rng} || ', ' || CAST({cov_years} AS VARCHAR) || ' years of data).'")


def _latest_insights(metric="tavg_c", since_year=None, obs=(OBS,), as_of=AS_OF, more=""):
    as_of_year = int(as_of[:4])
    since = since_year if since_year is not None else as_of_year - 24
    wins = ", ".join(f"({w})" for w in LATEST_WINDOWS)
    rolled = rolled_sql(f"SELECT station_id, obs_date, '{metric}' AS metric_id, {metric} AS value FROM obs "
                        f"WHERE obs_date >= DATE '{since}-01-01'", LATEST_WINDOWS, "rows_nonnull")
    cov = as_of_year - since + 1
    return with_(
        *obs,
        f"""lastd AS (SELECT station_id, LEAST(MAX(obs_date), DATE '{as_of}' - 1) AS latest_date FROM obs GROUP BY 1)""",
        f"""cand AS (SELECT station_id, w.window_days, latest_date - CAST(i.range AS INTEGER) AS end_date
            FROM lastd, (VALUES {wins}) w(window_days), range(0, 8) i)""",
        f"""win AS (SELECT c.station_id, c.window_days, c.end_date, AVG(o.{metric}) AS value,
                   COUNT(o.{metric}) AS n_valid, COUNT(o.{metric}) / c.window_days AS coverage_ratio
            FROM cand c LEFT JOIN obs o ON o.station_id = c.station_id
              AND o.obs_date BETWEEN c.end_date - (c.window_days - 1) AND c.end_date
            GROUP BY 1, 2, 3)""",
        f"""pick AS (SELECT station_id, window_days, end_date, {R('value', 4)} AS value, coverage_ratio,
                    dayofyear(end_date) AS end_doy
            FROM win WHERE n_valid > 0
            QUALIFY row_number() OVER (PARTITION BY station_id, window_days ORDER BY end_date DESC) = 1)""",
        f"clim AS ({clim_sql(rolled)})",
        f"""j AS (SELECT p.*, c.p02, c.p10, c.p25, c.p50, c.p75, c.p90, c.p98, {_pct_sql('p.value', 'c.')} AS pct
            FROM pick p LEFT JOIN clim c ON c.station_id = p.station_id AND c.window_days = p.window_days
              AND c.end_doy = p.end_doy)""",
        f"""k AS (SELECT *, {_severity_sql('pct', cov_ratio='coverage_ratio')} AS severity,
                    {_direction_sql('pct', f"'{metric}'")} AS direction FROM j)""") + f"""
SELECT station_id, window_days, '{metric}' AS metric, end_date, {R('value', 2)} AS value,
       {R('p50', 2)} AS normal_value, {R('pct', 1)} AS percentile, severity, direction,
       {_primary_sql('window_days', 'severity', 'direction')} AS primary_statement,
       {_supporting_sql('window_days', 'pct', 'direction', str(cov), str(since), str(since), str(as_of_year))} AS supporting_line,
       CAST({cov} AS INTEGER) AS coverage_years, CAST({since} AS INTEGER) AS first_year, CAST({since} AS INTEGER) AS since_year{more}
FROM k"""


Q["j3_latest_insights"] = _latest_insights()


# --- coverage and bookkeeping -------------------------------------------------
STATIONS = """st AS (SELECT n_name AS station_id, printf('%06d', 94000 + n_nationkey) AS wban, n_name AS name,
       CAST(25 + n_nationkey AS DOUBLE) AS lat, CAST(-120 + 2 * n_nationkey AS DOUBLE) AS lon,
       n_nationkey % 7 <> 3 AS is_active FROM nation)"""

SOURCED = """src AS (
  SELECT n_name AS station_id, CAST(l_shipdate AS DATE) AS obs_date,
         CASE l_returnflag WHEN 'A' THEN 'ghcn_daily' WHEN 'N' THEN 'gsod' ELSE 'open_meteo' END AS source,
         MIN(l_quantity) - 25 AS tmin_c, MAX(l_quantity) - 25 AS tmax_c,
         AVG(l_quantity) - 25 AS tavg_c, SUM(l_discount) * 10 AS prcp_mm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""

SRC_COLS = f"station_id, obs_date, source, tmin_c, tmax_c, {R('tavg_c', 4)} AS tavg_c, {R('prcp_mm', 4)} AS prcp_mm"

Q["d2_station_coverage"] = with_(OBS, OBS_NULLS, STATIONS) + f"""
SELECT st.station_id, wban, name, lat, lon, is_active, first_obs_date, last_obs_date, coverage_years,
       completeness_temp_pct, completeness_prcp_pct
FROM st LEFT JOIN (
  SELECT station_id, MIN(obs_date) AS first_obs_date, MAX(obs_date) AS last_obs_date,
         CAST(date_diff('year', MIN(obs_date), MAX(obs_date)) + 1 AS INTEGER) AS coverage_years,
         {R('100.0 * COUNT(tavg_c) / COUNT(*)', 1)} AS completeness_temp_pct,
         {R('100.0 * COUNT(prcp_mm) / COUNT(*)', 1)} AS completeness_prcp_pct
  FROM obs_nulls GROUP BY 1) c USING (station_id)"""

Q["d3_date_range"] = with_(OBS) + "SELECT station_id, MIN(obs_date) AS min_date, MAX(obs_date) AS max_date FROM obs GROUP BY 1"

Q["d4_baseline_years"] = with_(OBS, STATIONS) + """
SELECT g.station_id, g.since_year, CAST(COALESCE(COUNT(DISTINCT y.year), 0) AS INTEGER) AS coverage_years,
       CAST(COALESCE(MIN(y.year), g.since_year) AS INTEGER) AS first_year
FROM (SELECT station_id, since_year FROM st, (VALUES (NULL::INTEGER), (1996), (1998), (2000)) b(since_year)) g
LEFT JOIN (SELECT DISTINCT station_id, year(obs_date) AS year FROM obs) y
  ON y.station_id = g.station_id AND (g.since_year IS NULL OR y.year >= g.since_year)
GROUP BY g.station_id, g.since_year"""

Q["d8_observed_dates"] = with_(SOURCED) + """
SELECT station_id, obs_date, bool_or(source IN ('ghcn_daily', 'gsod')) AS has_authoritative FROM src GROUP BY 1, 2"""

Q["d9_last_authoritative"] = with_(SOURCED) + """
SELECT station_id, MAX(CASE WHEN source IN ('ghcn_daily', 'gsod') THEN obs_date END) AS last_auth_date FROM src GROUP BY 1"""

Q["d15_coverage_summary"] = with_(OBS) + f"""
SELECT station_id, actual_days, expected_days, {R('100.0 * actual_days / expected_days', 1)} AS coverage_pct,
       expected_days - actual_days AS missing_days, min_date, max_date
FROM (SELECT station_id, COUNT(*) AS actual_days, MIN(obs_date) AS min_date, MAX(obs_date) AS max_date,
             CAST(DATE '{AS_OF}' - 1 - MIN(obs_date) + 1 AS INTEGER) AS expected_days
      FROM obs WHERE obs_date <= DATE '{AS_OF}' - 1 GROUP BY 1)"""

# --- precedence, gaps, upsert -------------------------------------------------
Q["e11_keep_first"] = with_(SOURCED) + f"""
SELECT {SRC_COLS} FROM src QUALIFY row_number() OVER (PARTITION BY station_id, obs_date ORDER BY source) = 1"""

Q["i2_precedence"] = with_(SOURCED) + f"""
SELECT {SRC_COLS} FROM src QUALIFY row_number() OVER (PARTITION BY station_id, obs_date
  ORDER BY CASE source WHEN 'ghcn_daily' THEN 1 WHEN 'gsod' THEN 2 WHEN 'open_meteo' THEN 3 ELSE 4 END) = 1"""

Q["c1_gap_fill"] = with_(SOURCED) + f"""
SELECT {SRC_COLS} FROM src s WHERE source = 'gsod' AND NOT EXISTS (
  SELECT 1 FROM src p WHERE p.source = 'ghcn_daily' AND p.station_id = s.station_id AND p.obs_date = s.obs_date)"""

Q["c2_provisional_fill"] = with_(SOURCED) + f"""
SELECT {SRC_COLS} FROM src s JOIN (SELECT station_id, MAX(obs_date) AS last_auth FROM src
                                   WHERE source IN ('ghcn_daily', 'gsod') GROUP BY 1) l USING (station_id)
WHERE s.source = 'open_meteo' AND s.obs_date > l.last_auth AND s.obs_date < DATE '{AS_OF}'
  AND NOT EXISTS (SELECT 1 FROM src a WHERE a.source IN ('ghcn_daily', 'gsod')
                  AND a.station_id = s.station_id AND a.obs_date = s.obs_date)"""

_CAL = """cal AS (SELECT k.station_id, CAST(d.generate_series AS DATE) AS obs_date
          FROM (SELECT n_name AS station_id FROM nation) k, (SELECT unnest(generate_series(
                 (SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem), (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem),
                 INTERVAL 1 DAY)) AS generate_series) d)"""

Q["c3_calendar_gaps"] = with_(SOURCED, _CAL) + """
SELECT station_id, obs_date FROM cal
EXCEPT SELECT station_id, obs_date FROM src WHERE source = 'ghcn_daily'
UNION SELECT station_id, obs_date FROM cal WHERE obs_date > DATE '2001-06-30'"""

Q["c4_restrict_to_missing"] = with_(SOURCED, _CAL) + f"""
SELECT {SRC_COLS} FROM src WHERE source = 'gsod' AND (station_id, obs_date) IN (
  SELECT station_id, obs_date FROM cal EXCEPT SELECT station_id, obs_date FROM src WHERE source = 'ghcn_daily')"""

Q["a7_upsert"] = with_(SOURCED) + f"""
SELECT {SRC_COLS} FROM (
  SELECT * FROM src o WHERE source = 'open_meteo' AND NOT EXISTS (
    SELECT 1 FROM src n WHERE n.source <> 'open_meteo' AND n.station_id = o.station_id AND n.obs_date = o.obs_date)
  UNION ALL
  SELECT * FROM (SELECT * FROM src WHERE source <> 'open_meteo'
    QUALIFY row_number() OVER (PARTITION BY station_id, obs_date
      ORDER BY CASE source WHEN 'ghcn_daily' THEN 1 WHEN 'gsod' THEN 2 ELSE 3 END) = 1))"""


# --- rankings ------------------------------------------------------------------
def _tgt():
    return "tgt AS (SELECT station_id, MAX(obs_date) AS target_date FROM obs GROUP BY 1)"


def _band(w: int, since=None):
    where = f" WHERE obs_date >= DATE '{since}-01-01'" if since else ""
    rolled = rolled_sql(f"SELECT station_id, obs_date, 'tavg_c' AS metric_id, tavg_c AS value FROM obs{where}", [w],
                        "rows_nonnull")
    return f"""c AS (SELECT * FROM (
        SELECT r.station_id, t.target_date, r.obs_date, r.value, CAST(year(r.obs_date) AS INTEGER) AS year,
               least(abs(dayofyear(r.obs_date) - dayofyear(t.target_date)),
                     366 - abs(dayofyear(r.obs_date) - dayofyear(t.target_date))) AS doy_diff
        FROM ({rolled}) r JOIN tgt t USING (station_id)) WHERE doy_diff <= 7)"""


def _ranked(order_expr: str) -> str:
    f = lambda x: R(f"{x} * 9.0 / 5.0 + 32.0", 1)
    return f"""rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY station_id ORDER BY {order_expr}, year) AS INTEGER) AS rank,
                  MAX(CASE WHEN is_current THEN value_c END) OVER (PARTITION BY station_id) AS cur FROM dd)
SELECT station_id, target_date AS end_date, year, value_c, {{extra}}rank, {f('value_c')} AS value_f,
       {R(f"{f('value_c')} - {f('cur')}", 1)} AS delta_f, is_current,
       MAX(CASE WHEN is_current THEN rank END) OVER (PARTITION BY station_id) AS current_rank,
       COUNT(*) OVER (PARTITION BY station_id) AS total_years, direction
FROM rk"""


def _seasonal(w: int, excerpt: bool = False):
    body = with_(OBS, _tgt(), _band(w),
                 f"""py AS (SELECT station_id, target_date, year, {R('value', 2)} AS value_c,
                         year = year(target_date) AS is_current FROM c
                   QUALIFY row_number() OVER (PARTITION BY station_id, target_date, year ORDER BY doy_diff, obs_date) = 1)""",
                 """pp AS (SELECT *, 100.0 * SUM(CASE WHEN value_c < cur THEN 1 ELSE 0 END) OVER (PARTITION BY station_id)
                         / COUNT(*) OVER (PARTITION BY station_id) AS pct_below
                   FROM (SELECT *, MAX(CASE WHEN is_current THEN value_c END) OVER (PARTITION BY station_id) AS cur FROM py)
                   WHERE cur IS NOT NULL)""",
                 "dd AS (SELECT * EXCLUDE (cur), CASE WHEN pct_below <= 50 THEN 'cold' ELSE 'warm' END AS direction FROM pp)",
                 ) + ", " + _ranked("CASE WHEN direction = 'cold' THEN value_c ELSE -value_c END").replace("{extra}", "")
    if excerpt:
        return f"SELECT * FROM ({body}) WHERE rank <= 10 OR abs(rank - current_rank) <= 2"
    return body


def _extremes(w: int, direction: str, since=None):
    order = f"{R('value', 9)} ASC, obs_date" if direction == "cold" else f"{R('value', 9)} DESC, obs_date"
    return with_(OBS, _tgt(), _band(w, since),
                 f"""py AS (SELECT station_id, target_date, year, {R('value', 2)} AS value_c,
                         obs_date - {w - 1} AS start_date, obs_date AS period_end, year = year(target_date) AS is_current
                   FROM c QUALIFY row_number() OVER (PARTITION BY station_id, target_date, year ORDER BY {order}) = 1)""",
                 f"""dd AS (SELECT *, '{direction}' AS direction FROM py WHERE station_id IN (SELECT station_id FROM py WHERE is_current))""",
                 ) + ", " + _ranked("value_c" if direction == "cold" else "-value_c").replace("{extra}", "start_date, period_end, ")


Q["j5_seasonal_ranking"] = _seasonal(7)
Q["e12_ranking_excerpt"] = _seasonal(14, excerpt=True)
Q["j6_extremes_cold"] = _extremes(7, "cold")
Q["j6_extremes_warm"] = _extremes(30, "warm", since=1996)

_LATEST = "lv AS (SELECT o.station_id, o.tavg_c AS cur FROM obs o JOIN (SELECT station_id, MAX(obs_date) AS d FROM obs GROUP BY 1) m ON o.station_id = m.station_id AND o.obs_date = m.d)"
Q["d11_percent_below"] = with_(OBS, _LATEST) + f"""
SELECT station_id, {R('100.0 * AVG(CASE WHEN tavg_c < cur THEN 1 ELSE 0 END)', 4)} AS pct_below FROM obs JOIN lv USING (station_id) GROUP BY 1"""
Q["d12_percentile_of_score"] = with_(OBS, _LATEST) + f"""
SELECT station_id, {R('50.0 * (SUM(CASE WHEN tavg_c < cur THEN 1 ELSE 0 END) + SUM(CASE WHEN tavg_c <= cur THEN 1 ELSE 0 END) + MAX(CASE WHEN tavg_c = cur THEN 1 ELSE 0 END)) / COUNT(tavg_c)', 4)} AS percentile
FROM obs JOIN lv USING (station_id) WHERE tavg_c IS NOT NULL GROUP BY 1"""


# --- landed rows: cleaning chains and raw formats -------------------------------
LI_ST = """li AS (SELECT l.*, n_name AS station_id FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey)"""

RAW = """raw AS (
  SELECT station_id AS STATION, strftime(l_shipdate, '%Y-%m-%d') AS DATE,
         CASE WHEN l_orderkey % 103 = 0 THEN NULL
              ELSE CAST(CASE WHEN l_orderkey % 97 = 0 THEN -9999 WHEN l_orderkey % 89 = 0 THEN tmax0 ELSE tmin0 END AS VARCHAR) END AS TMIN,
         CASE WHEN l_orderkey % 103 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 'x'
              ELSE CAST(CASE WHEN l_orderkey % 89 = 0 THEN tmin0 ELSE tmax0 END AS VARCHAR) END AS TMAX,
         CAST(CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN mid + 200 WHEN 2 THEN mid + 150 ELSE mid END AS VARCHAR) AS TAVG,
         CAST(CAST(round(l_discount * 1000) AS INTEGER) AS VARCHAR) AS PRCP
  FROM (SELECT *, CAST(l_quantity * 10 - 250 AS INTEGER) AS tmin0,
               CAST(l_quantity * 10 - 250 AS INTEGER) + 10 * l_linenumber AS tmax0,
               CAST(trunc((2 * CAST(l_quantity * 10 - 250 AS INTEGER) + 10 * l_linenumber) / 2) AS INTEGER) AS mid
        FROM li))"""

CLEAN = """cl AS (
  SELECT *, CASE WHEN t3avg IS NULL AND t2min IS NOT NULL AND t2max IS NOT NULL THEN (t2min + t2max) / 2.0 ELSE t3avg END AS t4avg,
         t3avg IS NULL AND t2min IS NOT NULL AND t2max IS NOT NULL AS f_filled
  FROM (SELECT *, CASE WHEN f_corr THEN (t2min + t2max) / 2.0 ELSE t2avg END AS t3avg
        FROM (SELECT *, COALESCE(t2min IS NOT NULL AND t2max IS NOT NULL AND t2avg IS NOT NULL
                                 AND abs(t2avg - (t2min + t2max) / 2.0) > 15, FALSE) AS f_corr
              FROM (SELECT *, CASE WHEN NOT f_sw THEN t1min END AS t2min, CASE WHEN NOT f_sw THEN t1max END AS t2max,
                           CASE WHEN NOT f_sw THEN t1avg END AS t2avg
                    FROM (SELECT *, COALESCE(t1min > t1max, FALSE) AS f_sw
                          FROM (SELECT *, CASE WHEN t0min BETWEEN -90 AND 65 THEN t0min END AS t1min,
                                       CASE WHEN t0max BETWEEN -90 AND 65 THEN t0max END AS t1max,
                                       CASE WHEN t0avg BETWEEN -90 AND 65 THEN t0avg END AS t1avg
                                FROM (SELECT STATION AS station_id, TRY_CAST(DATE AS DATE) AS obs_date,
                                             TRY_CAST(TMIN AS DOUBLE) / 10.0 AS t0min, TRY_CAST(TMAX AS DOUBLE) / 10.0 AS t0max,
                                             TRY_CAST(TAVG AS DOUBLE) / 10.0 AS t0avg, TRY_CAST(PRCP AS DOUBLE) / 10.0 AS prcp_mm
                                      FROM raw)))))))"""

Q["b_clean_station_daily"] = with_(LI_ST, RAW, CLEAN) + f"""
SELECT station_id, obs_date, {R('t2min', 4)} AS tmin_c, {R('t2max', 4)} AS tmax_c, {R('t4avg', 4)} AS tavg_c,
       {R('prcp_mm', 4)} AS prcp_mm
FROM cl WHERE obs_date IS NOT NULL AND (t2min IS NOT NULL OR t2max IS NOT NULL)"""

Q["b12_quality_counters"] = with_(LI_ST, RAW, CLEAN) + """
SELECT station_id, COUNT(*) AS rows_in,
       COUNT(*) FILTER (WHERE t0min IS NOT NULL AND t1min IS NULL) AS implausible_tmin,
       COUNT(*) FILTER (WHERE t0max IS NOT NULL AND t1max IS NULL) AS implausible_tmax,
       COUNT(*) FILTER (WHERE t0avg IS NOT NULL AND t1avg IS NULL) AS implausible_tavg,
       COUNT(*) FILTER (WHERE f_sw) AS swapped_pairs, COUNT(*) FILTER (WHERE f_corr) AS corrected_tavg,
       COUNT(*) FILTER (WHERE f_filled) AS filled_tavg,
       COUNT(*) FILTER (WHERE (t2min IS NULL AND t2max IS NULL) OR obs_date IS NULL) AS dropped_rows
FROM cl GROUP BY 1"""

RAW_GSOD = """rg AS (
  SELECT station_id, CAST(year(l_shipdate) AS VARCHAR) AS year,
         CASE WHEN l_orderkey % 101 = 0 THEN '2' ELSE CAST(month(l_shipdate) AS VARCHAR) END AS mo,
         CASE WHEN l_orderkey % 101 = 0 THEN '30' ELSE CAST(day(l_shipdate) AS VARCHAR) END AS da,
         CASE WHEN l_orderkey % 97 = 0 THEN '9999.9' ELSE CAST(l_quantity + 20 AS VARCHAR) END AS temp,
         CASE WHEN l_orderkey % 103 = 0 THEN '9999.9' ELSE CAST(l_quantity + 20 + l_linenumber AS VARCHAR) END AS "max",
         CASE WHEN l_orderkey % 103 = 0 THEN '9999.9' ELSE CAST(l_quantity + 20 - l_linenumber AS VARCHAR) END AS "min",
         CASE WHEN l_orderkey % 89 = 0 THEN '99.99' ELSE CAST(l_discount AS VARCHAR) END AS prcp
  FROM li)"""

GSOD_DATE = "TRY_CAST(lpad(year, 4, '0') || '-' || lpad(mo, 2, '0') || '-' || lpad(da, 2, '0') AS DATE)"

Q["b_clean_gsod"] = with_(LI_ST, RAW_GSOD) + f"""
SELECT station_id, obs_date, {R('tmin_c', 4)} AS tmin_c, {R('tmax_c', 4)} AS tmax_c, {R('tavg_c', 4)} AS tavg_c,
       {R('prcp_mm', 4)} AS prcp_mm
FROM (SELECT station_id, {GSOD_DATE} AS obs_date,
             (CASE WHEN TRY_CAST("min" AS DOUBLE) <= 900 THEN TRY_CAST("min" AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tmin_c,
             (CASE WHEN TRY_CAST("max" AS DOUBLE) <= 900 THEN TRY_CAST("max" AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tmax_c,
             (CASE WHEN TRY_CAST(temp AS DOUBLE) <= 900 THEN TRY_CAST(temp AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tavg_c,
             CASE WHEN TRY_CAST(prcp AS DOUBLE) <= 90 THEN TRY_CAST(prcp AS DOUBLE) END * 25.4 AS prcp_mm
      FROM rg)
WHERE obs_date IS NOT NULL AND (tmin_c IS NOT NULL OR tmax_c IS NOT NULL)"""

Q["a3_open_meteo_arrays"] = with_(SOURCED) + f"""
SELECT station_id, obs_date, {R('tmin_c', 4)} AS tmin_c, {R('tmax_c', 4)} AS tmax_c,
       {R('CASE WHEN tavg_c IS NULL AND tmin_c IS NOT NULL AND tmax_c IS NOT NULL THEN (tmin_c + tmax_c) / 2.0 ELSE tavg_c END', 4)} AS tavg_c,
       {R('prcp_mm', 4)} AS prcp_mm
FROM (SELECT station_id, obs_date,
             CASE WHEN day(obs_date) % 7 = 0 THEN NULL ELSE tmin_c END AS tmin_c,
             CASE WHEN day(obs_date) % 7 = 0 THEN NULL ELSE tmax_c END AS tmax_c,
             CASE WHEN day(obs_date) % 5 = 0 THEN NULL ELSE tavg_c END AS tavg_c, prcp_mm
      FROM src WHERE source = 'open_meteo')
WHERE tmin_c IS NOT NULL OR tmax_c IS NOT NULL"""

FAHR = """fh AS (
  SELECT station_id, "date", CAST(year("date") AS INTEGER) AS year, CAST(month("date") AS INTEGER) AS month,
         CAST(day("date") AS INTEGER) AS day, COALESCE(a, (mx + mn) / 2) AS temp_f, mx AS max_temp_f, mn AS min_temp_f
  FROM (SELECT STATION AS station_id, TRY_CAST(DATE AS DATE) AS "date",
               TRY_CAST(TMAX AS DOUBLE) * 9 / 50 + 32 AS mx, TRY_CAST(TMIN AS DOUBLE) * 9 / 50 + 32 AS mn,
               TRY_CAST(TAVG AS DOUBLE) * 9 / 50 + 32 AS a FROM raw)
  WHERE "date" IS NOT NULL AND COALESCE(mx, mn, COALESCE(a, (mx + mn) / 2)) IS NOT NULL)"""

Q["a9_ghcn_fahrenheit"] = with_(LI_ST, RAW, FAHR) + f"""
SELECT station_id, "date", year, month, day, {R('temp_f', 4)} AS temp_f, {R('max_temp_f', 4)} AS max_temp_f,
       {R('min_temp_f', 4)} AS min_temp_f FROM fh"""

NATIVE = f"""nv AS (
  SELECT station_id, {GSOD_DATE} AS "date", CAST(TRY_CAST(year AS DOUBLE) AS INTEGER) AS year,
         CAST(TRY_CAST(mo AS DOUBLE) AS INTEGER) AS month, CAST(TRY_CAST(da AS DOUBLE) AS INTEGER) AS day,
         TRY_CAST(temp AS DOUBLE) AS temp_f, TRY_CAST("max" AS DOUBLE) AS max_temp_f, TRY_CAST("min" AS DOUBLE) AS min_temp_f
  FROM rg)"""

Q["a10_gsod_native"] = with_(LI_ST, RAW_GSOD, NATIVE) + 'SELECT * FROM nv WHERE "date" IS NOT NULL'

Q["j9_consolidation"] = with_(
    LI_ST, RAW, RAW_GSOD, NATIVE, FAHR,
    """prim AS (SELECT station_id, "date", min_temp_f AS "min", max_temp_f AS "max", temp_f AS "avg", 'BigQuery' AS source
              FROM nv WHERE "date" IS NOT NULL AND "date" <= DATE '2001-06-30')""",
    """cal AS (SELECT k.station_id, CAST(d.generate_series AS DATE) AS "date"
              FROM (SELECT DISTINCT station_id FROM rg UNION SELECT DISTINCT STATION FROM raw) k,
                   (SELECT unnest(generate_series((SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem),
                     (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem), INTERVAL 1 DAY)) AS generate_series) d)""",
    """miss AS (SELECT station_id, "date" FROM cal EXCEPT SELECT station_id, "date" FROM prim
              UNION SELECT station_id, "date" FROM cal WHERE "date" > DATE '2001-06-30')""",
    """fb AS (SELECT station_id, "date", min_temp_f AS "min", max_temp_f AS "max", temp_f AS "avg", 'GHCN Daily' AS source
            FROM fh WHERE (station_id, "date") IN (SELECT station_id, "date" FROM miss))""") + f"""
SELECT station_id, "date", {R('"min"', 4)} AS "min", {R('"max"', 4)} AS "max", {R('"avg"', 4)} AS "avg", source
FROM (SELECT * FROM prim UNION ALL SELECT * FROM fb)
WHERE "date" BETWEEN (SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem) AND (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY station_id, "date"
                           ORDER BY source, "max" NULLS FIRST, "min" NULLS FIRST, "avg" NULLS FIRST) = 1"""


# --- reports -------------------------------------------------------------------
J2_WINDOWS = (1, 7, 30)


def _records_core(metrics, windows, src="obs", frame="rows_nonnull", value_expr=None):
    lg = long_of(src, metrics) if value_expr is None else value_expr
    rolled = rolled_sql("SELECT * FROM lg", windows, frame)
    return (f"lg AS ({lg})",
            """span AS (SELECT station_id, metric_id, CAST(MAX(year(obs_date)) - MIN(year(obs_date)) + 1 AS INTEGER) AS n_years_considered
               FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)""",
            f"rl AS ({rolled})",
            f"""recs AS (
  SELECT station_id, metric_id, window_days, record_type, value, end_date - (window_days - 1) AS start_date, end_date, n_years_considered
  FROM (
    SELECT station_id, metric_id, window_days, 'highest' AS record_type, value, obs_date AS end_date,
           row_number() OVER (PARTITION BY station_id, metric_id, window_days ORDER BY {R('value', 9)} DESC, obs_date) AS rn
    FROM rl
    UNION ALL
    SELECT station_id, metric_id, window_days, 'lowest', value, obs_date,
           row_number() OVER (PARTITION BY station_id, metric_id, window_days ORDER BY {R('value', 9)} ASC, obs_date)
    FROM rl) x JOIN span USING (station_id, metric_id)
  WHERE rn = 1)""")


def _j2_for(windows, since=None, metrics=("tavg_c",), record_metrics=("tavg_c",)):
    where = f" WHERE obs_date >= DATE '{since}-01-01'" if since else ""
    clim = clim_sql(rolled_sql("SELECT * FROM lgm" + where, windows, "rows_nonnull"))
    if since:
        cov = f"""cov AS (SELECT station_id, COUNT(DISTINCT CASE WHEN year(obs_date) >= {since} THEN year(obs_date) END) AS cy,
                   COALESCE(MIN(CASE WHEN year(obs_date) >= {since} THEN year(obs_date) END), {since}) AS fy FROM obs GROUP BY 1)"""
        first, sev, line = "cov.fy", _severity_sql('pct', cov_ratio='coverage_ratio'), (str(since), AS_OF[:4])
    else:
        cov = """cov AS (SELECT station_id, CAST(date_diff('year', MIN(obs_date), MAX(obs_date)) + 1 AS INTEGER) AS cy,
                   year(MIN(obs_date)) AS fy FROM obs GROUP BY 1)"""
        first, line = "COALESCE(c.first_year, cov.fy, 2000)", (None, None)
        sev = _severity_sql('pct', cov_ratio='coverage_ratio', cov_years='cyears')
    parts = []
    for w in windows:
        spec = (f"(PARTITION BY station_id, metric_id ORDER BY obs_date RANGE BETWEEN INTERVAL {w - 1} DAYS PRECEDING AND CURRENT ROW)")
        parts.append(f"""SELECT station_id, metric_id, obs_date AS end_date, {w} AS window_days,
            {R(f'AVG(value) OVER {spec}', 4)} AS value, COUNT(value) OVER {spec} AS n_valid,
            {R(f'COUNT(value) OVER {spec} / {w}', 4)} AS coverage_ratio FROM lgm""")
    recs = _records_core(record_metrics, windows)
    body = with_(
        OBS, f"lgm AS ({long_of('obs', metrics)})", f"cw AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_valid > 0)", f"clim AS ({clim})", *recs,
        cov,
        f"""hl AS (SELECT station_id, metric_id, window_days,
                  MAX(CASE WHEN record_type = 'highest' THEN {R('value', 4)} END) AS hi,
                  MAX(CASE WHEN record_type = 'lowest' THEN {R('value', 4)} END) AS lo,
                  MAX(CASE WHEN record_type = 'highest' THEN start_date END) AS hi_start, MAX(CASE WHEN record_type = 'highest' THEN end_date END) AS hi_end,
                  MAX(CASE WHEN record_type = 'lowest' THEN start_date END) AS lo_start, MAX(CASE WHEN record_type = 'lowest' THEN end_date END) AS lo_end
           FROM recs GROUP BY 1, 2, 3)""",
        f"""j AS (SELECT cw.*, c.p02, c.p10, c.p25, c.p50, c.p75, c.p90, c.p98, c.n_samples, c.first_year AS qfy,
                  COALESCE(cov.cy, 0) AS cyears, {first} AS first_y,
                  CASE WHEN hl.hi IS NOT NULL AND cw.value >= hl.hi THEN 'highest'
                       WHEN hl.lo IS NOT NULL AND cw.value <= hl.lo THEN 'lowest' END AS record_type,
                  hi, lo, hi_start, hi_end, lo_start, lo_end, {_pct_sql('cw.value', 'c.')} AS pct
           FROM cw LEFT JOIN clim c ON c.station_id = cw.station_id AND c.window_days = cw.window_days
                   AND c.metric_id = cw.metric_id AND c.end_doy = dayofyear(cw.end_date)
           LEFT JOIN cov ON cov.station_id = cw.station_id
           LEFT JOIN hl ON hl.station_id = cw.station_id AND hl.window_days = cw.window_days AND hl.metric_id = cw.metric_id)""",
        f"""k AS (SELECT *, {sev} AS severity, {_direction_sql('pct', 'metric_id')} AS direction FROM j)""")
    return body + f"""
SELECT station_id, end_date, window_days, metric_id AS metric,
       {_primary_sql('window_days', 'severity', 'direction', 'record_type')} AS primary_statement,
       {_supporting_sql('window_days', 'pct', 'direction', 'cyears', 'first_y', *line)} AS supporting_line,
       {R('value', 2)} AS value, severity, {R('pct', 1)} AS percentile, p25, p75, CAST(cyears AS INTEGER) AS coverage_years,
       CAST(first_y AS INTEGER) AS first_year, coverage_ratio, n_samples, record_type,
       CASE record_type WHEN 'highest' THEN hi WHEN 'lowest' THEN lo END AS record_value,
       CASE record_type WHEN 'highest' THEN hi_start WHEN 'lowest' THEN lo_start END AS record_start,
       CASE record_type WHEN 'highest' THEN hi_end WHEN 'lowest' THEN lo_end END AS record_end
FROM k"""


def _j2():
    return _j2_for(J2_WINDOWS)


Q["j2_window_insight"] = _j2()
Q["j2_window_insight_windows"] = _j2_for(CLIMATOLOGY_WINDOWS)
Q["j2_window_insight_metrics"] = _j2_for(J2_WINDOWS, None, METRICS, ("tavg_c", "tmax_c", "tmin_c"))
Q["j2_window_insight_since"] = _j2_for(J2_WINDOWS, 1997)


def _j4(since=None):
    src = long_of("obs_nulls", ["tavg_c"]) + f" WHERE obs_date >= DATE '{since}-01-01'" if since else long_of("obs", ["tavg_c"])
    clim = clim_sql(rolled_sql(src, [7], "rows_nonnull"))
    ser = rolled_sql(long_of("obs_nulls", ["tavg_c"]), [7], "rows_nullable")
    return with_(OBS, OBS_NULLS, f"clim AS ({clim})", f"ser AS ({ser})") + f"""
SELECT s.station_id, s.obs_date AS "date", s.window_days, {R('s.value', 2)} AS value, {R(_pct_sql('s.value', 'c.'), 1)} AS percentile,
       c.p10, c.p25, c.p50, c.p75, c.p90
FROM ser s LEFT JOIN clim c ON c.station_id = s.station_id AND c.window_days = s.window_days
  AND c.end_doy = dayofyear(s.obs_date)"""


Q["j4_series_bands"] = _j4()
Q["j4_series_bands_since"] = _j4(1997)

Q["j7_records_report"] = with_(OBS, *_records_core(["tavg_c", "tmax_c", "tmin_c"], WINDOW_DAYS)) + f"""
SELECT station_id, metric_id, window_days, record_type, {R('value', 2)} AS value, start_date, end_date, n_years_considered
FROM recs ORDER BY station_id, metric_id, window_days, record_type"""


def _c10():
    wins = ", ".join(f"({w})" for w in LATEST_WINDOWS)
    return with_(
        OBS, *_records_core(["tavg_c"], LATEST_WINDOWS),
        f"lastd AS (SELECT station_id, LEAST(MAX(obs_date), DATE '{AS_OF}' - 1) AS latest_date FROM obs GROUP BY 1)",
        f"""cand AS (SELECT station_id, w.window_days, latest_date - CAST(i.range AS INTEGER) AS end_date
            FROM lastd, (VALUES {wins}) w(window_days), range(0, 8) i)""",
        """win AS (SELECT c.station_id, c.window_days, c.end_date, AVG(o.tavg_c) AS value, COUNT(o.tavg_c) AS n_valid
            FROM cand c LEFT JOIN obs o ON o.station_id = c.station_id
              AND o.obs_date BETWEEN c.end_date - (c.window_days - 1) AND c.end_date GROUP BY 1, 2, 3)""",
        f"""cur AS (SELECT station_id, 'tavg_c' AS metric_id, window_days, end_date, {R('value', 4)} AS value FROM win
            WHERE n_valid > 0 QUALIFY row_number() OVER (PARTITION BY station_id, window_days ORDER BY end_date DESC) = 1)""",
        f"""hl AS (SELECT station_id, metric_id, window_days,
                  MAX(CASE WHEN record_type = 'highest' THEN {R('value', 4)} END) AS hv, MAX(CASE WHEN record_type = 'highest' THEN start_date END) AS hs,
                  MAX(CASE WHEN record_type = 'highest' THEN end_date END) AS he,
                  MAX(CASE WHEN record_type = 'lowest' THEN {R('value', 4)} END) AS lv, MAX(CASE WHEN record_type = 'lowest' THEN start_date END) AS ls,
                  MAX(CASE WHEN record_type = 'lowest' THEN end_date END) AS le FROM recs GROUP BY 1, 2, 3)""") + f"""
SELECT c.station_id, c.metric_id, c.window_days, c.end_date, {R('c.value', 4)} AS value,
       CASE WHEN c.value >= hv THEN 'highest' WHEN c.value <= lv THEN 'lowest' END AS record_type,
       CASE WHEN c.value >= hv THEN {R('hv', 4)} WHEN c.value <= lv THEN {R('lv', 4)} END AS record_value,
       CASE WHEN c.value >= hv THEN hs WHEN c.value <= lv THEN ls END AS record_start,
       CASE WHEN c.value >= hv THEN he WHEN c.value <= lv THEN le END AS record_end,
       COALESCE(c.value >= hv OR c.value <= lv, FALSE) AS is_new_record
FROM cur c LEFT JOIN hl USING (station_id, metric_id, window_days)"""


Q["c10_record_check"] = _c10()

STREAK_WINDOWS = (1, 3, 5, 7, 10, 14, 21, 30, 45, 60, 90)
Q["e10_extreme_streaks"] = with_(OBS, OBS_NULLS, *_records_core(
    None, STREAK_WINDOWS, frame="rows_nullable",
    value_expr="SELECT station_id, obs_date, 'tavg_f' AS metric_id, tavg_c * 9.0 / 5.0 + 32.0 AS value FROM obs_nulls")) + f"""
SELECT station_id, window_days, record_type, {R('value', 1)} AS value_f, start_date, end_date FROM recs"""


# --- streaming (batch twins) ---------------------------------------------------
Q["i2_stream_precedence"] = Q["i2_precedence"]

Q["i5_stream_window_means"] = f"""
SELECT event_type, window_start, CAST(window_start + INTERVAL 7 DAY AS DATE) AS window_end,
       {R('AVG(value)', 4)} AS mean_value, COUNT(value) AS n
FROM (SELECT event_type, value, CAST(CAST(ts AS DATE) - CAST(k.range AS INTEGER) AS DATE) AS window_start
      FROM events, range(0, 7) k)
GROUP BY event_type, window_start"""


# --- spatial, period comparison, board -------------------------------------------
def _nearby(radius=300.0, k=3):
    dlat = radius / 111.0
    dist = ("6371.0 * acos(greatest(-1.0, least(1.0, cos(radians(p.lat)) * cos(radians(s.lat)) * "
            "cos(radians(s.lon) - radians(p.lon)) + sin(radians(p.lat)) * sin(radians(s.lat)))))")
    return with_(STATIONS) + f"""
SELECT point_id, station_id, {R('d', 2)} AS distance_km, CAST(rk AS INTEGER) AS rank FROM (
  SELECT p.point_id, s.station_id, {dist} AS d,
         row_number() OVER (PARTITION BY p.point_id ORDER BY {R(dist, 6)}, s.station_id) AS rk
  FROM (SELECT c_custkey AS point_id, 25.0 + (c_custkey % 250) / 10.0 AS lat, -120.0 + (c_custkey % 500) / 10.0 AS lon
        FROM customer) p
  JOIN st s ON s.is_active AND s.lat BETWEEN p.lat - {dlat} AND p.lat + {dlat}
   AND s.lon BETWEEN p.lon - {radius} / (111.0 * greatest(cos(radians(p.lat)), 0.01))
                 AND p.lon + {radius} / (111.0 * greatest(cos(radians(p.lat)), 0.01)))
WHERE rk <= {k}"""


Q["j8_nearby_stations"] = _nearby()

PERIOD = """, per AS (SELECT station_id, MAX(obs_date) - 29 AS start_date, MAX(obs_date) AS end_date FROM obs GROUP BY 1),
pcal AS (SELECT p.station_id, p.start_date, month(d) AS m, day(d) AS dd, CAST(d - p.start_date AS INTEGER) AS day_offset
         FROM per p, LATERAL (SELECT CAST(generate_series AS DATE) AS d FROM generate_series(p.start_date, p.end_date, INTERVAL 1 DAY)) g),
hist AS (SELECT o.station_id, o.obs_date, o.tavg_c AS "avg", c.start_date, c.day_offset FROM obs o
         JOIN pcal c ON c.station_id = o.station_id AND c.m = month(o.obs_date) AND c.dd = day(o.obs_date)
         WHERE year(o.obs_date) <> year(c.start_date)),
cur AS (SELECT o.station_id, p.start_date, p.end_date, AVG(o.tavg_c) AS current_avg FROM obs o JOIN per p USING (station_id)
        WHERE o.obs_date BETWEEN p.start_date AND p.end_date GROUP BY 1, 2, 3)"""

Q["j10_period_bands"] = with_(OBS) + PERIOD + f"""
SELECT station_id, start_date, day_offset, {R('quantile_cont("avg", 0.10)', 4)} AS p10, {R('quantile_cont("avg", 0.25)', 4)} AS p25,
       {R('quantile_cont("avg", 0.50)', 4)} AS p50, {R('quantile_cont("avg", 0.75)', 4)} AS p75,
       {R('quantile_cont("avg", 0.90)', 4)} AS p90, COUNT("avg") AS n_years
FROM hist GROUP BY 1, 2, 3"""

Q["j10_period_verdict"] = with_(OBS) + PERIOD + f""",
yr AS (SELECT station_id, CAST(year(obs_date) AS INTEGER) AS year, AVG("avg") AS ym FROM hist GROUP BY 1, 2),
agg AS (SELECT c.station_id, c.start_date, c.end_date, c.current_avg, MIN(y.year) AS earliest_year,
               CAST(SUM(CASE WHEN y.ym < c.current_avg THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rank_cold,
               CAST(SUM(CASE WHEN y.ym > c.current_avg THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rank_warm,
               COUNT(y.ym) + 1 AS total_years
        FROM cur c JOIN yr y USING (station_id) GROUP BY 1, 2, 3, 4),
v AS (SELECT *, rank_warm <= rank_cold AS w, CASE WHEN rank_warm <= rank_cold THEN rank_warm ELSE rank_cold END AS rk FROM agg)
SELECT station_id, start_date, end_date, {R('current_avg', 4)} AS current_avg, earliest_year, rank_cold, rank_warm, total_years,
       CASE WHEN rk / total_years <= 0.05 THEN 'unusually ' || (CASE WHEN w THEN 'warm' ELSE 'cold' END)
            WHEN rk / total_years <= 0.33 THEN (CASE WHEN w THEN 'warm' ELSE 'cold' END) || 'er than average'
            WHEN rk / total_years <= 0.67 THEN 'near average'
            ELSE (CASE WHEN w THEN 'cold' ELSE 'warm' END) || 'er than average' END AS verdict,
       CASE WHEN rk / total_years <= 0.67 THEN (CASE WHEN w THEN 'warmest' ELSE 'coldest' END)
            ELSE (CASE WHEN w THEN 'coldest' ELSE 'warmest' END) END AS side,
       CASE WHEN rk / total_years <= 0.67 THEN rk ELSE total_years - rk + 1 END AS rank_shown
FROM v"""

_J3 = Q["j3_latest_insights"]
BOARD = with_(STATIONS) + f""", ins AS ({_J3.split(chr(10) + 'SELECT station_id, window_days', 1)[0]}
SELECT station_id, window_days, 'tavg_c' AS metric, end_date, {R('value', 2)} AS value, {R('p50', 2)} AS normal_value,
       {R('pct', 1)} AS percentile, severity, direction FROM k),
rows AS (
  SELECT st.station_id, st.name, i.end_date IS NOT NULL AS has_data, i.severity, i.direction, i.percentile, i.value,
         i.normal_value, i.value - i.normal_value AS deviation,
         CASE WHEN i.direction = 'cold' AND i.severity = 'extreme' THEN 'Extremely Cold'
              WHEN i.direction = 'cold' AND i.severity = 'unusual' THEN 'Unusually Cold'
              WHEN i.direction = 'cold' AND i.severity = 'a_bit' THEN 'A Bit Colder'
              WHEN i.direction = 'warm' AND i.severity = 'extreme' THEN 'Extremely Warm'
              WHEN i.direction = 'warm' AND i.severity = 'unusual' THEN 'Unusually Warm'
              WHEN i.direction = 'warm' AND i.severity = 'a_bit' THEN 'A Bit Warmer' ELSE 'Near Normal' END AS display_label,
         CASE i.severity WHEN 'extreme' THEN 0 WHEN 'unusual' THEN 1 WHEN 'a_bit' THEN 2 WHEN 'normal' THEN 3
              WHEN 'insufficient_data' THEN 4 ELSE 5 END AS sev_order,
         CASE i.direction WHEN 'cold' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END AS dir_order,
         COALESCE(abs(i.percentile - 50), 0.0) AS pct_distance
  FROM st LEFT JOIN (SELECT * FROM ins WHERE window_days = 7) i USING (station_id))
"""

Q["j12_leaderboard"] = BOARD + """SELECT * FROM rows ORDER BY has_data DESC, sev_order, dir_order, pct_distance DESC, station_id"""
Q["d17_outlier_summary"] = BOARD + """SELECT COUNT(*) FILTER (WHERE severity NOT IN ('normal', 'insufficient_data')) AS outliers,
       COUNT(*) AS with_percentile FROM rows WHERE percentile IS NOT NULL"""
Q["d18_percentile_histogram"] = BOARD + """SELECT bin, COUNT(*) AS n,
       CASE WHEN bin < 5 THEN 'Extremely Cold' WHEN bin < 15 THEN 'Unusually Cold' WHEN bin < 35 THEN 'A Bit Colder'
            WHEN bin < 65 THEN 'Normal' WHEN bin < 85 THEN 'A Bit Warmer' WHEN bin < 95 THEN 'Unusually Warm'
            ELSE 'Extremely Warm' END AS zone
FROM (SELECT CAST(greatest(0, least(100, floor(percentile / 2 + 0.5) * 2)) AS INTEGER) AS bin FROM rows
      WHERE percentile IS NOT NULL) GROUP BY bin"""


# --- baselines, station bundle ---------------------------------------------------
Q["d6_baseline_climatology"] = with_(OBS) + clim_sql(
    rolled_sql("""SELECT station_id, obs_date, 'tavg_c' AS metric_id, tavg_c AS value, b.since_year
                  FROM obs, (VALUES (1996), (1998), (2000)) b(since_year)
                  WHERE obs_date >= make_date(b.since_year, 1, 1)""", [7], "rows_nonnull",
               keys=("station_id", "metric_id", "since_year")),
    keys=("station_id", "metric_id", "since_year", "window_days"))


def _j11():
    per = ("CASE WHEN w = 1 THEN 'day' WHEN w = 7 THEN 'week' WHEN w = 14 THEN 'two-week period' WHEN w = 30 THEN 'month' "
           "WHEN w = 90 THEN 'quarter' WHEN w = 365 THEN 'year' ELSE CAST(w AS VARCHAR) || '-day period' END")
    days = "CASE WHEN w = 1 THEN 'day' ELSE CAST(w AS VARCHAR) || ' days' END"
    head = f"'The last ' || {days} || ' have been '"
    cold = "(percentile IS NOT NULL AND percentile <= 50)"
    styled = "severity IN ('extreme', 'unusual', 'a_bit')"
    return f"""
SELECT station_id, end_date, window_days, percentile, severity, seasonal_rank, total_years,
  CASE WHEN COALESCE(seasonal_rank = 1 AND total_years >= 10, FALSE) AND {styled}
         THEN {head} || 'the ' || CASE WHEN {cold} THEN 'coldest' ELSE 'warmest' END || ' ' || {per}
              || ' for this time of year in ' || CAST(total_years AS VARCHAR) || ' years.'
       WHEN NOT ({styled}) THEN {head} || 'near normal.'
       WHEN severity = 'a_bit' THEN {head} || 'a bit ' || CASE WHEN {cold} THEN 'colder' ELSE 'warmer' END || '.'
       ELSE {head} || CASE WHEN severity = 'extreme' THEN 'extremely ' ELSE 'unusually ' END
            || CASE WHEN {cold} THEN 'cold' ELSE 'warm' END || '.' END AS headline
FROM (
  SELECT a.station_id, a.end_date, a.window_days, a.window_days AS w, a.percentile, a.severity,
         b.rank AS seasonal_rank, b.total_years
  FROM ({_j2_for((7,))}) a
  JOIN (SELECT station_id, MAX(obs_date) AS end_date FROM ({OBS.split(' AS (', 1)[1].rsplit(')', 1)[0]}) GROUP BY 1) t
    USING (station_id, end_date)
  LEFT JOIN (SELECT * FROM ({_seasonal(7)}) WHERE is_current) b USING (station_id, end_date))"""


Q["j11_station_bundle"] = _j11()


# --- baseline options, registry lookup -------------------------------------------

Q["h17_baseline_choices"] = with_(OBS) + """
SELECT station_id, o.label, o.position, o.since_year,
       NOT (o.since_year IS NOT NULL AND o.since_year < year(MIN(obs_date))) AS enabled
FROM obs CROSS JOIN (VALUES ('All', 0, CAST(NULL AS INTEGER)), ('25yr', 1, 2001 - 25 + 1), ('50yr', 2, 2001 - 50 + 1),
                            ('75yr', 3, 2001 - 75 + 1), ('100yr', 4, 2001 - 100 + 1)) o(label, position, since_year)
GROUP BY station_id, o.label, o.position, o.since_year"""

Q["c14_registry_lookup"] = with_(STATIONS) + """
SELECT r.station_id, st.wban, CASE WHEN st.wban IS NULL THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN st.wban IS NOT NULL THEN 'USW000' || right(st.wban, 5) END AS ghcn_station_id,
       CASE WHEN st.wban IS NULL THEN 'Station ' || r.station_id || ' not found in registry' END AS detail
FROM (SELECT n_name AS station_id FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION SELECT o_orderpriority FROM orders) r LEFT JOIN st USING (station_id)"""


# --- incremental ingest and refresh --------------------------------------------
FEED_AS_OF = "2001-10-20"
FEED_RUNS = ("1996-01-01 06:00:00", "1999-01-01 06:00:00", "2001-10-20 06:00:00")
_AUTH = "source IN ('ghcn_daily', 'gsod')"
_RANK = "CASE source WHEN 'ghcn_daily' THEN 1 WHEN 'gsod' THEN 2 ELSE 3 END"
_RUN_AT = "CASE wave " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FEED_RUNS)) + " END"
FEED = (
    LI_ST, STATIONS,
    RAW.replace("SELECT station_id AS STATION", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, station_id AS STATION"),
    """waved AS (SELECT *, CASE WHEN known < DATE '1996-01-01' THEN 0 WHEN known < DATE '1999-01-01' THEN 1 ELSE 2 END AS wave
       FROM (SELECT *, CASE WHEN source = 'open_meteo' THEN day ELSE day + 15 END AS known
             FROM (SELECT *, CASE WHEN l_linenumber <= 3 THEN 'ghcn_daily' WHEN l_linenumber <= 5 THEN 'gsod' ELSE 'open_meteo' END AS source
                   FROM raw)))""",
    """sent AS (SELECT *, FALSE AS late FROM waved WHERE wave < 2 OR STATION < 'K'
       UNION ALL SELECT * REPLACE (2 AS wave, '-100' AS TMIN), TRUE AS late FROM waved
       WHERE wave = 0 AND source = 'ghcn_daily' AND l_orderkey % 50 = 0 AND STATION < 'K')""",
    """feed AS (SELECT * REPLACE (CASE WHEN l_orderkey % 109 = 0 THEN 'NOWHERE' ELSE STATION END AS STATION,
                                  CASE WHEN l_orderkey % 107 = 0 THEN 'n/a' ELSE DATE END AS DATE) FROM sent)""",
    CLEAN.replace("FROM raw)", ", source, wave, late FROM feed)"),
    f"""judged AS (SELECT cl.*, CASE WHEN st.station_id IS NULL THEN 'unknown station' WHEN obs_date IS NULL THEN 'unreadable date'
                                     WHEN t2min IS NULL AND t2max IS NULL THEN 'no temperature' END AS problem
       FROM cl LEFT JOIN st ON cl.station_id = st.station_id
       WHERE (st.station_id IS NULL OR is_active) AND NOT COALESCE(obs_date >= DATE '{FEED_AS_OF}', FALSE))""",
    f"""ends AS (SELECT w.wave, j.station_id, MAX(j.obs_date) AS last_auth FROM judged j, (VALUES (0), (1), (2)) w(wave)
       WHERE j.wave <= w.wave AND {_AUTH} AND problem IS NULL GROUP BY 1, 2)""",
    f"""taken AS (SELECT j.station_id, j.obs_date, t2min AS tmin_c, t2max AS tmax_c, t4avg AS tavg_c, prcp_mm, source, j.wave
       FROM judged j LEFT JOIN ends e ON j.station_id = e.station_id AND j.wave = e.wave
       WHERE problem IS NULL AND NOT late AND ({_AUTH} OR j.obs_date > e.last_auth))""",
    f"""best AS (SELECT *, row_number() OVER (PARTITION BY station_id, obs_date, wave ORDER BY {_RANK}) AS in_wave FROM taken
       QUALIFY row_number() OVER (PARTITION BY station_id, obs_date, wave ORDER BY {_RANK}, tmin_c DESC NULLS LAST, tmax_c DESC NULLS LAST,
                                  tavg_c DESC NULLS LAST, prcp_mm DESC NULLS LAST) = 1)""",
    f"""obs AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY station_id, obs_date ORDER BY {_RANK}, wave DESC) = 1)""",
)

Q["i1_incremental"] = with_(*FEED) + f"""
SELECT station_id, obs_date, {R('tmin_c', 4)} AS tmin_c, {R('tmax_c', 4)} AS tmax_c, {R('tavg_c', 4)} AS tavg_c,
       {R('prcp_mm', 4)} AS prcp_mm, source, {_RUN_AT} AS ingested_at FROM obs"""

Q["i4_refresh"] = _latest_insights(obs=FEED, as_of=FEED_AS_OF, more=f""",
       (SELECT MAX({_RUN_AT}) FROM taken t WHERE t.station_id = k.station_id) AS computed_at""")

Q["d16_run_summary"] = with_(*FEED, """wrote AS (SELECT wave, station_id, COUNT(*) AS n,
       concat_ws('+', MAX(CASE source WHEN 'ghcn_daily' THEN source END), MAX(CASE source WHEN 'gsod' THEN source END),
                 MAX(CASE source WHEN 'open_meteo' THEN source END)) AS source FROM best GROUP BY 1, 2)""",
    """bad AS (SELECT wave, station_id, string_agg(problem || ': ' || CAST(n AS VARCHAR), '; ' ORDER BY problem) AS errors
       FROM (SELECT wave, station_id, problem, COUNT(*) AS n FROM judged WHERE problem IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)""") + f"""
SELECT CAST(wave AS BIGINT) AS batch, station_id, COALESCE(n, 0) AS "rows", source, COALESCE(errors, '') AS errors, {_RUN_AT} AS "at"
FROM wrote FULL JOIN bad USING (wave, station_id)"""

Q["d19_last_updated"] = with_(*FEED) + f"SELECT MAX({_RUN_AT}) AS last_updated FROM taken"


# --- landed files, registry seed, backfill ---------------------------------------
_LI_CSV = LI_ST.replace(
    "s_nationkey = n_nationkey)", "s_nationkey = n_nationkey WHERE l_linenumber <= 3 AND CAST(l_shipdate AS DATE) < DATE '2001-08-01')")
_LI_GSOD = LI_ST.replace("li AS (", "lig AS (").replace(
    "s_nationkey = n_nationkey)", "s_nationkey = n_nationkey WHERE l_linenumber > 3 AND CAST(l_shipdate AS DATE) < DATE '2001-09-15')")
_RG = RAW_GSOD.replace("FROM li)", "FROM lig)")
_GSOD_ROWS = f"""(SELECT station_id, {GSOD_DATE} AS obs_date,
             (CASE WHEN TRY_CAST("min" AS DOUBLE) <= 900 THEN TRY_CAST("min" AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tmin_c,
             (CASE WHEN TRY_CAST("max" AS DOUBLE) <= 900 THEN TRY_CAST("max" AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tmax_c,
             (CASE WHEN TRY_CAST(temp AS DOUBLE) <= 900 THEN TRY_CAST(temp AS DOUBLE) END - 32.0) * 5.0 / 9.0 AS tavg_c,
             CASE WHEN TRY_CAST(prcp AS DOUBLE) <= 90 THEN TRY_CAST(prcp AS DOUBLE) END * 25.4 AS prcp_mm, year AS y FROM rg)"""
_FOUR = f"{R('tmin_c', 4)} AS tmin_c, {R('tmax_c', 4)} AS tmax_c, {R('tavg_c', 4)} AS tavg_c, {R('prcp_mm', 4)} AS prcp_mm"

Q["a1_station_csv"] = with_(_LI_CSV, RAW, CLEAN) + f"""
SELECT station_id, obs_date, {_FOUR}
FROM (SELECT station_id, obs_date, t2min AS tmin_c, t2max AS tmax_c, t4avg AS tavg_c, prcp_mm FROM cl
      WHERE obs_date >= DATE '1995-01-01' AND (t2min IS NOT NULL OR t2max IS NOT NULL))"""

Q["a2_gsod_years"] = with_(_LI_GSOD, _RG) + f"""
SELECT station_id, obs_date, {_FOUR} FROM {_GSOD_ROWS}
WHERE y BETWEEN '1994' AND '1997' AND obs_date IS NOT NULL AND (tmin_c IS NOT NULL OR tmax_c IS NOT NULL)"""

Q["a4_registry_seed"] = with_(OBS, STATIONS, """cov AS (SELECT station_id, MIN(obs_date) AS f, MAX(obs_date) AS l,
       100.0 * COUNT(tavg_c) / COUNT(*) AS pct FROM obs GROUP BY 1)""") + f"""
SELECT station_id, wban, CASE WHEN k % 5 = 1 THEN lower(name) ELSE name END AS name, CASE WHEN k % 5 = 1 THEN 0.0 ELSE lat END AS lat, lon,
       CASE WHEN k % 5 <> 0 THEN f END AS first_obs_date, CASE WHEN k % 5 <> 0 THEN l END AS last_obs_date,
       CASE WHEN k % 5 <> 0 THEN CAST(year(l) - year(f) + 1 AS INTEGER) END AS coverage_years,
       CASE WHEN k % 5 <> 0 THEN {R('pct', 1)} END AS completeness_pct, k % 5 <> 1 AS is_active
FROM (SELECT *, CAST(right(wban, 3) AS INTEGER) AS k FROM st) LEFT JOIN cov USING (station_id)"""

_J1 = (
    _LI_CSV, _LI_GSOD, RAW, _RG, CLEAN, OBS.replace("obs AS (", "days AS ("),
    f"""prim AS (SELECT station_id, obs_date, t2min AS tmin_c, t2max AS tmax_c, t4avg AS tavg_c, prcp_mm, 1 AS rank FROM cl
       WHERE obs_date < DATE '{AS_OF}' AND (t2min IS NOT NULL OR t2max IS NOT NULL))""",
    f"""scnd AS (SELECT g.station_id, g.obs_date, tmin_c, tmax_c, tavg_c, prcp_mm, 2 AS rank FROM {_GSOD_ROWS} g
       JOIN (SELECT station_id, MIN(year(obs_date)) AS y0, MAX(year(obs_date)) AS y1 FROM prim GROUP BY 1) s USING (station_id)
       WHERE obs_date < DATE '{AS_OF}' AND (tmin_c IS NOT NULL OR tmax_c IS NOT NULL) AND year(obs_date) BETWEEN y0 AND y1
         AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.station_id = g.station_id AND p.obs_date = g.obs_date))""",
    f"""prov AS (SELECT d.station_id, d.obs_date, tmin_c, tmax_c,
              CASE WHEN tavg_c IS NULL AND tmin_c IS NOT NULL AND tmax_c IS NOT NULL THEN (tmin_c + tmax_c) / 2.0 ELSE tavg_c END AS tavg_c, prcp_mm, 3 AS rank
       FROM (SELECT station_id, obs_date, CASE WHEN day(obs_date) % 7 = 0 THEN NULL ELSE tmin_c END AS tmin_c,
                    CASE WHEN day(obs_date) % 7 = 0 THEN NULL ELSE tmax_c END AS tmax_c,
                    CASE WHEN day(obs_date) % 5 = 0 THEN NULL ELSE tavg_c END AS tavg_c, prcp_mm FROM days WHERE obs_date >= DATE '2001-07-01') d
       JOIN (SELECT station_id, MAX(obs_date) AS last_auth FROM (SELECT * FROM prim UNION ALL SELECT * FROM scnd) GROUP BY 1) a USING (station_id)
       WHERE (tmin_c IS NOT NULL OR tmax_c IS NOT NULL) AND d.obs_date > last_auth AND d.obs_date < DATE '{AS_OF}')""",
    """obs AS (SELECT station_id, obs_date, tmin_c, tmax_c, tavg_c, prcp_mm FROM (SELECT * FROM prim UNION ALL SELECT * FROM scnd UNION ALL SELECT * FROM prov)
       QUALIFY row_number() OVER (PARTITION BY station_id, obs_date ORDER BY rank, tmin_c DESC NULLS LAST, tmax_c DESC NULLS LAST,
                                  tavg_c DESC NULLS LAST, prcp_mm DESC NULLS LAST) = 1)""",
)


def _over_backfill(name: str) -> str:
    return Q[name].replace(OBS, ",\n".join(_J1))


Q["j1_backfill"] = f"""
SELECT 'climatology' AS stored_table, station_id, metric_id, window_days, CAST(end_doy AS VARCHAR) AS item, p50 AS value, n_samples AS n
FROM ({_over_backfill('d5_climatology')})
UNION ALL SELECT 'records', station_id, metric_id, window_days, record_type, value, n_years_considered FROM ({_over_backfill('d10_records')})
UNION ALL SELECT 'window_recent', station_id, 'tavg_c', window_days, CAST(end_date AS VARCHAR), tavg_c_mean, 0 FROM ({_over_backfill('e1_recent_windows')})
UNION ALL SELECT 'latest_insight', station_id, metric, window_days, severity, percentile, coverage_years FROM ({_over_backfill('j3_latest_insights')})"""
