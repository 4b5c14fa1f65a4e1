"""The named queries in SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

import math

# Mondays of the weeks that hold a London bank holiday, 1995 to 2000, by year.
HOLIDAY_WEEKS = {
    1995: "1995-01-02 1995-04-10 1995-04-17 1995-05-08 1995-05-29 1995-08-28 1995-12-25",
    1996: "1996-01-01 1996-04-01 1996-04-08 1996-05-06 1996-05-27 1996-08-26 1996-12-23",
    1997: "1996-12-30 1997-03-24 1997-03-31 1997-05-05 1997-05-26 1997-08-25 1997-12-22",
    1998: "1997-12-29 1998-04-06 1998-04-13 1998-05-04 1998-05-25 1998-08-31 1998-12-21 1998-12-28",
    1999: "1998-12-28 1999-03-29 1999-04-05 1999-05-03 1999-05-31 1999-08-30 1999-12-27",
    2000: "2000-01-03 2000-04-17 2000-04-24 2000-05-01 2000-05-29 2000-08-28 2000-12-25",
}


def _dates(*years: int) -> str:
    return ", ".join(f"DATE '{d}'" for y in years for d in HOLIDAY_WEEKS[y].split())


ALL_HOLIDAYS = _dates(*HOLIDAY_WEEKS)
HOLIDAYS_2000 = _dates(2000)

CALLS = """
calls AS (
  SELECT o_orderdate AS ts,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
         p_brand AS incident_type,
         CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'group a'
              WHEN p_brand IN ('Brand#3', 'Brand#4', 'Brand#5') THEN 'group b'
              WHEN p_brand = 'Brand#7' THEN 'group c'
              WHEN p_brand IN ('Brand#8', 'Brand#9') THEN 'group d'
              WHEN p_brand IN ('Brand#14', 'Brand#15') THEN 'group e'
              WHEN p_brand = 'Brand#16' THEN 'group f'
              WHEN p_brand IN ('Brand#17', 'Brand#18') THEN 'group g'
              WHEN p_brand = 'Brand#19' THEN 'group h' END AS type_group,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS call_origin,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'public non-emergency'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'household' END AS origin_new,
         concat('Grade ', substr(o_orderpriority, 1, 1)) AS initial_grade_of_response,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS attended_flag,
         (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7 AS raw_minutes,
         (epoch_us(l_shipdate + to_minutes(CAST(l_quantity AS BIGINT) - 5)) - epoch_us(l_shipdate))
           / 6e7 AS tos_minutes,
         l_suppkey AS area_id
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
)"""

RARE_TYPES = """
rare AS (SELECT incident_type FROM calls GROUP BY incident_type HAVING count(*) < 2000)"""
FOLDED = """coalesce(type_group, CASE WHEN incident_type IN (SELECT incident_type FROM rare) THEN 'other - minor'
                ELSE incident_type END) AS incident_type_new"""
RARE = f"""{RARE_TYPES},
typed AS (
  SELECT calls.*, coalesce(type_group, incident_type) AS merged_type,
         coalesce(type_group,
                  CASE WHEN incident_type IN (SELECT incident_type FROM rare) THEN 'other - minor'
                       ELSE incident_type END) AS incident_type_new
  FROM calls
)"""

ATTENDED = """
timed AS (
  SELECT *, CASE WHEN raw_minutes < 0 THEN raw_minutes + 720 ELSE raw_minutes END AS minutes
  FROM calls WHERE attended_flag = 1
)"""

AREAS = """
areas AS (
  SELECT s_suppkey AS area_id,
         CASE WHEN s_suppkey % 17 <> 0
              THEN row_number() OVER (ORDER BY s_acctbal, s_suppkey) END AS imd_rank,
         CASE WHEN s_suppkey % 17 <> 0
              THEN CAST(ntile(10) OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) END AS imd_decile
  FROM supplier
)"""

LEVELS = """
leveled AS (
  SELECT areas.*,
         CASE WHEN imd_rank IS NULL THEN NULL WHEN place <= high THEN 'high'
              WHEN place <= high + medium THEN 'medium' ELSE 'low' END AS dep_level
  FROM areas
  LEFT JOIN (SELECT area_id AS ranked_id, row_number() OVER (ORDER BY imd_rank) AS place
             FROM areas WHERE imd_rank IS NOT NULL) ON area_id = ranked_id
  CROSS JOIN (SELECT count(*) FILTER (WHERE imd_rank % 3 = 0) AS high,
                     count(*) FILTER (WHERE imd_rank % 3 = 1) AS medium FROM areas)
)"""

WEEKS = """
weeks AS (
  SELECT CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week
  FROM calls
)"""

EVENTS = """
slots AS (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS day,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'Pre-COVID' ELSE '2020' END AS period,
         CAST(hour(ts) AS INTEGER) AS hour, dayofweek(ts) AS dow_number,
         CASE dayofweek(ts) WHEN 0 THEN 'Sun' WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed'
              WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' ELSE 'Sat' END AS dow,
         CASE WHEN hour(ts) >= 5 AND hour(ts) < 11 THEN 'Early'
              WHEN hour(ts) >= 11 AND hour(ts) < 17 THEN 'Daytime'
              WHEN hour(ts) >= 17 AND hour(ts) < 23 THEN 'Evening' ELSE 'Late' END AS shift
  FROM events
)"""


def _sql(*parts: str, select: str = "", recursive: bool = False) -> str:
    """Common table expressions, then the final SELECT unless the last part brings its own."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n" + select


def _profile(slot: str) -> str:
    return f"""
profile AS (
  SELECT period, {slot}, round_even(avg(n), 0) AS avg_calls
  FROM (SELECT period, {slot}, week, count(*) AS n FROM slots GROUP BY ALL) GROUP BY ALL
)"""


def _wide(slot: str, values: list[str], quote: bool = True, prefix: str = "") -> str:
    columns = ", ".join(
        f"""max(avg_calls) FILTER (WHERE {slot} = {f"'{v}'" if quote else v}) AS "{prefix}{v}" """ for v in values
    )
    return f"SELECT period, {columns} FROM profile GROUP BY period"


DAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# Neighbours of unit squares on a grid: at most one step apart in each direction.
EDGES = """
cells AS (SELECT s_suppkey AS id, s_suppkey % 10 AS gx, s_suppkey // 10 AS gy FROM supplier),
edges AS (
  SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b
  ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.id <> b.id
)"""

MORAN = (
    CALLS
    + ","
    + EDGES
    + """,
degrees AS (SELECT src, count(*) AS degree FROM edges GROUP BY src),
vals AS (
  SELECT s_suppkey AS area_id, coalesce(c.n, 0) AS n
  FROM supplier LEFT JOIN (SELECT area_id, count(*) AS n FROM calls GROUP BY area_id) c
  ON s_suppkey = c.area_id
),
lagged AS (
  SELECT v.area_id, v.n, sum(u.n * (1.0::DOUBLE / d.degree)) AS lag,
         1.0::DOUBLE AS wi, 1.0::DOUBLE / any_value(d.degree) AS wi2
  FROM vals v JOIN edges e ON v.area_id = e.src JOIN degrees d ON d.src = e.src
  JOIN vals u ON u.area_id = e.dst GROUP BY v.area_id, v.n
),
centred AS (
  SELECT *, n - avg(n) OVER () AS z, lag - avg(n) OVER () AS lag_z,
         CAST(count(*) OVER () AS DOUBLE) AS areas FROM lagged
),
moments AS (SELECT avg(z * z) AS m2, avg(z * z * z * z) AS m4 FROM centred),
local AS (
  SELECT area_id, n, z, lag_z, z / m2 * lag_z AS local_i,
         -(z * z * wi) / ((areas - 1) * m2) AS e_cond,
         (z / m2) * (z / m2) * (areas / (areas - 2)) * (wi2 - wi * wi / (areas - 1))
           * (m2 - z * z / (areas - 1)) AS v_cond,
         -wi / (areas - 1) AS e_total,
         (areas - m4 / (m2 * m2)) / (areas - 1) * wi2
           + (2 * m4 / (m2 * m2) - areas) / ((areas - 1) * (areas - 2)) * (wi * wi - wi2)
           - (wi / (areas - 1)) * (wi / (areas - 1)) AS v_total
  FROM centred CROSS JOIN moments
)"""
)


def _local(kind: str) -> str:
    return f"""
SELECT area_id, round(z, 5) AS z, round(lag_z, 5) AS lag_z, round(local_i, 5) AS local_i,
       round(e_{kind}, 5) AS expectation, round(v_{kind}, 5) AS variance,
       round((local_i - e_{kind}) / nullif(sqrt(v_{kind}), 0), 5) AS z_score FROM local"""


QUADRANT = """
SELECT area_id, n,
       CASE WHEN v_cond = 0 OR abs((local_i - e_cond) / sqrt(v_cond)) < 1.959964 THEN 'non-significant'
            WHEN z > 0 AND lag_z > 0 THEN 'high-high' WHEN z > 0 THEN 'high-low'
            WHEN lag_z > 0 THEN 'low-high' ELSE 'low-low' END AS quadrant FROM local"""


def _gini(keys: str, source: str) -> str:
    """Definition over every area, zeros included."""
    return f"""
grid AS (SELECT k.*, s_suppkey AS area_id FROM ({source}) k CROSS JOIN supplier),
filled AS (
  SELECT g.*, CAST(coalesce(c.n, 0) AS DOUBLE) AS x
  FROM grid g LEFT JOIN counted c USING ({keys}, area_id)
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, area_id) AS i,
         count(*) OVER (PARTITION BY {keys}) AS areas FROM filled
),
ginis AS (
  SELECT {keys}, 2 * sum(i * x) / (any_value(areas) * nullif(sum(x), 0))
         - (any_value(areas) + 1) / any_value(areas)::DOUBLE AS gini
  FROM ordered GROUP BY {keys}
)"""


def _box(keys: str, value: str, source: str) -> str:
    return f"""
SELECT {keys}, count(*) AS n, round(any_value(q1), 9) AS q1, round(any_value(q2), 9) AS median,
       round(any_value(q3), 9) AS q3,
       round(min({value}) FILTER (WHERE {value} >= q1 - 1.5 * (q3 - q1)), 9) AS whisker_low,
       round(max({value}) FILTER (WHERE {value} <= q3 + 1.5 * (q3 - q1)), 9) AS whisker_high,
       count(*) FILTER (WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} JOIN (
  SELECT {keys}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
         quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {keys}) USING ({keys})
GROUP BY {keys}"""


LOGGED = """
logged AS (
  SELECT area_id, imd_decile, n, log10(n) AS log_n
  FROM (SELECT area_id, count(*) AS n FROM calls GROUP BY area_id) JOIN areas USING (area_id)
  WHERE imd_decile IS NOT NULL
)"""

AVERAGES = """
averages AS (
  SELECT a.area_id, imd_rank, imd_decile, p.period, coalesce(m, 0) AS avg_active_week
  FROM areas a CROSS JOIN (VALUES ('Pre-COVID'), ('2020')) p(period)
  LEFT JOIN (
    SELECT area_id, period, avg(n) AS m FROM (
      SELECT area_id, CASE WHEN ts < TIMESTAMP '2000-01-31' THEN 'Pre-COVID' ELSE '2020' END AS period,
             week, count(*) AS n FROM calls GROUP BY ALL) GROUP BY ALL) c
  ON a.area_id = c.area_id AND p.period = c.period
)"""


def _density(keys: str, source: str) -> str:
    """Kernel sum over 512 linear bins, as the definition has it."""
    return f"""
shape AS (
  SELECT {keys}, count(*) AS n, min(y) AS lo, (max(y) - min(y)) / 511e0 AS step,
         0.9e0 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34e0)
           * power(count(*), -0.2e0) AS h
  FROM {source} GROUP BY {keys}
),
placed AS (
  SELECT {keys}, least(floor((y - lo) / step), 510) AS bin, (y - lo) / step AS spot, lo, step, h, n
  FROM {source} JOIN shape USING ({keys})
),
bins AS (
  SELECT {keys}, bin, sum(w) AS w, any_value(lo) AS lo, any_value(step) AS step, any_value(h) AS h,
         any_value(n) AS n
  FROM (SELECT {keys}, bin, 1 - (spot - bin) AS w, lo, step, h, n FROM placed
        UNION ALL SELECT {keys}, bin + 1, spot - bin, lo, step, h, n FROM placed)
  GROUP BY {keys}, bin
)
SELECT {keys}, CAST(point AS INTEGER) AS point, round(any_value(lo + point * step), 6) AS x,
       round(sum(w / n * exp(-0.5e0 * power((point - bin) * step / h, 2)) / (h * sqrt(2 * pi()))), 6) AS density
FROM bins CROSS JOIN range(512) r(point) GROUP BY {keys}, point"""


def _decile_share(key: str, where: str) -> str:
    keys = f"{key}, " if key else ""
    source = f"(SELECT DISTINCT {key} FROM calls_typed) k CROSS JOIN" if key else ""
    return f"""
kept AS (SELECT * FROM areas WHERE {where}),
sizes AS (SELECT imd_decile, count(DISTINCT area_id) AS areas FROM kept GROUP BY imd_decile),
inner_weeks AS (SELECT week FROM weeks WHERE week > (SELECT min(week) FROM calls)
                AND week < (SELECT max(week) FROM calls)),
sums AS (SELECT {keys}week, imd_decile, count(*) AS n FROM calls_typed JOIN kept USING (area_id) GROUP BY ALL),
framed AS (
  SELECT {"k." + key + ", " if key else ""}w.week, s.imd_decile, s.areas, coalesce(u.n, 0) AS n
  FROM {source} inner_weeks w CROSS JOIN sizes s
  LEFT JOIN sums u ON u.week = w.week AND u.imd_decile IS NOT DISTINCT FROM s.imd_decile
  {f"AND u.{key} = k.{key}" if key else ""}
)
SELECT {keys}week, imd_decile, areas, CAST(n AS BIGINT) AS n, round(n / areas::DOUBLE, 6) AS calls_per_area,
       round((n / areas::DOUBLE) / nullif(sum(n / areas::DOUBLE) OVER (PARTITION BY {keys}week), 0), 9) AS share
FROM framed"""


def _band(keys: str, z: str = "1.959963984540054", digits: int = 6) -> str:
    """Straight-line band over `series(keys, week, y)`, joined in full to the actual values."""
    match = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM f.{k.strip()}" for k in keys.split(","))
    both = ", ".join(f"coalesce(a.{k.strip()}, f.{k.strip()}) AS {k.strip()}" for k in keys.split(","))
    return f"""
train AS (
  SELECT {keys}, y, date_diff('day', DATE '2000-01-31', week) / 7e0 AS t FROM series
  WHERE week < DATE '2000-01-31'
),
line AS (
  SELECT {keys}, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
         count(y) AS n, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy FROM train GROUP BY {keys}
),
horizon AS (SELECT CAST(DATE '2000-01-31' + INTERVAL (7 * i) DAY AS DATE) AS week, i FROM range(48) r(i)),
ahead AS (
  SELECT {keys}, week, intercept + slope * CAST(i AS DOUBLE) AS mean,
         CASE WHEN n > 2 THEN {z} * sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) END AS half
  FROM line CROSS JOIN horizon
),
shown AS (SELECT {keys}, week, y AS actual FROM series WHERE week > DATE '1999-12-27'),
band AS (
  SELECT {both}, coalesce(a.week, f.week) AS week, a.actual, f.mean, f.mean - half AS lower,
         f.mean + half AS upper,
         coalesce(a.actual < f.mean - half OR a.actual > f.mean + half, false) AS sig
  FROM shown a FULL JOIN ahead f ON {match} AND a.week = f.week
),
rounded AS (
  SELECT {keys}, week, round(actual, {digits}) AS actual, round(mean, {digits}) AS mean,
         round(lower, {digits}) AS lower, round(upper, {digits}) AS upper, sig FROM band
)"""


def _harmonic() -> str:
    """`solution` by elimination on the normal equations of `series`, and the band from it."""
    t = "(date_diff('day', DATE '2000-01-31', week) / 7e0)"
    waves = ", ".join(f"{f}({t} * {2 * math.pi * i / (365.25 / 7)!r}::DOUBLE)" for f in ("sin", "cos") for i in (1, 2, 3))
    numbers = lambda dummies: f"[1e0, {t} / {365.25 / 7!r}::DOUBLE, {waves}, {dummies}]"
    seen = f"(week > DATE '1997-06-02')::INT, (week > DATE '1997-05-12')::INT, (week IN ({ALL_HOLIDAYS}))::INT, y"
    later = f"1e0, 1e0, (week IN ({HOLIDAYS_2000}))::INT, 0e0"
    g = "initial_grade_of_response"
    band = _band(g, digits=4)
    return f"""
columns_of AS (
  SELECT {g}, week, unnest({numbers(seen)}) AS v, unnest(range(1, 13)) AS j FROM series WHERE week < DATE '2000-01-31'
),
gram AS (
  SELECT a.{g}, a.j AS i, b.j, sum(a.v * b.v) AS v FROM columns_of a JOIN columns_of b ON a.{g} = b.{g} AND a.week = b.week
  GROUP BY ALL
),
elim AS (
  SELECT {g}, 1 AS p, i, j, v FROM gram
  UNION ALL
  SELECT a.{g}, a.p + 1, a.i, a.j,
         CASE WHEN d.v <= 1e-9 * greatest(1, o.v) THEN a.v WHEN a.i = a.p THEN a.v / d.v ELSE a.v - c.v * b.v / d.v END
  FROM elim a JOIN elim b ON b.{g} = a.{g} AND b.i = a.p AND b.j = a.j
  JOIN elim c ON c.{g} = a.{g} AND c.i = a.i AND c.j = a.p
  JOIN elim d ON d.{g} = a.{g} AND d.i = a.p AND d.j = a.p
  JOIN gram o ON o.{g} = a.{g} AND o.i = a.p AND o.j = a.p
  WHERE a.p <= 11
),
pivots AS (
  SELECT e.{g}, e.i AS j, e.v > 1e-9 * greatest(1, o.v) AS fine FROM elim e JOIN gram o USING ({g}, i, j) WHERE e.i = e.p AND e.j = e.p AND e.i < 12
),
used AS (SELECT {g}, count(*) FILTER (WHERE fine) AS k FROM pivots GROUP BY ALL),
solution AS (
  SELECT e.{g}, e.i AS j, CASE WHEN fine THEN e.v ELSE 0 END AS b FROM elim e JOIN pivots p ON p.{g} = e.{g} AND p.j = e.i
  WHERE e.p = 12 AND e.j = 12
),
spread AS (
  SELECT e.{g}, sqrt(greatest(e.v, 0) / (n - k)) AS sigma
  FROM elim e JOIN used USING ({g})
  JOIN (SELECT {g}, count(*) AS n FROM series WHERE week < DATE '2000-01-31' GROUP BY ALL) USING ({g})
  WHERE e.p = 12 AND e.i = 12 AND e.j = 12 AND n >= k + 8
),
{band[: band.index("ahead AS (")].strip()}
later AS (
  SELECT {g}, week, unnest({numbers(later)}) AS v, unnest(range(1, 13)) AS j FROM spread CROSS JOIN horizon
),
ahead AS (
  SELECT {g}, week, sum(v * b) AS mean, 1.959963984540054 * any_value(sigma) AS half
  FROM later JOIN solution USING ({g}, j) JOIN spread USING ({g}) GROUP BY {g}, week
),
{band[band.index("shown AS ("):]}"""


def _lags(source: str, name: str, top: str) -> str:
    """Autocovariances of `source(g, i, x)` at lags 0 to `top`."""
    return f"""
{name} AS (
  SELECT a.g, a.i - b.i AS k, sum(a.x * b.x) / any_value(n) AS v FROM {source} a JOIN {source} b ON a.g = b.g AND a.i - b.i BETWEEN 0 AND {top}
  JOIN (SELECT g, count(*) AS n FROM {source} GROUP BY g) c ON c.g = a.g GROUP BY ALL
)"""


#: Differences and orders up to four: the statistic by windows, errors of each order from partial correlations written out.
ORDERS = f"""
numbered AS (
  SELECT incident_type_new AS g, row_number() OVER (PARTITION BY incident_type_new ORDER BY week) AS i, y,
         y - avg(y) OVER (PARTITION BY incident_type_new) AS x FROM series WHERE week < DATE '2000-01-31'
),
{_lags("numbered", "level_lags", "40").strip()},
runs AS (
  SELECT g, count(*) AS n, sum(s * s) AS squares, floor(3 * sqrt(count(*)) / 13) AS lags
  FROM (SELECT g, sum(x) OVER (PARTITION BY g ORDER BY i) AS s FROM numbered) GROUP BY g
),
tested AS (
  SELECT g, n, squares / (n * n * nullif(greatest(v, 0), 0)) AS kpss
  FROM (SELECT g, any_value(n) AS n, any_value(squares) AS squares,
               sum(CASE WHEN k = 0 THEN v WHEN k <= lags THEN 2 * (1 - k / (lags + 1)) * v ELSE 0 END) AS v
        FROM runs JOIN level_lags USING (g) GROUP BY g) WHERE n > 7
),
differences AS (
  SELECT g, i, y - avg(y) OVER (PARTITION BY g) AS x
  FROM (SELECT g, i, y - lag(y) OVER (PARTITION BY g ORDER BY i) AS y FROM numbered) WHERE y IS NOT NULL
),
stationary AS (
  SELECT s.g, s.i, s.x FROM differences s JOIN tested t ON t.g = s.g AND coalesce(kpss > 0.463, false)
  UNION ALL SELECT s.g, s.i, s.x FROM numbered s JOIN tested t ON t.g = s.g AND NOT coalesce(kpss > 0.463, false)
),
{_lags("stationary", "used_lags", "4").strip()},
flat AS (
  SELECT g, max(v) FILTER (k = 0) AS g0, max(v) FILTER (k = 1) AS g1, max(v) FILTER (k = 2) AS g2,
         max(v) FILTER (k = 3) AS g3, max(v) FILTER (k = 4) AS g4 FROM used_lags GROUP BY g
),
one AS (SELECT *, g1 / g0 AS a1, g0 * (1 - power(g1 / g0, 2)) AS e1 FROM flat),
two AS (SELECT *, (g2 - a1 * g1) / e1 AS b2 FROM one),
two_all AS (SELECT *, a1 - b2 * a1 AS b1, e1 * (1 - b2 * b2) AS e2 FROM two),
three AS (SELECT *, (g3 - b1 * g2 - b2 * g1) / e2 AS c3 FROM two_all),
three_all AS (SELECT *, b1 - c3 * b2 AS c1, b2 - c3 * b1 AS c2, e2 * (1 - c3 * c3) AS e3 FROM three),
four AS (SELECT *, e3 * (1 - power((g4 - c1 * g3 - c2 * g2 - c3 * g1) / e3, 2)) AS e4 FROM three_all),
errors AS (SELECT g, unnest([g0, e1, e2, e3, e4]) AS e, unnest(range(0, 5)) AS p FROM four),
scored AS (
  SELECT g, p, round(m * ln(e) + 2 * (p + 1) + 2 * (p + 1) * (p + 2) / (m - p - 2), 9) AS criterion
  FROM errors JOIN (SELECT g, count(*)::DOUBLE AS m FROM stationary GROUP BY g) USING (g)
),
chosen AS (
  SELECT g AS incident_type_new, n, round(kpss, 6) AS kpss, coalesce(kpss > 0.463, false)::INT AS d, p, round(criterion, 4) AS criterion
  FROM scored JOIN tested USING (g) QUALIFY row_number() OVER (PARTITION BY g ORDER BY criterion, p) = 1
)"""


def _gaps() -> str:
    """The band of medians per type whose errors follow the last one, by a filter over the weeks for every value on the grid."""
    key = "incident_type_new"
    band = _band(key, digits=4)
    return f"""
grouped AS (SELECT *, {FOLDED} FROM timed),
medians AS (SELECT {key}, week, quantile_cont(minutes, 0.5) AS y FROM grouped GROUP BY ALL),
grid AS (
  SELECT {key}, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week
  FROM medians GROUP BY {key}
),
series AS (SELECT {key}, week, y FROM grid LEFT JOIN medians USING ({key}, week)),
{band[: band.index("ahead AS (")].strip()}
errors AS (
  SELECT {key}, week, row_number() OVER (PARTITION BY {key} ORDER BY week) AS i, y - (intercept + slope * t) AS e
  FROM (SELECT *, date_diff('day', DATE '2000-01-31', week) / 7e0 AS t FROM series WHERE week < DATE '2000-01-31')
  JOIN line USING ({key})
),
walk AS (
  SELECT {key}, p / 100e0 AS phi, 0 AS i, 0e0 AS m, 1 / (1 - p / 100e0 * (p / 100e0)) AS v, 0 AS n, 0e0 AS squares, 0e0 AS logs
  FROM line CROSS JOIN range(-98, 99, 2) r(p)
  UNION ALL
  SELECT {key}, phi, errors.i, coalesce(e, phi * m), CASE WHEN e IS NULL THEN phi * phi * v + 1 ELSE 0 END,
         n + (e IS NOT NULL)::INT, squares + coalesce(power(e - phi * m, 2) / (phi * phi * v + 1), 0),
         logs + CASE WHEN e IS NULL THEN 0 ELSE ln(phi * phi * v + 1) END
  FROM walk JOIN errors USING ({key}) WHERE errors.i = walk.i + 1
),
ends AS (SELECT {key}, max(i) AS i, max(week) AS last_week FROM errors GROUP BY ALL),
states AS (
  SELECT * FROM walk JOIN ends USING ({key}, i) WHERE n > 3
  QUALIFY row_number() OVER (PARTITION BY {key}
    ORDER BY round(-(n * ln(greatest(squares, 1e-300) / n) + logs) / 2, 9) DESC, phi) = 1
),
distant AS (SELECT {key}, week, date_diff('day', last_week, week) / 7e0 AS h FROM ends CROSS JOIN horizon),
ahead AS (
  SELECT {key}, week, intercept + slope * (date_diff('day', DATE '2000-01-31', week) / 7e0) + power(phi, h) * m AS mean,
         1.959963984540054 * sqrt(squares / (n_seen - 3) * (power(phi * phi, h) * v + (1 - power(phi * phi, h)) / (1 - phi * phi))) AS half
  FROM distant JOIN line USING ({key}) LEFT JOIN (SELECT * RENAME (n AS n_seen) FROM states) USING ({key})
),
{band[band.index("shown AS ("):]}"""


def _filled_series(key: str, source: str) -> str:
    """Weekly counts without the first and last week, zeros inside each key's own range."""
    return f"""
counted AS (SELECT {key}, week, count(*) AS n FROM {source} GROUP BY ALL),
trimmed AS (SELECT * FROM counted WHERE week > (SELECT min(week) FROM counted)
            AND week < (SELECT max(week) FROM counted)),
ranges AS (SELECT {key}, min(week) AS lo, max(week) AS hi FROM trimmed GROUP BY {key}),
grid AS (SELECT {key}, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week
         FROM ranges),
series AS (SELECT {key}, week, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM grid LEFT JOIN trimmed USING ({key}, week))"""


GRADE = "initial_grade_of_response"
BY_GRADE = _filled_series(GRADE, "calls")
BY_TYPE = _filled_series("incident_type_new", "typed")
CHANNELS = "counted AS (SELECT origin_new, week, count(*) AS n FROM calls GROUP BY ALL)"


def _shares(key: str, source: str, extra: str = "", where: str = "true", out: str = "share", scale: str = "") -> str:
    keys = f"{extra}, {key}" if extra else key
    within = f"{extra}, week" if extra else "week"
    return f"""
SELECT {keys}, week, n, round(n / (sum(n) OVER (PARTITION BY {within}))::DOUBLE{scale}, 9) AS {out}
FROM (SELECT {keys}, week, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL)"""


def _median(value: str, source: str, keys: str = "", where: str = "true") -> str:
    prefix = f"{keys}, " if keys else ""
    return f"""
SELECT {prefix}week, round(quantile_cont({value}, 0.5), 3) AS median
FROM {source} WHERE {where} GROUP BY {prefix}week"""


def _attendance(keys: str, source: str, where: str = "true") -> str:
    prefix = f"{keys}, " if keys else ""
    return f"""
SELECT {prefix}week, count(*) AS n, CAST(coalesce(sum(attended_flag), 0) AS BIGINT) AS attended,
       round_even(coalesce(sum(attended_flag), 0)::DOUBLE / count(*)::DOUBLE * 100e0, 1) AS percent_attended
FROM {source} WHERE {where} GROUP BY {prefix}week"""


GRADES_1_4 = "initial_grade_of_response IN ('Grade 1', 'Grade 2', 'Grade 3', 'Grade 4')"


def _product(metric: str, key: str | None, value: str, source: str, where: str, fill: str) -> str:
    """Untrimmed weekly values of one forecast product, with the value that fills its gaps."""
    name = "NULL" if key is None else f"'{key}'"
    key_value = "NULL" if key is None else key
    return f"""
  SELECT '{metric}' AS metric, CAST({name} AS VARCHAR) AS key_name, CAST({key_value} AS VARCHAR) AS key_value,
         week, CAST({value} AS DOUBLE) AS y, CAST({fill} AS DOUBLE) AS fill
  FROM {source} WHERE {where} GROUP BY {"week" if key is None else key + ", week"}"""


_PERCENT = "round_even(coalesce(sum(attended_flag), 0)::DOUBLE / count(*)::DOUBLE * 100e0, 1)"
_MEDIAN = "quantile_cont(minutes, 0.5)"
_DV = "incident_type_new = 'Brand#10'"
_GINI_TYPES = {
    "gini": "true",
    "gini asb": "incident_type_new = 'group a'",
    "gini drugs": "incident_type_new = 'Brand#11'",
    "gini violence": "incident_type_new = 'group b'",
    "gini domestic": _DV,
    "gini missing person": "incident_type_new = 'Brand#12'",
}
_PRODUCTS = [
    _product("calls", None, "count(*)", "whole", "true", "0"),
    _product("calls by type", "incident_type_new", "count(*)", "whole", "true", "0"),
    _product("domestic calls by grade", GRADE, "count(*)", "whole", _DV, "0"),
    _product("calls by origin", "call_origin", "count(*)", "merged_origin", "true", "0"),
    _product(
        "asb share by deprivation",
        "dep_level",
        "count(*) / any_value(asb_in_week)::DOUBLE * 100",
        "asb",
        "true",
        "0",
    ),
    _product("attended", None, _PERCENT, "whole", "true", "NULL"),
    _product("attended by type", "incident_type_new", _PERCENT, "whole", "true", "0"),
    _product("attended by grade", GRADE, _PERCENT, "whole", GRADES_1_4, "0"),
    _product("domestic attended by grade", GRADE, _PERCENT, "whole", f"{_DV} AND {GRADES_1_4}", "0"),
    _product("response time", None, _MEDIAN, "went", "true", "NULL"),
    _product("response time by type", "incident_type_new", _MEDIAN, "went", "true", "NULL"),
    _product("response time by grade", GRADE, _MEDIAN, "went", "true", "NULL"),
    _product("domestic response time by grade", GRADE, _MEDIAN, "went", _DV, "NULL"),
    _product("time on scene by grade", GRADE, "quantile_cont(scene, 0.5)", "went", GRADES_1_4, "NULL"),
]
_GINI_ROWS = "\n  UNION ALL ".join(
    f"SELECT '{name}' AS metric, week, area_id, count(*) AS n FROM typed WHERE {where} GROUP BY week, area_id"
    for name, where in _GINI_TYPES.items()
)
PRODUCT_SERIES = f"""
whole AS (SELECT * FROM typed),
merged_origin AS (SELECT * REPLACE (origin_new AS call_origin) FROM typed),
asb AS (
  SELECT typed.*, dep_level, count(*) OVER (PARTITION BY week) AS asb_in_week
  FROM typed LEFT JOIN leveled USING (area_id) WHERE incident_type_new = 'group a'
),
went AS (
  SELECT *, CASE WHEN raw_minutes < 0 THEN raw_minutes + 720 ELSE raw_minutes END AS minutes,
         CASE WHEN tos_minutes >= 0 THEN tos_minutes END AS scene
  FROM typed WHERE attended_flag = 1
),
counted AS ({_GINI_ROWS}),
{_gini("metric, week", "SELECT metric, week FROM (SELECT DISTINCT metric FROM counted) m CROSS JOIN weeks")},
raw_series AS (
  {" UNION ALL ".join(_PRODUCTS)}
  UNION ALL SELECT metric, NULL, NULL, week, gini, NULL FROM ginis
),
inner_rows AS (
  SELECT * FROM raw_series WHERE week > (SELECT min(week) FROM calls) AND week < (SELECT max(week) FROM calls)
),
spans AS (
  SELECT metric, key_name, key_value, any_value(fill) AS fill,
         unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS week
  FROM inner_rows GROUP BY metric, key_name, key_value
),
series AS (
  SELECT s.metric, s.key_name, s.key_value, CAST(s.week AS DATE) AS week,
         CASE WHEN r.metric IS NULL THEN s.fill ELSE r.y END AS y
  FROM spans s LEFT JOIN inner_rows r ON r.metric = s.metric AND r.week = CAST(s.week AS DATE)
   AND r.key_value IS NOT DISTINCT FROM s.key_value
)"""

EVENTS_BY_WEEK = """
labels(week, events) AS (VALUES
  (DATE '2000-01-31', '1. first UK COVID case'), (DATE '2000-03-20', '2. first lockdown begins'),
  (DATE '2000-06-12', '3. first lockdown ends'), (DATE '2000-10-30', '4. second lockdown begins'),
  (DATE '2000-11-27', '5. second lockdown ends'))"""

ORACLE: dict[str, str] = {
    "key_dates": _sql(
        CALLS,
        select="""
SELECT CAST(k.i AS INTEGER) AS row, CAST(date_trunc('week', k.day) AS DATE) AS week, k.event,
       concat(k.i, '. ', k.event) AS label, c.n
FROM (VALUES (1, DATE '2000-01-31', 'first UK COVID case'), (2, DATE '2000-03-23', 'first lockdown begins'),
             (3, DATE '2000-06-15', 'first lockdown ends'), (4, DATE '2000-11-05', 'second lockdown begins'),
             (5, DATE '2000-12-02', 'second lockdown ends')) k(i, day, event)
LEFT JOIN (SELECT week, count(*) AS n FROM calls GROUP BY week) c
ON c.week = CAST(date_trunc('week', k.day) AS DATE)""",
    ),
    "week_grid": _sql(CALLS, WEEKS, select="SELECT week FROM weeks"),
    "recode_types": _sql(
        CALLS, RARE, select="SELECT incident_type, incident_type_new, count(*) AS n FROM typed GROUP BY ALL"
    ),
    "rare_fold": _sql(
        CALLS,
        select="""
SELECT call_origin, CASE WHEN count(*) < 12000 THEN 'other - minor' ELSE call_origin END AS origin_folded,
       count(*) AS n FROM calls GROUP BY call_origin""",
    ),
    "recode_origin": _sql(CALLS, select="SELECT call_origin, origin_new, count(*) AS n FROM calls GROUP BY ALL"),
    "shift_band_counts": _sql(EVENTS, select="SELECT shift, hour, count(*) AS n FROM slots GROUP BY ALL"),
    "intervention_days": _sql(
        CALLS,
        select="""
SELECT CASE WHEN CAST(ts AS DATE) < DATE '1997-06-03' THEN 0 ELSE 1 END AS system_change,
       CASE WHEN CAST(ts AS DATE) < DATE '1997-05-15' THEN 0 ELSE 1 END AS inspection,
       count(*) AS n FROM calls GROUP BY ALL""",
    ),
    "period_counts": _sql(
        CALLS,
        select="""
SELECT CASE WHEN ts < TIMESTAMP '2000-01-31' THEN 'Pre-COVID' ELSE '2020' END AS period,
       CASE WHEN ts < TIMESTAMP '2000-01-23' THEN 'Pre-COVID' ELSE '2020' END AS early_period,
       CASE WHEN ts <= TIMESTAMP '2000-01-31' THEN 'Pre-COVID' ELSE '2020' END AS closed_period,
       count(*) AS n FROM calls GROUP BY ALL""",
    ),
    "attended_classes": _sql(
        CALLS,
        select="""
SELECT CASE attended_flag WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS attended, count(*) AS n
FROM calls GROUP BY ALL""",
    ),
    "response_time": _sql(
        CALLS,
        ATTENDED,
        select="""
SELECT round(raw_minutes, 4) AS raw_minutes, round(minutes, 4) AS minutes, count(*) AS n
FROM timed GROUP BY raw_minutes, minutes""",
    ),
    "time_on_scene": _sql(
        CALLS,
        ATTENDED,
        select="SELECT round(tos_minutes, 4) AS tos_minutes, count(*) AS n FROM timed GROUP BY timed.tos_minutes",
    ),
    "negative_duration_split": _sql(
        CALLS,
        ATTENDED,
        select="""
SELECT CASE WHEN tos_minutes < 0 THEN 'negative' WHEN tos_minutes >= 0 THEN 'non-negative' END AS sign,
       count(*) AS n FROM timed GROUP BY ALL""",
    ),
    "calls_with_area": _sql(
        CALLS,
        AREAS,
        select="""
SELECT c.area_id, imd_rank, imd_decile, n FROM (SELECT area_id, count(*) AS n FROM calls GROUP BY area_id) c
LEFT JOIN (SELECT * FROM areas WHERE imd_rank IS NOT NULL) a ON a.area_id = c.area_id""",
    ),
    "calls_in_known_areas": _sql(
        CALLS,
        AREAS,
        select="""
SELECT initial_grade_of_response, count(*) AS n, count(DISTINCT area_id) AS areas FROM calls
WHERE area_id IN (SELECT area_id FROM areas WHERE imd_rank IS NOT NULL) GROUP BY ALL""",
    ),
    "areas_without_rank": "SELECT s_suppkey AS area_id FROM supplier WHERE s_suppkey % 17 = 0",
    "area_week_panel": _sql(
        CALLS,
        AREAS,
        WEEKS,
        select="""
SELECT a.area_id, imd_rank, imd_decile, w.week, coalesce(c.n, 0) AS n FROM areas a CROSS JOIN weeks w
LEFT JOIN (SELECT area_id, week, count(*) AS n FROM calls GROUP BY ALL) c
ON c.area_id = a.area_id AND c.week = w.week""",
    ),
    "area_week_panels": _sql(
        CALLS,
        RARE,
        AREAS,
        WEEKS,
        select="""
SELECT p.panel, a.area_id, a.imd_decile, count(*) AS weeks, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS n,
       count(*) FILTER (WHERE c.n IS NULL) AS empty_weeks
FROM areas a CROSS JOIN weeks w
CROSS JOIN (VALUES ('all'), ('asb'), ('drugs'), ('missing person'), ('domestic'), ('violence'), ('admin')) p(panel)
LEFT JOIN (
  SELECT panel, area_id, week, count(*) AS n FROM typed JOIN (VALUES
    ('asb', 'group a'), ('drugs', 'Brand#11'), ('missing person', 'Brand#12'), ('domestic', 'Brand#10'),
    ('violence', 'group b'), ('admin', 'group c')) m(panel, type) ON merged_type = type GROUP BY ALL
  UNION ALL SELECT 'all', area_id, week, count(*) FROM typed GROUP BY ALL) c
ON c.panel = p.panel AND c.area_id = a.area_id AND c.week = w.week GROUP BY ALL""",
    ),
    "area_week_panel_rows": _sql(
        CALLS,
        RARE,
        AREAS,
        WEEKS,
        select="""
SELECT p.panel, a.area_id, a.imd_decile, w.week, coalesce(c.n, 0) AS n
FROM areas a CROSS JOIN weeks w
CROSS JOIN (VALUES ('all'), ('asb'), ('drugs'), ('missing person'), ('domestic'), ('violence'), ('admin')) p(panel)
LEFT JOIN (
  SELECT panel, area_id, week, count(*) AS n FROM typed JOIN (VALUES
    ('asb', 'group a'), ('drugs', 'Brand#11'), ('missing person', 'Brand#12'), ('domestic', 'Brand#10'),
    ('violence', 'group b'), ('admin', 'group c')) m(panel, type) ON merged_type = type GROUP BY ALL
  UNION ALL SELECT 'all', area_id, week, count(*) FROM typed GROUP BY ALL) c
ON c.panel = p.panel AND c.area_id = a.area_id AND c.week = w.week""",
    ),
    "deprived_areas_alone": _sql(
        AREAS,
        EDGES,
        select="""
SELECT area_id FROM areas WHERE imd_decile = 1 AND area_id NOT IN (
  SELECT src FROM edges JOIN areas b ON b.area_id = dst AND b.imd_decile = 1)""",
    ),
    "areas_intersecting": """
SELECT s_suppkey AS area_id FROM supplier
WHERE s_suppkey % 10 <= 6.5 AND s_suppkey % 10 + 1 >= 2.5 AND s_suppkey // 10 <= 5.5 AND s_suppkey // 10 + 1 >= 1.5""",
    "queen_neighbours": _sql(EDGES, select="SELECT src, dst FROM edges"),
    "count_by_origin": _sql(CALLS, select="SELECT call_origin, count(*) AS n FROM calls GROUP BY ALL"),
    "weekly_total": _sql(CALLS, select="SELECT week, count(*) AS n FROM calls GROUP BY ALL"),
    "weekly_by_type": _sql(
        CALLS, RARE, select="SELECT incident_type_new, week, count(*) AS n FROM typed GROUP BY ALL"
    ),
    "weekly_of_types": _sql(
        CALLS, select="SELECT week, count(*) AS n FROM calls WHERE type_group = 'group b' GROUP BY ALL"
    ),
    "weekly_by_origin": _sql(CALLS, select="SELECT origin_new, week, count(*) AS n FROM calls GROUP BY ALL"),
    "weekly_by_grade": _sql(
        CALLS, select="SELECT initial_grade_of_response, week, count(*) AS n FROM calls GROUP BY ALL"
    ),
    "daily_count": _sql(EVENTS, select="SELECT day, count(*) AS n FROM slots GROUP BY ALL"),
    "daily_count_without_outlier": _sql(
        EVENTS, select="SELECT day, count(*) AS n FROM slots WHERE day <> DATE '2024-01-10' GROUP BY ALL"
    ),
    "attendance_weekly": _sql(CALLS, select=_attendance("", "calls")),
    "attendance_by_type": _sql(
        CALLS,
        RARE,
        select=_attendance("incident_type_new", "typed"),
    ),
    "attendance_by_grade": _sql(CALLS, select=_attendance(GRADE, "calls", GRADES_1_4)),
    "median_response_weekly": _sql(CALLS, ATTENDED, select=_median("minutes", "timed")),
    "median_response_by_type": _sql(
        CALLS,
        RARE_TYPES,
        ATTENDED,
        f"grouped AS (SELECT *, {FOLDED} FROM timed)",
        select=_median("minutes", "grouped", "incident_type_new"),
    ),
    "median_response_by_grade": _sql(CALLS, ATTENDED, select=_median("minutes", "timed", GRADE)),
    "median_scene_by_grade": _sql(
        CALLS, ATTENDED, select=_median("tos_minutes", "timed", GRADE, f"tos_minutes >= 0 AND {GRADES_1_4}")
    ),
    "duration_summary": _sql(
        CALLS,
        ATTENDED,
        select="""
SELECT count(raw_minutes) AS n, round(avg(raw_minutes), 3) AS mean, round(min(raw_minutes), 3) AS min,
       round(max(raw_minutes), 3) AS max, round(quantile_cont(raw_minutes, 0.5), 3) AS median FROM timed""",
    ),
    "duration_summary_by_grade": _sql(
        CALLS,
        ATTENDED,
        select="""
SELECT initial_grade_of_response, count(raw_minutes) AS n, round(avg(raw_minutes), 3) AS mean,
       round(min(raw_minutes), 3) AS min, round(max(raw_minutes), 3) AS max,
       round(quantile_cont(raw_minutes, 0.5), 3) AS median FROM timed GROUP BY ALL""",
    ),
    "trim_edge_weeks": _sql(
        CALLS,
        CHANNELS,
        select="""
SELECT * FROM counted WHERE week > (SELECT min(week) FROM counted) AND week < (SELECT max(week) FROM counted)""",
    ),
    "trim_table_rows": _sql(
        CALLS,
        CHANNELS,
        select="""
SELECT origin_new, week, n FROM (
  SELECT *, row_number() OVER (ORDER BY origin_new NULLS LAST, week) AS i, count(*) OVER () AS of FROM counted)
WHERE i > 1 AND i < of""",
    ),
    "trim_group_rows": _sql(
        CALLS,
        CHANNELS,
        select="""
SELECT origin_new, week, n FROM (
  SELECT *, row_number() OVER (PARTITION BY week ORDER BY origin_new NULLS LAST) AS i,
         count(*) OVER (PARTITION BY week) AS of FROM counted)
WHERE of < 3 OR (i > 1 AND i < of)""",
    ),
    "gap_fill_weekly": _sql(
        CALLS,
        "counted AS (SELECT area_id, week, count(*) AS n FROM calls GROUP BY ALL)",
        select="""
SELECT g.area_id, CAST(g.week AS DATE) AS week, coalesce(c.n, 0) AS n FROM (
  SELECT area_id, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS week
  FROM counted GROUP BY area_id) g LEFT JOIN counted c ON c.area_id = g.area_id AND c.week = CAST(g.week AS DATE)""",
    ),
    "series_regressors": _sql(
        CALLS,
        "counted AS (SELECT initial_grade_of_response, week, count(*) AS n FROM calls GROUP BY ALL)",
        select=f"""
SELECT g.initial_grade_of_response, CAST(g.week AS DATE) AS week, coalesce(c.n, 0) AS n,
       g.week > DATE '1997-06-02' AS new_system, g.week > DATE '1997-05-12' AS hmic_changes,
       CAST(g.week AS DATE) IN ({ALL_HOLIDAYS}) AS bank_holiday
FROM (SELECT initial_grade_of_response,
             unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS week
      FROM counted GROUP BY initial_grade_of_response) g
LEFT JOIN counted c ON c.initial_grade_of_response = g.initial_grade_of_response AND c.week = CAST(g.week AS DATE)""",
    ),
    "future_frame": f"""
SELECT concat('Grade ', g) AS initial_grade_of_response, week, true AS new_system, true AS hmic_changes,
       week IN ({HOLIDAYS_2000}) AS bank_holiday
FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
CROSS JOIN (SELECT CAST(date_trunc('week', DATE '2000-01-31' + INTERVAL (7 * i) DAY) AS DATE) AS week
            FROM range(53) r(i) WHERE DATE '2000-01-31' + INTERVAL (7 * i) DAY <= DATE '2000-12-31')""",
    "shift_share_weekly": _sql(EVENTS, select=_shares("shift", "slots")),
    "attended_share_weekly": _sql(
        CALLS,
        "flagged AS (SELECT week, CASE attended_flag WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS attended FROM calls)",
        select=_shares("attended", "flagged"),
    ),
    "origin_share_weekly": _sql(
        CALLS, select=_shares("origin_new", "calls", where="origin_new IS NOT NULL")
    ),
    "origin_share_weekly_by_type": _sql(
        CALLS,
        RARE_TYPES,
        f"merged AS (SELECT *, {FOLDED} FROM calls)",
        select=_shares("call_origin", "merged", "incident_type_new", "call_origin IS NOT NULL"),
    ),
    "origin_year_share": _sql(
        CALLS,
        select="""
SELECT call_origin, CAST(year(ts) AS INTEGER) AS year, count(*) AS n,
       round(count(*) / (sum(count(*)) OVER (PARTITION BY call_origin))::DOUBLE, 9) AS share
FROM calls GROUP BY call_origin, year(ts)""",
    ),
    "origin_order": _sql(
        CALLS,
        select="""
SELECT call_origin, quantile_cont(n, 0.5) AS median,
       CAST(row_number() OVER (ORDER BY quantile_cont(n, 0.5), call_origin) AS INTEGER) AS position
FROM (SELECT call_origin, week, count(*) AS n FROM calls WHERE call_origin IS NOT NULL GROUP BY ALL)
GROUP BY call_origin""",
    ),
    "yearly_weighted_change": """
SELECT year, n, round((n - lag(n) OVER (ORDER BY year)) / (lag(n) OVER (ORDER BY year))::DOUBLE, 6) AS change
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(o_custkey % 7) AS BIGINT) AS n FROM orders
      WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1999, 2000) GROUP BY ALL)""",
    "dow_profile": _sql(EVENTS, _profile("dow"), select="SELECT * FROM profile"),
    "dow_profile_wide": _sql(EVENTS, _profile("dow"), select=_wide("dow", DAYS)),
    "shift_profile": _sql(EVENTS, _profile("shift"), select="SELECT * FROM profile"),
    "shift_profile_wide": _sql(
        EVENTS, _profile("shift"), select=_wide("shift", ["Early", "Daytime", "Evening", "Late"])
    ),
    "hour_profile": _sql(EVENTS, _profile("hour"), select="SELECT * FROM profile"),
    "hour_profile_wide": _sql(
        EVENTS, _profile("hour"), select=_wide("hour", [str(h) for h in range(24)], False, "h")
    ),
    "profile_bounds": _sql(
        EVENTS,
        _profile("dow"),
        "limits AS (SELECT max(avg_calls) FILTER (WHERE period = 'Pre-COVID') + 10 AS hi,"
        " min(avg_calls) FILTER (WHERE period = '2020') - 10 AS lo FROM profile)",
        select=_wide("dow", DAYS)
        + "\nUNION ALL SELECT 'upper limit', hi, hi, hi, hi, hi, hi, hi FROM limits"
        + "\nUNION ALL SELECT 'lower limit', lo, lo, lo, lo, lo, lo, lo FROM limits",
    ),
    "avg_weekly_calls_by_area_period": _sql(CALLS, AREAS, AVERAGES, select="SELECT * REPLACE (round(avg_active_week, 6) AS avg_active_week) FROM averages"),
    "areas_per_decile": _sql(
        AREAS, select="SELECT imd_decile, count(DISTINCT area_id) AS areas FROM areas GROUP BY imd_decile"
    ),
    "area_group_sizes": _sql(
        AREAS,
        select="SELECT area_id, imd_rank, imd_decile, count(*) OVER (PARTITION BY imd_decile) AS areas FROM areas",
    ),
    "dep_terciles": _sql(AREAS, LEVELS, select="SELECT area_id, imd_rank, dep_level FROM leveled"),
    "dep_level_weekly_share": _sql(
        CALLS,
        AREAS,
        LEVELS,
        "located AS (SELECT week, dep_level FROM calls LEFT JOIN leveled USING (area_id)"
        " WHERE incident_type = 'Brand#10')",
        select=_shares("dep_level", "located", out="per", scale=" * 100"),
    ),
    "area_pre_post": _sql(
        CALLS,
        AREAS,
        select="""
SELECT a.area_id, imd_rank, imd_decile, count(*) FILTER (WHERE week < DATE '2000-01-31') AS pre,
       count(*) FILTER (WHERE week >= DATE '2000-01-31') AS post
FROM areas a LEFT JOIN calls c ON c.area_id = a.area_id GROUP BY ALL""",
    ),
    "total_calls_by_area": _sql(
        CALLS,
        AREAS,
        select="""
SELECT area_id, imd_rank, imd_decile, n FROM (SELECT area_id, count(*) AS n FROM calls GROUP BY area_id)
JOIN areas USING (area_id) WHERE imd_decile IS NOT NULL""",
    ),
    "calls_by_area_type": _sql(
        CALLS,
        AREAS,
        select="""
SELECT a.area_id, imd_rank, imd_decile, count(c.area_id) AS n FROM areas a
LEFT JOIN (SELECT area_id FROM calls WHERE incident_type = 'Brand#10') c ON c.area_id = a.area_id GROUP BY ALL""",
    ),
    "gini_weekly": _sql(
        CALLS,
        WEEKS,
        "counted AS (SELECT week, area_id, count(*) AS n FROM calls GROUP BY ALL)",
        _gini("week", "SELECT week FROM weeks"),
        select="SELECT week, round(gini, 6) AS gini FROM ginis",
    ),
    "gini_weekly_by_type": _sql(
        CALLS,
        RARE_TYPES,
        WEEKS,
        f"counted AS (SELECT {FOLDED}, week, area_id,"
        " count(*) AS n FROM calls GROUP BY ALL)",
        _gini(
            "incident_type_new, week",
            "SELECT incident_type_new, week FROM (SELECT DISTINCT incident_type_new FROM counted) t CROSS JOIN weeks",
        ),
        select="SELECT incident_type_new, week, round(gini, 6) AS gini FROM ginis",
    ),
    "boxplot_by_decile": _sql(CALLS, AREAS, LOGGED, select=_box("imd_decile", "log_n", "logged")),
    "boxplot_outliers": _sql(
        CALLS,
        AREAS,
        LOGGED,
        select="""
SELECT area_id, imd_decile, n FROM logged JOIN (
  SELECT imd_decile, quantile_cont(log_n, 0.25) AS q1, quantile_cont(log_n, 0.75) AS q3
  FROM logged GROUP BY imd_decile) USING (imd_decile)
WHERE log_n < q1 - 1.5 * (q3 - q1) OR log_n > q3 + 1.5 * (q3 - q1)""",
    ),
    "boxplot_by_decile_period": _sql(
        CALLS,
        AREAS,
        AVERAGES,
        "ranked AS (SELECT * FROM averages WHERE imd_decile IS NOT NULL)",
        select=_box("imd_decile, period", "avg_active_week", "ranked"),
    ),
    "boxplot_by_decile_type": _sql(
        CALLS,
        RARE_TYPES,
        AREAS,
        f"""
logged AS (
  SELECT incident_type_new, imd_decile, log10(n) AS log_n
  FROM (SELECT {FOLDED}, area_id, count(*) AS n FROM calls GROUP BY ALL)
  JOIN areas USING (area_id) WHERE imd_decile IS NOT NULL
)""",
        select=_box("incident_type_new, imd_decile", "log_n", "logged"),
    ),
    "boxplot_by_decile_period_type": _sql(
        CALLS,
        RARE_TYPES,
        AREAS,
        f"""
typed AS (
  SELECT area_id, {FOLDED}, week,
         CASE WHEN ts < TIMESTAMP '2000-01-31' THEN 'Pre-COVID' ELSE '2020' END AS period FROM calls
),
means AS (
  SELECT area_id, incident_type_new, period, avg(n) AS m
  FROM (SELECT area_id, incident_type_new, period, week, count(*) AS n FROM typed GROUP BY ALL) GROUP BY ALL
),
ranked AS (
  SELECT imd_decile, f.incident_type_new, f.period, coalesce(m, 0) AS avg_active_week
  FROM (SELECT area_id, imd_decile, incident_type_new, period FROM areas
        CROSS JOIN (SELECT DISTINCT incident_type_new FROM typed) CROSS JOIN (VALUES ('Pre-COVID'), ('2020')) p(period)
        WHERE imd_decile IS NOT NULL) f
  LEFT JOIN means USING (area_id, incident_type_new, period)
)""",
        select=_box("incident_type_new, imd_decile, period", "avg_active_week", "ranked"),
    ),
    "duration_density": _sql(
        CALLS,
        ATTENDED,
        "logs AS (SELECT 'all' AS calls, log10(minutes) AS y FROM timed WHERE minutes > 0)",
        _density("calls", "logs").lstrip(),
    ),
    "duration_density_by_grade": _sql(
        CALLS,
        ATTENDED,
        f"""
logs AS (
  SELECT initial_grade_of_response, asinh(tos_minutes / 2e0) AS y,
         CASE WHEN ts <= TIMESTAMP '2000-01-31' THEN 'pre-pandemic' ELSE 'pandemic' END AS period
  FROM timed WHERE {GRADES_1_4}
)""",
        _density("initial_grade_of_response, period", "logs").lstrip(),
    ),
    "decile_share_weekly": _sql(
        CALLS,
        AREAS,
        WEEKS,
        "calls_typed AS (SELECT * FROM calls)",
        _decile_share("", "true").lstrip(),
    ),
    "decile_share_weekly_by_type": _sql(
        CALLS,
        RARE_TYPES,
        AREAS,
        WEEKS,
        f"calls_typed AS (SELECT *, {FOLDED} FROM calls)",
        _decile_share("incident_type_new", "imd_decile IS NOT NULL").lstrip(),
    ),
    "spatial_weights": _sql(
        EDGES,
        select="SELECT src, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY src), 6) AS w FROM edges",
    ),
    "spatial_lag": _sql(MORAN, select="SELECT area_id, n, round(lag, 6) AS lag FROM lagged"),
    "moran_global": _sql(
        MORAN,
        select="""
SELECT count(*) AS n, round(sum(z * lag_z) / sum(z * z), 6) AS moran_i,
       round(count(*) * sum(z * z * z * z) / (sum(z * z) * sum(z * z)), 6) AS kurtosis FROM centred""",
    ),
    "moran_local": _sql(MORAN, select=_local("cond")),
    "moran_local_total": _sql(MORAN, select=_local("total")),
    "moran_quadrants": _sql(MORAN, select=QUADRANT),
    "moran_p_values": _sql(
        MORAN,
        """
scored AS (
  SELECT *, abs((local_i - e_cond) / nullif(sqrt(v_cond), 0)) AS size FROM local
),
tested AS (
  SELECT *, 2 * exp(-size * size / 2)
    * ((((((3.52624965998911e-02 * size + 0.700383064443688e0) * size + 6.37396220353165e0) * size + 33.912866078383e0)
        * size + 112.079291497871e0) * size + 221.213596169931e0) * size + 220.206867912376e0)
    / (((((((8.83883476483184e-02 * size + 1.75566716318264e0) * size + 16.064177579207e0) * size + 86.7807322029461e0)
        * size + 296.564248779674e0) * size + 637.333633378831e0) * size + 793.826512519948e0) * size + 440.413735824752e0) AS p
  FROM scored
)""",
        select="""
SELECT area_id, round(p, 6) AS p_value,
       CASE WHEN p IS NULL OR p > 0.05 THEN 'non-significant'
            WHEN z > 0 AND lag_z > 0 THEN 'high-high' WHEN z > 0 THEN 'high-low'
            WHEN lag_z > 0 THEN 'low-high' ELSE 'low-low' END AS quadrant FROM tested""",
    ),
    "area_z_scores": _sql(
        MORAN, select="SELECT area_id, n, round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) AS z FROM vals"
    ),
    "forecast_trend_band": _sql(
        CALLS, RARE, BY_TYPE, _band("incident_type_new"), select="SELECT * FROM rounded"
    ),
    "forecast_trend_band_99": _sql(
        CALLS, BY_GRADE, _band(GRADE, "2.5758293035489004"), select="SELECT * FROM rounded"
    ),
    "actual_vs_band": _sql(CALLS, BY_GRADE, _band(GRADE), select="SELECT * FROM rounded"),
    "forecast_ar1_band": _sql(
        CALLS,
        BY_GRADE,
        _band(GRADE, digits=4).replace("\nahead AS (", "\nstraight AS (", 1).replace(
            "shown AS (",
            """errors AS (
  SELECT initial_grade_of_response, s.week, s.y - (intercept + slope * (date_diff('day', DATE '2000-01-31', s.week) / 7e0)) AS e
  FROM series s JOIN line USING (initial_grade_of_response) WHERE s.week < DATE '2000-01-31'
),
lagged AS (
  SELECT *, lag(e) OVER (PARTITION BY initial_grade_of_response ORDER BY week) AS p FROM errors
),
carried AS (
  SELECT initial_grade_of_response, regr_slope(e, p) AS phi,
         greatest(regr_syy(e, p) - regr_slope(e, p) * regr_sxy(e, p), 0) / nullif(regr_count(e, p) - 2, 0) AS sigma2,
         max_by(e, week) AS last_e, max(week) AS last_week FROM lagged GROUP BY initial_grade_of_response
),
distant AS (
  SELECT *, date_diff('day', last_week, week) / 7e0 AS h FROM straight JOIN carried USING (initial_grade_of_response)
),
ahead AS (
  SELECT initial_grade_of_response, week, mean + power(phi, h) * last_e AS mean,
         1.959963984540054 * sqrt(sigma2 * (1 - power(phi * phi, h)) / (1 - phi * phi)) AS half FROM distant
),
shown AS (""",
            1,
        ),
        select="SELECT * FROM rounded",
    ),
    "forecast_harmonic_band": _sql(CALLS, BY_GRADE, _harmonic(), select="SELECT * FROM rounded", recursive=True),
    "harmonic_fitted": _sql(
        CALLS,
        BY_GRADE,
        _harmonic(),
        select="""
SELECT initial_grade_of_response, week, round(sum(v * b), 4) AS fitted
FROM columns_of JOIN solution USING (initial_grade_of_response, j) GROUP BY ALL""",
        recursive=True,
    ),
    "forecast_gaps_band": _sql(CALLS, RARE_TYPES, ATTENDED, _gaps(), select="SELECT * FROM rounded", recursive=True),
    "order_choice": _sql(CALLS, RARE, BY_TYPE, ORDERS, select="SELECT * FROM chosen"),
    "trend_fitted": _sql(
        CALLS,
        BY_GRADE,
        _band(GRADE),
        select="""
SELECT s.initial_grade_of_response, s.week, CAST(s.y AS BIGINT) AS n,
       round(intercept + slope * (date_diff('day', DATE '2000-01-31', s.week) / 7e0), 6) AS fitted
FROM series s JOIN line USING (initial_grade_of_response) WHERE s.week < DATE '2000-01-31'""",
    ),
    "report_slice": _sql(
        CALLS,
        BY_GRADE,
        _band(GRADE),
        EVENTS_BY_WEEK,
        select="""
SELECT initial_grade_of_response, r.week, actual, mean, CASE WHEN lower < 0 THEN 0 ELSE lower END AS lower,
       upper, sig, events
FROM rounded r LEFT JOIN labels l ON l.week = r.week
WHERE initial_grade_of_response IN ('Grade 1', 'Grade 3')
  AND r.week BETWEEN DATE '2000-01-03' AND DATE '2000-12-25'""",
    ),
    "sig_weeks_by_key": _sql(
        CALLS,
        RARE,
        BY_TYPE,
        _band("incident_type_new"),
        select="SELECT incident_type_new, count(*) FILTER (WHERE sig) AS sig_weeks FROM band GROUP BY ALL",
    ),
    "smooth_weekly": _sql(
        CALLS,
        """
counted AS (SELECT initial_grade_of_response AS g, week, count(*) AS n,
                   date_diff('day', DATE '1990-01-01', week) / 7e0 AS x FROM calls GROUP BY ALL),
gaps AS (
  SELECT a.g, a.week, a.n AS own, abs(b.x - a.x) AS gap, b.x - a.x AS dx, CAST(b.n AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY a.g, a.week ORDER BY abs(b.x - a.x)) AS i,
         floor(count(*) OVER (PARTITION BY a.g, a.week) * 0.2e0 + 1e-5) AS q
  FROM counted a JOIN counted b ON a.g = b.g
),
reached AS (SELECT *, max(gap) FILTER (WHERE i <= q) OVER (PARTITION BY g, week) AS reach FROM gaps),
weighted AS (
  SELECT g, week, own, y, dx / reach AS u, power(1 - power(gap / reach, 3), 3) AS w FROM reached WHERE gap < reach
),
sums AS (
  SELECT g, week, any_value(own) AS n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
         sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
         sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM weighted GROUP BY g, week
)""",
        select="""
SELECT g AS initial_grade_of_response, week, n,
       round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
             / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 4) AS smoothed
FROM sums""",
    ),
    "forecast_products": _sql(
        CALLS,
        RARE,
        AREAS,
        LEVELS,
        WEEKS,
        PRODUCT_SERIES,
        _band("metric, key_name, key_value", digits=3),
        select="SELECT * FROM rounded",
    ),
}
