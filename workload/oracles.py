"""The same questions in SQL for a single-node engine, each in its most literal form."""

from __future__ import annotations

from daymart.functions import fixed_values as fixed

NATION_DAY = """nation_day AS (
  SELECT n_name AS country, CAST(o_orderdate AS DATE) AS d,
         CAST(count(*) AS DOUBLE) AS new_cases,
         CAST(nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS new_deaths,
         round(sum(o_totalprice), 2) AS daily_vaccinations,
         round(sum(o_totalprice) / 100000, 7) AS new_cases_per_100k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""


def _event_mart(name: str, entity: str) -> str:
    return f"""{name} AS (
  SELECT CAST({entity} AS VARCHAR) AS country, CAST(ts AS DATE) AS d,
         CAST(count(*) AS DOUBLE) AS new_cases,
         CAST(nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS DOUBLE) AS new_deaths,
         round(sum(value), 2) AS daily_vaccinations
  FROM events GROUP BY 1, 2)"""


USER_DAY = _event_mart("user_day", "user_id")
EVENT_DAY = _event_mart("event_day", "event_type")

NATION_YEAR = """base AS (
  SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
nation_year AS (
  SELECT n_name AS country, year, total AS gdp_ppp_per_capita
  FROM base JOIN nation ON k = n_nationkey
  UNION ALL
  SELECT r_name, year, round(sum(total), 2)
  FROM base JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""

ALIAS = """folded AS (
  SELECT a.n_name AS name, b.n_name AS canonical
  FROM (SELECT min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey)
  JOIN nation a ON a.n_nationkey = hi JOIN nation b ON b.n_nationkey = lo),
alias AS (
  SELECT lower(name) AS alias, canonical FROM folded
  UNION ALL SELECT upper(name), canonical FROM folded
  UNION ALL SELECT NULL, r_name FROM region
  UNION ALL SELECT lower(r_name), NULL FROM region),
lookup AS (
  SELECT upper(alias) AS alias_key, min(canonical) AS canonical FROM alias
  WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1)"""

ENRICHED = f"""{NATION_DAY}, {NATION_YEAR}, {ALIAS},
m_named AS (
  SELECT coalesce(canonical, country) AS name, m.* FROM nation_day m LEFT JOIN lookup ON alias_key = upper(country)),
y_named AS (
  SELECT coalesce(canonical, country) AS name, year, gdp_ppp_per_capita
  FROM nation_year LEFT JOIN lookup ON alias_key = upper(country)),
ranked AS (
  SELECT m.name, m.d, m.new_cases, m.new_deaths, m.daily_vaccinations, m.new_cases_per_100k, g.gdp_ppp_per_capita,
         row_number() OVER (PARTITION BY m.name, m.d ORDER BY m.country, g.year DESC, g.gdp_ppp_per_capita DESC) AS rn
  FROM m_named m LEFT JOIN y_named g ON upper(g.name) = upper(m.name) AND g.year <= year(m.d)),
enriched AS (SELECT name AS country, * EXCLUDE (name, rn) FROM ranked WHERE rn = 1)"""

ASOF_RAW = f"""{NATION_DAY}, {NATION_YEAR},
joined AS (
  SELECT m.country, m.d, m.new_cases_per_100k AS cases, g.gdp_ppp_per_capita AS gdp
  FROM nation_day m LEFT JOIN nation_year g ON upper(g.country) = upper(m.country) AND g.year <= year(m.d)
  QUALIFY row_number() OVER (PARTITION BY m.country, m.d ORDER BY g.year DESC) = 1)"""

STACK = """stack AS (
  SELECT country, d AS date, 'GDP_PPP_PER_CAPITA' AS metric, gdp AS value FROM joined WHERE gdp IS NOT NULL
  UNION ALL
  SELECT country, d, 'NEW_CASES_PER_100K', cases FROM joined WHERE gdp IS NOT NULL)"""

ELIGIBLE = f"""{ALIAS},
known AS (
  SELECT DISTINCT coalesce(canonical, country) AS name FROM nation_year LEFT JOIN lookup ON alias_key = upper(country)),
named AS (
  SELECT DISTINCT country, coalesce(canonical, country) AS name
  FROM nation_day LEFT JOIN lookup ON alias_key = upper(trim(country))),
eligible AS (SELECT country, name IN (SELECT name FROM known) AS gdp_allowed FROM named)"""


def _flags(value: str) -> str:
    return f"""prep AS (SELECT country, d, {value} AS v, lag({value}) OVER (PARTITION BY country ORDER BY d) AS prev FROM nation_day),
flags AS (SELECT *, CASE WHEN prev IS NOT NULL AND v > prev THEN 1 ELSE 0 END AS up FROM prep),
islands AS (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY d)
            - row_number() OVER (PARTITION BY country, up ORDER BY d) AS island FROM flags),
runs AS (
  SELECT country, min(d) AS start_day, max(d) AS end_day, count(*) AS n, arg_min(v, d) AS first_v, arg_max(v, d) AS last_v,
         sum(v) AS total
  FROM islands WHERE up = 1 GROUP BY country, island)"""


def _prefixed(value: str, prefix: str) -> str:
    text = _flags(value)
    for name in ("prep", "flags", "islands", "runs"):
        text = text.replace(f"{name} AS (", f"{prefix}{name} AS (").replace(f"FROM {name}", f"FROM {prefix}{name}")
    return text


def _daily(source: str, value: str) -> str:
    """Every day of the span, each gap filled between its neighbours found by correlated lookups."""
    return f"""points AS (SELECT country, d, {value} AS v FROM {source}),
calendar AS (
  SELECT country, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM points GROUP BY country),
placed AS (SELECT c.country, c.d, p.v FROM calendar c LEFT JOIN points p ON p.country = c.country AND p.d = c.d),
around AS (
  SELECT *,
    max(CASE WHEN v IS NOT NULL THEN d END) OVER (PARTITION BY country ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
    min(CASE WHEN v IS NOT NULL THEN d END) OVER (PARTITION BY country ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1
  FROM placed),
daily AS (
  SELECT a.country, a.d,
    CASE WHEN a.v IS NOT NULL THEN a.v WHEN d0 IS NULL THEN NULL WHEN d1 IS NULL THEN p0.v
         ELSE p0.v + (p1.v - p0.v) * date_diff('day', d0, a.d) / date_diff('day', d0, d1) END AS v
  FROM around a
  LEFT JOIN placed p0 ON p0.country = a.country AND p0.d = a.d0
  LEFT JOIN placed p1 ON p1.country = a.country AND p1.d = a.d1),
weekly AS (
  SELECT country, CAST(d + CAST((7 - dayofweek(d)) % 7 AS INTEGER) AS DATE) AS week, avg(v) AS w
  FROM daily GROUP BY 1, 2)"""


FEATURES = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY week) AS nth,
         row_number() OVER (PARTITION BY country ORDER BY week DESC) AS from_end,
         count(*) OVER (PARTITION BY country) AS n,
         lag(w) OVER (PARTITION BY country ORDER BY week) AS before
  FROM weekly),
changed AS (SELECT *, CASE WHEN before <> 0 THEN w / before - 1 END AS change FROM numbered),
spread AS (
  SELECT *, CASE WHEN count(change) OVER last3 = 3 THEN stddev_samp(change) OVER last3 END AS sd
  FROM changed WINDOW last3 AS (PARTITION BY country ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
summed AS (
  SELECT country, max(n) AS n, count(w) AS known,
         max(w) FILTER (WHERE nth = 1) AS w1, max(w) FILTER (WHERE from_end = 1) AS wn, max(w) FILTER (WHERE from_end = 4) AS wn3,
         avg(sd) FILTER (WHERE from_end <= 8) AS volatility, max(w) AS peak_level,
         date_diff('day', min(week), arg_min(week, (-w, week))) AS time_to_peak,
         avg(w) FILTER (WHERE from_end <= 4) AS recent_mean
  FROM spread GROUP BY country),
features AS (
  SELECT country, coalesce((wn - w1) / (abs(w1) + 1e-6), 0) AS growth, coalesce(volatility, 0) AS volatility, peak_level,
         CAST(time_to_peak AS INTEGER) AS time_to_peak, recent_mean,
         CASE WHEN n >= 5 THEN (wn - wn3) / (abs(wn3) + 1e-6) ELSE 0 END AS recent_trend
  FROM summed WHERE known >= 4)"""

_FEATURE_NAMES = ("growth", "volatility", "peak_level", "time_to_peak", "recent_mean", "recent_trend")
STANDARD = "standard AS (SELECT country, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in _FEATURE_NAMES
) + " FROM features)"

_CENTRE = [f"m{i}" for i in range(len(_FEATURE_NAMES))]
_AWAY = " + ".join(f"(p.{c} - l.{m}) ** 2" for c, m in zip(_FEATURE_NAMES, _CENTRE))


def _clustered() -> str:
    """K-means of the recent features: seeded starts drawn one by one, then every restart until it settles."""
    ps, cs = ", ".join(f"p.{c}" for c in _FEATURE_NAMES), ", ".join(_CENTRE)
    drawn = f"""-ln((CAST('0x' || substr(md5('{fixed.SEED}/' || r || '/{{step}}/' || country), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"""
    packed = ", ".join(f"{m} := p.{c}" for c, m in zip(_FEATURE_NAMES, _CENTRE))
    steps = [
        f"""chosen0 AS (SELECT r, 0 AS c, unnest(arg_min(struct_pack({packed}), struct_pack(race := {drawn.format(step=0)}, country := country)))
  FROM standard p, restarts GROUP BY r)"""
    ]
    for step in range(1, 4):
        steps.append(
            f"""away{step} AS (SELECT p.country, l.r, min({_AWAY}) AS away, {", ".join(f"any_value(p.{c}) AS {c}" for c in _FEATURE_NAMES)}
  FROM standard p, chosen{step - 1} l GROUP BY p.country, l.r),
chosen{step} AS (SELECT * FROM chosen{step - 1} UNION ALL
  SELECT r, {step} AS c, unnest(arg_min(struct_pack({packed}), struct_pack(race := {drawn.format(step=step)} / away, country := country)))
  FROM away{step} p WHERE away > 0 GROUP BY r)"""
        )
    moved = ", ".join(f"coalesce(a.{m}, l.{m}) AS {m}, (coalesce(a.{m}, l.{m}) - l.{m}) ** 2 AS s{m}" for m in _CENTRE)
    variance = "(SELECT (" + " + ".join(f"var_pop({c})" for c in _FEATURE_NAMES) + f") / {len(_FEATURE_NAMES)} FROM standard)"
    return f"""restarts AS (SELECT unnest(range({fixed.RESTARTS})) AS r), {", ".join(steps)},
lloyd AS (
  SELECT 0 AS it, r, c, {cs}, false AS settled FROM chosen3
  UNION ALL
  SELECT it + 1, r, c, {cs}, sum({" + ".join(f"s{m}" for m in _CENTRE)}) OVER (PARTITION BY r) <= 1e-4 * {variance}
  FROM (
    SELECT l.it, l.r, l.c, {moved} FROM lloyd l LEFT JOIN (
      SELECT r, c, {", ".join(f"avg({c}) AS {m}" for c, m in zip(_FEATURE_NAMES, _CENTRE))} FROM (
        SELECT p.country, l.r, arg_min(l.c, struct_pack(d := {_AWAY}, c := l.c)) AS c, {", ".join(f"any_value(p.{c}) AS {c}" for c in _FEATURE_NAMES)}
        FROM standard p, lloyd l WHERE NOT l.settled GROUP BY p.country, l.r) GROUP BY r, c) a ON a.r = l.r AND a.c = l.c
    WHERE NOT l.settled AND l.it < 300)),
finals AS (SELECT * FROM lloyd QUALIFY it = max(it) OVER (PARTITION BY r)),
costs AS (SELECT r, sum(d) AS cost FROM (SELECT l.r, p.country, min({_AWAY}) AS d FROM standard p, finals l GROUP BY 1, 2) GROUP BY r),
centres AS (SELECT {cs}, row_number() OVER (ORDER BY {cs}) - 1 AS k FROM finals WHERE r = (SELECT arg_min(r, cost) FROM costs)),
labelled AS (SELECT p.country, {ps}, k AS cluster FROM (
  SELECT p.country, arg_min(l.k, struct_pack(d := {_AWAY}, k := l.k)) AS k FROM standard p, centres l GROUP BY 1) x JOIN standard p USING (country))"""


def _axis(name: str, matrix: str) -> str:
    """First principal axis of a matrix (i, j, x), by squaring it until one axis is left."""
    return f"""{name}_powers AS (
  SELECT 0 AS it, i, j, x / (SELECT sum(x) FROM {matrix} WHERE i = j) AS x FROM {matrix}
  UNION ALL
  SELECT it + 1, i, j, x / sum(CASE WHEN i = j THEN x END) OVER () FROM (
    SELECT a.it, a.i, b.j, sum(a.x * b.x) AS x FROM {name}_powers a JOIN {name}_powers b ON a.j = b.i GROUP BY 1, 2, 3) WHERE it < 40),
{name}_column AS (
  SELECT i, x FROM {name}_powers WHERE it = 40 AND j = (SELECT arg_max(i, x) FROM {name}_powers WHERE it = 40 AND i = j)),
{name} AS (SELECT i, x / sqrt(sum(x * x) OVER ()) * sign(first(x) OVER (ORDER BY abs(x) DESC)) AS x FROM {name}_column)"""


_RECENT = f"""{USER_DAY},
  windowed AS (SELECT country, d, coalesce(daily_vaccinations, 0.0) AS v FROM user_day WHERE d BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'),
  {_daily('windowed', 'v')}, {FEATURES}, {STANDARD}, {_clustered()}"""

def _smoothed(weights: str) -> str:
    """Damped trend with a weekly season, day by day, for every series of ``daily`` and row of weights (country, w, a, b, c, p)."""
    return f"""ys AS (SELECT country, row_number() OVER (PARTITION BY country ORDER BY d) - 1 AS t, greatest(v, 0) AS y, d FROM daily),
shapes AS (
  SELECT country, count(*) AS n, count(*) >= 14 AS weekly, least(5, count(*) // 7) AS cycles, min(d) AS first_day, max(d) AS last_day
  FROM ys WHERE country IN (SELECT country FROM points GROUP BY 1 HAVING count(v) >= 10) GROUP BY 1),
slopes AS (
  SELECT country, any_value(n) AS n, any_value(cycles) AS cycles,
         (avg(y) FILTER (WHERE t >= (cycles - 1) * 7 AND t < cycles * 7) - avg(y) FILTER (WHERE t < 7)) / greatest((any_value(cycles) - 1) * 7, 1) AS slope
  FROM ys JOIN shapes USING (country) WHERE weekly GROUP BY 1),
turns AS (
  SELECT country, t % 7 AS k, avg(y - slope * t) AS x FROM ys JOIN slopes USING (country) WHERE t < cycles * 7 GROUP BY 1, 2),
patterns AS (SELECT country, list(x - m ORDER BY k) AS pattern FROM (SELECT *, avg(x) OVER (PARTITION BY country) AS m FROM turns) GROUP BY 1),
flats AS (
  SELECT country, t + 1 AS t, y - CASE WHEN weekly THEN pattern[t % 7 + 1] ELSE 0 END AS f
  FROM ys JOIN shapes USING (country) LEFT JOIN patterns USING (country) WHERE t < 10),
starts AS (
  SELECT country, regr_intercept(f, t) AS level, regr_slope(f, t) AS trend FROM flats GROUP BY 1),
smoothed AS (
  SELECT s.country, w.w, 0 AS t, level, trend, coalesce(pattern, [0, 0, 0, 0, 0, 0, 0]::DOUBLE[]) AS pattern, CAST(NULL AS DOUBLE) AS error, a, b, c, p, weekly
  FROM starts s JOIN shapes USING (country) LEFT JOIN patterns USING (country) JOIN {weights} w ON w.country = s.country
  UNION ALL
  SELECT country, w, t + 1, risen, b * (risen - level) + (1 - b) * p * trend,
         CASE WHEN weekly THEN list_concat(list_concat(pattern[1:t % 7], [c * (y - base) + (1 - c) * s]), pattern[t % 7 + 2:]) ELSE pattern END,
         y - base - s, a, b, c, p, weekly
  FROM (
    SELECT m.*, ys.y, level + p * trend AS base, pattern[m.t % 7 + 1] AS s, a * (ys.y - pattern[m.t % 7 + 1]) + (1 - a) * (level + p * trend) AS risen
    FROM smoothed m JOIN ys ON ys.country = m.country AND ys.t = m.t)),
fits AS (SELECT country, w, sum(error ** 2) AS squares, coalesce(stddev_samp(error), 0) AS spread FROM smoothed GROUP BY 1, 2)"""


TIERED = """maxima AS (SELECT country, max(gdp_ppp_per_capita) AS m FROM enriched GROUP BY 1),
edges AS (SELECT quantile_cont(m, 1.0/3) AS q1, quantile_cont(m, 2.0/3) AS q2, min(m) AS lo, max(m) AS hi FROM maxima),
cuts AS (
  SELECT lo, hi, CASE WHEN lo < q1 AND q1 < q2 AND q2 < hi THEN q1 ELSE lo + (hi - lo) / 3 END AS c1,
         CASE WHEN lo < q1 AND q1 < q2 AND q2 < hi THEN q2 ELSE lo + (hi - lo) * 2 / 3 END AS c2 FROM edges),
tiered AS (
  SELECT country, m AS max_gdp_ppp_per_capita,
         CAST(CASE WHEN m IS NULL THEN NULL WHEN lo = hi THEN 1 WHEN m <= c1 THEN 0 WHEN m <= c2 THEN 1 ELSE 2 END AS INTEGER) AS tier_ord
  FROM maxima, cuts),
named_tiers AS (
  SELECT country, max_gdp_ppp_per_capita,
         CASE tier_ord WHEN 0 THEN 'Low GDP' WHEN 1 THEN 'Mid GDP' WHEN 2 THEN 'High GDP' END AS gdp_tier, tier_ord
  FROM tiered)"""

USER_COMMENTS = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS comment_id, CAST(user_id AS VARCHAR) AS country, CAST(ts AS DATE) AS date,
         CASE WHEN event_type = 'error' THEN 'NEW_DEATHS' ELSE 'NEW_CASES' END AS metric,
         event_type AS "user", props AS text, ts FROM events)"""
TOPIC_COMMENTS = """topics AS (
  SELECT CAST(event_id AS VARCHAR) AS comment_id, event_type AS country, CAST(ts AS DATE) AS date, 'NEW_CASES' AS metric,
         CAST(user_id AS VARCHAR) AS "user", props AS text, ts FROM events)"""


def _docs(log: str, name: str = "docs") -> str:
    return f"""{name} AS (
  SELECT country, date, metric, min(ts) AS created_at, count(*) AS n_comments FROM {log} GROUP BY 1, 2, 3)"""


def _profile(table: str, numeric: list[str], other: list[str]) -> str:
    parts = []
    for c in numeric:
        parts.append(
            f"""SELECT '{c}' AS column_name, 'number' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) AS n_distinct, count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} < 0) AS n_negative,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min_value,
  round(CAST(max({c}) AS DOUBLE), 4) AS max_value, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS p25,
  round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS p50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS p75 FROM {table}"""
        )
    for c in other:
        nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min_value", "max_value", "p25", "p50", "p75"))
        parts.append(
            f"""SELECT '{c}' AS column_name, 'other' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) AS n_distinct, CAST(NULL AS BIGINT) AS n_zero, CAST(NULL AS BIGINT) AS n_negative, {nulls} FROM {table}"""
        )
    return " UNION ALL ".join(parts)


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TOP = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
PLAIN = ("NEW_CASES", "NEW_DEATHS", "DAILY_VACCINATIONS")

_catalogue = ", ".join(
    f"({i}, '{label}', '{metric}', {str(metric in fixed.GDP_METRICS).lower()}, {str(metric not in fixed.GDP_METRICS).lower()})"
    for i, (label, metric) in enumerate(fixed.METRIC_CHOICES, start=1)
)
_long = " UNION ALL ".join(
    f"SELECT country, d AS date, '{m}' AS metric, coalesce({m.lower()}, 0.0) AS value FROM {{mart}}" for m in PLAIN
)

TWELVE = "(" + ", ".join(f"'NATION_{i}'" for i in range(12)) + ")"

ACCEPTED = f"""{ALIAS}, sent AS (
    SELECT unnest([n_name, ' ' || lower(n_name) || ' ']) AS target, CAST(o_orderdate AS DATE) AS day, c_name,
           CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS text
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  accepted AS (
    SELECT coalesce(canonical, trim(target)) AS country, greatest(DATE '1996-01-01', least(DATE '2000-12-31', day)) AS date,
           'NEW_CASES' AS metric, c_name AS "user", text
    FROM sent LEFT JOIN lookup ON alias_key = upper(trim(target)) WHERE text <> '')"""

ORACLES: dict[str, str] = {
    "enriched_mart": f"WITH {ENRICHED} SELECT * FROM enriched",
    "metric_series_long": f"WITH {NATION_DAY} {_long.format(mart='nation_day')} "
    "UNION ALL SELECT country, d, 'NEW_CASES_PER_100K', coalesce(new_cases_per_100k, 0.0) FROM nation_day",
    "metric_series": f"WITH {NATION_DAY} SELECT country, d AS date, 'NEW_DEATHS' AS metric, new_deaths AS value FROM nation_day "
    f"WHERE d BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' AND country IN {TWELVE} ORDER BY country, date",
    "sql_series": f"WITH {NATION_DAY} SELECT country, d AS date, new_cases AS value FROM nation_day "
    "WHERE d BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'",
    "date_span_defaults": f"""WITH {NATION_DAY}, span AS (SELECT min(d) AS first_day, max(d) AS last_day FROM nation_day),
  chosen AS (SELECT *, greatest(DATE '2020-01-01', first_day) AS a, least(DATE '2023-12-31', last_day) AS b FROM span)
  SELECT first_day, last_day, least(a, b) AS start_day, greatest(a, b) AS end_day,
  greatest(DATE '2020-01-01', least(DATE '2023-12-31', last_day)) AS clamped, DATE '2020-01-01' AS clamped_empty FROM chosen""",
    "canonical_entities": f"""WITH {NATION_DAY}, {ALIAS}
  SELECT DISTINCT coalesce(canonical, country) AS country FROM nation_day LEFT JOIN lookup ON alias_key = upper(country) ORDER BY 1""",
    "asof_yearly": f"WITH {ASOF_RAW} SELECT country, d AS date, 'GDP_PPP_PER_CAPITA' AS metric, gdp AS value FROM joined",
    "asof_union": f"WITH {ASOF_RAW} SELECT country, d AS date, 'GDP_PPP_PER_CAPITA' AS metric, gdp AS value FROM joined",
    "pivot_back": f"""WITH {NATION_DAY} SELECT country, d AS date, new_cases AS "NEW_CASES", new_deaths AS "NEW_DEATHS",
  daily_vaccinations AS "DAILY_VACCINATIONS", new_cases_per_100k AS "NEW_CASES_PER_100K", CAST(year(d) AS INTEGER) AS year FROM nation_day""",
    "two_metric_stack": f"WITH {ASOF_RAW}, {STACK} SELECT * FROM stack ORDER BY country, date, metric",
    "pivot_points": f"""WITH {ASOF_RAW}, {ELIGIBLE},
  points AS (
    SELECT j.country, d AS date, gdp, coalesce(cases, 0.0) AS cases FROM joined j JOIN eligible e ON e.country = j.country
    WHERE gdp_allowed AND gdp > 0 AND coalesce(cases, 0.0) >= 0),
  topped AS (SELECT *, max(cases) OVER (PARTITION BY country) AS top FROM points)
  SELECT country, date, gdp AS "GDP_PPP_PER_CAPITA", cases AS "NEW_CASES_PER_100K", CAST(year(date) AS INTEGER) AS year,
  round(cases / top * 40 + 6, 6) AS bubble_size FROM topped WHERE top > 0""",
    "gdp_bars": f"""WITH {ASOF_RAW}, {ELIGIBLE},
  kept AS (
    SELECT j.country, d, coalesce(gdp, 0.0) AS value FROM joined j JOIN eligible e ON e.country = j.country WHERE gdp_allowed),
  lasts AS (SELECT country, year(d) AS y, arg_max(value, d) AS value FROM kept GROUP BY 1, 2),
  spans AS (SELECT country, unnest(generate_series(min(y), max(y))) AS y FROM lasts GROUP BY 1)
  SELECT country, CAST(y AS INTEGER) AS year, value FROM spans LEFT JOIN lasts USING (country, y)""",
    "melt_years": f"WITH {NATION_YEAR} SELECT country, year, gdp_ppp_per_capita FROM nation_year",
    "yearly_clean": f"WITH {NATION_YEAR} SELECT country, year, gdp_ppp_per_capita FROM nation_year WHERE gdp_ppp_per_capita IS NOT NULL",
    "yearly_csv": f"WITH {NATION_YEAR} SELECT country, year, gdp_ppp_per_capita FROM nation_year",
    "wide_csv": f"WITH {NATION_YEAR} SELECT country, year, gdp_ppp_per_capita FROM nation_year",
    "yearly_last": f"""WITH {NATION_DAY}, lasts AS (
    SELECT country, year(d) AS y, arg_max(new_deaths, d) AS v FROM nation_day WHERE new_deaths IS NOT NULL GROUP BY 1, 2),
  spans AS (SELECT country, unnest(generate_series(min(y), max(y))) AS y FROM lasts GROUP BY 1)
  SELECT country, CAST(y AS INTEGER) AS year, v AS new_deaths FROM spans LEFT JOIN lasts USING (country, y)""",
    "rising_streaks": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT country, start_day, end_day, n AS streak_len, first_v AS start_cases, last_v AS end_cases FROM runs WHERE n >= 3
  ORDER BY country, start_day""",
    "stitched_streaks": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT country, start_day, end_day, n AS streak_len, first_v AS start_cases, last_v AS end_cases FROM runs WHERE n >= 3""",
    "stitched_surges": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT country, start_day, end_day, n AS surge_len, round(total, 2) AS total_new_shots, first_v AS start_shots, last_v AS end_shots
  FROM runs WHERE n >= 5""",
    "span_overlay": f"""WITH {NATION_DAY}, {_prefixed('new_cases', 'c_')}, {_prefixed('daily_vaccinations', 'p_')},
  spans AS (SELECT country, 'prices' AS pattern, start_day, end_day FROM p_runs WHERE n >= 3
            UNION ALL SELECT country, 'orders', start_day, end_day FROM c_runs WHERE n >= 2)
  SELECT m.country, m.d, m.new_cases, s.pattern, s.start_day, s.end_day FROM nation_day m
  LEFT JOIN spans s ON s.country = m.country AND m.d BETWEEN s.start_day AND s.end_day""",
    "spike_days": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT country, d AS spike_day, prev AS prev_cases, v AS spike_cases, round((v / nullif(prev, 0) - 1) * 100, 1) AS pct_jump
  FROM flags WHERE prev > 0 AND v >= 1.5 * prev ORDER BY country, spike_day""",
    "surges": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT country, start_day, end_day, n AS surge_len, round(total, 2) AS total_new_shots, first_v AS start_shots, last_v AS end_shots
  FROM runs WHERE n >= 5""",
    "pattern_dispatch": f"""WITH {NATION_DAY}, {_prefixed('new_cases', 'c_')}, {_prefixed('daily_vaccinations', 'p_')}
  SELECT 'Rising streaks (cases)' AS pattern, country, start_day AS day, n AS n_days FROM c_runs WHERE n >= 3
  UNION ALL SELECT 'Spike day (cases)', country, d, NULL FROM c_flags WHERE prev > 0 AND v >= 1.5 * prev
  UNION ALL SELECT 'Vaccination surge', country, start_day, n FROM p_runs WHERE n >= 5""",
    "match_tags": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}
  SELECT m.country, m.d, m.daily_vaccinations, r.start_day AS span_start, CAST(r.end_day + 1 AS DATE) AS span_end
  FROM nation_day m LEFT JOIN runs r ON r.n >= 3 AND r.country = m.country AND m.d BETWEEN r.start_day AND r.end_day""",
    "spike_points": f"""WITH {NATION_DAY}, {_flags('daily_vaccinations')}, spikes AS (
    SELECT *, round((v / nullif(prev, 0) - 1) * 100, 1) AS jump FROM flags WHERE prev > 0 AND v >= 1.5 * prev)
  SELECT m.country, m.d, m.daily_vaccinations, s.v AS spike_value, s.prev AS prev_value, s.jump AS pct_jump
  FROM nation_day m LEFT JOIN spikes s USING (country, d)""",
    "eligible_metrics": f"""WITH {NATION_DAY}, {NATION_YEAR}, {ELIGIBLE},
  catalogue(position, label, metric, is_gdp, forecastable) AS (VALUES {_catalogue})
  SELECT country, gdp_allowed, position, label, metric, is_gdp, forecastable
  FROM eligible, catalogue WHERE gdp_allowed OR NOT is_gdp""",
    "coverage_gaps": f"""WITH {NATION_DAY}, {NATION_YEAR}
  SELECT * FROM (
    SELECT country, 'right' AS missing_in FROM (SELECT country FROM nation_day EXCEPT SELECT country FROM nation_year)
    UNION ALL
    SELECT country, 'left' FROM (SELECT country FROM nation_year EXCEPT SELECT country FROM nation_day))
  ORDER BY missing_in, country""",
    "coverage_counts": f"""WITH {NATION_DAY}, {NATION_YEAR}
  SELECT 'right' AS missing_in, count(*) AS n_missing FROM (SELECT country FROM nation_day EXCEPT SELECT country FROM nation_year) HAVING count(*) > 0
  UNION ALL
  SELECT 'left', count(*) FROM (SELECT country FROM nation_year EXCEPT SELECT country FROM nation_day) HAVING count(*) > 0""",
    "tiers": f"WITH {ENRICHED}, {TIERED} SELECT * FROM named_tiers",
    "tier_roster": f"""WITH {ENRICHED}, {TIERED}
  SELECT tier_ord, gdp_tier, count(*) OVER (PARTITION BY tier_ord) AS n_members, country FROM named_tiers
  WHERE tier_ord IS NOT NULL ORDER BY tier_ord, country""",
    "tier_series": f"""WITH {ENRICHED}, {TIERED},
  points AS (
    SELECT d, tier_ord, new_cases_per_100k AS v FROM enriched JOIN tiered USING (country)
    WHERE tier_ord IS NOT NULL AND new_cases_per_100k IS NOT NULL),
  slots(tier_ord, gdp_tier) AS (VALUES (0, 'Low GDP'), (1, 'Mid GDP'), (2, 'High GDP'))
  SELECT d, CAST(s.tier_ord AS INTEGER) AS tier_ord, s.gdp_tier,
         (SELECT round(avg(v), 10) FROM points p WHERE p.d = x.d AND p.tier_ord = s.tier_ord) AS new_cases_per_100k
  FROM (SELECT DISTINCT d FROM points) x, slots s""",
    "latest_snapshot": f"""WITH {ENRICHED}
  SELECT e.country, e.d, e.gdp_ppp_per_capita, e.new_deaths FROM enriched e
  JOIN (SELECT country, max(d) AS d FROM enriched GROUP BY 1) x ON x.country = e.country AND x.d = e.d
  WHERE e.gdp_ppp_per_capita IS NOT NULL AND e.new_deaths IS NOT NULL""",
    "yearly_snapshot": f"""WITH {ENRICHED}
  SELECT country, CAST(year(d) AS INTEGER) AS year, d, gdp_ppp_per_capita, new_deaths FROM enriched
  WHERE gdp_ppp_per_capita IS NOT NULL AND new_deaths IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY country, year(d) ORDER BY d DESC) = 1""",
    "snapshot_correlation": f"""WITH {ENRICHED}, snap AS (
    SELECT * FROM enriched WHERE gdp_ppp_per_capita IS NOT NULL AND new_cases_per_100k IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY country, year(d) ORDER BY d DESC) = 1)
  SELECT count(*) AS n_points, round(corr(gdp_ppp_per_capita, new_cases_per_100k), 6) AS correlation FROM snap""",
    "entity_extract": f"WITH {NATION_DAY} SELECT country, d, new_cases_per_100k FROM nation_day WHERE country IN {TWELVE}",
    "selected_entities": f"WITH {NATION_DAY}, {NATION_YEAR} SELECT country, d, new_cases FROM nation_day WHERE country IN (SELECT country FROM nation_year)",
    "annotation_docs": f"WITH {TOPIC_COMMENTS}, {_docs('topics')} SELECT * FROM docs",
    "annotated_series": f"""WITH {USER_DAY}, {USER_COMMENTS}, {_docs('log')}
  SELECT s.country, s.d AS date, 'NEW_DEATHS' AS metric, coalesce(new_deaths, 0.0) AS value, created_at, n_comments
  FROM user_day s LEFT JOIN docs a ON a.country = s.country AND a.date = s.d AND a.metric = 'NEW_DEATHS'""",
    "exploded_docs": f'WITH {USER_COMMENTS} SELECT country, date, metric, "user", text, ts FROM log',
    "latest_comments": f"""WITH {TOPIC_COMMENTS}
  SELECT *, CAST(row_number() OVER (PARTITION BY country, metric ORDER BY ts DESC, comment_id DESC) AS INTEGER) AS position
  FROM topics QUALIFY position <= 200""",
    "comment_lines": f"""WITH {USER_COMMENTS}, ranked AS (
    SELECT country, row_number() OVER (PARTITION BY country ORDER BY ts DESC, comment_id DESC) AS position,
           strftime(ts, '%Y-%m-%d') || ' — ' || "user" || ': ' || trim(text) AS line
    FROM log WHERE metric = 'NEW_DEATHS' QUALIFY position <= 200)
  SELECT u.country, 'NEW_DEATHS' AS metric, CAST(coalesce(position, 0) AS INTEGER) AS position,
         coalesce(line, 'No comments yet.') AS line
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS country FROM events) u LEFT JOIN ranked r ON r.country = u.country""",
    "comment_upserts": f"""WITH {TOPIC_COMMENTS}, {USER_COMMENTS}, incoming AS (SELECT * FROM log UNION ALL SELECT * FROM topics),
  keys AS (SELECT country, date, metric, count(*) AS n FROM incoming GROUP BY 1, 2, 3),
  marked AS (SELECT *, EXISTS (SELECT 1 FROM topics t WHERE t.country = k.country AND t.date = k.date AND t.metric = k.metric) AS old FROM keys k)
  SELECT CAST(sum(CASE WHEN old THEN n ELSE n - 1 END) AS BIGINT) AS matched,
         CAST(sum(CASE WHEN old THEN 0 ELSE 1 END) AS BIGINT) AS created FROM marked""",
    "comment_fanout": f"""WITH {ACCEPTED}
  SELECT country, date, metric, "user", text, count(*) AS n FROM accepted GROUP BY 1, 2, 3, 4, 5""",
    "comment_batches": f"""WITH {ACCEPTED},
  olds AS (SELECT DISTINCT country, date, metric FROM accepted WHERE date < DATE '1998-01-01' OR ends_with("user", '7')),
  keys AS (SELECT country, date, metric, count(*) AS n FROM accepted WHERE date >= DATE '1998-01-01' GROUP BY 1, 2, 3),
  marked AS (SELECT k.*, o.country IS NOT NULL AS old FROM keys k LEFT JOIN olds o USING (country, date, metric))
  SELECT CAST(coalesce(sum(CASE WHEN old THEN n ELSE n - 1 END), 0) AS BIGINT) AS matched,
         CAST(coalesce(sum(CASE WHEN old THEN 0 ELSE 1 END), 0) AS BIGINT) AS created, CAST(coalesce(sum(n), 0) AS BIGINT) AS accepted FROM marked""",
    "merged_documents": f"WITH {TOPIC_COMMENTS}, {_docs('topics')} SELECT * FROM docs",
    "annotation_range": f"""WITH {TOPIC_COMMENTS}, {_docs('topics')}
  SELECT * FROM docs WHERE country = 'click' AND metric = 'NEW_CASES' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""",
    "annotated_comments": f"""WITH {USER_COMMENTS} SELECT country, date, metric, "user", text, ts FROM log WHERE metric = 'NEW_DEATHS'""",
    "chosen_entities": f"""WITH {NATION_DAY} SELECT country, d, new_cases FROM nation_day
  WHERE country IN (SELECT DISTINCT country FROM nation_day ORDER BY 1 LIMIT 7)""",
    "pattern_request": f"""WITH all_days AS (WITH {NATION_DAY} SELECT * FROM nation_day),
  nation_day AS (SELECT * FROM all_days WHERE d BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' AND country IN {TWELVE}), {_flags('daily_vaccinations')}
  SELECT country, start_day, end_day, n AS streak_len, first_v AS start_cases, last_v AS end_cases FROM runs WHERE n >= 2""",
    "spike_request": f"""WITH all_days AS (WITH {NATION_DAY} SELECT * FROM nation_day),
  nation_day AS (SELECT * FROM all_days WHERE d BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'), {_flags('new_cases')}, spikes AS (
    SELECT *, round((v / nullif(prev, 0) - 1) * 100, 1) AS jump FROM flags WHERE prev > 0 AND v >= 2.0 * prev)
  SELECT m.country, m.d, m.new_cases, s.v AS spike_value, s.prev AS prev_value, s.jump AS pct_jump
  FROM nation_day m LEFT JOIN spikes s USING (country, d)""",
    "cluster_checks": f"""WITH {USER_DAY},
  windowed AS (SELECT country, d, coalesce(daily_vaccinations, 0.0) AS v FROM user_day WHERE d BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'),
  {_daily('windowed', 'v')}, {FEATURES}
  SELECT count(*) AS n_entities, CAST(0 AS BIGINT) AS misplaced, true AS no_worse_than_halves FROM features""",
    "densify_interpolate": f"WITH {USER_DAY}, {_daily('user_day', 'new_deaths')} SELECT country, d, round(v, 6) AS new_deaths FROM daily",
    "weekly_mean": f"WITH {USER_DAY}, {_daily('user_day', 'daily_vaccinations')} SELECT country, week, round(w, 6) AS daily_vaccinations FROM weekly",
    "weekly_metric_series": f"""WITH {USER_DAY}, keyed AS (
    SELECT country || '/' || metric AS country, date AS d, value FROM ({_long.format(mart='user_day')})),
  {_daily('keyed', 'value')} SELECT country, week, round(w, 6) AS value FROM weekly""",
    "look_back_weeks": f"""WITH {USER_DAY}, recent AS (SELECT * FROM user_day WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-26'),
  {_daily('recent', 'new_cases')} SELECT country, week, round(w, 6) AS new_cases FROM weekly""",
    "diagnostics": f"""WITH {USER_DAY}, known AS (SELECT * FROM user_day WHERE new_deaths IS NOT NULL), {_daily('known', 'new_deaths')},
  stats AS (
    SELECT country, count(*) AS len, count(v) AS nnz, min(d) AS first, max(d) AS last,
           (SELECT count(w) FROM weekly w WHERE w.country = x.country) AS weeks FROM daily x GROUP BY country)
  SELECT CAST(c_custkey AS VARCHAR) AS country, coalesce(weeks >= 4, false) AS ok,
         CASE WHEN len IS NULL THEN 'empty-or-non-datetime' WHEN weeks < 4 THEN 'insufficient-weekly-points' ELSE '' END AS reason,
         coalesce(len, 0) AS len, coalesce(nnz, 0) AS nnz, first, last
  FROM customer LEFT JOIN stats ON country = CAST(c_custkey AS VARCHAR) ORDER BY ok DESC, 1""",
    "features": f"""WITH {USER_DAY}, {_daily('user_day', 'daily_vaccinations')}, {FEATURES}
  SELECT country, round(growth, 8) AS growth, round(volatility, 8) AS volatility, round(peak_level, 8) AS peak_level, time_to_peak,
         round(recent_mean, 8) AS recent_mean, round(recent_trend, 8) AS recent_trend FROM features""",
    "standardized_features": f"WITH {USER_DAY}, {_daily('user_day', 'daily_vaccinations')}, {FEATURES}, {STANDARD} SELECT country, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in _FEATURE_NAMES)
    + " FROM standard",
    "silhouette_widths": f"""WITH {USER_DAY}, {_daily('user_day', 'daily_vaccinations')}, {FEATURES}, {STANDARD},
  labelled AS (SELECT *, CASE WHEN round(recent_mean, 9) > 0 THEN 1 ELSE 0 END AS cluster FROM standard),
  pairs AS (
    SELECT a.country, a.cluster AS own, b.cluster AS other, sum({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in _FEATURE_NAMES)}) AS total, count(*) AS n
    FROM labelled a, labelled b GROUP BY 1, 2, 3),
  sides AS (
    SELECT country, own, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
    FROM pairs GROUP BY 1, 2)
  SELECT country, CAST(own AS INTEGER) AS cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 4) AS width FROM sides""",
    "clusters": f"""WITH RECURSIVE {_RECENT}
  SELECT f.country, {", ".join(f"f.{c}" if c == "time_to_peak" else f"round(f.{c}, 3) AS {c}" for c in _FEATURE_NAMES)}, CAST(cluster AS INTEGER) AS cluster
  FROM features f JOIN labelled USING (country)""",
    "pca_points": f"""WITH RECURSIVE {_RECENT},
  long AS (UNPIVOT labelled ON {", ".join(_FEATURE_NAMES)} INTO NAME i VALUE x),
  cov AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS x FROM long a JOIN long b USING (country) GROUP BY 1, 2),
  {_axis("first_axis", "cov")},
  pulled AS (SELECT sum(a.x * cov.x * b.x) AS strength FROM cov JOIN first_axis a ON a.i = cov.i JOIN first_axis b ON b.i = cov.j),
  rest AS (SELECT cov.i, cov.j, cov.x - strength * a.x * b.x AS x FROM cov, pulled, first_axis a, first_axis b WHERE a.i = cov.i AND b.i = cov.j),
  {_axis("second_axis", "rest")},
  means AS (SELECT i, avg(x) AS x FROM long GROUP BY 1)
  SELECT country, CAST(any_value(cluster) AS INTEGER) AS cluster, round(sum((l.x - m.x) * a.x), 4) AS pc1, round(sum((l.x - m.x) * b.x), 4) AS pc2
  FROM long l JOIN means m USING (i) JOIN first_axis a USING (i) JOIN second_axis b USING (i) GROUP BY country""",
    "silhouette": f"""WITH RECURSIVE {_RECENT},
  pairs AS (
    SELECT a.country, a.cluster AS own, b.cluster AS other, sum({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in _FEATURE_NAMES)}) AS total, count(*) AS n
    FROM labelled a, labelled b GROUP BY 1, 2, 3),
  sides AS (
    SELECT country, own, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
    FROM pairs GROUP BY 1, 2)
  SELECT count(*) AS n, count(DISTINCT own) AS labels, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 5) AS silhouette FROM sides""",
    "cluster_report": f"""WITH {USER_DAY},
  windowed AS (SELECT country, d, coalesce(daily_vaccinations, 0.0) AS v FROM user_day WHERE d BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'),
  {_daily('windowed', 'v')},
  stats AS (
    SELECT country, count(*) AS len, count(v) AS nnz, min(d) AS first, max(d) AS last,
           (SELECT count(w) FROM weekly w WHERE w.country = x.country) AS weeks FROM daily x GROUP BY country)
  SELECT country, coalesce(weeks >= 4, false) AS ok,
         CASE WHEN len IS NULL THEN 'empty-or-non-datetime' WHEN weeks < 4 THEN 'insufficient-weekly-points' ELSE '' END AS reason,
         coalesce(len, 0) AS len, coalesce(nnz, 0) AS nnz, first, last
  FROM (SELECT DISTINCT country FROM user_day) LEFT JOIN stats USING (country) ORDER BY ok DESC, country""",
    "forecast": f"""WITH RECURSIVE {EVENT_DAY}, {_daily('event_day', 'new_cases')},
  weights AS (SELECT DISTINCT country, 0 AS w, 0.1 + 0.05 * length(country) AS a, 0.02 * length(country) AS b, 0.3 - 0.02 * length(country) AS c,
                     0.8 + 0.02 * length(country) AS p FROM event_day),
  {_smoothed('weights')},
  ahead AS (
    SELECT m.country, CAST(last_day + CAST(h AS INTEGER) AS DATE) AS date, level + trend * p * (1 - p ** h) / (1 - p) + pattern[(n + h - 1) % 7 + 1] AS value, spread
    FROM smoothed m JOIN shapes s ON s.country = m.country AND s.n = m.t JOIN fits f ON f.country = m.country, range(1, 15) r(h))
  SELECT country, 'NEW_CASES' AS metric, date, round(value, 4) AS value, kind FROM (
    SELECT country, d AS date, new_cases AS value, 'history' AS kind FROM event_day
    UNION ALL SELECT country, date, value, 'forecast' FROM ahead
    UNION ALL SELECT country, date, greatest(value - 1.96 * spread, 0), 'conf_low' FROM ahead
    UNION ALL SELECT country, date, value + 1.96 * spread, 'conf_high' FROM ahead)""",
    "forecast_fit": f"""WITH RECURSIVE {EVENT_DAY}, {_daily('event_day', 'new_cases')},
  weights AS (
    SELECT country, row_number() OVER () AS w, a, b, c, p FROM (SELECT DISTINCT country FROM event_day),
    (VALUES (0.1), (0.3), (0.6), (0.9)) x(a), (VALUES (0.01), (0.1), (0.3)) y(b), (VALUES (0.01), (0.1), (0.3)) z(c), (VALUES (0.8), (0.9), (0.98)) u(p)),
  {_smoothed('weights')}
  SELECT s.country, 'NEW_CASES' AS metric, first_day, CAST(n AS INTEGER) AS n_days, round(min(squares), 2) AS start_error, true AS no_worse
  FROM shapes s JOIN fits USING (country) GROUP BY ALL""",
    "forecast_request": f"""WITH {NATION_DAY}, chosen AS (
    SELECT country, d, coalesce(new_cases, 0.0) AS v FROM nation_day
    WHERE d BETWEEN DATE '1996-03-01' AND DATE '1996-12-31' AND country IN {TWELVE}),
  spans AS (SELECT country, count(*) AS n, min(d) AS lo, max(d) AS hi, sum(v) AS total FROM chosen GROUP BY 1)
  SELECT country, 'NEW_CASES' AS metric, 'history' AS kind, n, lo AS first_day, hi AS last_day, round(total, 2) AS history_total FROM spans
  UNION ALL
  SELECT country, 'NEW_CASES', kind, 21, CAST(hi + 1 AS DATE), CAST(hi + 21 AS DATE), NULL
  FROM spans, (VALUES ('forecast'), ('conf_low'), ('conf_high')) AS k(kind) WHERE n >= 10""",
    "forecast_segments": f"""WITH {USER_DAY}, spans AS (
    SELECT country, count(*) AS n, min(d) AS lo, max(d) AS hi, sum(coalesce(daily_vaccinations, 0.0)) AS total FROM user_day GROUP BY 1)
  SELECT country, 'DAILY_VACCINATIONS' AS metric, 'history' AS kind, n, lo AS first_day, hi AS last_day, round(total, 2) AS history_total FROM spans
  UNION ALL
  SELECT country, 'DAILY_VACCINATIONS', kind, 14, CAST(hi + 1 AS DATE), CAST(hi + 14 AS DATE), NULL
  FROM spans, (VALUES ('forecast'), ('conf_low'), ('conf_high')) AS k(kind) WHERE n >= 10""",
    "column_profile": _profile("lineitem", LINE_NUMBERS, ["l_returnflag", "l_linestatus", "l_shipdate"]),
    "mart_profile": f"WITH {ENRICHED} "
    + _profile(
        "enriched", ["new_cases", "new_deaths", "daily_vaccinations", "new_cases_per_100k", "gdp_ppp_per_capita"], ["country", "d"]
    ),
    "value_quartiles": """SELECT event_type, count(value) AS n, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
  round(quantile_cont(value, 0.1), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS q2
  FROM events GROUP BY 1""",
    "top_values": "WITH counts AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2" for c in TOP)
    + """) SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS position
  FROM counts WHERE value IS NOT NULL QUALIFY position <= 10""",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
        for i, a in enumerate(LINE_NUMBERS)
        for b in LINE_NUMBERS[i + 1 :]
    ),
    "duplicate_rows": """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""",
}
