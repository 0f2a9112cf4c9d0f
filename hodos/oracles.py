"""The same results as plain SQL over the given tables, for comparison in DuckDB.

Written from the definitions of the models, not from the Spark plans: the dense grid is a
cross join here, a sample is an ORDER BY, and so on. Every statement is a chain of common
table expressions followed by one SELECT. Doubles are published by the rule of
``hodos.functions.measures.published``.
"""

from __future__ import annotations

# Fixed values, written out here as well: a slip in the tables of the Spark side has to show.
ROAD_ALIASES = {
    "Β. ΣΟΦΙΑΣ": "ΒΑΣ. ΣΟΦΙΑΣ",
    "Π. ΡΑΛΛΗ": "ΠΕΤΡΟΥ ΡΑΛΛΗ",
    "Β. ΑΛΕΞΑΝΔΡΟΥ": "ΒΑΣ. ΑΛΕΞΑΝΔΡΟΥ",
    "ΕΘΝ. ΑΝΤΙΣΤΑΣΕΩΣ (ΟΛΓΑΣ)": "ΕΘΝ. ΑΝΤΙΣΤΑΣΕΩΣ",
    "Λ. ΑΘΗΝΩΝ": "ΑΘΗΝΩΝ",
    "Λ. ΑΘΗΝΩΝ (ΠΑΡΑΛΛΗΛΟΣ)": "ΑΘΗΝΩΝ (ΠΑΡΑΛΛΗΛΟΣ)",
    "Λ. ΑΛΕΞΑΝΔΡΑΣ": "ΑΛΕΞΑΝΔΡΑΣ",
    "Λ. ΑΜΑΛΙΑΣ": "ΑΜΑΛΙΑΣ",
    "Λ. ΒΟΥΛΙΑΓΜΕΝΗΣ": "ΒΟΥΛΙΑΓΜΕΝΗΣ",
    "Λ. ΔΗΜΟΚΡΑΤΙΑΣ": "ΔΗΜΟΚΡΑΤΙΑΣ",
    "Λ. ΚΑΡΑΜΑΝΛΗ ΚΩΝ.": "ΚΑΡΑΜΑΝΛΗ ΚΩΝ.",
    "Λ. ΚΗΦΙΣΙΑΣ": "ΚΗΦΙΣΙΑΣ",
    "Λ. ΚΗΦΙΣΟΥ": "ΚΗΦΙΣΟΥ",
    "Λ. ΚΩΝΣΤΑΝΤΙΝΟΥΠΟΛΕΩΣ": "ΚΩΝΣΤΑΝΤΙΝΟΥΠΟΛΕΩΣ",
    "Λ. ΜΕΣΟΓΕΙΩΝ": "ΜΕΣΟΓΕΙΩΝ",
    "Λ. ΟΜΟΡΦΟΚΚΛΗΣΙΑΣ/ΒΕΪΚΟΥ": "ΟΜΟΡΦΟΚΚΛΗΣΙΑΣ/ΒΕΪΚΟΥ",
    "Λ. ΣΥΓΓΡΟΥ": "ΣΥΓΓΡΟΥ",
}
ROAD_NAMES = [*ROAD_ALIASES, "ΚΗΦΙΣΙΑΣ", "ΜΕΣΟΓΕΙΩΝ", "ΠΕΙΡΑΙΩΣ", "ΙΕΡΑ ΟΔΟΣ", "ΑΘΗΝΩΝ"]

_q = lambda text: "'" + text.replace("'", "''") + "'"
_NAMES = "[" + ", ".join(map(_q, ROAD_NAMES)) + "]"
_CASE = "CASE " + " ".join(f"WHEN road_name = {_q(a)} THEN {_q(b)}" for a, b in ROAD_ALIASES.items()) + " ELSE road_name END"
_MART = """device_id, processed_at, processed_date, processed_year, processed_month, processed_day, processed_hour,
  ingested_at, counted_cars, average_speed, road_name"""

_RAW = f"""SELECT cast(user_id AS varchar) AS deviceid,
  cast(date_trunc('hour', ts) AS varchar) AS appprocesstime,
  cast(props->>'k' AS bigint) AS countedcars,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS average_speed,
  {_NAMES}[user_id % {len(ROAD_NAMES)} + 1] AS road_name,
  'seg-' || cast(event_id % 7 AS varchar) AS road_info,
  cast(date_trunc('day', ts) AS timestamp) + INTERVAL 29 HOUR AS ingested_at,
  cast(year(ts) AS integer) AS year, cast(month(ts) AS integer) AS month FROM events"""

_REDELIVERED = f"""SELECT * FROM raw UNION ALL
  SELECT cast(user_id AS varchar), cast(date_trunc('hour', ts) AS varchar), cast(props->>'k' AS bigint), value,
  {_NAMES}[user_id % {len(ROAD_NAMES)} + 1], 'corrected',
  cast(date_trunc('day', ts) AS timestamp) + INTERVAL 29 HOUR + INTERVAL 3 DAY,
  cast(year(ts) AS integer), cast(month(ts) AS integer) FROM events WHERE event_type = 'error'"""


def _typed(source: str) -> str:
    return f"""SELECT deviceid || '-' || appprocesstime AS traffic_id, deviceid AS device_id,
  cast(appprocesstime AS timestamp) AS processed_at, cast(appprocesstime AS date) AS processed_date,
  cast(year AS smallint) AS processed_year, cast(month AS smallint) AS processed_month, ingested_at,
  countedcars AS counted_cars, average_speed, road_name, road_info FROM {source}"""


def _dedup(typed: str, keys: str = "device_id, processed_at") -> str:
    return f"""SELECT * FROM ({typed}) QUALIFY row_number() OVER (PARTITION BY {keys}
  ORDER BY ingested_at DESC NULLS LAST, counted_cars NULLS LAST, average_speed NULLS LAST,
  road_name NULLS LAST, road_info NULLS LAST) = 1"""


def _roads(staged: str) -> str:
    return f"""SELECT device_id, {_CASE} AS road_name, road_info, ingested_at FROM (SELECT * FROM {staged}
  QUALIFY row_number() OVER (PARTITION BY device_id
  ORDER BY ingested_at DESC NULLS LAST, processed_at DESC NULLS LAST, road_name, road_info) = 1)"""


def _hours(first: str, last: str) -> str:
    return f"SELECT unnest(generate_series({first}, {last}, INTERVAL 1 HOUR)) AS hourly_slot"


def _facts(devices: str, slots: str, staged: str) -> str:
    return f"""SELECT *, NOT (is_ghost_reading OR is_missing OR is_dead OR is_impossible_speed OR counted_cars IS NULL) AS is_quality
  FROM (SELECT d.device_id, h.hourly_slot AS processed_at, cast(h.hourly_slot AS date) AS processed_date,
  cast(year(h.hourly_slot) AS integer) AS processed_year, cast(month(h.hourly_slot) AS integer) AS processed_month,
  dayname(h.hourly_slot) AS processed_day, strftime(h.hourly_slot, '%H:%M') AS processed_hour,
  s.ingested_at, s.counted_cars, s.average_speed,
  coalesce(least(s.counted_cars, s.average_speed) = 0 AND greatest(s.counted_cars, s.average_speed) > 0, false) AS is_ghost_reading,
  coalesce(s.counted_cars = 0 AND s.average_speed = 0, false) AS is_dead,
  coalesce(s.average_speed > 130, false) AS is_impossible_speed,
  s.ingested_at IS NULL AS is_missing
  FROM {devices} d CROSS JOIN {slots} h LEFT JOIN {staged} s ON d.device_id = s.device_id AND h.hourly_slot = s.processed_at)"""


_WAS = "sum(average_speed * counted_cars) / nullif(sum(counted_cars), 0)"
_FIRST_RUN = "(SELECT date_trunc('day', first_hour) + INTERVAL 20 DAY + INTERVAL 5 HOUR FROM clock)"
_BOUND = f"({_FIRST_RUN} - INTERVAL 2 DAY)"


def _window(mart: str, name: str, days: int = 30) -> dict[str, str]:
    latest = f"(SELECT max(processed_date) FROM {mart})"
    return {
        f"{name}_last": f"SELECT * FROM {mart} WHERE processed_date >= {latest} - {days}",
        f"{name}_previous": f"SELECT * FROM {mart} WHERE processed_at >= {latest} - {2 * days} AND processed_at < {latest} - {days}",
    }


def _kpi(window: str) -> str:
    return f"""SELECT {_WAS} AS weighted_avg_speed, cast(sum(counted_cars) AS bigint) AS sum_counted_cars,
  count(DISTINCT road_name) AS distinct_roads_count, count(DISTINCT device_id) AS distinct_devices_count,
  max(processed_at) AS latest_timestamp FROM {window}"""


_EASTER = "(SELECT y, (19 * (y % 19) + 15) % 30 AS d, y % 4 AS a, y % 7 AS b FROM {years})"
_FIXED = [(1, 1, "New Year's Day"), (1, 6, "Epiphany"), (3, 25, "Independence Day"), (5, 1, "Labour Day"),
          (8, 15, "Assumption Day"), (10, 28, "Ochi Day"), (12, 25, "Christmas Day"), (12, 26, "Glorifying Mother of God")]
_MOVED = [(-48, "Clean Monday"), (-2, "Good Friday"), (1, "Easter Monday"), (50, "Whit Monday")]


def _md5(seed: int) -> str:
    return f"""md5('{seed}|' || device_id || '|' || road_name || '|' || cast("date" AS varchar) || '|' || cast("hour" AS varchar) || '|' || cast(average_speed AS varchar))"""


def _bucket(seed: int, n: int) -> str:
    return f"cast('0x' || substr({_md5(seed)}, 1, 8) AS bigint) % {n}"


def _shrink(n: str, t: str, s: str, an: str, at: str, as_: str, m: int | None = None) -> str:
    if m is not None:
        return f"(({t}) + {m}.0 * ({at}) / ({an})) / (({n}) + {m}.0)"
    inner = f"greatest(({s}) / ({n}) - (({t}) / ({n})) * (({t}) / ({n})), 0.0)"
    spread = f"greatest(({as_}) / ({an}) - (({at}) / ({an})) * (({at}) / ({an})), 0.0)"
    trust = f"(CASE WHEN {spread} * ({n}) + {inner} > 0 THEN {spread} * ({n}) / ({spread} * ({n}) + {inner}) ELSE 0.0 END)"
    return f"CASE WHEN ({n}) > 0 THEN {trust} * ({t}) / ({n}) + (1.0 - {trust}) * ({at}) / ({an}) ELSE ({at}) / ({an}) END"


def _scored(rows: str) -> str:
    angle = '"hour" * (2.0 * pi() / 24)'
    return f"""SELECT b.*, round(30.0 + 20.0 * cos({angle})
  - 5.0 * (CASE WHEN "hour" BETWEEN 7 AND 9 OR "hour" BETWEEN 15 AND 18 THEN 1 ELSE 0 END)
  + 3.0 * (CASE WHEN isodow("date") >= 6 THEN 1 ELSE 0 END)
  + 2.0 * (CASE WHEN "date" IN (SELECT holiday_date FROM holiday_list) THEN 1 ELSE 0 END)
  + cast(device_id AS bigint) % 10 + 1e-9, 6) AS prediction FROM {rows} b"""


def _split(rows: str) -> str:
    """The best split of every node of ``rows``: all cuts of every feature, categories by their mean."""
    numbers = " UNION ALL ".join(
        f"SELECT node, {place} AS place, '{name}' AS feature, {name} AS value, {name} AS o, '' AS road, count(*) AS n, sum(s) AS s, sum(y) AS t FROM own GROUP BY node, {name}"
        for place, name in enumerate(("slot", "day_id", "processed_month"))
    )
    before = "OVER (PARTITION BY node, feature ORDER BY o, road ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "OVER (PARTITION BY node, feature)"
    return f"""SELECT * FROM (
  WITH own AS ({rows}),
  cells AS ({numbers} UNION ALL SELECT node, 3, 'road', NULL, sum(s) / count(*), road_name, count(*), sum(s), sum(y) FROM own GROUP BY node, road_name),
  sums AS (SELECT node, place, feature, value, sum(n) {before} AS ln, sum(s) {before} AS ls, sum(t) {before} AS lt, sum(n) {whole} AS n, sum(s) {whole} AS s, sum(t) {whole} AS t,
    list(road) {before} AS roads FROM cells)
  SELECT node, feature, value AS threshold, CASE WHEN feature = 'road' THEN roads END AS roads, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain,
    ln AS n_left, n - ln AS n_right, lt / ln AS left_mean, (t - lt) / (n - ln) AS right_mean
  FROM sums WHERE ln >= 5 AND n - ln >= 5 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, place, threshold) = 1)"""


_TODAY = "(SELECT max(processed_date) FROM hist)"

# Name -> definition; a statement takes the ones it needs, in this order.
CTES: dict[str, str] = {
    "raw": _RAW,
    "redelivered": _REDELIVERED,
    "clock": "SELECT date_trunc('hour', min(ts)) AS first_hour, date_trunc('hour', max(ts)) AS last_hour FROM events",
    "stg": _dedup(_typed("raw")),
    "dim": _roads("stg"),
    "slots": _hours("(SELECT first_hour FROM clock)", "(SELECT last_hour FROM clock)"),
    "fct": _facts("dim", "slots", "stg"),
    "mart": "SELECT f.*, d.road_name FROM (SELECT * FROM fct WHERE is_quality) f LEFT JOIN dim d ON f.device_id = d.device_id",
    **_window("mart", "mart"),
    # two incremental runs
    "raw1": f"SELECT * FROM redelivered WHERE ingested_at <= {_FIRST_RUN}",
    "stg1": _dedup(_typed("raw1")),
    "dim1": _roads("stg1"),
    "slots1": _hours("(SELECT first_hour FROM clock)", _FIRST_RUN),
    "fct1": _facts("dim1", "slots1", "stg1"),
    "raw2": "SELECT * FROM redelivered WHERE ingested_at > (SELECT max(ingested_at) FROM stg1)",
    "batch2": _dedup(_typed("raw2")),
    "stg2": "SELECT * FROM stg1 WHERE traffic_id NOT IN (SELECT traffic_id FROM batch2) UNION ALL BY NAME SELECT * FROM batch2",
    "corrected": _dedup(_typed("redelivered")),
    "respelled": "SELECT * REPLACE (CASE WHEN road_info = 'corrected' THEN replace(appprocesstime, ' ', 'T') || 'Z' ELSE appprocesstime END AS appprocesstime) FROM redelivered",
    "stg_respelled": _dedup(_typed("respelled")),
    "stg2_new": "SELECT * FROM stg2 WHERE ingested_at > (SELECT max(ingested_at) FROM dim1)",
    "dim_batch2": _roads("stg2_new"),
    "dim2": "SELECT * FROM dim1 WHERE device_id NOT IN (SELECT device_id FROM dim_batch2) UNION ALL BY NAME SELECT * FROM dim_batch2",
    "slots2": f"SELECT * FROM slots WHERE hourly_slot > {_BOUND}",
    "stg2_recent": f"SELECT * FROM stg2 WHERE processed_at >= {_BOUND}",
    "fct_batch2": _facts("dim2", "slots2", "stg2_recent"),
    "fct2": """SELECT * FROM fct1 WHERE NOT EXISTS (SELECT 1 FROM fct_batch2 b WHERE b.device_id = fct1.device_id AND b.processed_at = fct1.processed_at)
  UNION ALL BY NAME SELECT * FROM fct_batch2""",
    "mart2": "SELECT f.*, d.road_name FROM (SELECT * FROM fct2 WHERE is_quality) f LEFT JOIN dim2 d ON f.device_id = d.device_id",
    **_window("mart2", "mart2"),
    # long history
    "hist_rows": """SELECT cast(l_suppkey AS varchar) AS device_id, l_shipdate + to_hours(l_linenumber) AS processed_at,
  cast(l_quantity AS bigint) AS counted_cars, cast(l_partkey % 140 AS double) AS average_speed,
  cast(s_nationkey AS varchar) AS road_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE cast(l_quantity AS bigint) <> 0 AND l_partkey % 140 <> 0 AND l_partkey % 140 <= 130""",
    "hist": """SELECT device_id, processed_at, cast(processed_at AS date) AS processed_date,
  cast(year(processed_at) AS integer) AS processed_year, cast(month(processed_at) AS integer) AS processed_month,
  dayname(processed_at) AS processed_day, strftime(processed_at, '%H:%M') AS processed_hour,
  processed_at + INTERVAL 1 DAY AS ingested_at, counted_cars, average_speed, road_name FROM hist_rows""",
    **_window("hist", "hist"),
    # features
    "train": f"""SELECT device_id, road_name, processed_month, processed_day, processed_hour, average_speed, processed_at, processed_date
  FROM hist WHERE average_speed IS NOT NULL AND average_speed > 2 AND average_speed < 130 AND processed_date >= {_TODAY} - 365""",
    "base": """SELECT device_id, road_name, cast(processed_at AS date) AS "date", cast(split_part(processed_hour, ':', 1) AS bigint) AS "hour", average_speed
  FROM train WHERE device_id IS NOT NULL AND road_name IS NOT NULL""",
    "years": "SELECT unnest(range(1990, 2031)) AS y",
    "easter": f"""SELECT y, make_date(y, (d + (2 * a + 4 * b - d + 34) % 7 + 114) // 31, (d + (2 * a + 4 * b - d + 34) % 7 + 114) % 31 + 1) + 13 AS sunday
  FROM {_EASTER.format(years="years")}""",
    "holiday_list": " UNION ALL ".join(
        [f"SELECT make_date(y, {m}, {d}) AS holiday_date, {_q(name)} AS holiday_name FROM years" for m, d, name in _FIXED]
        + [f"SELECT cast(sunday + ({offset}) AS date), {_q(name)} FROM easter" for offset, name in _MOVED]
    ),
    "marked": f"SELECT *, {_bucket(42, 100)} < 20 AS is_test FROM base",
    "reference": f"SELECT device_id, road_name, \"date\", \"hour\", average_speed FROM marked WHERE NOT is_test ORDER BY {_md5(42)} LIMIT 100000",
    "train_part": "SELECT * FROM marked WHERE NOT is_test",
    "recent14": f"SELECT * FROM hist WHERE processed_date >= {_TODAY} - 14",
    "scored": _scored("base"),
    "scored_test": _scored("(SELECT * EXCLUDE (is_test) FROM marked WHERE is_test)"),
    "lesson": f"SELECT * EXCLUDE (prediction) REPLACE (round(prediction + (average_speed - 70) / 10 + 1e-9, 6) AS average_speed) FROM ({_scored('marked')})",
    "slope_rows": """SELECT cast("hour" AS double) AS slot, cast(isodow("date") - 1 AS double) AS day_id, cast(month("date") AS double) AS processed_month, road_name,
  average_speed AS y, (SELECT avg(average_speed) FROM lesson) - average_speed AS s FROM lesson""",
    "split0": _split("SELECT 0 AS node, * FROM slope_rows"),
    "sides1": """SELECT CASE WHEN (CASE b.feature WHEN 'slot' THEN r.slot <= b.threshold WHEN 'day_id' THEN r.day_id <= b.threshold WHEN 'processed_month' THEN r.processed_month <= b.threshold
  ELSE list_contains(b.roads, r.road_name) END) THEN 1 ELSE 2 END AS node, r.* FROM slope_rows r, split0 b""",
    "split1": _split("SELECT * FROM sides1"),
    "model_pairs": "SELECT DISTINCT road_name, device_id FROM base",
    "model_asked": """SELECT event_id AS request_id, cast(user_id % 30 AS varchar) AS road_name, cast(ts AS date) AS target_date,
  cast(cast(props->>'k' AS integer) % 30 AS integer) AS target_hour FROM events""",
    "pairs": "SELECT DISTINCT road_name, device_id FROM mart WHERE road_name IS NOT NULL",
    "requests": f"""SELECT request_id, CASE WHEN event_type = 'view' THEN road_name ELSE {_CASE} END AS road_name, target_date, target_hour
  FROM (SELECT event_id AS request_id, event_type, {_NAMES}[user_id % {len(ROAD_NAMES)} + 1] AS road_name, cast(ts AS date) AS target_date,
  cast(cast(props->>'k' AS integer) % 30 AS integer) AS target_hour FROM events)""",
    "questions": """SELECT DISTINCT r.road_name, p.device_id, r.target_date AS "date", r.target_hour AS "hour"
  FROM requests r JOIN pairs p ON r.road_name = p.road_name WHERE r.target_hour BETWEEN 0 AND 23""",
    "answers": _scored("questions"),
    "versions": "SELECT 'run-' || cast(event_id AS varchar) AS run_id, cast(event_id AS varchar) AS version, ts AS start_time FROM events",
}


def _needs(text: str) -> set[str]:
    import re

    return set(re.findall(r"[a-z_0-9]+", text)) & set(CTES)


def _statement(select: str) -> str:
    wanted, queue = set(), _needs(select)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue |= _needs(CTES[name]) - wanted - {name}
    chain = [f"{name} AS MATERIALIZED ({body})" for name, body in CTES.items() if name in wanted]
    return ("WITH " + ",\n".join(chain) + "\n" if chain else "") + select


_STG = "traffic_id, device_id, processed_at, processed_date, processed_year, processed_month, ingested_at, counted_cars, average_speed, road_name, road_info"
_FCT = "device_id, processed_at, processed_date, processed_year, processed_month, processed_day, processed_hour, ingested_at, counted_cars, average_speed, is_ghost_reading, is_dead, is_impossible_speed, is_missing, is_quality"
_LAKE = "deviceid, appprocesstime, countedcars, average_speed, road_name, road_info, ingested_at, year, month"
_R6 = lambda x, name: f"round({x} + 1e-9, 6) AS {name}"
_PCT = ", ".join(
    f"cast(count(CASE WHEN {flag} THEN 1 END) AS bigint) AS {name}_count, round(100 * count(CASE WHEN {flag} THEN 1 END) / count(*) + 1e-9, 6) AS {name}_percent"
    for name, flag in (("dead", "is_dead"), ("ghost", "is_ghost_reading"), ("impossible_speed", "is_impossible_speed"), ("missing_reading", "is_missing"))
)
_HEALTH = f"SELECT processed_year, processed_month, count(*) AS readings, {_PCT} FROM fct GROUP BY 1, 2"
_VOL = f"SELECT road_name, {_WAS} AS weighted_avg_speed, stddev_samp(average_speed) AS std_average_speed FROM {{}} GROUP BY 1"
_ROUND_VOL = "SELECT road_name, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed, round(std_average_speed + 1e-9, 6) AS std_average_speed FROM ({})"
_SPATIO = f"SELECT road_name, processed_hour, processed_day, {_WAS} AS weighted_avg_speed, avg(counted_cars) AS avg_counted_cars FROM mart GROUP BY 1, 2, 3"
_HOURLY = f"SELECT road_name, processed_hour, {_WAS} AS weighted_avg_speed, avg(counted_cars) AS avg_counted_cars FROM mart GROUP BY 1, 2"
_DAILY = f"SELECT processed_date, cast(sum(counted_cars) AS bigint) AS total_counted_cars, {_WAS} AS weighted_avg_speed FROM {{}} GROUP BY 1"
_SLOT = f"SELECT processed_day, processed_hour, {_WAS} AS weighted_avg_speed FROM {{}} GROUP BY 1, 2"
_KPI4 = ("weighted_avg_speed", "sum_counted_cars", "distinct_roads_count", "distinct_devices_count")
_RK = lambda p, n: f"round({p}.{n} + 1e-9, 6)" if n == "weighted_avg_speed" else f"{p}.{n}"
_DELTA = ", ".join(
    [f"{_RK('l', n)} AS {n}" for n in _KPI4]
    + [f"{_RK('p', n)} AS previous_{n}" for n in _KPI4]
    + [(f"round(l.{n} - p.{n} + 1e-9, 6)" if n == "weighted_avg_speed" else f"l.{n} - p.{n}") + f" AS delta_{n}" for n in _KPI4]
)
_PERIODS = f"({_kpi('hist_last')}) l, ({_kpi('hist_previous')}) p"
_DAY_RANK = "list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], processed_day)"


def _extreme(which: str, window: str) -> str:
    return f"""(SELECT processed_day || ' ' || processed_hour FROM ({_SLOT.format(window)}) s
  WHERE weighted_avg_speed = (SELECT {which}(weighted_avg_speed) FROM ({_SLOT.format(window)})) ORDER BY {_DAY_RANK}, processed_hour LIMIT 1)"""


def _test(table: str, column: str, test: str, failing: str) -> str:
    return f"""SELECT {_q(table)} AS table_name, {_q(column)} AS column_name, {_q(test)} AS test_name, cast(n AS bigint) AS failing_rows,
  CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({failing})"""


def _unique(table: str, source: str, keys: str) -> str:
    return _test(table, keys, "unique", f"SELECT count(*) AS n FROM (SELECT 1 FROM {source} WHERE ({keys.replace(',', ' || ')}) IS NOT NULL GROUP BY {keys} HAVING count(*) > 1)".replace("processed_at) IS", "cast(processed_at AS varchar)) IS"))


def _not_null(table: str, source: str, *columns: str) -> list[str]:
    return [_test(table, c, "not_null", f"SELECT count(*) AS n FROM {source} WHERE {c} IS NULL") for c in columns]


_STG_NOT_NULL = ("traffic_id", "device_id", "processed_at", "counted_cars", "average_speed")
_DQ = [
    _unique("stg_traffic", "stg", "traffic_id"),
    _unique("util_hours", "slots", "hourly_slot"),
    _unique("dim_roads", "dim", "device_id"),
    _unique("fct_last_30_days_daily_speed_count", f"({_DAILY.format('mart_last')})", "processed_date"),
    _unique("fct_measurements", "fct", "device_id,processed_at"),
    *_not_null("stg_traffic", "stg", *_STG_NOT_NULL),
    *_not_null("util_hours", "slots", "hourly_slot"),
    *_not_null("dim_roads", "dim", "device_id", "road_name"),
    *_not_null("fct_measurements", "fct", "device_id", "processed_at", "is_ghost_reading", "is_dead", "is_impossible_speed", "is_quality"),
    *_not_null("mrt_traffic_road", "mart", "device_id"),
    *_not_null("fct_last_30_days_daily_speed_count", f"({_DAILY.format('mart_last')})", "processed_date", "total_counted_cars", "weighted_avg_speed"),
    *_not_null("fct_last_30_days_KPI", f"({_kpi('mart_last')})", "weighted_avg_speed"),
    _test("fct_measurements", "device_id", "relationships", "SELECT count(*) AS n FROM fct WHERE device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM dim)"),
]
_SUSPICIOUS = f"(SELECT * REPLACE (CASE WHEN average_speed <= 130 THEN average_speed END AS average_speed) FROM ({_typed('redelivered')}))"

_TIME = """cast(month("date") AS bigint) AS processed_month, cast(isodow("date") - 1 AS bigint) AS day_id,
  cast(CASE WHEN isodow("date") >= 6 THEN 1 ELSE 0 END AS bigint) AS is_weekend,
  cast(CASE WHEN "date" IN (SELECT holiday_date FROM holiday_list) THEN 1 ELSE 0 END AS bigint) AS is_holiday,
  cast(CASE WHEN "hour" BETWEEN 7 AND 9 OR "hour" BETWEEN 15 AND 18 THEN 1 ELSE 0 END AS bigint) AS is_rush_hour,
  round(sin("hour" * (2.0 * pi() / 24)) + 1e-9, 6) AS hour_sin, round(cos("hour" * (2.0 * pi() / 24)) + 1e-9, 6) AS hour_cos"""
_GROUPS = "SELECT device_id, count(*) AS n, sum(average_speed) AS t, sum(average_speed * average_speed) AS s FROM base GROUP BY 1"
_ALL = "SELECT count(*) AS an, sum(average_speed) AS at_, sum(average_speed * average_speed) AS as_ FROM base"
_HEX = """SELECT *, CASE WHEN power(u - cu, 2) + 3 * power(v - cv, 2) < power(u - mu, 2) + 3 * power(v - mv, 2) THEN cu ELSE mu END AS hex_x,
  CASE WHEN power(u - cu, 2) + 3 * power(v - cv, 2) < power(u - mu, 2) + 3 * power(v - mv, 2) THEN cv ELSE mv END AS hex_y
  FROM (SELECT *, round_even(u, 0) AS cu, round_even(v, 0) AS cv, least(floor(u), 74) + 0.5 AS mu, least(floor(v), 42) + 0.5 AS mv
  FROM (SELECT (average_speed - x0) / sx AS u, (prediction - y0) / sy AS v, x0, y0, sx, sy FROM scored,
  (SELECT min(average_speed) AS x0, (max(average_speed) - min(average_speed)) / 75 AS sx, min(prediction) AS y0, (max(prediction) - min(prediction)) / 43 AS sy FROM scored)))"""


def _js(column: str) -> str:
    sides = f"""SELECT coalesce(r.value, c.value) AS value, coalesce(r.n, 0) AS ref, coalesce(c.n, 0) AS cur
  FROM (SELECT {column} AS value, count(*) AS n FROM train_part WHERE {column} IS NOT NULL GROUP BY 1) r
  FULL JOIN (SELECT {column} AS value, count(*) AS n FROM recent14 WHERE {column} IS NOT NULL GROUP BY 1) c ON r.value = c.value"""
    shares = f"SELECT *, ref / sum(ref) OVER () AS p, cur / sum(cur) OVER () AS q, sum(ref) OVER () AS nr, sum(cur) OVER () AS nc FROM ({sides})"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ((p + q) / 2)) ELSE 0 END"
    expected = lambda n: f"((ref + cur) * {n} / (nr + nc))"
    chi = f"sum(power(ref - {expected('nr')}, 2) / {expected('nr')} + power(cur - {expected('nc')}, 2) / {expected('nc')})"
    return f"""SELECT {_q(column)} AS column_name, 'jensenshannon' AS method, score, statistic, score >= 0.1 AS is_drifted
  FROM (SELECT sqrt(greatest(sum((({term('p')}) + ({term('q')})) / 2), 0)) AS score, {chi} AS statistic FROM ({shares}))"""


_WASSERSTEIN = """SELECT 'average_speed' AS column_name, 'wasserstein' AS method, score, statistic, score >= 0.1 AS is_drifted FROM (
  SELECT sum(gap * coalesce(nxt - value, 0)) / greatest((SELECT stddev_pop(average_speed) FROM train_part), 0.001) AS score, max(gap) AS statistic FROM (
  SELECT value, lead(value) OVER (ORDER BY value) AS nxt,
  abs(sum(ref) OVER (ORDER BY value) / sum(ref) OVER () - sum(cur) OVER (ORDER BY value) / sum(cur) OVER ()) AS gap FROM (
  SELECT value, sum(ref) AS ref, sum(cur) AS cur FROM (SELECT average_speed AS value, 1 AS ref, 0 AS cur FROM train_part WHERE average_speed IS NOT NULL
  UNION ALL SELECT average_speed, 0, 1 FROM recent14 WHERE average_speed IS NOT NULL) GROUP BY 1)))"""
_DRIFT = f"({_js('device_id')} UNION ALL {_js('road_name')} UNION ALL {_WASSERSTEIN})"
_DRIFT_OUT = "SELECT column_name, method, round(score + 1e-9, 6) AS score, round(statistic + 1e-9, 6) AS statistic, is_drifted FROM ({})"

SELECTS: dict[str, str] = {
    "stg_traffic": f"SELECT {_STG} FROM stg",
    "dim_roads": "SELECT device_id, road_name, road_info, ingested_at FROM dim",
    "util_hours": "SELECT hourly_slot FROM slots",
    "fct_measurements": f"SELECT {_FCT} FROM fct",
    "mrt_traffic_road": f"SELECT {_MART} FROM mart",
    "fct_by_device": f"SELECT {_FCT} FROM fct",
    "mrt_by_device": f"SELECT {_MART} FROM mart",
    "warehouse_build": """SELECT 'stg_traffic' AS table_name, count(*) AS n_rows FROM stg UNION ALL SELECT 'dim_roads', count(*) FROM dim
  UNION ALL SELECT 'fct_measurements', count(*) FROM fct UNION ALL SELECT 'mrt_traffic_road', count(*) FROM mart""",
    "mart_layout": f"SELECT {_MART} FROM mart",
    "dev_slice": f"SELECT {_MART} FROM hist WHERE processed_year = 1998",
    "mrt_last_n_days": f"SELECT {_MART} FROM hist_last",
    "device_health": _HEALTH,
    "device_health_spans": _HEALTH,
    "kpi_last": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_kpi('hist_last')})",
    "kpi_previous": f"SELECT * EXCLUDE (latest_timestamp) REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_kpi('hist_previous')})",
    "kpi_delta": f"SELECT {_DELTA} FROM {_PERIODS}",
    "distinct_counts": "SELECT count(DISTINCT road_name) AS distinct_roads_count, count(DISTINCT device_id) AS distinct_devices_count, max(processed_at) AS latest_timestamp FROM mart",
    "daily_speed_count": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_DAILY.format('mart_last')})",
    "busiest_times": f"""SELECT processed_day, processed_hour, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed, CASE WHEN weighted_avg_speed = lo THEN 'busiest' ELSE 'lightest' END AS slot
  FROM (SELECT *, min(weighted_avg_speed) OVER () AS lo, max(weighted_avg_speed) OVER () AS hi FROM ({_SLOT.format('mart_last')}))
  WHERE weighted_avg_speed = lo OR weighted_avg_speed = hi""",
    "homepage_tables": f"""SELECT 'last_kpi' AS table_name, cast(1 AS bigint) AS n_rows UNION ALL SELECT 'previous_kpi', 1
  UNION ALL SELECT 'daily_speed_count', count(DISTINCT processed_date) FROM mart_last
  UNION ALL SELECT 'busiest_times', count(*) FROM (SELECT weighted_avg_speed AS w, min(weighted_avg_speed) OVER () AS lo, max(weighted_avg_speed) OVER () AS hi FROM ({_SLOT.format('mart_last')})) WHERE w = lo OR w = hi""",
    "stored_kpi_last": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_kpi('mart_last')})",
    "stored_kpi_previous": f"SELECT * EXCLUDE (latest_timestamp) REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_kpi('mart_previous')})",
    "stored_daily": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_DAILY.format('mart_last')})",
    "stored_busiest": f"""SELECT processed_day, processed_hour, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed
  FROM (SELECT *, min(weighted_avg_speed) OVER () AS lo, max(weighted_avg_speed) OVER () AS hi FROM ({_SLOT.format('mart_last')}))
  WHERE weighted_avg_speed = lo OR weighted_avg_speed = hi""",
    "stored_last_days": f"SELECT {_MART} FROM mart_last",
    "scoreboard": f"SELECT {_DELTA}, l.latest_timestamp, {_extreme('min', 'hist_last')} AS busiest_slot, {_extreme('max', 'hist_last')} AS lightest_slot FROM {_PERIODS}",
    "heatmap_last_n": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed) FROM ({_SLOT.format('mart_last')})",
    "spatiotemporal": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed, round(avg_counted_cars + 1e-9, 6) AS avg_counted_cars) FROM ({_SPATIO})",
    "speed_count": f"SELECT * REPLACE (round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed, round(avg_counted_cars + 1e-9, 6) AS avg_counted_cars) FROM ({_HOURLY})",
    "volatility_last_n": _ROUND_VOL.format(_VOL.format("hist_last")),
    "volatility_all": _ROUND_VOL.format(_VOL.format("mart")),
    "volatility_chart": _ROUND_VOL.format(_VOL.format("hist")),
    "top20_volatile": _ROUND_VOL.format(f"SELECT * FROM ({_VOL.format('hist_last')}) ORDER BY std_average_speed DESC NULLS LAST, road_name LIMIT 20"),
    "bottom20_volatile": _ROUND_VOL.format(f"SELECT * FROM ({_VOL.format('hist_last')}) ORDER BY std_average_speed ASC NULLS FIRST, road_name DESC LIMIT 20"),
    "heatmap_mean": f"SELECT processed_day, processed_hour, round(avg(weighted_avg_speed) + 1e-9, 6) AS mean_speed FROM ({_SPATIO}) GROUP BY 1, 2",
    "heatmap_pivot": "SELECT processed_hour, "
    + ", ".join(f"round(avg(CASE WHEN processed_day = '{d}' THEN weighted_avg_speed END) + 1e-9, 6) AS \"{d}\"" for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))
    + f" FROM ({_SPATIO}) GROUP BY 1",
    "road_choices": "SELECT DISTINCT road_name FROM mart",
    "road_filter_many": f"SELECT road_name, processed_hour, {_R6('weighted_avg_speed', 'weighted_avg_speed')}, {_R6('avg_counted_cars', 'avg_counted_cars')} FROM ({_HOURLY}) WHERE road_name IN ('ΜΕΣΟΓΕΙΩΝ', 'ΚΗΦΙΣΙΑΣ')",
    "road_filter_one": f"SELECT road_name, processed_hour, processed_day, {_R6('weighted_avg_speed', 'weighted_avg_speed')}, {_R6('avg_counted_cars', 'avg_counted_cars')} FROM ({_SPATIO}) WHERE road_name = 'ΚΗΦΙΣΙΑΣ'",
    "twin_series": f"""SELECT processed_date, 'speed' AS measure, round(weighted_avg_speed + 1e-9, 6) AS y FROM ({_DAILY.format('mart_last')})
  UNION ALL SELECT processed_date, 'volume', cast(total_counted_cars AS double) FROM ({_DAILY.format('mart_last')})""",
    "twin_series_roads": f"""SELECT road_name, processed_hour, 'speed' AS measure, round(weighted_avg_speed + 1e-9, 6) AS y FROM ({_HOURLY})
  UNION ALL SELECT road_name, processed_hour, 'volume', round(avg_counted_cars + 1e-9, 6) FROM ({_HOURLY})""",
    "health_series": f"""SELECT make_date(processed_year, processed_month, 1) AS "date", 'dead_percent' AS "Error Type", dead_percent AS "Percent", 'Dead Readings' AS "Label" FROM ({_HEALTH})
  UNION ALL SELECT make_date(processed_year, processed_month, 1), 'missing_reading_percent', missing_reading_percent, 'Missing Readings' FROM ({_HEALTH})""",
    "reporting_days": "SELECT cast(ts - INTERVAL 6 HOUR AS date) AS reporting_day, count(*) AS n_rows FROM events GROUP BY 1",
    "next_hour_local": "SELECT DISTINCT processed_at, date_trunc('hour', (processed_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens') + INTERVAL 1 HOUR AS local_hour FROM hist",
    "holidays": "SELECT holiday_date, holiday_name FROM holiday_list WHERE year(holiday_date) BETWEEN (SELECT min(processed_year) FROM hist) AND (SELECT max(processed_year) FROM hist)",
    "dq_report": " UNION ALL ".join(_DQ),
    "dq_raw": " UNION ALL ".join([
        _unique("raw_traffic", f"({_typed('redelivered')})", "traffic_id"),
        _unique("raw_traffic", f"({_typed('redelivered')})", "device_id,processed_at"),
        *_not_null("raw_traffic", _SUSPICIOUS, *_STG_NOT_NULL),
    ]),
    "dim_orphans": "SELECT traffic_id, device_id, processed_at FROM stg WHERE device_id NOT IN (SELECT device_id FROM hist)",
    "source_freshness": """SELECT m AS newest_ingested_at, date_diff('second', m, now_) AS age_seconds,
  CASE WHEN m IS NULL OR now_ > m + INTERVAL 36 HOUR THEN 'error' WHEN now_ > m + INTERVAL 24 HOUR THEN 'warn' ELSE 'pass' END AS status
  FROM (SELECT max(ingested_at) AS m FROM raw), (SELECT last_hour + INTERVAL 36 HOUR AS now_ FROM clock)""",
    "lake_write_read": f"SELECT {_LAKE}, strftime(cast(appprocesstime AS date), '%Y-%m-%d') AS batch FROM raw WHERE year = (SELECT min(year) FROM raw)",
    "compact_months": f"SELECT {_LAKE}, strftime(cast(appprocesstime AS date), 'compact-%Y-%m') AS batch FROM raw",
    "backfill_range": f"""SELECT {_LAKE}, strftime(cast(appprocesstime AS date), 'compact-%Y-%m') AS batch FROM raw
  WHERE cast(appprocesstime AS date) BETWEEN (SELECT cast(first_hour AS date) + 3 FROM clock) AND (SELECT cast(first_hour AS date) + 17 FROM clock)""",
    "missing_days": """SELECT cast(d AS date) AS day FROM (SELECT unnest(generate_series(date_trunc('day', first_hour) - INTERVAL 2 DAY, date_trunc('day', last_hour) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS d FROM clock)
  WHERE cast(d AS date) NOT IN (SELECT cast(appprocesstime AS date) FROM raw WHERE countedcars = 0 AND average_speed = 0)""",
    "inc_watermark_filter": "SELECT deviceid, appprocesstime, countedcars, average_speed, ingested_at FROM raw2",
    "inc_upsert_stg": f"SELECT {_STG} FROM stg2",
    "inc_upsert_dim": "SELECT device_id, road_name, road_info, ingested_at FROM dim2",
    "inc_fct_lookback": f"SELECT {_FCT} FROM fct2",
    "inc_reports": f"SELECT {_DELTA}, l.latest_timestamp FROM ({_kpi('mart2_last')}) l, ({_kpi('mart2_previous')}) p",
    "inc_daily": f"SELECT processed_date, total_counted_cars, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed FROM ({_DAILY.format('mart2_last')})",
    "inc_busiest": f"""SELECT processed_day, processed_hour, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed FROM ({_SLOT.format('mart2_last')})
  WHERE weighted_avg_speed IN (SELECT min(weighted_avg_speed) FROM ({_SLOT.format('mart2_last')}) UNION ALL SELECT max(weighted_avg_speed) FROM ({_SLOT.format('mart2_last')}))""",
    "inc_health": _HEALTH.replace("FROM fct ", "FROM fct2 "),
    "dq_incremental": " UNION ALL ".join(
        [
            _unique("stg_traffic", "stg2", "traffic_id"), *_not_null("stg_traffic", "stg2", *_STG_NOT_NULL),
            _unique("fct_measurements", "fct2", "device_id,processed_at"),
            *_not_null("fct_measurements", "fct2", "device_id", "processed_at", "is_ghost_reading", "is_dead", "is_impossible_speed", "is_quality"),
            _test("fct_measurements", "device_id", "relationships", "SELECT count(*) AS n FROM fct2 WHERE device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM dim2)"),
            _unique("dim_roads", "dim2", "device_id"), *_not_null("dim_roads", "dim2", "device_id", "road_name"),
            _unique("util_hours", "slots", "hourly_slot"), *_not_null("util_hours", "slots", "hourly_slot"),
        ]
    ),
    "run_report": f"""SELECT 'run' AS run_id, step, measure, cast(value AS bigint) AS value FROM (
  SELECT 'facts' AS step, 'n_late' AS measure, (SELECT count(*) FROM batch2 WHERE processed_at <= {_BOUND}) AS value
  UNION ALL SELECT 'facts', 'n_late_cars', (SELECT sum(counted_cars) FROM batch2 WHERE processed_at <= {_BOUND})
  UNION ALL SELECT 'training', 'n_rows', (SELECT count(*) FROM train)
  UNION ALL SELECT 'training', 'n_kept', (SELECT count(*) FROM base WHERE road_name <> '7')
  UNION ALL SELECT 'compaction', 'files_before', (SELECT count(DISTINCT cast(appprocesstime AS date)) FROM raw)
  UNION ALL SELECT 'compaction', 'files_after', (SELECT count(DISTINCT (year, month)) FROM raw)
  UNION ALL SELECT 'compaction', 'n_rows', (SELECT count(*) FROM raw))""",
    "late_rows": f"SELECT device_id, processed_at, counted_cars, average_speed FROM batch2 WHERE processed_at <= {_BOUND}",
    "stream_staging": f"SELECT {_STG} FROM stg",
    "stream_dedup": "SELECT device_id, processed_at FROM stg",
    "stream_daily": f"SELECT processed_date, total_counted_cars, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed FROM ({_DAILY.format('corrected')})",
    "stream_window_daily": f"""SELECT processed_date, total_counted_cars, round(weighted_avg_speed + 1e-9, 6) AS weighted_avg_speed FROM ({_DAILY.format('stg')})
  WHERE processed_date + INTERVAL 1 DAY <= (SELECT max(processed_at) - INTERVAL 2 DAY FROM stg)""",
    "stream_gapfill": f"SELECT {_FCT} FROM fct WHERE processed_at + INTERVAL 1 HOUR <= (SELECT last_hour - INTERVAL 2 DAY FROM clock)",
    "stg_quarantine": """SELECT CASE WHEN kind <> 7 THEN deviceid || '-' || moment END AS traffic_id, CASE WHEN kind <> 7 THEN deviceid END AS device_id,
  CASE WHEN kind <> 7 THEN TRY_CAST(moment AS timestamp) END AS processed_at, CASE WHEN kind <> 7 THEN TRY_CAST(cars AS bigint) END AS counted_cars,
  CASE WHEN kind <> 7 THEN round(value + 1e-9, 6) END AS average_speed, nullif(CASE WHEN kind = 7 THEN 'malformed record' ELSE concat_ws('; ',
    CASE WHEN deviceid IS NULL THEN 'deviceid is missing' END, CASE WHEN TRY_CAST(moment AS timestamp) IS NULL THEN 'appprocesstime is no timestamp_ntz' END,
    CASE WHEN TRY_CAST(cars AS bigint) IS NULL THEN 'countedcars is no bigint' END) END, '') AS reason, reason IS NULL AS is_good
  FROM (SELECT event_id % 50 AS kind, value, CASE WHEN event_id % 50 <> 29 THEN cast(user_id AS varchar) END AS deviceid,
    CASE WHEN event_id % 50 = 19 THEN 'not a time' ELSE cast(date_trunc('hour', ts) AS varchar) END AS moment,
    CASE WHEN event_id % 50 IN (13, 19) THEN 'many' ELSE props->>'k' END AS cars FROM events)""",
    "inc_two_spellings": f"SELECT {_STG} FROM stg_respelled",
    "training_rows": "SELECT * FROM train",
    "base_features": "SELECT * FROM base",
    "time_features": f"SELECT device_id, road_name, average_speed, \"date\", \"hour\", {_TIME} FROM base",
    "split_hash": "SELECT * FROM marked",
    "target_encode": f"SELECT device_id, {_R6(_shrink('n', 't', 's', 'an', 'at_', 'as_'), 'encoding')} FROM ({_GROUPS}), ({_ALL})",
    "target_encode_smoothed": f"SELECT device_id, {_R6(_shrink('n', 't', 's', 'an', 'at_', 'as_', 10), 'encoding')} FROM ({_GROUPS}), ({_ALL})",
    "target_encode_folds": f"""SELECT b.device_id, b.road_name, b."date", b."hour", b.average_speed, round({_shrink('n', 't', 's', 'an', 'at_', 'as_')} + 1e-9, 6) AS device_code
  FROM (SELECT *, {_bucket(5, 5)} AS fold FROM base) b
  JOIN (SELECT d.device_id, f.fold, count(*) FILTER (x.fold <> f.fold) AS n, coalesce(sum(x.average_speed) FILTER (x.fold <> f.fold), 0) AS t, coalesce(sum(x.average_speed * x.average_speed) FILTER (x.fold <> f.fold), 0) AS s
  FROM (SELECT DISTINCT device_id FROM base) d CROSS JOIN (SELECT unnest(range(5)) AS fold) f JOIN (SELECT *, {_bucket(5, 5)} AS fold FROM base) x ON x.device_id = d.device_id GROUP BY 1, 2) g
  ON g.device_id = b.device_id AND g.fold = b.fold
  JOIN (SELECT f.fold, count(*) AS an, sum(average_speed) AS at_, sum(average_speed * average_speed) AS as_ FROM (SELECT unnest(range(5)) AS fold) f JOIN (SELECT *, {_bucket(5, 5)} AS fold FROM base) y ON y.fold <> f.fold GROUP BY 1) o ON o.fold = b.fold""",
    "ordinal_encode": """SELECT m.road_name, cast(coalesce(c.code, -1) AS integer) AS road_code FROM (SELECT DISTINCT road_name FROM mart) m
  LEFT JOIN (SELECT road_name, row_number() OVER (ORDER BY road_name) - 1 AS code FROM (SELECT DISTINCT road_name FROM mart WHERE road_name < 'Κ')) c ON m.road_name = c.road_name""",
    "ordinal_encode_devices": """SELECT m.device_id, cast(coalesce(c.code, -1) AS integer) AS device_code FROM (SELECT DISTINCT device_id FROM hist) m
  LEFT JOIN (SELECT device_id, row_number() OVER (ORDER BY device_id) - 1 AS code FROM (SELECT DISTINCT device_id FROM train_part)) c ON m.device_id = c.device_id""",
    "road_devices": "SELECT road_name, device_id FROM pairs",
    "road_map": "SELECT road_name, string_agg(device_id, ',' ORDER BY device_id) AS devices, cast(count(*) AS integer) AS n_devices FROM pairs GROUP BY 1",
    "model_metrics": """SELECT count(*) AS n_rows, round(avg(abs(average_speed - prediction)) + 1e-9, 6) AS mae,
  round(1 - sum(power(average_speed - prediction, 2)) / sum(power(average_speed - m, 2)) + 1e-9, 6) AS r2_score FROM scored_test, (SELECT avg(average_speed) AS m FROM scored_test)""",
    "gbt_splits": f"""SELECT step, feature, threshold, CASE WHEN roads IS NOT NULL THEN array_to_string(list_sort(roads), ',') END AS left_roads,
  {_R6('gain', 'gain')}, cast(n_left AS bigint) AS n_left, cast(n_right AS bigint) AS n_right, {_R6('left_mean', 'left_mean')}, {_R6('right_mean', 'right_mean')}
  FROM (SELECT 0 AS step, * FROM split0 UNION ALL SELECT * FROM (SELECT 1 AS step, * FROM split1 ORDER BY gain DESC LIMIT 1))""",
    "model_holdout": """SELECT count(*) AS n_rows, count(*) AS n_plausible, count(DISTINCT device_id) AS n_devices,
  round(avg(abs(average_speed - m)) + 1e-9, 6) AS mean_mae,
  round(1 - sum(power(average_speed - m, 2)) / sum(power(average_speed - own, 2)) + 1e-9, 6) AS mean_r2_score, true AS is_better
  FROM lesson, (SELECT avg(average_speed) AS m FROM lesson WHERE NOT is_test), (SELECT avg(average_speed) AS own FROM lesson WHERE is_test) WHERE is_test""",
    "model_answers": """SELECT a.request_id, strftime(a.target_date, '%Y-%m-%d') || ' ' || lpad(cast(a.target_hour AS varchar), 2, '0') || ':00' AS target_datetime,
  count(*) AS active_devices_used, true AS is_plausible, cast(NULL AS varchar) AS reason
  FROM model_asked a JOIN model_pairs p ON a.road_name = p.road_name WHERE a.target_hour BETWEEN 0 AND 23 GROUP BY 1, 2
  UNION ALL SELECT request_id, NULL, NULL, NULL, CASE WHEN target_hour NOT BETWEEN 0 AND 23 THEN 'target_hour outside 0..23' ELSE 'no device is known on road ''' || road_name || '''' END
  FROM model_asked WHERE target_hour NOT BETWEEN 0 AND 23 OR road_name NOT IN (SELECT road_name FROM model_pairs)""",
    "road_scoring": """SELECT r.request_id, r.road_name, strftime(r.target_date, '%Y-%m-%d') || ' ' || lpad(cast(r.target_hour AS varchar), 2, '0') || ':00' AS target_datetime,
  round(round_even(avg(a.prediction), 2) + 1e-9, 6) AS average_predicted_speed_kmh, count(*) AS active_devices_used
  FROM requests r JOIN answers a ON r.road_name = a.road_name AND r.target_date = a."date" AND r.target_hour = a."hour" GROUP BY 1, 2, 3""",
    "road_breakdown": """SELECT road_name, strftime("date", '%Y-%m-%d') || ' ' || lpad(cast("hour" AS varchar), 2, '0') || ':00' AS target_datetime, device_id, round_even(prediction, 2) AS speed FROM answers""",
    "road_rejects": """SELECT request_id, CASE WHEN target_hour NOT BETWEEN 0 AND 23 THEN 'target_hour outside 0..23' ELSE 'no device is known on road ''' || road_name || '''' END AS reason
  FROM requests WHERE target_hour NOT BETWEEN 0 AND 23 OR road_name NOT IN (SELECT road_name FROM pairs)""",
    "residual_hist": """SELECT bin, round(lo + bin * w + 1e-9, 6) AS bin_start, round(lo + (bin + 1) * w + 1e-9, 6) AS bin_end, n_rows, round(n_rows / (n * w) + 1e-9, 6) AS density FROM (
  SELECT cast(least(floor((average_speed - prediction - lo) / w), 49) AS integer) AS bin, any_value(lo) AS lo, any_value(w) AS w, any_value(n) AS n, count(*) AS n_rows FROM scored,
  (SELECT min(average_speed - prediction) AS lo, (max(average_speed - prediction) - min(average_speed - prediction)) / 50 AS w, count(*) AS n FROM scored) GROUP BY 1)""",
    "density_hex": f"""SELECT hex_x, hex_y, round(any_value(x0 + hex_x * sx) + 1e-9, 6) AS x_centre, round(any_value(y0 + hex_y * sy) + 1e-9, 6) AS y_centre, count(*) AS n_rows, round(log10(count(*)) + 1e-9, 6) AS log_rows
  FROM ({_HEX}) GROUP BY 1, 2""",
    "scatter_sample": f"SELECT device_id, \"date\", \"hour\", average_speed, prediction FROM scored ORDER BY {_md5(42)} LIMIT 1000",
    "scatter_points": "SELECT device_id, \"date\", \"hour\", average_speed, prediction FROM scored",
    "latest_run": """SELECT (SELECT max_by(run_id, cast(version AS bigint)) FROM versions) AS model_run, (SELECT max(cast(version AS bigint)) FROM versions) AS version,
  (SELECT run_id FROM versions ORDER BY start_time DESC, run_id DESC LIMIT 1) AS newest_run""",
    "reference_sample": "SELECT * FROM reference",
    "shared_columns": "SELECT device_id, road_name, average_speed FROM recent14",
    "drift_numeric": _DRIFT_OUT.format(_WASSERSTEIN),
    "drift_categorical": _DRIFT_OUT.format(f"{_js('device_id')} UNION ALL {_js('road_name')}"),
    "drift_pvalues": f"""SELECT column_name, test, round(statistic + 1e-9, 6) AS statistic, freedom, round(p_value + 1e-9, 6) AS p_value, p_value < 0.05 AS is_drifted FROM (
  SELECT column_name, 'kolmogorov_smirnov' AS test, statistic, cast(NULL AS bigint) AS freedom, CASE WHEN l < 0.2 THEN 1.0 ELSE
    least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * l * l))))) END AS p_value
  FROM (SELECT column_name, statistic, (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * statistic AS l FROM ({_WASSERSTEIN}),
    (SELECT (SELECT count(average_speed) FROM train_part) * 1.0 * (SELECT count(average_speed) FROM recent14) / ((SELECT count(average_speed) FROM train_part) + (SELECT count(average_speed) FROM recent14)) AS ne))
  UNION ALL SELECT column_name, 'chi_square', statistic, freedom, greatest(0.0, 1 - list_sum(list_transform(range(0, 20000), lambda n:
    exp((freedom / 2.0 + n) * ln(statistic / 2) - statistic / 2 - lgamma(freedom / 2.0 + n + 1))))) AS p_value
  FROM (SELECT j.*, CASE column_name WHEN 'device_id' THEN (SELECT count(DISTINCT device_id) FROM (SELECT device_id FROM train_part UNION ALL SELECT device_id FROM recent14))
    ELSE (SELECT count(DISTINCT road_name) FROM (SELECT road_name FROM train_part UNION ALL SELECT road_name FROM recent14)) END - 1 AS freedom
    FROM ({_js('device_id')} UNION ALL {_js('road_name')}) j))""",
    "drift_summary": f"""SELECT count(*) AS n_columns, cast(count(*) FILTER (is_drifted) AS bigint) AS n_drifted, round(count(*) FILTER (is_drifted) / count(*) + 1e-9, 6) AS drift_share,
  count(*) FILTER (is_drifted) / count(*) > 0.5 AS is_drifting, printf('%.2f', count(*) FILTER (is_drifted) / count(*)) AS drift_share_text FROM {_DRIFT}""",
}

ORACLES: dict[str, str] = {name: _statement(select) for name, select in SELECTS.items()}
