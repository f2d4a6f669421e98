"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Each text runs on the driver's pre-registered views.  Computed columns carry
the same aliases as the Spark results.  Pieces shared by several queries are
kept as CTE texts and composed with :func:`wattlane.sources.standins.sql_with`.
"""

from __future__ import annotations

from wattlane.sources.standins import sql_event_parts, sql_exact_avg, sql_exact_sum, sql_with

# ---------------------------------------------------------------- shared CTEs

def md5_bucket(text_sql: str, modulus_sql: str) -> str:
    return f"(CAST(('0x' || substr(md5({text_sql}), 1, 8)) AS BIGINT) % ({modulus_sql}))"


LOCAL = "((time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid')"

CLEANED = f"""
    SELECT *,
        CASE WHEN z_norm < 4 AND z_norm > -2 AND consumption > rolling_q10 * 0.7
             THEN consumption END AS consumption_filtered
    FROM (
        SELECT *, CASE WHEN rolling_std <> 0 THEN (consumption - rolling_mean) / rolling_std END AS z_norm
        FROM (
            SELECT *,
                CASE WHEN count(consumption) OVER w48 >= 4 THEN
                    {sql_exact_avg("consumption", " OVER w48")} END AS rolling_mean,
                CASE WHEN count(consumption) OVER w48 >= 4 THEN stddev_samp(consumption) OVER w48 END AS rolling_std,
                CASE WHEN count(consumption) OVER w168 >= 24 THEN quantile_cont(consumption, 0.1) OVER w168 END
                    AS rolling_q10
            FROM (
                SELECT *, CAST(hour(localtime) AS INTEGER) AS hour, CAST(localtime AS DATE) AS date
                FROM (SELECT *, {LOCAL} AS localtime FROM meter_hourly) a
            ) b
            WINDOW w48 AS (PARTITION BY postalcode ORDER BY time ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING),
                   w168 AS (PARTITION BY postalcode ORDER BY time ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)
        ) c
    ) d"""

CLEAN_COLS = ("postalcode, time, consumption, contracts, localtime, hour, date, rolling_mean, "
              "rolling_std, rolling_q10, z_norm, consumption_filtered")


def with_cleaned(**extra: str) -> str:
    ctes = {"cleaned": CLEANED}
    ctes.update(extra)
    return sql_with("meter_hourly", extra=ctes)


ORACLE: dict[str, str] = {}

ORACLE["clean_series"] = with_cleaned() + f"SELECT {CLEAN_COLS} FROM cleaned"

ORACLE["clean_many_series"] = sql_with("meter_users", extra={"cleaned": CLEANED.replace("meter_hourly", "meter_users")}) + \
    f"SELECT {CLEAN_COLS} FROM cleaned"
ORACLE["clean_skewed_series"] = sql_with("meter_skewed", extra={"cleaned": CLEANED.replace("meter_hourly", "meter_skewed").replace(
    "ORDER BY time ROWS", "ORDER BY time, consumption, contracts ROWS")}) + f"SELECT {CLEAN_COLS} FROM cleaned"

ORACLE["rolling_nearest_q10"] = sql_with("meter_hourly") + """
SELECT postalcode, time, consumption,
       CASE WHEN n >= 24 THEN vals[CAST(round_even(0.1 * (len(vals) - 1), 0) AS INTEGER) + 1] END
           AS rolling_q10_nearest
FROM (
    SELECT *, count(consumption) OVER w AS n,
           list_sort(list_filter(list(consumption) OVER w, lambda x: x IS NOT NULL)) AS vals
    FROM meter_hourly
    WINDOW w AS (PARTITION BY postalcode ORDER BY time ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)
) t"""

ORACLE["calendar_fields"] = """
SELECT event_id, localtime, CAST(hour(localtime) AS INTEGER) AS hour, CAST(localtime AS DATE) AS date,
       CAST(year(localtime) AS INTEGER) AS year, CAST(month(localtime) AS INTEGER) AS month,
       CAST(month(localtime) AS VARCHAR) AS month_text, CAST(isodow(localtime) - 1 AS INTEGER) AS weekday,
       CAST(isodow(localtime) AS VARCHAR) AS weekday_iso,
       CAST(floor(hour(localtime) / 3) * 3 AS INTEGER) AS bucket,
       CAST(year(localtime) AS INTEGER) AS year_from_text
FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS localtime FROM events) e"""

STRICT_DAY = """CASE WHEN count(*) OVER d = count(consumption_filtered) OVER d
             THEN avg(consumption_filtered) OVER d * 24 END"""

ORACLE["strict_daily_total"] = with_cleaned() + f"""
SELECT postalcode, time, date, consumption_filtered, {STRICT_DAY} AS daily_consumption
FROM cleaned WINDOW d AS (PARTITION BY postalcode, date)"""

ORACLE["lenient_daily_total"] = with_cleaned() + f"""
SELECT postalcode, date, {sql_exact_avg("consumption_filtered")} * 24 AS daily_consumption
FROM cleaned WHERE postalcode IS NOT NULL AND date IS NOT NULL GROUP BY postalcode, date"""

PROFILE_LONG = f"""
    SELECT *, CASE WHEN daily_consumption <> 0 THEN consumption_filtered * 100.0 / daily_consumption END
               AS consumption
    FROM (
        SELECT postalcode, hour, date, daily_consumption,
               CASE WHEN count(*) = count(consumption_filtered) THEN avg(consumption_filtered) END * 3
                   AS consumption_filtered
        FROM (
            SELECT postalcode, date, CAST(floor(hour / 3) * 3 AS INTEGER) AS hour, consumption_filtered,
                   {STRICT_DAY} AS daily_consumption
            FROM cleaned WHERE postalcode IS NOT NULL AND date IS NOT NULL
            WINDOW d AS (PARTITION BY postalcode, date)
        ) s
        GROUP BY postalcode, hour, date, daily_consumption
    ) g"""

BUCKETS = [0, 3, 6, 9, 12, 15, 18, 21]
PROFILE_WIDE = ("SELECT postalcode, date, "
                + ", ".join(f'avg(consumption) FILTER (WHERE hour = {h}) AS "{h}"' for h in BUCKETS)
                + " FROM long_profile WHERE consumption IS NOT NULL GROUP BY postalcode, date")
ALL_PRESENT = " AND ".join(f'"{h}" IS NOT NULL' for h in BUCKETS)


def with_profiles(**extra: str) -> str:
    ctes = {"long_profile": PROFILE_LONG, "wide_profile": PROFILE_WIDE}
    ctes.update(extra)
    return with_cleaned(**ctes)


ORACLE["daily_profile_long"] = with_profiles() + "SELECT * FROM long_profile"
ORACLE["daily_profile_wide"] = with_profiles() + "SELECT * FROM wide_profile"
ORACLE["unscaled"] = with_profiles() + f"SELECT * FROM wide_profile WHERE {ALL_PRESENT}"


def _minmax(h: int) -> str:
    c = f'"{h}"'
    lo, hi = f"min({c}) OVER ()", f"max({c}) OVER ()"
    return (f"CASE WHEN {hi} - {lo} = 0 THEN {c} - {lo} ELSE ({c} - {lo}) / ({hi} - {lo}) END AS {c}")


def _znorm(h: int) -> str:
    c = f'"{h}"'
    sd = f"stddev_pop({c}) OVER ()"
    return f"({c} - avg({c}) OVER ()) / CASE WHEN {sd} = 0 THEN 1 ELSE {sd} END AS {c}"


ORACLE["scaled_minmax"] = with_profiles() + (
    "SELECT * FROM (SELECT postalcode, date, " + ", ".join(_minmax(h) for h in BUCKETS)
    + f" FROM wide_profile) s WHERE {ALL_PRESENT}")
ORACLE["scaled_znorm"] = with_profiles() + (
    "SELECT * FROM (SELECT postalcode, date, " + ", ".join(_znorm(h) for h in BUCKETS)
    + f" FROM wide_profile) s WHERE {ALL_PRESENT}")

RULE_LABELS = f"""
    SELECT postalcode, date, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS cluster
    FROM wide_profile WHERE {ALL_PRESENT}"""

LABELLED_HOURS = f"""
    SELECT r.postalcode, r.date, r.hour, r.time AS ts_utc,
           CASE WHEN d.daily_consumption <> 0 THEN r.consumption_filtered * 100.0 / d.daily_consumption END
               AS consumption_filtered,
           d.daily_consumption, l.cluster
    FROM cleaned r
    JOIN (SELECT postalcode, date, {sql_exact_avg("consumption_filtered")} * 24 AS daily_consumption
          FROM cleaned WHERE postalcode IS NOT NULL AND date IS NOT NULL GROUP BY postalcode, date) d
      ON r.postalcode = d.postalcode AND r.date = d.date
    JOIN labels l ON r.postalcode = l.postalcode AND r.date = l.date"""


def with_labelled_hours() -> str:
    return with_profiles(labels=RULE_LABELS, lh=LABELLED_HOURS)


ORACLE["daily_curve_list"] = with_labelled_hours() + """
SELECT date, postalcode, cluster, list(consumption_filtered ORDER BY ts_utc) AS consumption_filtered
FROM lh GROUP BY date, postalcode, cluster"""

ORACLE["centroids_long"] = with_labelled_hours() + """
SELECT hour, cluster, avg(consumption_filtered) AS consumption_filtered FROM lh GROUP BY hour, cluster"""

ORACLE["centroids_wide"] = with_labelled_hours() + (
    "SELECT cluster, "
    + ", ".join(f'avg(consumption_filtered) FILTER (WHERE hour = {h}) AS "{h}"' for h in range(24))
    + " FROM lh GROUP BY cluster")

ORACLE["cluster_ids"] = with_labelled_hours() + "SELECT DISTINCT cluster FROM lh"

WEATHER_DAILY = f"""
    SELECT CAST({LOCAL} AS DATE) AS date, postalcode,
           round_even(({sql_exact_avg("airtemperature")}) * 100, 0) / 100 AS airtemperature,
           round_even(({sql_exact_avg("relativehumidity")}) * 100, 0) / 100 AS relativehumidity,
           round_even((coalesce({sql_exact_sum("totalprecipitation")}, 0) * 24) * 100, 0) / 100 AS totalprecipitation,
           round_even(({sql_exact_avg("ghi")}) * 100, 0) / 100 AS ghi,
           round_even(({sql_exact_avg("sunelevation")}) * 100, 0) / 100 AS sunelevation
    FROM weather_hourly_rows WHERE postalcode IS NOT NULL GROUP BY 1, 2"""

ORACLE["weather_daily"] = sql_with("weather_hourly_rows", extra={"wd": WEATHER_DAILY}) + \
    "SELECT * FROM wd"

ORACLE["consumption_daily"] = with_profiles(labels=RULE_LABELS) + f"""
SELECT cd.*, l.cluster
FROM (SELECT date, postalcode, round_even(({sql_exact_avg("consumption_filtered")} * 24) * 100, 0) / 100 AS consumption
      FROM cleaned WHERE postalcode IS NOT NULL AND date IS NOT NULL GROUP BY date, postalcode) cd
LEFT JOIN labels l ON cd.postalcode = l.postalcode AND cd.date = l.date"""

CADASTER_NATION = """
    SELECT postalcode, CAST(coalesce(sum(value), 0) AS BIGINT) AS builtarea,
           CAST(coalesce(sum(numberOfDwellings), 0) AS BIGINT) AS households
    FROM buildings_raw
    WHERE currentUse = 'ECONOMY' AND conditionOfConstruction IN ('Brand#17', 'Brand#2')
      AND postalcode IS NOT NULL
    GROUP BY postalcode"""

ORACLE["cadaster_by_area"] = sql_with("buildings_raw", extra={"cad": CADASTER_NATION}) + \
    "SELECT * FROM cad"

ORACLE["append_buildings"] = sql_with("buildings_raw") + """
SELECT * FROM buildings_raw WHERE value < 17
UNION ALL
SELECT * FROM buildings_raw WHERE value >= 17 AND value < 34
UNION ALL
SELECT reference, currentUse, conditionOfConstruction, value, CAST(NULL AS INTEGER) AS numberOfDwellings,
       postalcode
FROM buildings_raw WHERE value >= 34"""

CLASSIFICATION = f"""
    SELECT * FROM (
        SELECT c.date, c.postalcode, c.consumption, c.cluster, CAST(year(c.date) AS INTEGER) AS year,
               s.income, s.persons, k.builtarea, k.households,
               w.airtemperature, w.relativehumidity, w.totalprecipitation, w.ghi, w.sunelevation,
               CAST(month(c.date) AS INTEGER) AS month, CAST(isodow(c.date) - 1 AS INTEGER) AS weekday
        FROM (SELECT cd.*, l.cluster FROM cd LEFT JOIN nlabels l
                ON cd.postalcode = l.postalcode AND cd.date = l.date) c
        LEFT JOIN (SELECT postalcode, CAST(year(year) AS INTEGER) AS year, income, persons FROM socio_nation) s
          ON c.postalcode = s.postalcode AND CAST(year(c.date) AS INTEGER) = s.year
        LEFT JOIN cad k ON c.postalcode = k.postalcode
        LEFT JOIN wd w ON c.postalcode = w.postalcode AND c.date = w.date
    ) x WHERE cluster IS NOT NULL"""


def with_classification() -> str:
    return sql_with(
        "nation_daily_orders", "weather_hourly_rows", "socio_nation", "buildings_raw",
        extra={
            "nrows": f"SELECT *, CAST({LOCAL} AS DATE) AS date FROM nation_daily_orders",
            "nlabels": f"""SELECT DISTINCT postalcode, date, CAST((CAST(month(date) BETWEEN 4 AND 9 AS INTEGER)
                                  + 2 * CAST(isodow(date) >= 6 AS INTEGER)
                                  + CAST({md5_bucket("concat_ws('|', '7', CAST(postalcode AS VARCHAR), CAST(date AS VARCHAR))", "100")} < 15
                                         AS INTEGER)) % 4 AS INTEGER) AS cluster FROM nrows""",
            "cd": f"""SELECT date, postalcode, round_even(({sql_exact_avg("consumption_filtered")} * 24) * 100, 0) / 100 AS consumption
                     FROM nrows WHERE postalcode IS NOT NULL AND date IS NOT NULL GROUP BY date, postalcode""",
            "wd": WEATHER_DAILY,
            "cad": CADASTER_NATION,
            "ds": CLASSIFICATION,
        })


ORACLE["classification_dataset"] = with_classification() + "SELECT * FROM ds"

FORECAST = """
    SELECT c.postalcode, c.time AS ts_utc, c.localtime, c.hour, c.contracts, c.consumption_filtered,
           c.consumption, CAST(year(c.localtime) AS INTEGER) AS year, s.income, s.persons,
           a.builtarea, a.households, w.time, w.airtemperature, w.ghi,
           CAST(month(c.localtime) AS VARCHAR) AS month, CAST(isodow(c.localtime) AS VARCHAR) AS weekday
    FROM cleaned c
    JOIN (SELECT postalcode, CAST(year(year) AS INTEGER) AS year, income, persons FROM socio_events) s
      ON c.postalcode = s.postalcode AND CAST(year(c.localtime) AS INTEGER) = s.year
    JOIN area_events a ON c.postalcode = a.postalcode
    JOIN hourly_weather w ON c.postalcode = w.postalcode AND c.time = w.time"""


def with_forecast(**extra: str) -> str:
    ctes = {"cleaned": CLEANED, "fc": FORECAST}
    ctes.update(extra)
    return sql_with("meter_hourly", "hourly_weather", "socio_events", "area_events", extra=ctes)


def with_forecast_areas(**extra: str) -> str:
    """As with_forecast, by (event type, user group)."""
    return sql_with(extra={**sql_event_parts(4), "cleaned": CLEANED, "fc": FORECAST, **extra})


ORACLE["forecast_dataset"] = with_forecast() + "SELECT * FROM fc"


ORACLE["stored_forecast_dataset"] = ORACLE["forecast_dataset"]

ORACLE["stored_months"] = sql_with("nation_daily_orders") + """
SELECT postalcode, time, consumption_filtered AS consumption, 1 AS contracts
FROM nation_daily_orders WHERE time >= '1995-03-10' AND time < '1996-02-05'"""

ORACLE["hash_split"] = with_classification() + f"""
SELECT postalcode, date, cluster,
       CASE WHEN {md5_bucket("concat_ws('|', '42', CAST(postalcode AS VARCHAR), CAST(date AS VARCHAR))", "100")} < 20
            THEN 'test' ELSE 'train' END AS split
FROM ds"""

HOLDOUT = """
    SELECT *, CASE WHEN row_number() OVER (ORDER BY ts_utc DESC, postalcode DESC) <= 3840
                   THEN 'test' ELSE 'train' END AS split
    FROM fc WHERE consumption_filtered IS NOT NULL"""

PROFILE_MEAN = """
    SELECT postalcode, hour, avg(consumption_filtered) AS prediction
    FROM hold WHERE split = 'train' GROUP BY postalcode, hour"""

ORACLE["chrono_holdout"] = with_forecast_areas(hold=HOLDOUT) + \
    "SELECT postalcode, ts_utc, consumption_filtered, split FROM hold"

ORACLE["expanding_folds"] = with_forecast_areas(hold=HOLDOUT) + """
SELECT postalcode, ts_utc,
       CASE WHEN rn < 480 THEN CAST(4 - floor(rn / 96) AS BIGINT) END AS test_fold,
       CAST(CASE WHEN rn < 480 THEN 5 - floor(rn / 96) ELSE 0 END AS BIGINT) AS train_from_fold
FROM (SELECT *, row_number() OVER (ORDER BY ts_utc DESC, postalcode DESC) - 1 AS rn
      FROM hold WHERE split = 'train') t"""

FOLD_OF = """
    SELECT *, CASE WHEN rn < 480 THEN 5 - floor(rn / 96) ELSE 0 END AS train_from_fold
    FROM (SELECT *, CASE WHEN hour % 5 <> 0 THEN consumption END AS gappy,
                 row_number() OVER (ORDER BY ts_utc DESC, postalcode DESC) - 1 AS rn
          FROM hold WHERE split = 'train') t"""

ORACLE["fold_scalers"] = with_forecast_areas(hold=HOLDOUT, fold_of=FOLD_OF) + " UNION ALL ".join(f"""
SELECT CAST(f.fold AS INTEGER) AS fold, '{c}' AS feature, count(*) AS n_rows, count({c}) AS n,
       avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std
FROM fold_of JOIN range(0, 6) f(fold) ON train_from_fold <= f.fold GROUP BY f.fold""" for c in ("hour", "contracts", "gappy"))

ORACLE["fold_categories"] = with_forecast_areas(hold=HOLDOUT, fold_of=FOLD_OF) + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, {c} AS value, CAST(min(train_from_fold) AS INTEGER) AS first_fold
FROM fold_of WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("postalcode", "month", "weekday"))

ORACLE["accuracy_by_split"] = with_classification() + f"""
SELECT split, count(*) AS n,
       avg(CAST(prediction = cluster AS DOUBLE)) AS accuracy
FROM (SELECT *, CASE WHEN airtemperature > 25 THEN 1 ELSE 0 END AS prediction,
             CASE WHEN {md5_bucket("concat_ws('|', '42', CAST(postalcode AS VARCHAR), CAST(date AS VARCHAR))", "100")} < 20
                  THEN 'test' ELSE 'train' END AS split
      FROM ds) t
GROUP BY split"""

ORACLE["regression_metrics"] = with_forecast_areas(hold=HOLDOUT, prof=PROFILE_MEAN) + """
SELECT count(*) AS n, avg(power(y - prediction, 2)) AS mse, avg(y) AS mean_y,
       sqrt(avg(power(y - prediction, 2))) AS rmse,
       sqrt(avg(power(y - prediction, 2))) / avg(y) AS cvrmse
FROM (SELECT h.consumption_filtered AS y, p.prediction
      FROM hold h JOIN prof p ON h.postalcode = p.postalcode AND h.hour = p.hour
      WHERE h.split = 'test') t"""

ORACLE["forecast_slices"] = with_forecast_areas(
    hold=HOLDOUT, prof=PROFILE_MEAN,
    pred="""SELECT f.*, p.prediction AS predicted FROM fc f
            LEFT JOIN prof p ON f.postalcode = p.postalcode AND f.hour = p.hour
            WHERE f.postalcode IN ('click-0', 'view-0')""",
    idx="""SELECT *, row_number() OVER (PARTITION BY postalcode ORDER BY ts_utc) - 1 AS row_idx,
                  count(*) OVER (PARTITION BY postalcode) AS len FROM pred""",
    starts=f"""SELECT postalcode, CAST(s.slice AS INTEGER) AS slice,
                      {md5_bucket("concat_ws('|', '42', postalcode, CAST(s.slice AS VARCHAR))", "len - 96 + 1")}
                          AS start
               FROM (SELECT DISTINCT postalcode, len FROM idx WHERE len > 96) l, range(0, 10) s(slice)""",
) + """
SELECT i.postalcode, s.slice, CAST(i.row_idx - s.start AS INTEGER) AS "offset", i.localtime, i.predicted,
       i.consumption
FROM idx i JOIN starts s ON i.postalcode = s.postalcode
WHERE i.row_idx >= s.start AND i.row_idx < s.start + 96"""

ORACLE["silhouette_given_labels"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
cnt AS (SELECT label, count(*) AS n FROM e GROUP BY label),
pair_sums AS (
    SELECT vec_id, la, lb, sum(d2) AS s, sum(sqrt(d2)) AS e
    FROM (SELECT a.vec_id, a.label AS la, b.label AS lb,
                 list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
          FROM e a CROSS JOIN e b) GROUP BY vec_id, la, lb),
means AS (
    SELECT p.vec_id, p.la, p.lb, c.n,
           CASE WHEN p.la = p.lb THEN p.s / NULLIF(c.n - 1, 0) ELSE p.s / c.n END AS mean_d,
           CASE WHEN p.la = p.lb THEN p.e / NULLIF(c.n - 1, 0) ELSE p.e / c.n END AS mean_e
    FROM pair_sums p JOIN cnt c ON p.lb = c.label),
per AS (
    SELECT vec_id, max(CASE WHEN la = lb THEN mean_d END) AS a, min(CASE WHEN la <> lb THEN mean_d END) AS b,
           max(CASE WHEN la = lb THEN mean_e END) AS ae, min(CASE WHEN la <> lb THEN mean_e END) AS be,
           max(CASE WHEN la = lb THEN n END) AS own_n
    FROM means GROUP BY vec_id)
SELECT count(*) AS n,
       avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE coalesce((b - a) / NULLIF(greatest(a, b), 0), 0.0) END) AS silhouette_sqeuclidean,
       avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE coalesce((be - ae) / NULLIF(greatest(ae, be), 0), 0.0) END) AS silhouette_euclidean
FROM per"""


# ------------------------------------------------------------------ spatial (list lambdas)

def sql_edges(r: str) -> str:
    """Edges of an open ring expression ``r`` as a list of structs."""
    return (f"list_transform(range(1, len({r}) + 1), lambda i: {{'ax': {r}[i].x, 'ay': {r}[i].y, "
            f"'bx': {r}[(i % len({r})) + 1].x, 'by': {r}[(i % len({r})) + 1].y}})")


def _sql_on_edge(px: str, py: str, e: str) -> str:
    return (f"(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({e}.by - {e}.ay) * ({px} - {e}.ax) = 0 "
            f"AND {px} >= least({e}.ax, {e}.bx) AND {px} <= greatest({e}.ax, {e}.bx) "
            f"AND {py} >= least({e}.ay, {e}.by) AND {py} <= greatest({e}.ay, {e}.by))")


def _sql_ray(px: str, py: str, e: str) -> str:
    return (f"((({e}.ay > {py}) <> ({e}.by > {py})) AND {px} < CASE WHEN {e}.by <> {e}.ay THEN "
            f"({e}.bx - {e}.ax) * ({py} - {e}.ay) / ({e}.by - {e}.ay) + {e}.ax END)")


def _sql_exists(lst: str, var: str, cond: str) -> str:
    return f"(len(list_filter({lst}, lambda {var}: {cond})) > 0)"


def sql_inside_or_on(px: str, py: str, edges_sql: str, v: str) -> str:
    return (f"({_sql_exists(edges_sql, v, _sql_on_edge(px, py, v))} OR "
            f"len(list_filter({edges_sql}, lambda {v}: {_sql_ray(px, py, v)})) % 2 = 1)")


def sql_strictly_inside(px: str, py: str, edges_sql: str, v: str) -> str:
    return (f"(NOT {_sql_exists(edges_sql, v, _sql_on_edge(px, py, v))} AND "
            f"len(list_filter({edges_sql}, lambda {v}: {_sql_ray(px, py, v)})) % 2 = 1)")


def _orient(ax, ay, bx, by, cx, cy):
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def sql_any_cross(ea: str, eb: str, e: str, f: str) -> str:
    d1 = _orient(f"{f}.ax", f"{f}.ay", f"{f}.bx", f"{f}.by", f"{e}.ax", f"{e}.ay")
    d2 = _orient(f"{f}.ax", f"{f}.ay", f"{f}.bx", f"{f}.by", f"{e}.bx", f"{e}.by")
    d3 = _orient(f"{e}.ax", f"{e}.ay", f"{e}.bx", f"{e}.by", f"{f}.ax", f"{f}.ay")
    d4 = _orient(f"{e}.ax", f"{e}.ay", f"{e}.bx", f"{e}.by", f"{f}.bx", f"{f}.by")
    inner = _sql_exists(eb, f, f"({d1} * {d2} < 0 AND {d3} * {d4} < 0)")
    return _sql_exists(ea, e, inner)


def sql_probes(edges_sql: str) -> str:
    """Vertices and edge midpoints of a ring given by its edge list."""
    return (f"list_concat(list_transform({edges_sql}, lambda q: {{'x': q.ax, 'y': q.ay}}), "
            f"list_transform({edges_sql}, lambda q: {{'x': (q.ax + q.bx) / 2, 'y': (q.ay + q.by) / 2}}))")


def sql_within(b: str, ext: str, holes: str) -> str:
    be, ee = sql_edges(b), sql_edges(ext)
    probes = sql_probes(be)
    verts_in = f"(len(list_filter({probes}, lambda v: NOT {sql_inside_or_on('v.x', 'v.y', ee, 'e1')})) = 0)"
    no_cross = f"(NOT {sql_any_cross(be, ee, 'e2', 'f2')})"
    he = sql_edges("hr")
    hole_bad = (f"({_sql_exists(probes, 'w', sql_strictly_inside('w.x', 'w.y', he, 'e3'))} OR "
                f"{sql_any_cross(be, he, 'e4', 'f4')} OR "
                f"{_sql_exists(sql_probes(he), 'u', sql_strictly_inside('u.x', 'u.y', be, 'e5'))})")
    holes_ok = f"(len(list_filter({holes}, lambda hr: {hole_bad})) = 0)"
    return f"({verts_in} AND {no_cross} AND {holes_ok})"


ORACLE["within_join"] = sql_with("postal_polygons", "footprints") + f"""
SELECT b.cadastralref, p.postalcode
FROM footprints b
LEFT JOIN (SELECT CODPOS AS postalcode, exterior, holes FROM postal_polygons) p
  ON {sql_within('b.geometry', 'p.exterior', 'p.holes')}"""

ORACLE["cadaster_spatial_by_area"] = sql_with("postal_polygons", "footprints", "footprint_buildings") + f"""
SELECT postalcode, CAST(coalesce(sum(value), 0) AS BIGINT) AS builtarea,
       CAST(coalesce(sum(numberOfDwellings), 0) AS BIGINT) AS households
FROM (
    SELECT b.*, p.postalcode
    FROM footprint_buildings b
    LEFT JOIN (SELECT CODPOS AS postalcode, exterior, holes FROM postal_polygons) p
      ON {sql_within('b.geometry', 'p.exterior', 'p.holes')}
) j
WHERE currentUse = 'HOUSEHOLD' AND conditionOfConstruction = 'functional' AND postalcode IS NOT NULL
GROUP BY postalcode"""


def _sql_twice_area(r: str) -> str:
    return f"list_sum(list_transform({sql_edges(r)}, lambda e: e.ax * e.by - e.bx * e.ay))"


def _sql_moment(r: str, a: str, b: str) -> str:
    return (f"list_sum(list_transform({sql_edges(r)}, "
            f"lambda e: (e.{a} + e.{b}) * (e.ax * e.by - e.bx * e.ay)))")


def _sql_centroid(ext: str, holes: str | None, axis: str) -> str:
    a, b = ("ax", "bx") if axis == "x" else ("ay", "by")
    sign = f"sign({_sql_twice_area(ext)} / 2.0)"
    area = f"abs({_sql_twice_area(ext)} / 2.0)"
    mom = f"({_sql_moment(ext, a, b)} * {sign})"
    if holes:
        h_area = f"coalesce(list_sum(list_transform({holes}, lambda hr: abs({_sql_twice_area('hr')} / 2.0))), 0.0)"
        h_mom = (f"coalesce(list_sum(list_transform({holes}, lambda hr: "
                 f"{_sql_moment('hr', a, b)} * sign({_sql_twice_area('hr')} / 2.0))), 0.0)")
        area = f"({area} - {h_area})"
        mom = f"({mom} - {h_mom})"
    return f"{mom} / (6.0 * {area})"


ORACLE["ring_centroid"] = sql_with("postal_polygons", "footprints") + f"""
SELECT cadastralref AS id, {_sql_centroid('geometry', None, 'x')} AS cx,
       {_sql_centroid('geometry', None, 'y')} AS cy
FROM footprints
UNION ALL
SELECT CODPOS AS id, {_sql_centroid('exterior', 'holes', 'x')} AS cx,
       {_sql_centroid('exterior', 'holes', 'y')} AS cy
FROM postal_polygons"""


def _sql_tm() -> tuple[str, str]:
    import math

    # fixed values: GRS80 (a, 1/f), UTM's scale, and by quadrature of the meridian the radius of the
    # rectifying sphere over a and the Fourier coefficients of rectifying minus conformal latitude
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    big_a = 0.9983242984230423
    alpha = (0.0008377318247285103, 7.608527848336207e-07, 1.1976455079943694e-09, 2.429178874111676e-12)
    k = math.sqrt(f * (2 - f))
    scale = k0 * a * big_a
    east = "eta" + "".join(f" + {a!r} * cos({2.0 * j!r} * xi) * sinh({2.0 * j!r} * eta)"
                           for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r} * sin({2.0 * j!r} * xi) * cosh({2.0 * j!r} * eta)"
                           for j, a in enumerate(alpha, 1))
    inner = f"""
        SELECT c_custkey, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1.0 + t * t)) AS eta
        FROM (SELECT c_custkey, radians(lon - 3.0) AS lam,
                     sinh(atanh(sin(radians(lat))) - {k!r} * atanh({k!r} * sin(radians(lat)))) AS t
              FROM pts) a"""
    return inner, (f"round_even((500000.0 + {scale!r} * ({east})) * 1000, 0) / 1000 AS x, "
                   f"round_even((0.0 + {scale!r} * ({north})) * 1000, 0) / 1000 AS y")


_TM_INNER, _TM_OUT = _sql_tm()
ORACLE["reproject"] = f"""
WITH pts AS (SELECT c_custkey, 0.3 + (c_custkey % 100) * 0.006 AS lon,
                    41.5 + (c_acctbal + 1000.0) / 100000.0 AS lat FROM customer)
SELECT c_custkey, {_TM_OUT} FROM ({_TM_INNER}) b"""

ORACLE["profile_csv"] = with_profiles() + """
SELECT postalcode, hour, date, daily_consumption, consumption_filtered, consumption FROM long_profile"""

ORACLE["gml_buildings"] = sql_with("footprints", "footprint_buildings", "building_parts") + """
SELECT reference, currentUse, conditionOfConstruction, numberOfDwellings, value,
       list_transform(rings, lambda r: CAST(len(r) AS INTEGER)) AS ring_sizes,
       flatten(list_transform(flatten(rings), lambda p: [p.x, p.y])) AS coords
FROM building_parts"""

ORACLE["within_join_parts"] = sql_with("postal_polygons", "footprints", "footprint_buildings", "building_parts") + f"""
SELECT b.reference, p.postalcode
FROM building_parts b
LEFT JOIN (SELECT CODPOS AS postalcode, exterior, holes FROM postal_polygons) p
  ON {sql_within('b.rings[1]', 'p.exterior', 'p.holes')}
     AND (b.n <> 0 OR {sql_within('b.rings[len(b.rings)]', 'p.exterior', 'p.holes')})"""

ORACLE["wkt_within"] = sql_with("footprints", "nation_rings") + f"""
SELECT b.cadastralref, p.postalcode
FROM footprints b
LEFT JOIN (SELECT *, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[][]) AS holes FROM nation_rings) p
  ON {sql_within('b.geometry', 'p.exterior', 'p.holes')}"""

ORACLE["text_missing"] = """
SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1"""

ORACLE["unlabelled_curves"] = with_profiles(
    labels="SELECT DISTINCT postalcode, date, 1 AS cluster FROM cleaned", lh=LABELLED_HOURS) + """
SELECT hour, cluster, avg(consumption_filtered) AS consumption_filtered FROM lh GROUP BY hour, cluster"""

ORACLE["tables_round_trip"] = ORACLE["daily_profile_wide"]

ORACLE["forecast_features"] = with_forecast() + """
SELECT * EXCLUDE (localtime, time, consumption) FROM fc WHERE consumption_filtered IS NOT NULL"""


# ------------------------------------------------------------------ Ward, one merge per step

WARD_MATRIX = (f"SELECT postalcode, date, [{', '.join(f'\"{h}\"' for h in BUCKETS)}] AS v FROM (SELECT * FROM (SELECT postalcode, date, "
               + ", ".join(_znorm(h) for h in BUCKETS) + f" FROM wide_profile) s WHERE {ALL_PRESENT}) z")
WARD_STEPS = """
    SELECT 0 AS step, len(c) AS m, c, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS n
    FROM (SELECT list({'node': leaf, 'w': CAST(w AS DOUBLE), 'v': v, 'ls': [leaf]} ORDER BY leaf) AS c FROM leaves) s
    UNION ALL
    SELECT step + 1, m, list_append(list_filter(c, lambda q: q.node <> x.node AND q.node <> y.node),
               {'node': m + step, 'w': x.w + y.w,
                'v': list_transform(list_zip(x.v, y.v), lambda z: (z[1] * x.w + z[2] * y.w) / (x.w + y.w)),
                'ls': list_concat(x.ls, y.ls)}),
           x.node, y.node, best.d, x.w + y.w
    FROM (SELECT *, list_filter(c, lambda q: q.node = best.a)[1] AS x, list_filter(c, lambda q: q.node = best.b)[1] AS y
          FROM (SELECT step, m, c, list_sort(flatten(list_transform(c, lambda p: list_transform(
                    list_filter(c, lambda q: q.node > p.node), lambda q: {
                        'd': sqrt(2.0 * p.w * q.w / (p.w + q.w) * list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))),
                        'a': p.node, 'b': q.node}))))[1] AS best
                FROM steps WHERE len(c) > 1) a) b"""


def with_ward() -> str:
    text = with_profiles(mat=WARD_MATRIX, leaves="SELECT v, count(*) AS w, row_number() OVER (ORDER BY v) - 1 AS leaf FROM mat GROUP BY v",
                         steps=WARD_STEPS)
    return "WITH RECURSIVE " + text.removeprefix("WITH ")


WARD_CUT = """(SELECT k, no - 1 AS cluster, unnest(c[no].ls) AS leaf
    FROM (SELECT len(c) AS k, list_sort(list_transform(c, lambda q: {'a': -q.w, 'b': list_min(q.ls), 'ls': q.ls})) AS c,
                 unnest(range(1, len(c) + 1)) AS no FROM steps) u)"""

ORACLE["ward_merges"] = with_ward() + """
SELECT step - 1 AS merge_id, l AS left_node, r AS right_node, h AS height, CAST(n AS BIGINT) AS size FROM steps WHERE step > 0"""
ORACLE["ward_top_merges"] = ORACLE["ward_merges"] + " ORDER BY height DESC, merge_id DESC LIMIT 2"
ORACLE["ward_labels"] = with_ward() + f"""
SELECT postalcode, date, CAST(cluster AS INTEGER) AS cluster
FROM mat JOIN leaves USING (v) JOIN {WARD_CUT} USING (leaf) WHERE k = 3"""
ORACLE["silhouette_sweep"] = with_ward() + f"""
, pts AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY postalcode, date) AS id, cluster, v
          FROM mat JOIN leaves USING (v) JOIN {WARD_CUT} USING (leaf) WHERE k BETWEEN 2 AND 9),
cnt AS (SELECT k, cluster, count(*) AS n FROM pts GROUP BY k, cluster),
sums AS (SELECT k, id, ca, cb, sum(d2) AS s, sum(sqrt(d2)) AS e
         FROM (SELECT a.k, a.id, a.cluster AS ca, b.cluster AS cb,
                      list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
               FROM pts a JOIN pts b ON a.k = b.k) GROUP BY k, id, ca, cb),
per AS (SELECT s.k, s.id, max(CASE WHEN ca = cb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b,
               max(CASE WHEN ca = cb THEN e / nullif(n - 1, 0) END) AS ae, min(CASE WHEN ca <> cb THEN e / n END) AS be,
               max(CASE WHEN ca = cb THEN n END) AS own
        FROM sums s JOIN cnt ON cnt.k = s.k AND cnt.cluster = cb GROUP BY s.k, s.id)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n,
       avg(CASE WHEN own <= 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS silhouette_sqeuclidean,
       avg(CASE WHEN own <= 1 THEN 0.0 ELSE coalesce((be - ae) / nullif(greatest(ae, be), 0), 0.0) END) AS silhouette_euclidean
FROM per GROUP BY k"""


# ------------------------------------------------------------------ Ward on wide vectors: costs of all pairs, updated merge by merge

WARD_PAIRS = """
    SELECT 0 AS step, a.leaf AS a, b.leaf AS b, 2.0 * a.w * b.w / (a.w + b.w) * list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d,
           CAST(a.w AS DOUBLE) AS wa, CAST(b.w AS DOUBLE) AS wb, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, (SELECT count(*) FROM leaves) AS m
    FROM leaves a JOIN leaves b ON a.leaf < b.leaf
    UNION ALL
    SELECT * FROM (
        WITH cur AS (SELECT *, min({'d': d, 'a': a, 'b': b, 'wa': wa, 'wb': wb}) OVER () AS best FROM pairs WHERE l IS NULL),
        side AS (SELECT step, m, best, d, CASE WHEN a IN (best.a, best.b) THEN b ELSE a END AS ka,
                        CASE WHEN a IN (best.a, best.b) OR b IN (best.a, best.b) THEN m + step ELSE b END AS kb,
                        CASE WHEN a IN (best.a, best.b) THEN wb ELSE wa END AS wka, wa, wb,
                        a IN (best.a, best.b) OR b IN (best.a, best.b) AS met
                 FROM cur WHERE NOT (a = best.a AND b = best.b))
        SELECT any_value(step) + 1, ka, kb,
               CASE WHEN any_value(met) THEN (sum((wa + wb) * d) - any_value(wka) * any_value(best.d)) / (any_value(best.wa) + any_value(best.wb) + any_value(wka))
                    ELSE any_value(d) END,
               any_value(wka), CASE WHEN any_value(met) THEN any_value(best.wa) + any_value(best.wb) ELSE any_value(wb) END,
               CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), any_value(m) FROM side GROUP BY ka, kb
        UNION ALL
        SELECT any_value(step) + 1, any_value(m) + any_value(step), NULL, any_value(best.d), any_value(best.wa) + any_value(best.wb), NULL,
               any_value(best.a), any_value(best.b), any_value(m) FROM cur HAVING count(*) > 0)"""
ORACLE["ward_embeddings"] = f"""
WITH RECURSIVE rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
leaves AS (SELECT v, count(*) AS w, row_number() OVER (ORDER BY v) - 1 AS leaf FROM rows GROUP BY v),
pairs AS ({WARD_PAIRS}),
up AS (SELECT a AS parent, unnest([l, r]) AS node FROM pairs WHERE l IS NOT NULL AND step <= m - 10),
climb AS (SELECT leaf, leaf AS node FROM leaves UNION ALL SELECT climb.leaf, up.parent FROM climb JOIN up ON up.node = climb.node),
top AS (SELECT leaf, max(node) AS root FROM climb GROUP BY leaf),
num AS (SELECT root, row_number() OVER (ORDER BY sum(w) DESC, min(leaf)) - 1 AS cluster FROM top JOIN leaves USING (leaf) GROUP BY root)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM rows JOIN leaves USING (v) JOIN top USING (leaf) JOIN num USING (root)"""


# ------------------------------------------------------------------ the day-ahead tree: four levels of exact splits

TREE_FEATURES = ["year", "income", "persons", "builtarea", "households", "airtemperature", "relativehumidity", "totalprecipitation",
                 "ghi", "sunelevation", "month", "weekday"]
TREE_LEVELS, TREE_LEAF, TREE_CLASSES = 4, 20, range(4)


def _sql_entropy(counts: list[str]) -> str:
    n = f"({' + '.join(counts)})"
    return "(" + " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {n}) * log2({c} / {n}) ELSE 0.0 END" for c in counts) + ")"


def sql_tree_level(i: int) -> dict[str, str]:
    """The best split of every node of level ``i`` and the nodes of the rows below it."""
    def each(text: str) -> str:
        return ", ".join(text.replace("#", str(c)) for c in TREE_CLASSES)
    here = [f"(l{c} + CASE WHEN missing THEN m{c} ELSE 0.0 END)" for c in TREE_CLASSES]
    there = [f"(t{c} - l{c} - CASE WHEN missing THEN m{c} ELSE 0.0 END)" for c in TREE_CLASSES]
    nl, nr, lost = (f"({' + '.join(x)})" for x in (here, there, [f"m{c}" for c in TREE_CLASSES]))
    whole = _sql_entropy([f"t{c}" for c in TREE_CLASSES])
    return {
        f"tot{i}": f"SELECT path, {each('CAST(count(*) FILTER (WHERE y = #) AS DOUBLE) AS t#')} FROM at{i} WHERE split = 'train' GROUP BY path",
        f"cell{i}": f"""SELECT path, f, v, {each('CAST(count(*) FILTER (WHERE y = #) AS DOUBLE) AS c#')}
            FROM at{i} JOIN lg USING (rid) WHERE split = 'train' GROUP BY path, f, v""",
        f"run{i}": f"""SELECT path, f, v, lead(v) OVER w AS after, {each('sum(c#) OVER w AS l#')}
            FROM cell{i} WHERE v IS NOT NULL WINDOW w AS (PARTITION BY path, f ORDER BY v)""",
        f"cand{i}": f"""SELECT run{i}.*, missing, {each('t#')}, {each('coalesce(x.c#, 0.0) AS m#')}
            FROM run{i} JOIN tot{i} USING (path) LEFT JOIN (SELECT * FROM cell{i} WHERE v IS NULL) x ON x.path = run{i}.path AND x.f = run{i}.f
            CROSS JOIN (VALUES (true), (false)) s(missing)""",
        f"best{i}": f"""SELECT path, max({{'score': round({whole} - ({nl} * {_sql_entropy(here)} + {nr} * {_sql_entropy(there)}) / ({nl} + {nr}), 10),
                'nf': -f, 'nc': -CASE WHEN after IS NULL THEN CAST('inf' AS DOUBLE) WHEN (v + after) / 2 < after THEN (v + after) / 2 ELSE v END,
                'm': missing, 'side': CASE WHEN {lost} > 0 THEN missing ELSE {nl} > {nr} END}}) AS b
            FROM cand{i} WHERE {nl} >= {TREE_LEAF} AND {nr} >= {TREE_LEAF} AND {whole} > 1e-9
                AND (CASE WHEN missing THEN {lost} > 0 AND after IS NOT NULL ELSE {lost} > 0 OR after IS NOT NULL END) GROUP BY path""",
        f"at{i + 1}": f"""SELECT a.rid, split, y, a.path || CASE WHEN b.b IS NULL THEN '' WHEN (CASE WHEN lg.v IS NULL THEN b.b.side ELSE lg.v <= -b.b.nc END)
                THEN 'l' ELSE 'r' END AS path
            FROM at{i} a LEFT JOIN best{i} b USING (path) LEFT JOIN lg ON lg.rid = a.rid AND lg.f = -b.b.nf""",
    }


def with_tree() -> str:
    ctes = {
        "sp": f"""SELECT *, row_number() OVER (ORDER BY postalcode, date) AS rid, CASE WHEN {md5_bucket("concat_ws('|', '42', CAST(postalcode AS VARCHAR), CAST(date AS VARCHAR))", "100")} < 20
            THEN 'test' ELSE 'train' END AS split FROM ds""",
        "lg": f"""SELECT rid, unnest(range({len(TREE_FEATURES)})) AS f, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in TREE_FEATURES)}]) AS v FROM sp""",
        "at0": "SELECT rid, split, cluster AS y, '' AS path FROM sp",
    }
    for i in range(TREE_LEVELS):
        ctes |= sql_tree_level(i)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE y = {c}) AS DOUBLE)" for c in TREE_CLASSES)
    splits = " UNION ALL ".join(f"SELECT path, b FROM best{i}" for i in range(TREE_LEVELS))
    paths = " UNION ALL ".join(f"SELECT path, y FROM at{i} WHERE split = 'train' AND length(path) = {i}" for i in range(TREE_LEVELS + 1))
    ctes["nodes"] = f"""SELECT path, s, b, row_number() OVER (ORDER BY path) - 1 AS id
        FROM (SELECT path, [{counts}] AS s FROM ({paths}) GROUP BY path) LEFT JOIN ({splits}) USING (path)"""
    return with_classification().rstrip() + "".join(f",\n{k} AS MATERIALIZED ({v})" for k, v in ctes.items()) + "\n"


_PREDICTED = f"""SELECT postalcode, date, cluster, sp.split, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction,
       list_transform(s, lambda x: x / list_sum(s)) AS probability
FROM sp JOIN at{TREE_LEVELS} USING (rid) JOIN nodes USING (path)"""
ORACLE["tree_classify"] = with_tree() + _PREDICTED
ORACLE["tree_accuracy"] = with_tree() + f"""
SELECT split, count(*) AS n, avg(CAST(prediction = cluster AS DOUBLE)) AS accuracy FROM ({_PREDICTED}) GROUP BY split"""
ORACLE["tree_nodes"] = with_tree() + f"""
SELECT CAST(n.id AS INTEGER) AS node_id, [{', '.join(f"'{c}'" for c in TREE_FEATURES)}][1 - n.b.nf] AS feature, -n.b.nc AS threshold, n.b.score AS gain,
       {_sql_entropy([f'n.s[{c + 1}]' for c in TREE_CLASSES])} AS impurity, CAST(list_position(n.s, list_max(n.s)) - 1 AS DOUBLE) AS prediction,
       n.s AS class_counts, CAST(l.id AS INTEGER) AS left_child, CAST(r.id AS INTEGER) AS right_child, n.b.side AS missing_left
FROM nodes n LEFT JOIN nodes l ON l.path = n.path || 'l' LEFT JOIN nodes r ON r.path = n.path || 'r'"""
