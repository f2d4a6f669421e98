"""Stand-in inputs derived from the driver's test tables.

The test tables hold no energy data.  Each stand-in maps one input of the
load-curve pipeline onto a table the driver provides, with a Spark builder
and the same definition as DuckDB SQL (used by the oracle).  All of them are
aggregations or joins over the whole tables, so their work grows with the
scale factor.

=====================  ======================================================
stand-in               definition
=====================  ======================================================
meter_hourly           events per (event_type, UTC hour): sum(value), distinct users
weather_hourly_rows    lineitem x supplier rows: one weather reading per line
hourly_weather         events per (event_type, UTC hour) with >= 2 events
socio_nation           orders x customer per (nation, year)
socio_events           events per (event_type, year)
area_events            events per event_type: built area and households
buildings_raw          distinct (part, supplier nation) of lineitem x part x supplier
nation_daily           orders x customer per (nation, local order date)
=====================  ======================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.functions.numeric import exact_avg, exact_sum
from wattlane.sources.tables import read_table


def hour_floor(col: str | Column) -> Column:
    """Truncate a naive timestamp to the hour without consulting the session zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


# --------------------------------------------------------------------------- Spark

def meter_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: hourly consumption per user."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "value"])
    return (ev.groupBy(F.col("user_id").cast("string").alias("postalcode"), hour_floor("ts").alias("time"))
              .agg(exact_sum("value").alias("consumption"), F.count(F.lit(1)).alias("contracts")))


def meter_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series and fifty shorter ones: orders, a third of the customers under one code."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    code = F.when(F.col("o_custkey") % 3 == 0, "hot").otherwise((F.col("o_custkey") % 50).cast("string"))
    time = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select(code.alias("postalcode"), time.alias("time"), F.col("o_totalprice").alias("consumption"),
                    F.col("o_orderkey").alias("contracts"))


def event_area(parts: int | None) -> Column:
    """The 'postal code' of an event: its type, or its type and one of ``parts`` user groups."""
    if parts is None:
        return F.col("event_type").alias("postalcode")
    return F.concat("event_type", F.lit("-"), (F.col("user_id") % parts).cast("string")).alias("postalcode")


def meter_hourly(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Hourly consumption per 'postal code' (F-1 layout)."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return (ev.groupBy(event_area(parts), hour_floor("ts").alias("time"))
              .agg(exact_sum("value").alias("consumption"),
                   F.count_distinct("user_id").alias("contracts")))


def weather_hourly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather readings (F-2 layout) keyed by supplier nation and ship instant."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate"])
    su = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    return j.select(
        F.col("s_nationkey").cast("string").alias("postalcode"),
        F.col("l_shipdate").alias("time"),
        F.col("l_quantity").alias("airtemperature"),
        F.col("l_discount").alias("relativehumidity"),
        F.col("l_tax").alias("totalprecipitation"),
        F.col("l_extendedprice").alias("ghi"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sunelevation"),
    )


def hourly_weather(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Hourly weather per event area; without ``parts``, hours with a single event report nothing."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return (ev.groupBy(event_area(parts), hour_floor("ts").alias("time"))
              .agg(F.avg("value").alias("airtemperature"),
                   F.avg("user_id").alias("ghi"),
                   F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") >= (2 if parts is None else 1)).drop("_n"))


def socio_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly socioeconomic rows (F-3): ``year`` is date-like, as at the source."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy(F.col("c_nationkey").cast("string").alias("postalcode"),
                      F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("year"))
             .agg(exact_avg("c_acctbal").alias("income"),
                  F.count_distinct("c_custkey").alias("persons")))


def socio_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return (ev.groupBy(event_area(parts),
                       F.make_date(F.year("ts"), F.lit(1), F.lit(1)).alias("year"))
              .agg(F.avg("value").alias("income"),
                   F.count_distinct("user_id").alias("persons")))


def area_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Per-area cadaster summary (F-6 layout) keyed by event area."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    return (ev.groupBy(event_area(parts))
              .agg(F.count(F.lit(1)).alias("builtarea"),
                   F.count_distinct("user_id").alias("households")))


def buildings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with the GML field names (F-4) before renaming.

    One building per distinct (part, supplier nation) that a line item links;
    large parts (size >= 48) straddle areas and get no postal code.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"])
    pa = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    su = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    pairs = (li.join(su, li.l_suppkey == su.s_suppkey)
               .select(F.col("l_partkey").alias("partkey"), "s_nationkey").distinct())
    j = pairs.join(pa, pairs.partkey == pa.p_partkey)
    return j.select(
        F.concat(F.lit("B"), F.col("partkey").cast("string"), F.lit("-"),
                 F.col("s_nationkey").cast("string")).alias("reference"),
        F.col("p_type").alias("currentUse"),
        F.col("p_brand").alias("conditionOfConstruction"),
        F.col("p_size").alias("value"),
        (F.col("partkey") % 7).cast("int").alias("numberOfDwellings"),
        F.when(F.col("p_size") < 48, F.col("s_nationkey").cast("string")).alias("postalcode"),
    )


def nation_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order revenue rows per nation with the order instant (daily consumption input)."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(F.col("c_nationkey").cast("string").alias("postalcode"),
                    F.col("o_orderdate").alias("time"),
                    F.col("o_totalprice").alias("consumption_filtered"))


# ----------------------------------------------------------------------- DuckDB SQL


def sql_exact_sum(x: str, over: str = "") -> str:
    """Order-free sum: whole numbers, 2^-26 steps and rests are summed apart."""
    step = f"(({x}) - round_even({x}, 0)) * 67108864.0"
    total = lambda e: f"sum({e}){over}"
    return (f"({total(f'round_even({x}, 0)')} + ({total(f'round_even({step}, 0)')}"
            f" + {total(f'{step} - round_even({step}, 0)')}) / 67108864.0)")


def sql_exact_avg(x: str, over: str = "") -> str:
    return f"({sql_exact_sum(x, over)} / CAST(nullif(count({x}){over}, 0) AS DOUBLE))"


SQL = {
    "meter_hourly": f"""
        SELECT event_type AS postalcode, date_trunc('hour', ts) AS time,
               {sql_exact_sum("value")} AS consumption, count(DISTINCT user_id) AS contracts
        FROM events GROUP BY 1, 2""",
    "meter_users": f"""
        SELECT CAST(user_id AS VARCHAR) AS postalcode, date_trunc('hour', ts) AS time,
               {sql_exact_sum("value")} AS consumption, count(*) AS contracts FROM events GROUP BY 1, 2""",
    "meter_skewed": """
        SELECT CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS postalcode,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS time, o_totalprice AS consumption, o_orderkey AS contracts
        FROM orders""",
    "weather_hourly_rows": """
        SELECT CAST(s.s_nationkey AS VARCHAR) AS postalcode, l.l_shipdate AS time,
               l.l_quantity AS airtemperature, l.l_discount AS relativehumidity,
               l.l_tax AS totalprecipitation, l.l_extendedprice AS ghi,
               l.l_extendedprice * (1 - l.l_discount) AS sunelevation
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "hourly_weather": """
        SELECT event_type AS postalcode, date_trunc('hour', ts) AS time,
               avg(value) AS airtemperature, avg(user_id) AS ghi
        FROM events GROUP BY 1, 2 HAVING count(*) >= 2""",
    "socio_nation": f"""
        SELECT CAST(c.c_nationkey AS VARCHAR) AS postalcode,
               make_date(year(o.o_orderdate), 1, 1) AS year,
               {sql_exact_avg("c.c_acctbal")} AS income, count(DISTINCT c.c_custkey) AS persons
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    "socio_events": """
        SELECT event_type AS postalcode, make_date(year(ts), 1, 1) AS year,
               avg(value) AS income, count(DISTINCT user_id) AS persons
        FROM events GROUP BY 1, 2""",
    "area_events": """
        SELECT event_type AS postalcode, count(*) AS builtarea,
               count(DISTINCT user_id) AS households
        FROM events GROUP BY 1""",
    "buildings_raw": """
        SELECT 'B' || CAST(x.partkey AS VARCHAR) || '-' || CAST(x.s_nationkey AS VARCHAR) AS reference,
               p.p_type AS currentUse, p.p_brand AS conditionOfConstruction, p.p_size AS value,
               CAST(x.partkey % 7 AS INTEGER) AS numberOfDwellings,
               CASE WHEN p.p_size < 48 THEN CAST(x.s_nationkey AS VARCHAR) END AS postalcode
        FROM (SELECT DISTINCT l.l_partkey AS partkey, s.s_nationkey
              FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) x
        JOIN part p ON x.partkey = p.p_partkey""",
    "nation_daily_orders": """
        SELECT CAST(c.c_nationkey AS VARCHAR) AS postalcode, o.o_orderdate AS time,
               o.o_totalprice AS consumption_filtered
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
}


def sql_event_parts(parts: int) -> dict[str, str]:
    """The event stand-ins by (event type, user group), under their usual names."""
    names = ("meter_hourly", "hourly_weather", "socio_events", "area_events")
    area = f"event_type || '-' || CAST(user_id % {parts} AS VARCHAR) AS postalcode"
    return {n: SQL[n].replace("event_type AS postalcode", area).replace("HAVING count(*) >= 2", "") for n in names}


def sql_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the named stand-ins (and extra CTEs, in order)."""
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    if extra:
        parts += [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------------ spatial stand-ins

# Four postal polygons on the (c_acctbal, c_custkey % 1000) plane:
# a concave U, a square with a hole, a square overlapping it, a triangle.
POLYGONS = [
    ("25", "25001", [(0, 0), (4000, 0), (4000, 1000), (2500, 1000), (2500, 400), (1500, 400),
                     (1500, 1000), (0, 1000)], []),
    ("25", "25002", [(4000, 0), (8000, 0), (8000, 1000), (4000, 1000)],
     [[(5000, 300), (7000, 300), (7000, 700), (5000, 700)]]),
    ("25", "25003", [(7000, 0), (10000, 0), (10000, 1000), (7000, 1000)], []),
    ("25", "25004", [(-1000, 0), (0, 0), (-1000, 1000)], []),
]
FOOT_HALF_X = 30.0
FOOT_HALF_Y = 10.0


def postal_polygons(spark: SparkSession) -> DataFrame:
    """S5 layout (PROV, CODPOS, exterior ring, holes), already in the cadaster CRS."""
    rows = [(prov, code, [(float(x), float(y)) for x, y in ext],
             [[(float(x), float(y)) for x, y in h] for h in holes])
            for prov, code, ext, holes in POLYGONS]
    return spark.createDataFrame(
        rows, "PROV string, CODPOS string, exterior array<struct<x:double,y:double>>, "
              "holes array<array<struct<x:double,y:double>>>")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building footprints: a 60 x 20 rectangle around (c_acctbal, c_custkey % 1000)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    x, y = F.col("c_acctbal"), (F.col("c_custkey") % 1000).cast("double")
    hx, hy = F.lit(FOOT_HALF_X), F.lit(FOOT_HALF_Y)

    def pt(px, py):
        return F.struct(px.alias("x"), py.alias("y"))
    ring = F.array(pt(x - hx, y - hy), pt(x + hx, y - hy), pt(x + hx, y + hy), pt(x - hx, y + hy))
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cadastralref"),
                    ring.alias("geometry"))


def building_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint buildings with several patches and courtyards: every third one has a second
    patch 100 to the right, every other third an interior ring of half the size."""
    b = footprint_buildings(spark, sf_dir)
    no = F.substring("reference", 2, 20).cast("long") % 3

    def ring(scale: float, right: float) -> Column:
        c = F.struct(((F.col("geometry")[0]["x"] + F.col("geometry")[2]["x"]) / 2).alias("x"),
                     ((F.col("geometry")[0]["y"] + F.col("geometry")[2]["y"]) / 2).alias("y"))
        return F.transform("geometry", lambda p: F.struct(
            (c["x"] + (p["x"] - c["x"]) * scale + right).alias("x"), (c["y"] + (p["y"] - c["y"]) * scale).alias("y")))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    first = F.struct(F.col("geometry").alias("exterior"), F.when(no == 1, F.array(ring(0.5, 0.0))).otherwise(none).alias("holes"))
    second = F.struct(ring(1.0, 100.0).alias("exterior"), none.alias("holes"))
    return b.withColumn("parts", F.when(no == 0, F.array(first, second)).otherwise(F.array(first)))


def nation_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 as text: one rectangle per nation, placed by its least customer key, as WKT."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    x = (F.min("c_custkey") * 37 % 90 * 100 - 500).cast("string")
    x2 = (F.min("c_custkey") * 37 % 90 * 100 + 1000).cast("string")
    text = F.concat(F.lit("POLYGON (("), x, F.lit(" 0, "), x2, F.lit(" 0, "), x2, F.lit(" 1000, "), x, F.lit(" 1000, "), x, F.lit(" 0))"))
    return c.groupBy("c_nationkey").agg(text.alias("wkt")).select(F.col("c_nationkey").cast("string").alias("postalcode"), "wkt")


def polygons_sql() -> str:
    def ring(pts):
        return "[" + ", ".join(f"{{'x': {float(x)}, 'y': {float(y)}}}" for x, y in pts) + "]"
    rows = []
    for prov, code, ext, holes in POLYGONS:
        hs = "[" + ", ".join(ring(h) for h in holes) + "]"
        if not holes:
            hs = "CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[][])"
        rows.append(f"SELECT '{prov}' AS PROV, '{code}' AS CODPOS, {ring(ext)} AS exterior, {hs} AS holes")
    return " UNION ALL ".join(rows)


SQL["postal_polygons"] = polygons_sql()
SQL["footprints"] = f"""
    SELECT 'C' || CAST(c_custkey AS VARCHAR) AS cadastralref,
           [{{'x': c_acctbal - {FOOT_HALF_X}, 'y': CAST(c_custkey % 1000 AS DOUBLE) - {FOOT_HALF_Y}}},
            {{'x': c_acctbal + {FOOT_HALF_X}, 'y': CAST(c_custkey % 1000 AS DOUBLE) - {FOOT_HALF_Y}}},
            {{'x': c_acctbal + {FOOT_HALF_X}, 'y': CAST(c_custkey % 1000 AS DOUBLE) + {FOOT_HALF_Y}}},
            {{'x': c_acctbal - {FOOT_HALF_X}, 'y': CAST(c_custkey % 1000 AS DOUBLE) + {FOOT_HALF_Y}}}]
               AS geometry
    FROM customer"""


def footprint_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints with GML attributes: use from the market segment, a negative
    balance marks a ruin, dwellings and area from the key and balance."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    fp = footprints(spark, sf_dir)
    attrs = c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("reference"),
        F.col("c_mktsegment").alias("currentUse"),
        F.when(F.col("c_acctbal") >= 0, "functional").otherwise("ruin").alias("conditionOfConstruction"),
        (F.col("c_custkey") % 5).cast("int").alias("numberOfDwellings"),
        F.floor(F.abs(F.col("c_acctbal"))).cast("int").alias("value"))
    return attrs.join(fp, attrs.reference == fp.cadastralref).drop("cadastralref")


SQL["footprint_buildings"] = """
    SELECT 'C' || CAST(c.c_custkey AS VARCHAR) AS reference, c.c_mktsegment AS currentUse,
           CASE WHEN c.c_acctbal >= 0 THEN 'functional' ELSE 'ruin' END AS conditionOfConstruction,
           CAST(c.c_custkey % 5 AS INTEGER) AS numberOfDwellings,
           CAST(floor(abs(c.c_acctbal)) AS INTEGER) AS value, f.geometry
    FROM customer c JOIN footprints f ON 'C' || CAST(c.c_custkey AS VARCHAR) = f.cadastralref"""


SQL["building_parts"] = """
    SELECT reference, currentUse, conditionOfConstruction, numberOfDwellings, value, geometry,
           CASE n WHEN 0 THEN [geometry, list_transform(geometry, lambda p: {'x': p.x + 100.0, 'y': p.y})]
                  WHEN 1 THEN [geometry, list_transform(geometry, lambda p: {'x': cx + (p.x - cx) * 0.5, 'y': cy + (p.y - cy) * 0.5})]
                  ELSE [geometry] END AS rings, n
    FROM (SELECT *, CAST(substr(reference, 2) AS BIGINT) % 3 AS n, (geometry[1].x + geometry[3].x) / 2 AS cx,
                 (geometry[1].y + geometry[3].y) / 2 AS cy FROM footprint_buildings) b"""

SQL["nation_rings"] = """
    SELECT CAST(c_nationkey AS VARCHAR) AS postalcode,
           [{'x': x - 500.0, 'y': 0.0}, {'x': x + 1000.0, 'y': 0.0}, {'x': x + 1000.0, 'y': 1000.0}, {'x': x - 500.0, 'y': 1000.0}] AS exterior
    FROM (SELECT c_nationkey, CAST(min(c_custkey) * 37 % 90 * 100 AS DOUBLE) AS x FROM customer GROUP BY c_nationkey) n"""
