"""Time series, reports, histograms and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import timeseries as ts
from .registry import query, table

HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M')"
LOADS = f"l AS (SELECT event_type, user_id, {HOUR} AS hour, round(sum(value), 4) AS v FROM events GROUP BY event_type, user_id, {HOUR})"
GROUPS = "g AS (SELECT event_type, hour, round(sum(v), 4) AS total FROM l GROUP BY event_type, hour), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, hour) AS r FROM g) WHERE r = 1)"


def loads(spark, d):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    return table(spark, d, "events").groupBy("event_type", "user_id", hour.alias("hour")).agg(F.round(F.sum("value"), 4).alias("v"))


@query(
    "peak_summary",
    f"""WITH {LOADS}, {GROUPS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY v DESC, hour) AS r FROM l) WHERE r = 1)
    SELECT 'own' AS kind, event_type, user_id, hour, v AS value FROM o
    UNION ALL SELECT 'group', event_type, NULL, hour, total FROM h
    UNION ALL SELECT 'coincident', l.event_type, l.user_id, l.hour, l.v FROM l JOIN h ON l.event_type = h.event_type AND l.hour = h.hour""",
)
def peak_summary(spark, d):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    return ts.peak_summary(table(spark, d, "events").withColumn("hour", hour), "event_type", "user_id", "hour", "value", digits=4)


@query("coincident_peak_snapshot", f"WITH {LOADS}, {GROUPS} SELECT l.event_type, l.user_id, l.hour, l.v, h.total FROM l JOIN h ON l.event_type = h.event_type AND l.hour = h.hour")
def coincident_peak_snapshot(spark, d):
    rows = loads(spark, d)
    hours = rows.groupBy("event_type", "hour").agg(F.round(F.sum("v"), 4).alias("total"))
    return rows.join(ts.zone_peaks(hours, ["event_type"], "total", ["hour"]), ["event_type", "hour"]).select("event_type", "user_id", "hour", "v", "total")


@query(
    "hourly_long_pivot",
    """SELECT user_id, CAST(month(ts) * 10000 + day(ts) * 100 + hour(ts) + 1 AS INTEGER) AS month_day_hour,
    round(coalesce(sum(CASE WHEN event_type = 'click' THEN value END), 0), 4) AS click, round(coalesce(sum(CASE WHEN event_type = 'view' THEN value END), 0), 4) AS view
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
)
def hourly_long_pivot(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "view"))
    rows = rows.withColumn("month_day_hour", text.month_day_hour(F.month("ts"), F.day("ts"), F.hour("ts") + 1))
    wide = ts.wide_hours(rows, ["user_id", "month_day_hour"], "event_type", ["click", "view"], "value")
    return wide.select("user_id", "month_day_hour", F.round("click", 4).alias("click"), F.round("view", 4).alias("view"))


END_USE = "CASE WHEN p_size % 5 = 0 THEN p_type || ':General' WHEN p_size % 5 = 1 THEN p_type ELSE p_type || ':' || split_part(p_name, ' ', 2) END"


@query(
    "end_use_labels",
    f"""WITH r AS (SELECT p_brand, {END_USE} AS name, CASE p_size % 4 WHEN 0 THEN 'GJ' WHEN 1 THEN 'kWh' WHEN 2 THEN 'm3' ELSE 'MJ' END AS unit, CASE WHEN p_size % 7 = 0 THEN '0' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS value FROM part),
    e AS (SELECT p_brand, CASE WHEN contains(name, ':') AND split_part(name, ':', 2) <> 'General' THEN name ELSE split_part(name, ':', 1) END AS end_use,
      CAST(value AS DOUBLE) * CASE unit WHEN 'GJ' THEN 1000.0 / 3.6 WHEN 'kWh' THEN 1.0 WHEN 'MJ' THEN 1.0 / 3.6 END AS kwh FROM r)
    SELECT p_brand, end_use, round(sum(kwh), 2) AS kwh FROM e WHERE kwh IS NOT NULL AND kwh <> 0 GROUP BY 1, 2""",
)
def end_use_labels(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    name = F.when(size % 5 == 0, F.concat("p_type", F.lit(":General"))).when(size % 5 == 1, F.col("p_type")).otherwise(F.concat_ws(":", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))))
    unit = F.when(size % 4 == 0, "GJ").when(size % 4 == 1, "kWh").when(size % 4 == 2, "m3").otherwise("MJ")
    value = F.when(size % 7 == 0, "0").otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    report = p.select("p_brand", name.alias("name"), unit.alias("unit"), value.alias("value"))
    return ts.end_uses(report, ["p_brand"], "name", "unit", "value").withColumn("kwh", F.round("kwh", 2))


@query(
    "end_use_wide",
    """SELECT p_brand, round(coalesce(sum(CASE WHEN p_type = 'ECONOMY' THEN p_retailprice END), 0), 2) AS end_use_economy, round(coalesce(sum(CASE WHEN p_type = 'LARGE' THEN p_retailprice END), 0), 2) AS end_use_large FROM part GROUP BY p_brand""",
)
def end_use_wide(spark, d):
    uses = table(spark, d, "part").select("p_brand", F.col("p_type").alias("end_use"), F.col("p_retailprice").alias("kwh"))
    wide = ts.end_uses_wide(uses, ["p_brand"], ["ECONOMY", "LARGE"])
    return wide.select("p_brand", *[F.round(c, 2).alias(c) for c in wide.columns[1:]])


@query(
    "eui_total_vs_ref_area",
    """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS kwh, count(*) * 1.0 AS total_area, count(*) FILTER (o_orderstatus = 'F') * 1.0 AS reference FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round(kwh / total_area, 7) AS by_total, round(kwh / coalesce(nullif(reference, 0), total_area), 7) AS by_reference FROM a""",
)
def eui(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("kwh"), F.count("*").cast("double").alias("total"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("ref"))
    total, ref = ts.intensities(F.col("kwh"), F.col("total"), F.col("ref"))
    return a.select("o_custkey", F.round(total, 7).alias("by_total"), F.round(ref, 7).alias("by_reference"))


@query(
    "unit_conversion",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 1000.0 WHEN 'R' THEN 1.0 / 3.6 END), 2) AS kwh FROM lineitem GROUP BY 1, 2",
)
def unit_conversion(spark, d):
    unit = F.element_at(scalars.literal_map({"A": "kWh", "N": "MWh", "R": "MJ"}), F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", scalars.to_kwh(F.col("l_quantity"), unit).alias("kwh"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("kwh"), 2).alias("kwh"))


@query("zone_rollup", "SELECT l_orderkey, count(*) AS n_zones, max(l_quantity) AS max_load, round(sum(l_quantity), 2) AS sum_load FROM lineitem GROUP BY l_orderkey")
def zone_rollup(spark, d):
    return ts.zone_rollup(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").withColumn("sum_load", F.round("sum_load", 2))


@query("union_of_keys", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def union_of_keys(spark, d):
    named = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return ts.union_of_keys([named("customer", "c_nationkey"), named("supplier", "s_nationkey"), named("nation", "n_nationkey")], "k")


@query(
    "histogram_cut",
    """WITH b(bin, low, high) AS (VALUES (0, 0.0, 10000.0), (1, 10000.0, 30000.0), (2, 30000.0, 60000.0), (3, 60000.0, 100000.0), (4, 100000.0, 1000000.0))
    SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(l_orderkey) AS n FROM b LEFT JOIN lineitem ON l_extendedprice > low AND l_extendedprice <= high GROUP BY 1, 2, 3""",
)
def histogram_cut(spark, d):
    return ts.histogram(table(spark, d, "lineitem"), "l_extendedprice", [0, 10_000, 30_000, 60_000, 100_000, 1_000_000])


@query("series_stats", "SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def series_stats(spark, d):
    out = ts.series_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


@query(
    "star_facts",
    """SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2""",
)
def star_facts(spark, d):
    dims = table(spark, d, "nation").join(table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(
    "sim_time_text",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS text_time, CAST(month(ts) * 10000 + day(ts) * 100 + hour(ts) AS INTEGER) AS code FROM events",
)
def sim_time_text(spark, d):
    at = F.col("ts")
    return table(spark, d, "events").select("event_id", text.sim_time(F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at)).alias("text_time"), text.month_day_hour(F.month(at), F.day(at), F.hour(at)).alias("code"))
