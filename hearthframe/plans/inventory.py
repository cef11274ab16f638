"""One query for each operator that no analysis in the other modules calls: sources, sinks, checks, joins, text, models."""

from __future__ import annotations

import io
import json
import sqlite3
import uuid
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import session
from ..functions import scalars, text
from ..operators import assembly, dims, incremental, quality, rules, sampling, weather
from ..operators import timeseries as ts
from ..sources import sinks, tables
from ..streaming import hourly
from .registry import query, table


def folder(spark, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = folder(spark, "csv")
    sinks.write_table(table(spark, d, "customer"), path, "csv")
    return tables.read_delimited(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("pipe_csv_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def pipe_csv_columns(spark, d):
    path = folder(spark, "pipe")
    table(spark, d, "supplier").write.option("header", True).option("sep", "|").csv(path)
    return tables.read_delimited(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "|", ["s_suppkey", "s_acctbal"])


@query("sheets_union", "SELECT n_nationkey AS key, n_name AS name, 'nation' AS sheet, CAST(1 AS BIGINT) AS absent FROM nation UNION ALL SELECT r_regionkey, r_name, 'region', 1 FROM region")
def sheets_union(spark, d):
    path = folder(spark, "sheets")
    for name in ("nation", "region"):
        t = table(spark, d, name)
        sinks.write_table(t.select(t[0].alias("key"), t[1].alias("name")), f"{path}/{name}", "csv")
    rows, absent = tables.read_sheets(spark, {n: f"{path}/{n}" for n in ("nation", "region", "planet")}, "key int, name string")
    return rows.withColumn("absent", F.lit(len(absent)).cast("long"))


@query("read_if_exists", "SELECT r_regionkey, r_name FROM region")
def read_if_exists(spark, d):
    schema = "r_regionkey int, r_name string"
    return tables.read_if_exists(spark, f"{d}/region.parquet", schema).unionByName(tables.read_if_exists(spark, f"{d}/nothing.parquet", schema))


@query("first_existing_path", "SELECT r_regionkey, r_name FROM region")
def first_existing_path(spark, d):
    return spark.read.parquet(tables.first_existing(spark, [f"{d}/nothing.parquet", f"{d}/region.parquet"], f"{d}/nation.parquet"))


def nations_by_region(spark, d) -> dict[int, list[tuple[int, str]]]:
    """Nations, a dimension of 25 rows, by their region's key."""
    out: dict[int, list[tuple[int, str]]] = {}
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        out.setdefault(r.n_regionkey, []).append((r.n_nationkey, r.n_name))
    return out


@query("sqlite_scan", "SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(1 AS BIGINT) AS n_errors FROM nation WHERE n_nationkey % 2 = 0")
def sqlite_scan(spark, d):
    path = folder(spark, "sqlite")
    for region, nations in nations_by_region(spark, d).items():
        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE zone (key INTEGER, name TEXT)")
        con.executemany("INSERT INTO zone VALUES (?, ?)", nations)
        con.commit()
        tables.put_bytes(spark, f"{path}/{region}.sql", con.serialize())
        con.close()
    tables.put_bytes(spark, f"{path}/broken.sql", b"no database")
    rows, errors = tables.sqlite_query(spark, path, "*.sql", "SELECT key, name FROM zone WHERE key % 2 = 0 ORDER BY key", "key bigint, name string", batch=3)
    stem = F.regexp_extract("path", r"([^/]+)\.sql$", 1)
    return rows.select(stem.alias("file"), "key", "name").crossJoin(F.broadcast(errors.agg(F.count("*").alias("n_errors"))))


@query("file_listing", "SELECT CAST(r_regionkey AS VARCHAR) || '.txt' AS name, CAST(r_regionkey AS VARCHAR) AS stem, CAST(length(r_name) AS BIGINT) AS size FROM region")
def file_listing(spark, d):
    path = folder(spark, "files")
    for r in table(spark, d, "region").collect():
        tables.put_bytes(spark, f"{path}/deep/{r.r_regionkey}.txt", r.r_name.encode())
    tables.put_bytes(spark, f"{path}/._0.txt", b"fork")
    return tables.file_listing(spark, path, "*.txt").select("name", "stem", "size")


ZIPS = "z AS (SELECT r_regionkey, r_regionkey % 2 = 0 AS own FROM region)"


def archives(spark, d):
    """A weather archive a region: even ones have two candidates, one of them of the archive's name."""
    path = folder(spark, "zips")
    for region in nations_by_region(spark, d):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name in [f"{region}.epw", "x.epw"] if region % 2 == 0 else ["x.epw"]:
                z.writestr(name, "LOCATION,Town" if name != "x.epw" or region == 1 else "no weather")
            if region != 3:
                z.writestr("x.ddy", "SizingPeriod:DesignDay,")
        tables.put_bytes(spark, f"{path}/{region}.zip", held.getvalue())
    return path, tables.zip_members(spark, path)


@query(
    "zip_member_choice",
    f"WITH {ZIPS} SELECT CAST(r_regionkey AS VARCHAR) AS archive, CASE WHEN own THEN CAST(r_regionkey AS VARCHAR) ELSE 'x' END || '.epw' AS epw, CASE WHEN own OR r_regionkey = 1 THEN 1 ELSE 0 END AS n_real FROM z",
)
def zip_member_choice(spark, d):
    _, members = archives(spark, d)
    return members.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("archive"), tables.choose_member(F.col("names"), F.col("path"), ".epw").alias("epw"), F.size("epw").alias("n_real"))


@query(
    "archive_preflight",
    """SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'x' END || '.epw' AS epw, CAST(NULL AS VARCHAR) AS issues FROM nation WHERE n_regionkey <> 3
    UNION ALL SELECT n_nationkey, NULL, 'no_single_ddy' FROM nation WHERE n_regionkey = 3""",
)
def archive_preflight(spark, d):
    path, members = archives(spark, d)
    members = members.select(F.regexp_extract("path", r"([^/]+\.zip)$", 1).alias("path"), "names")
    cities = table(spark, d, "nation").select("n_nationkey", F.format_string("%d.zip", F.col("n_regionkey")).alias("path"))
    good, bad = weather.preflight(members, cities)
    found = weather.city_files(cities, good).select("n_nationkey", "epw", F.lit(None).cast("string").alias("issues"))
    return found.unionByName(weather.city_files(cities, bad).select("n_nationkey", F.lit(None).cast("string").alias("epw"), "issues"))


@query("weather_headers", "SELECT s_suppkey, s_name AS site, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier")
def weather_headers(spark, d):
    head = F.concat_ws(",", F.lit(" location"), F.col("s_name"), F.lit("-"), F.lit("X"), F.lit("SRC"), F.lit("1"), F.col("s_suppkey") % 90, F.col("s_suppkey") % 180, F.lit("1.0"), F.lit("100"))
    lines = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(head, F.lit("DESIGN CONDITIONS,1"))).alias("value"))
    return tables.weather_header(lines).select("s_suppkey", "site", "lat", "lon")


@query("station_catalogue", "SELECT s_name AS station, CAST(s_nationkey AS DOUBLE) AS lat, 'http://h/' || CAST(s_suppkey AS VARCHAR) || '.zip' AS url FROM supplier WHERE s_suppkey % 7 <> 0")
def station_catalogue(spark, d):
    name = F.concat(F.lit("http://h/"), F.col("s_suppkey").cast("string"))
    urls = F.explode(F.array(F.concat(name, F.lit(".2007-2021.zip")), F.concat(name, F.lit(".zip "))))
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("n"), F.when(F.col("s_suppkey") % 7 == 0, "north").otherwise(F.col("s_nationkey").cast("string")).alias("la"), F.lit("1").alias("lo"), urls.alias("u"))
    return weather.stations(rows, "n", "la", "lo", "u").select("station", "lat", "url")


@query("zip_links", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def zip_links(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".ZIP "))).when(F.col("page_id") % 3 == 1, F.col("url"))
    return weather.bad_links(table(spark, d, "pages").select("page_id", url.alias("u")), "u").select("page_id")


@query("json_object_counts", "SELECT n_regionkey, 'Zone' AS type, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT n_regionkey, 'Site', CAST(1 AS BIGINT) FROM nation")
def json_object_counts(spark, d):
    zone = F.map_from_entries(F.collect_list(F.struct("n_name", F.lit("x"))))
    texts = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(zone.alias("Zone"), F.create_map(F.lit("a"), F.lit("b")).alias("Site"))).alias("t"))
    return tables.json_object_counts(texts, "t")


@query("json_config", "SELECT 'mass' AS family, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'wood', 2")
def json_config(spark, d):
    path = f"{folder(spark, 'config')}/families.json"
    tables.put_bytes(spark, path, json.dumps({"families": {"mass": ["a", "b", "c"], "wood": ["d", "e"]}, "version": 1}).encode())
    config = tables.read_json_config(spark, path, {"families": dict, "version": int})
    return spark.createDataFrame([(k, len(v)) for k, v in config["families"].items()], "family string, n bigint")


@query("checked_bundle", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def checked_bundle(spark, d):
    path, c, o = folder(spark, "bundle"), table(spark, d, "customer"), table(spark, d, "orders")
    sinks.write_bundle({"customer": c, "orders": o}, path, {"unique customers": quality.duplicates(c, ["c_custkey"])})
    held = sinks.read_bundle(spark, path, ["customer", "orders"])
    return held["customer"].agg(F.lit("customer").alias("name"), F.count("*").alias("n")).unionByName(held["orders"].agg(F.lit("orders").alias("name"), F.count("*").alias("n")))


@query("resume_modes", "SELECT * FROM (VALUES (false, 'ask', 'overwrite'), (true, 'ask', 'continue'), (true, 'continue', 'continue'), (true, 'overwrite', 'overwrite'), (false, 'error', 'overwrite')) AS t(found, asked, mode)")
def resume_modes(spark, d):
    cases = [(False, "ask"), (True, "ask"), (True, "continue"), (True, "overwrite"), (False, "error")]
    return spark.createDataFrame([(f, a, sinks.resume_mode(f, a)) for f, a in cases], "found boolean, asked string, mode string")


@query(
    "review_selection",
    """SELECT c_custkey, c_custkey AS place FROM customer WHERE c_nationkey = 1 AND c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, c_custkey + (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 1) FROM customer WHERE c_nationkey = 2 AND c_custkey % 5 <> 0""",
)
def review_selection(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("place"), "c_nationkey")
    more = incremental.select_more(c.filter("c_nationkey = 1"), c.filter("c_nationkey IN (1, 2)"), "c_custkey")
    return incremental.select_less(more, c.filter("c_custkey % 5 = 0"), "c_custkey")


@query("mosaic_cells", 'SELECT CAST(o_custkey % 50 AS INTEGER) AS "row", CAST(o_custkey % 40 AS INTEGER) AS col, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2')
def mosaic_cells(spark, d):
    from ..operators import spatial

    return spatial.mosaic(grid(spark, d), "tile")


def grid(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select((k % 50).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("tile"))


@query(
    "resampled_grid",
    """WITH m AS (SELECT o_custkey % 50 AS r, o_custkey % 40 AS c, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2)
    SELECT 'fine' AS kind, CAST(2 * r + a AS INTEGER) AS "row", CAST(2 * c + b AS INTEGER) AS col, v AS value FROM m, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)
    UNION ALL SELECT 'coarse', CAST(r // 2 AS INTEGER), CAST(c // 2 AS INTEGER), v FROM m WHERE r % 2 = 1 AND c % 2 = 1""",
)
def resampled_grid(spark, d):
    from ..operators import spatial

    m = spatial.mosaic(grid(spark, d), "tile")
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "row", "col", "value")
    return pick(spatial.resample(m, 2), "fine").unionByName(pick(spatial.resample(m, 0.5), "coarse"))


# Projections, predicates, checks


@query("projected_columns", "SELECT c_mktsegment, c_name, c_custkey FROM customer")
def projected_columns(spark, d):
    found = tables.project_existing(table(spark, d, "customer"), ["c_custkey", "c_age", "c_mktsegment", "c_name", "c_custkey"])
    return tables.columns_last(found, ["c_name", "c_custkey", "c_age"])


@query("found_column", "SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1")
def found_column(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.col(tables.find_column(c.columns, ["building type", "Segment"])).alias("kind")).agg(F.count("*").alias("n"))


@query("sector_predicate", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'household') AND c_nationkey <> 3")
def sector_predicate(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_mktsegment").isin("building", "household") & (F.col("c_nationkey") != 3)).select("c_custkey")


@query("u_value_predicate", "SELECT p_partkey FROM part WHERE p_retailprice / 1000.0 > 0 AND p_retailprice / 1000.0 < 1.0 AND p_size IS NOT NULL")
def u_value_predicate(spark, d):
    u = F.col("p_retailprice") / 1000.0
    return table(spark, d, "part").filter((u > 0) & (u < 1.0) & ~scalars.is_missing(F.col("p_size"))).select("p_partkey")


@query("missing_values", "SELECT p_partkey, p_size % 4 IN (0, 1, 2) AS missing, p_size % 4 IN (0, 1) AS missing_number FROM part")
def missing_values(spark, d):
    m = F.col("p_size") % 4
    words = F.when(m == 1, "").when(m == 2, "  ").when(m == 3, "x")
    numbers = F.when(m == 1, float("nan")).when(m > 1, 1.0)
    return table(spark, d, "part").select("p_partkey", scalars.is_missing(words).alias("missing"), scalars.is_missing(numbers, "double").alias("missing_number"))


@query("number_texts", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS number FROM part")
def number_texts(spark, d):
    s = F.col("p_size")
    raw = F.when(s % 3 == 0, F.concat(F.lit(" "), s.cast("string"), F.lit(",5"))).when(s % 3 == 1, s.cast("string")).otherwise(F.lit("n/a"))
    return table(spark, d, "part").select("p_partkey", scalars.number_or_null(raw).alias("number"))


@query("zone_filter", "SELECT l_orderkey, count(*) AS n_zones FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4 AND bool_and(l_linestatus = 'F')")
def zone_filter(spark, d):
    z = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_zones"), F.bool_and(F.col("l_linestatus") == "F").alias("convex"))
    return z.filter(F.col("n_zones").between(2, 4) & F.col("convex")).drop("convex")


@query("linear_artifacts", "WITH x AS (SELECT p_partkey, p_size / 10.0 AS s, p_retailprice / 60.0 AS l FROM part) SELECT p_partkey, s < 2 AND l / s > 12 AS hard, s < 3 AND l / s > 8 AND NOT (s < 2 AND l / s > 12) AS review FROM x")
def linear_artifacts(spark, d):
    from ..operators import shading

    hard, review = shading.linear_artifact(F.col("p_size") / 10.0, F.col("p_retailprice") / 60.0)
    return table(spark, d, "part").select("p_partkey", hard.alias("hard"), review.alias("review"))


@query("non_residential", "SELECT p_partkey, p_type IN ('ECONOMY', 'SMALL') OR p_size % 5 = 0 AS other FROM part")
def non_residential(spark, d):
    shop = F.when(F.col("p_size") % 5 == 0, "bakery").when(F.col("p_size") % 5 == 1, " No ").when(F.col("p_size") % 5 == 2, "")
    return table(spark, d, "part").select("p_partkey", rules.looks_non_residential(F.col("p_type"), ["economy", "small"], [shop, F.lit("none")]).alias("other"))


@query(
    "domain_and_bounds",
    "SELECT 'domain' AS what, o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'bounds', o_orderkey FROM orders WHERE o_totalprice > 1000 * (o_custkey % 300)",
)
def domain_and_bounds(spark, d):
    o = table(spark, d, "orders").withColumn("high", 1000 * (F.col("o_custkey") % 300))
    pick = lambda df, what: df.select(F.lit(what).alias("what"), "o_orderkey")
    return pick(quality.outside_domain(o, "o_orderstatus", ["F", "O"]), "domain").unionByName(pick(quality.inverted_bounds(o, "o_totalprice", "high"), "bounds"))


@query("full_hvac", "SELECT o_orderkey, o_custkey % 4 > 0 AND o_custkey % 5 >= o_custkey % 4 AND o_custkey % 6 >= o_custkey % 4 AS ok FROM orders")
def full_hvac(spark, d):
    from ..operators import shading

    k = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", shading.has_full_hvac(k % 4, k % 5, k % 6).alias("ok"))


@query("first_geometry", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS geometry FROM part")
def first_geometry(spark, d):
    from ..operators import shading

    p = table(spark, d, "part").withColumn("geom_local", F.when(F.col("p_size") % 3 == 0, F.col("p_name")))
    return p.select("p_partkey", shading.first_geometry(p, ["geom_final", "geom_local", "p_type"]).alias("geometry"))


@query("decomposition_inputs", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'seeds' WHEN p_size % 3 = 0 THEN 'perimeter' WHEN p_size % 2 = 0 THEN 'whole' END AS source FROM part")
def decomposition_inputs(spark, d):
    from ..operators import shading

    s, one = F.col("p_size"), F.array(F.lit(1))
    return table(spark, d, "part").select("p_partkey", shading.decomposition_input(F.when(s % 5 == 0, one), F.when(s % 3 == 0, one), F.when(s % 2 == 0, F.lit(1))).alias("source"))


@query("complete_coverage", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def complete_coverage(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    quality.require_none(quality.orphans(c, "c_nationkey", n, "n_nationkey"), "customers of unknown nations")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"))


# Joins and facts


@query(
    "validated_joins",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def validated_joins(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = quality.join_validated(table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    one = quality.join_validated(table(spark, d, "nation").select("n_nationkey"), n, ["n_nationkey"], cardinality="1:1")
    o = quality.join_validated(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])
    return quality.join_validated(o, one, ["n_nationkey"]).select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "folded_keys",
    """WITH i AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
    f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN 'MACHINERY' ELSE NULL END AS s FROM customer)
    SELECT c_custkey, id FROM f LEFT JOIN i ON lower(f.s) = lower(i.s)""",
)
def folded_keys(spark, d):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, F.col("c_mktsegment")).when(k == 2, "Engines").otherwise("no such")
    fact = table(spark, d, "customer").select("c_custkey", raw.alias("kind"))
    dim = dims.with_ids(table(spark, d, "customer").select("c_mktsegment").distinct(), ["c_mktsegment"])
    found, lost = dims.resolve_folded(fact, dim, "kind", {"Engines": "Machinery"}, "c_mktsegment", "id")
    return found.select("c_custkey", "id").unionByName(lost.select("c_custkey", F.lit(None).cast("long").alias("id")))


@query(
    "hourly_report_facts",
    """SELECT 'V' || CAST(s_nationkey % 3 AS VARCHAR) AS name, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE o_orderstatus = 'F' AND s_suppkey % 2 = 0 AND s_nationkey % 3 < 2 GROUP BY 1""",
)
def hourly_report_facts(spark, d):
    data = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("TimeIndex"), F.col("l_suppkey").alias("ReportDataDictionaryIndex"), F.col("l_quantity").alias("Value"))
    time = table(spark, d, "orders").select(F.col("o_orderkey").alias("TimeIndex"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(1).alias("EnvironmentType"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ReportDataDictionaryIndex"), F.format_string("V%d", F.col("s_nationkey") % 3).alias("Name"), F.when(F.col("s_suppkey") % 2 == 0, "Hourly").otherwise("Daily").alias("ReportingFrequency"))
    return ts.hourly_facts(data, time, names, ["V0", "V1"]).groupBy(F.col("Name").alias("name")).agg(F.count("*").alias("n"), F.sum("Value").alias("total"))


HOURS = "h AS (SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, sum(value) AS total FROM events GROUP BY 1, 2)"


@query("group_peak_hours", f"WITH {HOURS} SELECT event_type, hour, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, hour) AS r FROM h) WHERE r = 1")
def group_peak_hours(spark, d):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    peaks = ts.peak_hours(table(spark, d, "events").withColumn("hour", hour), ["event_type"], "value", ["hour"])
    return peaks.select("event_type", "hour", F.round("total", 4).alias("total"))


@query("null_groups", "SELECT CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS kind, count(*) AS n FROM customer GROUP BY 1")
def null_groups(spark, d):
    return table(spark, d, "customer").groupBy(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("kind")).agg(F.count("*").alias("n"))


@query("qa_aggregates", "SELECT p_brand, count(*) AS n, round(avg(p_size), 3) AS size, round(avg(p_retailprice), 3) AS price, round(avg(p_retailprice / p_size), 3) AS ratio, max(p_retailprice) AS top FROM part GROUP BY 1")
def qa_aggregates(spark, d):
    mean = lambda c, name: F.round(F.avg(c), 3).alias(name)
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), mean("p_size", "size"), mean("p_retailprice", "price"), mean(F.col("p_retailprice") / F.col("p_size"), "ratio"), F.max("p_retailprice").alias("top"))


@query("value_counts", "SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS place FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def value_counts(spark, d):
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return dims.with_ids(counts, [F.desc("n"), "p_type"], "place")  # as many rows as values


@query(
    "integer_counts",
    """WITH v AS (SELECT CASE WHEN p_size < 5 THEN 'under' WHEN p_size > 20 THEN 'over' ELSE CAST(p_size AS VARCHAR) END AS label FROM part WHERE p_size <> 7),
    w AS (SELECT 'under' AS label UNION ALL SELECT 'over' UNION ALL SELECT CAST(unnest(range(5, 21)) AS VARCHAR)) SELECT w.label, count(v.label) AS n FROM w LEFT JOIN v ON w.label = v.label GROUP BY 1""",
)
def integer_counts(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") != 7, F.col("p_size") + 0.2).alias("v"))
    return ts.integer_counts(p, "v", 5, 20, "under", "over")


# Order, pages, unions


@query("mixed_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal >= 0 THEN c_mktsegment END NULLS FIRST, c_acctbal DESC, c_custkey) AS place FROM customer")
def mixed_sort(spark, d):
    kind = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    order = Window.partitionBy("c_nationkey").orderBy(kind.asc_nulls_first(), F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(order).cast("long").alias("place"))


@query("first_ids", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def first_ids(spark, d):
    """A report of the first ids."""
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("one_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def one_page(spark, d):
    return sampling.page(table(spark, d, "customer"), [F.desc("c_acctbal"), "c_custkey"], 3, 20).select("c_custkey")


@query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY ((c_custkey + 42) * 2654435761) % 4294967296, c_custkey LIMIT 40")
def seeded_sample(spark, d):
    return sampling.seeded_subset(table(spark, d, "customer"), "c_custkey", 40).select("c_custkey")


@query("retried_quota", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 5")
def retried_quota(spark, d):
    session.checkpoint_ready(spark)
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    targets = c.select("c_nationkey").distinct().withColumn("target", F.lit(5))

    def draw(short, used):  # two a pass and group
        left = c.join(used, "c_custkey", "left_anti").select("c_nationkey", "c_custkey")
        return sampling.quota_sample(left, ["c_nationkey"], ["c_custkey"], short.withColumn("target", F.least("target", F.lit(2)))).drop("place")

    return sampling.retry(draw, targets, ["c_nationkey"], c.limit(0), "c_custkey")


@query("typed_union", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def typed_union(spark, d):
    pick = lambda n: (lambda t: t.select(t[0].alias("key"), t[1].alias("name")))(table(spark, d, n))
    return incremental.concat([pick("nation"), pick("region")], "key int, name string", spark).unionByName(incremental.concat([], "key int, name string", spark))


@query("first_seen_values", "SELECT c_mktsegment, row_number() OVER (ORDER BY k) AS place FROM (SELECT c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1)")
def first_seen_values(spark, d):
    return incremental.first_seen(table(spark, d, "customer"), "c_mktsegment", ["c_custkey"])


@query("joined_columns", "SELECT c_custkey, concat_ws(' | ', c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, CAST(c_nationkey AS VARCHAR)) AS label FROM customer")
def joined_columns(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" | ", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("label"))


@query("archive_merge", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) GROUP BY 1 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def archive_merge(spark, d):
    o = table(spark, d, "orders")
    return incremental.archive(o.filter("o_orderstatus = 'F' AND o_orderkey % 2 = 0").select("o_custkey", "o_orderkey"), o.filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), ["o_custkey"])


# Text and numbers


@query(
    "text_forms",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5(regexp_replace(trim(text), '[^\p{L}\p{M}\p{Nd}_\-]+', '_', 'g')) AS part, md5(regexp_replace(replace(trim(text), 'the', 'THE'), '\s+', '_', 'g')) AS key,
    md5(CASE WHEN length(text) > 60 THEN left(text, 60) || chr(10) || '... (truncated) ...' ELSE text END) AS short, regexp_replace(source || '_' || CAST(doc_id AS VARCHAR), '[^\w\-]+', '_', 'g') AS sample FROM documents""",
)
def text_forms(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse_whitespace(x)).alias("collapsed"), F.md5(text.path_part(x)).alias("part"), F.md5(text.shown_key(x, {"the": "THE"})).alias("key"), F.md5(text.at_most(x, 60)).alias("short"), text.sample_key(F.col("source"), F.col("doc_id")).alias("sample"))


@query("pattern_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages")
def pattern_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_replace("url", "[0-9]+", "#").alias("masked"))


@query("zone_and_building_ids", "SELECT p_partkey, p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' X' END AS zone, p_brand || '_' || CAST(p_partkey AS VARCHAR) AS building FROM part")
def zone_and_building_ids(spark, d):
    zone = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, " IDEAL LOADS AIR SYSTEM").otherwise(" X"))
    path = F.concat(F.lit("/runs/a.b/"), "p_brand", F.lit("_"), F.col("p_partkey").cast("string"), F.lit("out.sql"))
    return table(spark, d, "part").select("p_partkey", text.zone_id(zone).alias("zone"), text.building_id(path).alias("building"))


@query(
    "positive_shares",
    """WITH s AS (SELECT c_nationkey, lower(c_mktsegment) AS k, count(*) - 12 AS v FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, coalesce(string_agg(k || '=' || CAST(v AS VARCHAR), ';' ORDER BY k) FILTER (v > 0), '') AS shares FROM s GROUP BY 1""",
)
def positive_shares(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.count("*") - 12).cast("double").alias("v"))
    m = s.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), "c_mktsegment"), "v"))).alias("m"))
    entries = F.transform(scalars.positive_shares(F.col("m")), lambda e: F.concat_ws("=", e["key"], e["share"].cast("long").cast("string")))
    return m.select("c_nationkey", F.array_join(entries, ";").alias("shares"))


@query("report_numbers", "SELECT c_nationkey, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 6) AS pct, format('{:,}', CAST(sum(c_custkey) AS BIGINT)) AS total, CAST(count(DISTINCT c_mktsegment) AS INTEGER) AS n_kinds FROM customer GROUP BY 1")
def report_numbers(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("a"), F.count("*").alias("n"), F.sum("c_custkey").alias("s"), F.collect_set("c_mktsegment").alias("k"))
    return c.select("c_nationkey", F.round(scalars.percent(F.col("a"), F.col("n")), 6).alias("pct"), text.grouped_digits(F.col("s")).alias("total"), text.size_or_zero(F.col("k")).alias("n_kinds"))


@query("brief_lists", "WITH s AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' (+' || CAST(len(k) - 3 AS VARCHAR) || ')' ELSE '' END AS brief FROM s")
def brief_lists(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("k"))
    return s.select("o_custkey", text.first_words(F.col("k")).alias("brief"))


@query("json_tags", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' AS tags FROM customer""")
def json_tags(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("none"))).alias("tags"))


@query("rounded_fields", "SELECT p_brand, round(avg(p_retailprice), 2) AS price, round(avg(p_size), 2) AS size FROM part GROUP BY 1")
def rounded_fields(spark, d):
    s = table(spark, d, "part").groupBy("p_brand").agg(F.struct(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size")).alias("s"))
    return s.select("p_brand", *[F.round(f"s.{f}", 2).alias(f) for f in ("price", "size")])


# Models


@query(
    "opaque_constructions",
    """WITH l AS (SELECT p_brand, p_partkey, p_size / 100.0 AS r, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AND p_brand NOT LIKE '%1' AS ins FROM part),
    t AS (SELECT p_brand, sum(r) AS r_all, sum(r) FILTER (ins) AS r_ins, count(*) AS n, count(*) FILTER (ins) AS n_ins FROM l GROUP BY 1),
    x AS (SELECT *, 0.02 + 0.001 * row_number() OVER (ORDER BY p_brand) AS u FROM t), y AS (SELECT *, 1.0 / u - (r_all - r_ins) AS need FROM x WHERE n_ins = 1)
    SELECT p_brand, round(CASE WHEN need <= 0.0001 THEN 0.0001 ELSE need END, 6) AS r_insulation, need <= 0.0001 AS clamped, n AS n_layers, CAST(NULL AS VARCHAR) AS error FROM y
    UNION ALL SELECT p_brand, NULL, NULL, NULL, 'expected one insulation layer, found 0' FROM x WHERE n_ins = 0""",
)
def opaque_constructions(spark, d):
    p = table(spark, d, "part")
    first = (F.col("p_partkey") == F.min("p_partkey").over(Window.partitionBy("p_brand"))) & ~F.col("p_brand").endswith("1")
    layers = p.select(F.col("p_brand").alias("construction"), F.col("p_partkey").alias("position"), F.when(first, "Typical Insulation R").otherwise(F.col("p_type")).alias("material"), (F.col("p_size") / 100.0).alias("r"))
    brands = dims.with_ids(p.select("p_brand").distinct(), ["p_brand"], "i")
    targets = brands.select("p_brand", F.col("p_brand").alias("construction"), (0.02 + 0.001 * F.col("i")).alias("u_target"), F.lit("replace").alias("mode"), F.lit(None).cast("string").alias("donor"), F.lit(None).cast("int").alias("insert_after"))
    good, bad = rules.opaque_constructions(targets, layers, spark.createDataFrame([("Typical Insulation R",)], "material string"), "p_brand")
    none = F.lit(None)
    good = good.select("p_brand", F.round("r_insulation", 6).alias("r_insulation"), "clamped", F.size("layers").cast("long").alias("n_layers"), none.cast("string").alias("error"))
    return good.unionByName(bad.select("p_brand", none.cast("double").alias("r_insulation"), none.cast("boolean").alias("clamped"), none.cast("long").alias("n_layers"), "error"))


@query(
    "construction_sets",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'wall construction lacks its generated material' WHEN p_size % 7 = 0 THEN 'invalid roof construction or material' WHEN p_size % 11 = 0 THEN 'unknown floor material Straw' END AS error,
    CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 11 <> 0 THEN 'cs_' || CAST(p_partkey AS VARCHAR) END AS identifier FROM part""",
)
def construction_sets(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey").cast("string")
    generated = lambda p: F.concat(F.lit(f'{{"identifier": "{p}_'), k, F.lit('"}'))
    listed = lambda p, *more: F.concat(F.lit(f'{{"identifier": "c_{p}", "materials": ["Brick", '), *more, F.lit(f'"{p}_'), k, F.lit('"]}'))
    columns = {f"{p}_material": generated(p) for p in ("wall", "roof", "floor", "window")} | {f"{p}_construction": listed(p) for p in ("wall", "roof", "floor", "window")}
    columns["roof_construction"] = F.when(s % 7 == 0, "{").otherwise(F.replace(listed("roof"), F.lit('"'), F.lit("'")))
    columns["wall_construction"] = F.when(s % 5 == 0, '{"materials": ["Brick"]}').otherwise(listed("wall"))
    columns["floor_construction"] = F.when(s % 11 == 0, listed("floor", F.lit('"Straw", '))).otherwise(listed("floor"))
    b = table(spark, d, "part").select(F.concat(F.lit("town_"), k).alias("sample_id"), "p_partkey", *[v.alias(n) for n, v in columns.items()])
    good, bad = assembly.construction_sets(b, "sample_id", spark.createDataFrame([("Brick",)], "material string"))
    key = F.split_part("sample_id", F.lit("_"), F.lit(2)).cast("long").alias("p_partkey")
    return good.select(key, F.lit(None).cast("string").alias("error"), F.get_json_object("construction_set", "$.identifier").alias("identifier")).unionByName(bad.select(key, F.col("construction_error").alias("error"), F.lit(None).cast("string").alias("identifier")))


@query(
    "energy_programs",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2016::MediumOffice::Closed' WHEN p_size % 3 = 1 THEN '2016::MidriseApartment::Apartment' END AS program, CASE WHEN p_size % 3 < 2 THEN p_size % 3 = 1 AND p_size >= 9 OR p_size % 3 = 0 AND p_size % 2 = 0 END AS fallback FROM part""",
)
def energy_programs(spark, d):
    s = F.col("p_size")
    office = F.when(s % 2 == 0, F.array(F.lit("1980::MediumOffice::Closed"), F.lit("2016::MediumOffice::Closed"))).otherwise(F.array(F.lit("2016::MediumOffice::Closed")))
    home = F.when(s >= 9, F.array(F.lit("2016::HighriseApartment::Apartment"), F.lit("2016::MidriseApartment::Apartment"))).otherwise(F.array(F.lit("2016::MidriseApartment::Apartment")))
    names = F.when(s % 3 == 0, office).when(s % 3 == 1, home).otherwise(F.array(F.lit("2016::Barn::Open")))
    installed = spark.createDataFrame([("2016::MidriseApartment::Apartment",), ("2016::MediumOffice::Closed",)], "program string")
    found, lost = rules.programs(table(spark, d, "part").select("p_partkey", "p_size"), names, installed)
    return found.select("p_partkey", "program", "fallback").unionByName(lost.select("p_partkey", F.lit(None).cast("string").alias("program"), F.lit(None).cast("boolean").alias("fallback")))


@query("window_parameters", "SELECT p_partkey, CAST(CASE WHEN p_size % 6 IN (1, 2, 3) THEN p_size % 6 / 10.0 WHEN p_size % 2 = 0 THEN 0.3 END AS DOUBLE) AS ratio FROM part")
def window_parameters(spark, d):
    kinds = spark.createDataFrame([(1, 0.1, 1.0), (2, 0.2, 1.0), (3, 0.3, 1.5), (5, None, 1.0)], "kind int, ratio double, height double")
    b = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 6).alias("kind"), "p_size")
    found, lost = assembly.window_parameters(b, kinds, "kind", F.col("p_size") % 2 == 0, ["ratio", "height"])
    return found.select("p_partkey", "ratio").unionByName(lost.select("p_partkey", F.lit(None).cast("double").alias("ratio")))


@query("export_split", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 10 = 0 THEN 'no_zones' END, CASE WHEN p_size % 4 = 0 THEN 'no_windows' END) AS why, p_size % 10 <> 0 AND p_size % 4 <> 0 AS kept FROM part")
def export_split(spark, d):
    s = F.col("p_size")
    models = table(spark, d, "part").select("p_partkey", assembly.export_reasons(F.when(s % 10 == 0, 0).otherwise(1), s % 4, F.lit(True)).alias("why"))
    kept, index = assembly.split_valid(models, "why")
    return kept.select("p_partkey", F.array_join("why", "; ").alias("why"), F.lit(True).alias("kept")).unionByName(index.select("p_partkey", "why", F.lit(False).alias("kept")))


SEEN = "model weather design idf epjson overwrite need_hvac validate idf_hvac idf_valid epjson_hvac epjson_valid made_idf made_epjson failed".split()
BITS = {n: 2 + (i * 7) % 29 if i < 3 else i + 2 for i, n in enumerate(SEEN)}


@query(
    "conversion_statuses",
    f"""WITH b AS (SELECT o_orderkey, {", ".join(f"o_custkey % {m} {'<> 0' if n in ('model', 'weather', 'design') else f'< {m} // 2'} AS {n}" for n, m in BITS.items())} FROM orders),
    h AS (SELECT *, NOT need_hvac OR idf_hvac AS ih, NOT need_hvac OR epjson_hvac AS eh FROM b)
    SELECT o_orderkey, CASE WHEN NOT model THEN 'missing_hbjson' WHEN NOT weather THEN 'missing_epw' WHEN NOT design THEN 'missing_ddy'
    WHEN NOT overwrite AND idf AND epjson AND ih AND eh THEN CASE WHEN NOT validate THEN 'skipped_existing' WHEN idf_valid AND epjson_valid THEN 'validated_existing' ELSE 'invalid_existing' END
    WHEN NOT overwrite AND idf AND NOT epjson AND ih THEN CASE WHEN NOT idf_valid THEN 'idf_validation_failed' WHEN NOT made_epjson THEN 'epjson_not_generated' WHEN NOT eh THEN 'epjson_structure_failed' ELSE 'restored_missing_epjson' END
    WHEN NOT overwrite AND epjson AND NOT idf AND eh THEN CASE WHEN NOT epjson_valid THEN 'epjson_validation_failed' WHEN NOT made_idf THEN 'idf_not_generated' WHEN NOT ih THEN 'idf_structure_failed' ELSE 'restored_missing_idf' END
    WHEN failed OR NOT made_idf THEN 'conversion_failed' WHEN NOT ih THEN 'idf_structure_failed' WHEN NOT idf_valid THEN 'idf_validation_failed' WHEN NOT made_epjson THEN 'epjson_not_generated' WHEN NOT eh THEN 'epjson_structure_failed'
    WHEN epjson_valid THEN 'converted' ELSE 'epjson_validation_failed' END AS status FROM h""",
)
def conversion_statuses(spark, d):
    k = F.col("o_custkey")
    seen = {n: (k % m != 0) if n in ("model", "weather", "design") else (k % m < m // 2) for n, m in BITS.items()}
    return table(spark, d, "orders").select("o_orderkey", incremental.conversion_status(**seen).alias("status"))


# Streams


def streamed(spark, d, name: str, columns: list[str]):
    """A driver's table as a stream, of a file or a folder."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = hourly.event_stream(spark, f"{d}/{name}.parquet" if whole else d, schema, pattern="*.parquet" if whole else f"{name}.parquet")
    return rows.select(*columns)


@query("streamed_hours", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_hours(spark, d):
    events = streamed(spark, d, "events", ["event_type", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    path = folder(spark, "stream")
    out = hourly.hourly_totals(events, "ts", ["event_type"], "value")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")
    out.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("streamed_upserts", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def streamed_upserts(spark, d):
    events = streamed(spark, d, "events", ["user_id", "event_id"])
    path = folder(spark, "upserts")
    events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(hourly.upsert_sink(f"{path}/log", ["user_id"])).start().awaitTermination()
    return hourly.upserted(spark, f"{path}/log", ["user_id"], "user_id bigint, event_id bigint")


@query(
    "activity_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, k""",
)
def activity_sessions(spark, d):
    out = hourly.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")
