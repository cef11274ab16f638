"""Hourly loads and tabular reports: annual totals, zone peaks, coincident building peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_number, to_kwh
from ..functions.text import end_use_label


def hourly_facts(data: DataFrame, time: DataFrame, names: DataFrame, wanted: list[str], frequency: str = "Hourly", environment: int = 3) -> DataFrame:
    """Report values with their time and variable: the star join, the small sides filtered first."""
    t = time.filter(F.col("EnvironmentType") == environment) if "EnvironmentType" in time.columns else time
    n = names.filter(F.col("Name").isin(wanted) & (F.col("ReportingFrequency") == frequency))
    return data.join(n, "ReportDataDictionaryIndex").join(t, "TimeIndex")


def zone_peaks(facts: DataFrame, groups: list[str], value: str, order: list) -> DataFrame:
    """The row of the largest value of each group, the earliest on ties."""
    ranked = Window.partitionBy(*groups).orderBy(F.desc(value), *order)
    return facts.withColumn("__r", F.row_number().over(ranked)).filter("__r = 1").drop("__r")


def peak_hours(facts: DataFrame, groups: list[str], value: str, time: list[str], digits: int | None = None) -> DataFrame:
    """For each group the time of the largest sum over its members, with ``total`` (rounded, if asked for); the earliest on ties."""
    total = F.sum(value) if digits is None else F.round(F.sum(value), digits)
    return zone_peaks(facts.groupBy(*groups, *time).agg(total.alias("total")), groups, "total", time)


def coincident(facts: DataFrame, peaks: DataFrame, groups: list[str], time: list[str]) -> DataFrame:
    """The members' values at their group's peak hour."""
    return facts.join(peaks.select(*groups, *time), [*groups, *time])


def peak_summary(facts: DataFrame, group: str, member: str, time: str, value: str, digits: int | None = None) -> DataFrame:
    """Own peaks of members and coincident peaks of groups, as rows of (kind, group, member, time, value).

    ``digits`` rounds sums before they are compared, so that the order of adding decides nothing.
    """
    total = F.sum(value) if digits is None else F.round(F.sum(value), digits)
    loads = facts.groupBy(group, member, time).agg(total.alias("v"))
    own = zone_peaks(loads, [group, member], "v", [time])
    hours = peak_hours(loads, [group], "v", [time], digits)
    pick = lambda df, kind, who, v: df.select(F.lit(kind).alias("kind"), F.col(group), who.alias(member), F.col(time), F.col(v).alias("value"))
    nobody = F.lit(None).cast(facts.schema[member].dataType)
    return pick(own, "own", F.col(member), "v").unionByName(pick(hours, "group", nobody, "total")).unionByName(pick(coincident(loads, hours, [group], [time]), "coincident", F.col(member), "v"))


def wide_hours(facts: DataFrame, keys: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """One row a key, one summed column a variable, zero where a variable has no value."""
    sums = [F.coalesce(F.sum(F.when(F.col(name) == v, F.col(value))), F.lit(0.0)).alias(v) for v in values]
    return facts.groupBy(*keys).agg(*sums)


def end_uses(report: DataFrame, keys: list[str], row: str, unit: str, value: str) -> DataFrame:
    """(keys, end_use, kwh) from a text report: energy units only, zeros skipped, labels joined."""
    kwh = to_kwh(parse_number(F.col(value)), F.col(unit))
    rows = report.select(*keys, end_use_label(F.col(row)).alias("end_use"), kwh.alias("kwh")).filter("kwh IS NOT NULL AND kwh <> 0")
    return rows.groupBy(*keys, "end_use").agg(F.sum("kwh").alias("kwh"))


def end_uses_wide(uses: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Columns ``end_use_*``; missing ones are zero. Names come from the data (a bounded list) if not given."""
    names = names or sorted(r[0] for r in uses.select("end_use").distinct().collect())
    safe = lambda n: "end_use_" + "".join(c if c.isalnum() else "_" for c in n.lower())
    return uses.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("end_use") == n, F.col("kwh"))), F.lit(0.0)).alias(safe(n)) for n in names])


def intensities(kwh, total_area, reference_area):
    """(by total area, by conditioned-first reference area); null for no area."""
    return F.try_divide(kwh, F.nullif(total_area, F.lit(0.0))), F.try_divide(kwh, F.nullif(F.coalesce(F.nullif(reference_area, F.lit(0.0)), total_area), F.lit(0.0)))


def zone_rollup(zones: DataFrame, key: str, load: str) -> DataFrame:
    """Zones, largest and summed load of each building; zero where there is no load."""
    return zones.groupBy(key).agg(F.count("*").alias("n_zones"), F.coalesce(F.max(load), F.lit(0.0)).alias("max_load"), F.coalesce(F.sum(load), F.lit(0.0)).alias("sum_load"))


def union_of_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """All keys of several tables, once each."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) for bins (low, high], empty bins included; values outside leave."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    which = F.coalesce(*[F.when((F.col(value) > a) & (F.col(value) <= b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    counts = df.select(which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def integer_counts(df: DataFrame, value: str, low: int, high: int, under: str | None = None, over: str | None = None) -> DataFrame:
    """(label, n) of rounded values, one row an integer from ``low`` to ``high``, empty ones too, and tails where they have a label."""
    whole = F.rint(F.col(value)).cast("long")
    label = F.when(whole < low, F.lit(under)).when(whole > high, F.lit(over)).otherwise(whole.cast("string"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    names = [*([under] if under else []), *map(str, range(low, high + 1)), *([over] if over else [])]
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "label string")
    return wanted.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def series_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))
