"""Streams (an extension: the batch operators have no streaming counterpart to match).

Hourly totals under a watermark, and batch-wise upserts of a run log into a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import keep_one
from ..session import remove_folder
from ..sources.sinks import move
from ..sources.tables import exists


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", pattern).parquet(path)


def hourly_totals(events: DataFrame, time: str, groups: list[str], value: str, late: str = "2 hours") -> DataFrame:
    """(groups, hour, n, total); an hour is final once the watermark has passed it."""
    out = events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*groups, F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n) of activity without a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_sink(target: str, keys: list[str]):
    """A ``foreachBatch`` function that logs each batch's rows, one a key; ``upserted`` reads what holds.

    Batch N writes ``v=N`` only, so a batch costs its own size, and one that runs again writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        keep_one(batch, keys, [F.col(c) for c in batch.columns if c not in keys]).write.mode("overwrite").parquet(f"{target}/v={number}")

    return write


def upserted(spark: SparkSession, target: str, keys: list[str], schema) -> DataFrame:
    """The last row of each key over all batches; an empty table before the first."""
    if not exists(spark, target):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", target).parquet(target)
    return keep_one(rows, keys, [F.desc("v")]).drop("v")


def compact(spark: SparkSession, target: str, keys: list[str], upto: int) -> None:
    """Folds the batches up to a finished one into that one's folder; the older folders go.

    The folded rows are written beside and moved in, so a stopped fold loses nothing.
    """
    rows = spark.read.option("basePath", target).parquet(target).filter(F.col("v") <= upto)
    staged = f"{target}__fold_{upto}"
    keep_one(rows, keys, [F.desc("v")]).drop("v").write.mode("overwrite").parquet(staged)
    numbers = [r[0] for r in rows.select("v").distinct().collect()]
    remove_folder(spark, f"{target}/v={upto}")
    move(spark, staged, f"{target}/v={upto}")
    for n in numbers:
        if n != upto:
            remove_folder(spark, f"{target}/v={n}")
