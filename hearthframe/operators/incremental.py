"""Restartable batches: upserts, pending sets, resume points, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the stated order."""
    ranked = Window.partitionBy(*keys).orderBy(*(order or keys))
    return df.withColumn("__r", F.row_number().over(ranked)).filter("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], within: list | None = None) -> DataFrame:
    """Rows of both, the newer batch winning; inside a batch the first by ``within`` (default: all columns)."""
    within = within or [F.col(c) for c in old.columns if c not in keys]
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return keep_one(both, keys, [F.desc("__batch"), *within]).drop("__batch")


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def pending(models: DataFrame, finished: DataFrame, on_disk: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """Models still to run: all but (finished and on disk and not forced)."""
    done = finished.select(key).intersect(on_disk.select(key)).join(forced.select(key), key, "left_anti")
    return models.join(done, key, "left_anti")


def resume_prefix(names: DataFrame, outputs: list[DataFrame], key: str) -> DataFrame:
    """The longest prefix, in key order, that all outputs have.

    The prefix ends before the least missing key: an anti-join and a minimum, no ordered scan.
    """
    have = names.select(key).distinct()
    for out in outputs:
        have = have.join(out.select(key).distinct(), key, "left_semi")
    first_gap = names.select(key).distinct().join(have, key, "left_anti").agg(F.min(key).alias("__gap"))
    return have.crossJoin(F.broadcast(first_gap)).filter(F.col("__gap").isNull() | (F.col(key) < F.col("__gap"))).drop("__gap")


def trim_to(df: DataFrame, prefix: DataFrame, key: str) -> DataFrame:
    return df.join(prefix.select(key), key, "left_semi")


def exclude(tables: dict[str, DataFrame], selected: DataFrame, key: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(kept, removed) parts of every table with the key; applying it again changes nothing."""
    chosen = selected.select(key).distinct()
    return {n: t.join(chosen, key, "left_anti") for n, t in tables.items()}, {n: t.join(chosen, key, "left_semi") for n, t in tables.items()}


def unknown_selection(selected: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return selected.select(key).distinct().join(base, key, "left_anti")


def archive(old: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Removed rows added to an archive; rows that it has already stay as they are."""
    return append_new(old, keep_one(removed, keys, [F.col(c) for c in removed.columns if c not in keys]), keys)


def stale(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What should be deleted: existing outputs without a wanted model."""
    return existing.join(wanted.select(key), key, "left_anti")


def run_status(finished, has_output, failed) -> F.Column:
    """Status of a run: exception, failed_job, failed_no_sql or success."""
    return F.when(failed.isNotNull(), "exception").when(~finished, "failed_job").when(~has_output, "failed_no_sql").otherwise("success")


def select_more(chosen: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A review selection (key, place) with new keys added behind, each once; keys it has keep their place."""
    fresh = keep_one(new.select(key, "place"), [key], ["place"]).join(chosen.select(key), key, "left_anti")
    end = chosen.agg(F.coalesce(F.max("place"), F.lit(0)).alias("__end"))
    return chosen.select(key, "place").unionByName(fresh.crossJoin(F.broadcast(end)).select(key, (F.col("place") + F.col("__end")).alias("place")))


def select_less(chosen: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return chosen.join(gone.select(key), key, "left_anti")


def concat(frames: list[DataFrame], schema, spark) -> DataFrame:
    """All rows of frames of one schema; a typed empty table where there are none."""
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f)
    return out


#: Statuses of a conversion (fixed values).
STATUSES = (
    "unknown", "missing_hbjson", "missing_epw", "missing_ddy",
    "skipped_existing", "validated_existing", "invalid_existing",
    "idf_validation_failed", "epjson_not_generated", "epjson_structure_failed", "restored_missing_epjson",
    "epjson_validation_failed", "idf_not_generated", "idf_structure_failed", "restored_missing_idf",
    "converted", "conversion_failed",
)


def conversion_status(**seen: F.Column) -> F.Column:
    """Status of one model's conversion to a pair of files, from what is there and what each step said.

    There: ``model weather design idf epjson``; what the run asks for: ``overwrite need_hvac validate``; the files' own
    checks: ``idf_hvac idf_valid epjson_hvac epjson_valid``; what conversions made: ``made_idf made_epjson``; whether
    translation ``failed``. Booleans, null as false. A whole pair is reused, half a pair restored, unless a
    needed air system is missing in what exists; then, and without files, the model is translated anew.
    """
    s = {k: F.coalesce(v, F.lit(False)) for k, v in seen.items()}
    hvac = lambda kind: ~s["need_hvac"] | s[f"{kind}_hvac"]
    keep = ~s["overwrite"]
    pair, only_idf, only_epjson = keep & s["idf"] & s["epjson"] & hvac("idf") & hvac("epjson"), keep & s["idf"] & ~s["epjson"] & hvac("idf"), keep & s["epjson"] & ~s["idf"] & hvac("epjson")
    reused = F.when(~s["validate"], "skipped_existing").when(s["idf_valid"] & s["epjson_valid"], "validated_existing").otherwise("invalid_existing")
    from_idf = lambda done: F.when(~s["idf_valid"], "idf_validation_failed").when(~s["made_epjson"], "epjson_not_generated").when(~hvac("epjson"), "epjson_structure_failed").otherwise(done)
    from_epjson = F.when(~s["epjson_valid"], "epjson_validation_failed").when(~s["made_idf"], "idf_not_generated").when(~hvac("idf"), "idf_structure_failed").otherwise("restored_missing_idf")
    anew = F.when(s["failed"] | ~s["made_idf"], "conversion_failed").when(~hvac("idf"), "idf_structure_failed").otherwise(from_idf(F.when(s["epjson_valid"], "converted").otherwise("epjson_validation_failed")))
    return (
        F.when(seen["model"].isNull(), "unknown")
        .when(~s["model"], "missing_hbjson")
        .when(~s["weather"], "missing_epw")
        .when(~s["design"], "missing_ddy")
        .when(pair, reused)
        .when(only_idf, from_idf(F.lit("restored_missing_epjson")))
        .when(only_epjson, from_epjson)
        .otherwise(anew)
    )


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """(key, place): distinct values in the order in which they are first seen, from one."""
    from .dims import numbered

    return numbered(keep_one(df, [key], order), order, "place").select(key, "place")
