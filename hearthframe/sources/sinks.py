"""Sinks: tables, bundles of tables that appear whole or not at all, appended batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import append_new
from ..operators.quality import require_none
from ..session import remove_folder
from .tables import exists


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None, codec: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if codec:
        writer = writer.option("compression", codec)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def move(spark: SparkSession, a: str, b: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(a).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(a), path(b)):
        raise OSError(f"cannot move {a} to {b}")


def write_bundle(tables: dict[str, DataFrame], path: str, checks: dict[str, DataFrame] | None = None) -> None:
    """All tables under one folder, after all checks; the folder is staged and then renamed."""
    spark = next(iter(tables.values())).sparkSession
    for what, offenders in (checks or {}).items():
        require_none(offenders, what)
    staged, old = f"{path}__{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            write_table(df, f"{staged}/{name}")
        if exists(spark, path):
            move(spark, path, old)
        move(spark, staged, path)
    finally:
        for leftover in (staged, old):
            if exists(spark, leftover) and exists(spark, path):
                remove_folder(spark, leftover)


def read_bundle(spark: SparkSession, path: str, required: list[str]) -> dict[str, DataFrame]:
    """The required tables of a bundle; a missing one raises."""
    if missing := [n for n in required if not exists(spark, f"{path}/{n}")]:
        raise FileNotFoundError(f"{path} lacks {missing}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in required}


def append_bundle(new: dict[str, DataFrame], path: str, key: str) -> None:
    """Adds rows whose key the bundle has not, table by table, and writes the bundle whole."""
    spark = next(iter(new.values())).sparkSession
    if not exists(spark, path):
        return write_bundle(new, path)
    old = read_bundle(spark, path, list(new))
    return write_bundle({n: append_new(old[n], df, [key]) for n, df in new.items()}, path)


def resume_mode(found: bool, asked: str, answer: str | None = None) -> str:
    """continue, overwrite or error, given whether outputs exist. ``ask`` takes an answer; none, or a blank one, continues."""
    if asked not in ("continue", "overwrite", "error", "ask"):
        raise ValueError(f"unknown resume mode {asked!r}")
    if not found:
        return "overwrite"
    if asked == "error":
        raise FileExistsError("outputs exist; choose continue or overwrite")
    if asked == "ask":
        return "continue" if (answer or "").strip().lower() in ("", "y", "yes") else "overwrite"
    return asked
