"""Queries without a twin run over whole tables."""

import pytest
from pyspark.sql import functions as F

from hearthframe import catalog


@pytest.fixture
def parts(spark, tmp_path):
    """A part table on both sides of key 300."""
    spark.range(296, 306).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") + 700.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_hole_split_takes_every_shape(spark, parts):
    want = {}
    for r in spark.read.parquet(f"{parts}/part.parquet").collect():
        full = (r.p_size + 4) * r.p_retailprice / 100
        want[r.p_partkey] = round(full * (0.75 if r.p_size % 2 else 1) - full / 16, 4)
    got = {r.p_partkey: r.area for r in catalog.QUERIES["hole_split"](spark, parts).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_rows_of_buildings_are_whole(spark, parts):
    every = set(range(296, 306))
    assert {r.p_partkey for r in catalog.QUERIES["window_candidates"](spark, parts).collect()} == every
    assert {r.p_partkey for r in catalog.QUERIES["visible_edges"](spark, parts).collect()} == every - {305}  # the last has no neighbour
