"""Sample ids of large groups and of rows without a group."""

import duckdb
from pyspark.sql import functions as F

from hearthframe import catalog
from hearthframe.operators import sampling


def customers(spark):
    """Nation 0 has 10,050 customers, nation 1 has five, seven have none."""
    nation = F.when(F.col("id") < 10_050, 0).when(F.col("id") < 10_055, 1)
    return spark.range(10_062).select(F.col("id").alias("c_custkey"), nation.cast("int").alias("c_nationkey"))


def test_query_matches_its_sql_beyond_four_digits(spark, tmp_path):
    customers(spark).unionByName(spark.createDataFrame([(None, 1)], "c_custkey long, c_nationkey int")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT c_custkey, sample_id FROM ({catalog.ORACLES['sample_ids']})").fetchall(), key=repr)
    got = sorted(map(tuple, catalog.QUERIES["sample_ids"](spark, str(tmp_path)).select("c_custkey", "sample_id").collect()), key=repr)
    assert got == want


def test_ids_are_unique_where_the_width_is_free(spark):
    ids = [r.sample_id for r in sampling.sequence_ids(customers(spark), "c_nationkey", ["c_custkey"]).collect()]
    given = [i for i in ids if i is not None]
    assert ids.count(None) == 7 and len(set(given)) == len(given) == 10_055
    assert {"0_00001", "0_10050", "1_0001", "1_0005"} <= set(given)
