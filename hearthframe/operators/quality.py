"""Integrity checks that return offending rows, and joins with a stated cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A required check found offending rows."""


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``n_rows``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct non-null foreign keys without a row in the dimension, with ``n_rows``."""
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return counted.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def inverted_bounds(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.filter(F.col(low) > F.col(high))


def require_none(offenders: DataFrame, what: str, show: int = 10) -> None:
    """Raises with up to ``show`` offending rows if there are any."""
    if rows := offenders.limit(show).collect():
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "m:1") -> DataFrame:
    """A join that first asserts uniqueness of the sides that ``cardinality`` names as one."""
    if cardinality.endswith(":1"):
        require_none(duplicates(right, on), f"right side is not unique on {on}")
    if cardinality.startswith("1:"):
        require_none(duplicates(left, on), f"left side is not unique on {on}")
    return left.join(right, on, how)


def reasons(**rules) -> F.Column:
    """Names of the rules that hold, in order, as an array of strings."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def split_ready(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows without reasons, rows with)."""
    return df.filter(F.size(column) == 0), df.filter(F.size(column) > 0)


def reason_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls and distinct values of columns, one row a column, in one pass."""
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.count("*").alias(f"r{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("n_rows"), F.col(f"n{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)])
    return stats.select(F.explode(rows).alias("p")).select("p.*")
