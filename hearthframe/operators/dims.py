"""Dimensions and facts: surrogate ids, key resolution, merging of reports, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .quality import require_none


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with 1..N in a stated, total order, without passing all rows through one task.

    Rows are dealt to ranges of the order and written (``checkpoint()``); each range is numbered by itself, and the
    ranges' sizes, one row each, give where it starts.
    """
    checkpoint_ready(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__place") + F.col("__start")).cast("long")).drop("__range", "__place", "__start")


def with_ids(dim: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Ids 1..N in a stated order."""
    return numbered(dim, order, name)


def resolve(fact: DataFrame, dim: DataFrame, key: str, id_name: str, dim_key: str, dim_id: str = "id") -> DataFrame:
    """Adds a dimension's id; null where the key is unknown. Small dimensions are broadcast by size."""
    return fact.join(dim.select(F.col(dim_key).alias(key), F.col(dim_id).alias(id_name)), key, "left")


def resolve_folded(fact: DataFrame, dim: DataFrame, key: str, synonyms: dict[str, str], dim_key: str, id_name: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows with the id, unmatched rows); keys are compared in lower case after synonyms."""
    known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]) if synonyms else None
    folded = F.lower(F.col(key)) if known is None else F.lower(F.coalesce(F.try_element_at(known, F.col(key)), F.col(key)))
    right = dim.select(F.lower(F.col(dim_key)).alias("__key"), F.col("id").alias(id_name))
    left = fact.withColumn("__key", folded)
    return left.join(right, "__key").drop("__key"), left.join(right, "__key", "left_anti").drop("__key")


def mean_of_reports(fact: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key: the mean of repeated reports; keys with a null leave."""
    return fact.dropna(subset=keys).groupBy(*keys).agg(F.avg(value).alias(value))


def shares_map(fact: DataFrame, keys: list[str], name: str, share: str, order: str, out: str) -> DataFrame:
    """A map of shares for each key; of repeated names the last by ``order`` counts. Null keys form a group."""
    last = fact.groupBy(*keys, name).agg(F.max_by(share, order).alias("__v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("__v").alias("v"))))).alias(out))


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge on keys; keys with a null leave."""
    return left.dropna(subset=keys).join(right.dropna(subset=keys), keys, "full_outer")


def update(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """``base`` with non-null values of ``new``; unknown keys raise when ``strict``."""
    if strict:
        require_none(new.join(base, keys, "left_anti").select(*keys), "update of unknown keys")
    fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(fresh, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def dominant(fact: DataFrame, keys: list[str], name: str, share: str) -> DataFrame:
    """The name of the largest share for each key, ties to the alphabetically first, and its share."""
    best = F.min(F.struct((-F.col(share)).alias("a"), F.col(name).alias("b")))
    return fact.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.b").alias(name), (-F.col("m.a")).alias(share))


def wide_by(fact: DataFrame, keys: list[str], name: str, values: list[str], columns: list[str]) -> DataFrame:
    """One row a key and one column for each (value of ``name``, column); a repeated (key, name) raises."""
    require_none(fact.groupBy(*keys, name).count().filter("count > 1"), f"repeated {keys + [name]}")
    aggs = [F.max(F.when(F.col(name) == v, F.col(c))).alias(f"{v.lower()}_{c}") for v in values for c in columns]
    return fact.groupBy(*keys).agg(*aggs)
