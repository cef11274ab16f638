"""Weather stations and archives of cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_preference
from ..sources.tables import choose_member, is_zip_link


def stations(catalogue: DataFrame, name: str, lat: str, lon: str, url: str) -> DataFrame:
    """One row a station and place with its preferred archive: no year range, then short, then by name."""
    rows = catalogue.select(F.trim(name).alias("station"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"), F.trim(url).alias("url"))
    rows = rows.filter("lat IS NOT NULL AND lon IS NOT NULL AND url <> ''")
    return rows.groupBy("station", "lat", "lon").agg(F.min(url_preference(F.col("url"))).alias("m")).select("station", "lat", "lon", F.col("m.url").alias("url"))


def bad_links(rows: DataFrame, url: str) -> DataFrame:
    return rows.filter(F.col(url).isNull() | ~is_zip_link(F.col(url)))


def preflight(archives: DataFrame, wanted: DataFrame, path: str = "path", names: str = "names") -> tuple[DataFrame, DataFrame]:
    """(archives with their ``epw`` and ``ddy`` members, issues).

    ``wanted``: column ``path``. Issues: an archive that is missing, or lacks exactly one usable member.
    """
    found = wanted.select(path).distinct().join(archives.select(path, names), path, "left")
    members = found.withColumns({"epw": choose_member(F.col(names), F.col(path), ".epw"), "ddy": choose_member(F.col(names), F.col(path), ".ddy")})
    issue = F.when(F.col(names).isNull(), F.array(F.lit("archive_missing"))).otherwise(F.array_compact(F.array(F.when(F.col("epw").isNull(), F.lit("no_single_epw")), F.when(F.col("ddy").isNull(), F.lit("no_single_ddy")))))
    checked = members.withColumn("issues", issue)
    return checked.filter(F.size("issues") == 0).drop("issues", names), checked.filter(F.size("issues") > 0).select(path, F.array_join("issues", "; ").alias("issues"))


def city_files(cities: DataFrame, good: DataFrame, path: str = "path") -> DataFrame:
    """Every city of an archive with the archive's members: one archive serves many cities."""
    return cities.join(good, path)
