"""Sources: delimited files, sheets, SQLite outputs, weather and model files."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_ready, ship


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A CSV with header and a stated schema; only the wanted columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.select(*columns) if columns else df


def project_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted columns that exist, in the wanted order, each once."""
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def columns_last(df: DataFrame, last: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in last], *[c for c in last if c in df.columns])


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first column that equals a candidate, else one that contains a candidate; without regard to case."""
    low = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    return next((col for c in candidates for col in columns if c.lower() in col.lower()), None)


def read_sheets(spark: SparkSession, sheets: dict[str, str], schema: str, wanted: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(union of sheets staged as delimited files, names of absent ones). Columns a sheet lacks are null."""
    out, absent = None, []
    for name, path in wanted and {n: sheets.get(n) for n in wanted}.items() or sheets.items():
        if path is None or not exists(spark, path):
            absent.append(name)
            continue
        df = read_delimited(spark, path, schema).withColumn("sheet", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return (spark.createDataFrame([], schema + ", sheet string") if out is None else out), absent


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the same schema."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def file_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, stem, size) of files, hidden resource forks left out; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", "")}).filter(~F.col("name").startswith("._"))


def sqlite_query(spark: SparkSession, path: str, pattern: str, sql: str, schema: str, batch: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows of ``sql`` over every SQLite file, errors), both with ``path``.

    Files come through Spark's reader as bytes (up to its two gigabytes) and are opened in memory, so any store
    works and no task writes to a local disk. Rows leave in batches as SQLite yields them. A file that fails
    is a row of errors, behind what it gave before. Each file is read once: both results come from one checkpoint.
    """
    ship(spark), checkpoint_ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    fields = [f.strip().split()[0] for f in schema.split(",")]
    kinds = [to_arrow(f, schema) for f in fields]

    def batch_of(name, rows, error=None):
        n = 1 if error else len(rows)
        columns = [pa.nulls(1, t) if error else pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *columns, pa.array([error] * n, pa.string())], names=["path", *fields, "__error"])

    def run(batches):
        import sqlite3

        for rows in batches:
            for name, content in zip(rows.column(0).to_pylist(), rows.column(1)):
                try:
                    con = sqlite3.connect(":memory:")
                    con.deserialize(content.as_py())
                    found = con.execute(sql)
                    while part := found.fetchmany(batch):
                        yield batch_of(name, part)
                    con.close()
                except (sqlite3.Error, pa.ArrowInvalid, pa.ArrowTypeError) as e:
                    yield batch_of(name, [], str(e) or type(e).__name__)

    staged = files.mapInArrow(run, f"path string, {schema}, __error string").checkpoint()
    return staged.filter("__error IS NULL").drop("__error"), staged.filter("__error IS NOT NULL").select("path", F.col("__error").alias("error"))


def to_arrow(field: str, schema: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return kinds[dict(f.strip().split()[:2] for f in schema.split(","))[field].lower()]


def read_json_config(spark: SparkSession, path: str, required: dict[str, type] | None = None) -> dict:
    """A JSON object, from any store, whose required keys have the required types."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for key, kind in (required or {}).items():
        if not isinstance(data.get(key), kind):
            raise ValueError(f"{path}: {key} must be a {kind.__name__}")
    return data


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file to whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def switch(name: str, default: str = "") -> str | None:
    """A job switch from the environment; blank counts as unset."""
    return os.environ.get(name, default).strip() or None


def first_existing(spark: SparkSession, candidates: list[str], default: str) -> str:
    return next((c for c in candidates if exists(spark, c)), default)


def weather_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """Site of weather files from their LOCATION line: name, latitude, longitude, offset, elevation."""
    parts = F.split(value, ",")
    at = lambda i: F.trim(F.try_element_at(parts, F.lit(i + 1)))
    return lines.filter(F.upper(F.trim(parts[0])) == "LOCATION").select(*[c for c in lines.columns if c != value], at(1).alias("site"), at(6).try_cast("double").alias("lat"), at(7).try_cast("double").alias("lon"), at(8).try_cast("double").alias("utc_offset"), at(9).try_cast("double").alias("elevation"))


def model_objects(texts: DataFrame, text: str, comment: str = "!", end: str = ";") -> DataFrame:
    """One row an object of a text model: ``position``, ``type`` and ``body``; comments and blanks leave."""
    plain = F.regexp_replace(F.col(text), F.lit(f"{comment}[^\\n]*"), F.lit(""))
    others = [c for c in texts.columns if c != text]
    out = texts.select(*others, F.posexplode(F.split(plain, end)).alias("position", "body")).withColumn("body", F.trim(F.regexp_replace("body", r"\s+", " "))).filter("body <> ''")
    return out.withColumn("type", F.trim(F.split("body", ",")[0]))


def object_counts(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys, F.lower("type").alias("type")).agg(F.count("*").alias("n"))


def json_object_counts(texts: DataFrame, text: str) -> DataFrame:
    """(other columns, type, n) of a JSON model: entries under each top-level key."""
    parsed = F.from_json(F.col(text), "map<string,map<string,string>>")
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.explode(parsed).alias("type", "entries")).select(*others, "type", F.size("entries").cast("long").alias("n"))


def choose_member(names: Column, archive: Column, suffix: str) -> Column:
    """Of an archive's members the one with the suffix: the archive's own base name if there, else the only one, else null."""
    good = F.filter(names, lambda n: F.lower(n).endswith(suffix) & ~n.contains("__MACOSX"))
    base = F.lower(F.regexp_replace(F.element_at(F.split(archive, "/"), -1), r"\.[^.]*$", ""))
    own = F.filter(good, lambda n: F.lower(F.regexp_replace(F.element_at(F.split(n, "/"), -1), r"\.[^.]*$", "")) == base)
    return F.when(F.size(own) == 1, own[0]).when(F.size(good) == 1, good[0])


def zip_members(spark: SparkSession, path: str, pattern: str = "*.zip", sniff: int = 128 * 1024) -> DataFrame:
    """(path, names, error, epw, ddy) of every archive under a path: whether any member of a suffix has its kind's content.

    ``epw`` and ``ddy`` are the members whose first ``sniff`` bytes are a weather file's or a design day's.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, good, error = [], {"epw": [], "ddy": []}, None
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        names = z.namelist()
                        for n in names:
                            kind = n.lower().rpartition(".")[2]
                            if kind in good:
                                with z.open(n) as f:
                                    if looks_like(kind, f.read(sniff).decode("utf-8", "replace")):
                                        good[kind].append(n)
                except (zipfile.BadZipFile, OSError, NotImplementedError) as e:
                    error = str(e)
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([names], text), pa.array([error], pa.string()), pa.array([good["epw"]], text), pa.array([good["ddy"]], text)], names=["path", "names", "error", "epw", "ddy"])

    return files.mapInArrow(run, "path string, names array<string>, error string, epw array<string>, ddy array<string>")


def looks_like(kind: str, head: str) -> bool:
    """Whether a member's beginning is a weather file's (LOCATION first) or a design day's."""
    return head.lstrip("\ufeff\r\n ").upper().startswith("LOCATION,") if kind == "epw" else "SIZINGPERIOD:DESIGNDAY" in head.upper()


def is_zip_link(url: Column) -> Column:
    return F.lower(F.trim(url)).endswith(".zip")
