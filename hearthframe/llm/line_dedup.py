"""Line dedup by site-relative frequency.

A host's pages are its distinct texts, so copies of a page are no evidence. A line is boilerplate of its
host when the pages that hold it, divided by all pages of the host, exceed ``ratio`` by more
than chance: the score test of a share, (held - ratio * pages)^2 > spread * pages * ratio *
(1 - ratio), and when at least two pages hold it. The test needs no least size of a host: the fewer
pages, the larger the share that proves anything. Only built-in functions run.

Lines travel as two 64-bit hashes and never as text. The boilerplate of a host is a short
list: at most (lines of the host) / (ratio * pages of the host) entries, whatever the
host's size. Documents meet their host's list by one left join on the host; Spark
broadcasts the lists when they are small and otherwise uses a shuffled join, whose hot
hosts adaptive execution splits (the list side is repeated, no row is dropped).

Defined cases: a line is compared without blanks, tabs, carriage returns and form feeds at its
ends; blank lines are never counted and never dropped; a null text stays null and all null texts of
a host are one page; null hosts form one host; repeated rows are one page; two near copies on a
host of four pages or fewer still prove a line; a text of which every line is dropped becomes empty,
the row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .frames import column

RATIO, SPREAD = 0.05, 9.0
BROADCAST_LINES = 250_000
BLANKS = " \t\r\f\v"


def _hashes(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _bare(line):
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float, spread: float) -> DataFrame:
    """(``__h``, ``__drop``): per host the hashes of its boilerplate lines."""
    text = column(text_col)
    pages = df.select(column(host_col).alias("__h"), _hashes(text).alias("__page"), text.alias("__t"))
    totals = pages.groupBy("__h", "__page").agg(F.lit(1).alias("__one")).groupBy(F.col("__h").alias("__site")).agg(F.count("*").alias("__pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("__t", "\n", -1), lambda x: _bare(x) != ""), lambda x: _hashes(_bare(x))))
    held = pages.select("__h", "__page", F.explode(lines).alias("__line")).groupBy("__h", "__line", "__page").agg(F.lit(1).alias("__one")).groupBy("__h", "__line").agg(F.count("*").alias("__n"))
    over = F.col("__n") - F.lit(ratio) * F.col("__pages")
    return (
        held.filter(F.col("__n") >= 2)
        .join(totals, F.col("__h").eqNullSafe(F.col("__site")))
        .filter((over > 0) & (over * over > F.lit(spread * ratio * (1 - ratio)) * F.col("__pages")))
        .groupBy("__h")
        .agg(F.collect_list("__line").alias("__drop"))
    )


def drop_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, spread: float = SPREAD) -> DataFrame:
    """All rows and columns of ``df``, texts without their host's boilerplate, and ``n_lines``, ``n_dropped`` (long)."""
    checkpoint_ready(df.sparkSession)
    drops = boilerplate(df, host_col, text_col, ratio, spread).checkpoint()
    entries = drops.agg(F.coalesce(F.sum(F.size("__drop") + 1), F.lit(0))).first()[0]
    if entries <= BROADCAST_LINES:
        drops = F.broadcast(drops)
    host, text = column(host_col), column(text_col)
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    joined = df.join(drops, host.eqNullSafe(F.col("__h")), "left")
    parts = F.split(text, "\n", -1)
    left = F.filter(parts, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("__drop"), _hashes(_bare(x))))
    rest = F.when(F.col("__drop").isNull() | text.isNull(), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_left = F.when(text.isNull(), F.lit(0)).when(F.col("__drop").isNull(), F.size(parts)).otherwise(F.size(left)).cast("long")
    return joined.select(*[rest.alias(c) if c == text_col else column(c) for c in kept], n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))


def query(spark, sf_dir):
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, source, text, line, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS bare FROM l),
pages_of AS (SELECT source, count(DISTINCT coalesce('t' || text, 'n')) AS n_pages FROM documents GROUP BY source),
held AS (SELECT source, bare, count(DISTINCT text) AS n FROM t WHERE bare <> '' GROUP BY source, bare),
b AS (SELECT source, bare FROM (SELECT held.source, bare, n, n_pages, n - CAST({RATIO} AS DOUBLE) * n_pages AS over FROM held JOIN pages_of ON held.source IS NOT DISTINCT FROM pages_of.source)
      WHERE n >= 2 AND over > 0 AND over * over > CAST({SPREAD * RATIO * (1 - RATIO)!r} AS DOUBLE) * n_pages),
k AS (SELECT doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped, coalesce(string_agg(CASE WHEN b.bare IS NULL THEN t.line END, chr(10) ORDER BY pos), '') AS kept
      FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.bare = b.bare GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
