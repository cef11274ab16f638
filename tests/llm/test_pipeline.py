"""The pipeline against a plain Python version of its stages."""

import hashlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_fingerprint
from test_text_operators import brute_decontam

import corpus_pipeline
from hearthframe.llm import bpe, line_dedup


def test_pipeline_matches_brute_force(spark, sf):
    import public_tokenizers

    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [d for d in docs if any(map(str.isalpha, d["text"] or ""))]
    pages, held = {}, {}
    for d in docs:
        pages.setdefault(d["source"], set()).add(d["text"])
        for line in {x.strip(line_dedup.BLANKS) for x in d["text"].split("\n")} - {""}:
            held.setdefault((d["source"], line), set()).add(d["text"])
    drop = set()
    for key, texts in held.items():
        n, over, r = len(pages[key[0]]), len(texts) - line_dedup.RATIO * len(pages[key[0]]), line_dedup.RATIO
        if len(texts) > 1 and over > 0 and over**2 > line_dedup.SPREAD * r * (1 - r) * n:
            drop.add(key)
    assert drop
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(line_dedup.BLANKS)) not in drop)
    heads = brute_components([d["doc_id"] for d in docs], [brute_fingerprint(d["text"]) for d in docs])
    docs = [d for d, head in zip(docs, heads) if d["doc_id"] == head]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [d for d in docs if not brute_decontam(d["text"], items)[3]]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(bpe.vocabulary()).ranks, special_tokens={})
    want = {}
    for d in docs:
        ids = np.array(enc.encode_ordinary(d["text"]), "<u4")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0, name


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf):
    text = " ".join(f"word{k}" for k in range(50))
    rows = [(None, None, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "", None, None, 0), (None, text + " more", None, None, 5), (3, text + " more", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = {c: F.lit("clash") for c in ("lang_pred", "score", "n_lines", "n_dropped", "spans", "items", "contaminated", "id", "mark", "head")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumns(clash), sf)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() > 0, name
    out = corpus_pipeline.tokens(spark, docs.withColumns(clash), sf)
    assert out.count() == len(rows)
