"""Cases in which operators once lost clean text or missed findings."""

import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hearthframe.llm import decontam, html_extract, lang_id, secret_scan

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_lines_of_exact_copies_stay(spark):
    copy = "first line of a copied page\nsecond line of it"
    rows = [(k, copy if k < 3 else f"menu\nown text {k}", "en", "s", 1) for k in range(24)]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert all(out[k] == (copy if k < 3 else f"own text {k}") for k in range(24))
    # copies are one page, and two pages prove nothing about a line
    rows = [(k, "same text" if k < 23 else "shared\nelse", "en", "s", 1) for k in range(24)]
    assert {r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {"same text", "shared\nelse"}


def test_small_hosts_follow_the_same_rule(spark):
    rows = [(100 * n + k, f"menu\r\nown text {n} {k}" if k < 4 else f"other {n} {k}", "en", f"s{n}", 1) for n in (5, 12, 40) for k in range(n)]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    # 4 of 5 and 4 of 12 pages prove the menu, 4 of 40 do not
    assert out[500] == "own text 5 0" and out[1200] == "own text 12 0" and out[4000] == "menu\r\nown text 40 0"


def test_repeated_rows_long_texts_and_empty_tables_of_language_id(spark):
    rows = [(k, "alpha beta gamma " * 10, "en", "s", 1) for k in range(30)] + [(99, "delta " * 10, "xx", "s", 1), (100, "alpha " * 300_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    langs, table = lang_id.learn(df)
    assert langs == ["en", "xx"]
    out = lang_id.predict(df.withColumn("score", F.lit("clash")), (langs, table)).collect()
    assert [r.lang_pred for r in out] == [r.lang for r in out]
    assert lang_id.learn(df.limit(0))[0] == [] and lang_id.predict(df.limit(0), (langs, table)).count() == 0
    # many labels: all are learned
    many = spark.createDataFrame([(k, f"w{k} x{k * 7} y{k * 13}", f"l{k:03}", "s", 1) for k in range(500)], DOCS)
    assert len(lang_id.learn(many)[0]) == 500
    # two languages of the same texts tie: the first by name
    tie = spark.createDataFrame([(k, "same words here", lang, "s", 1) for k, lang in enumerate(("b", "a"))], DOCS)
    assert {r.lang_pred for r in lang_id.predict(tie, lang_id.learn(tie)).collect()} == {"a"}


def test_mixture_against_plain_em():
    rng = np.random.default_rng(4)
    table = np.log(rng.dirichlet(np.full(lang_id.GRAMS, 0.2), 4).T + 1e-9).astype(np.float32)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (3, 47, 48, 49, 96, 97, 500, 3000)] + [b"1 2 3", b"", b"a"]
    offsets = np.cumsum([0, *map(len, texts)])
    lang, score = lang_id.infer(table, np.frombuffer(b"".join(texts), np.uint8), offsets)

    def gram(t, k):
        h = sum(t[k + j] << (8 * j) for j in range(3))
        return ((h * 2654435761) % 2**32) >> 16

    for k, t in enumerate(texts):
        if not any(97 <= c < 123 for c in t):
            assert lang[k] == -1 and score[k] == 0
            continue
        units = [[sum(float(table[gram(t, p), j]) for p in range(a, min(a + lang_id.UNIT, len(t) - 2))) for j in range(4)] for a in range(0, len(t), lang_id.UNIT)]
        share = [0.25] * 4
        for _ in range(lang_id.ROUNDS):
            new = [0.0] * 4
            for u in units:
                joint = [s * math.exp(x - max(u)) for s, x in zip(share, u)]
                new = [n + x / sum(joint) / len(units) for n, x in zip(new, joint)]
            share = new
        total = [sum(u[j] for u in units) for j in range(4)]
        chosen = [s if s >= lang_id.LEAST_SHARE else 0.0 for s in share]
        chosen = [c / sum(chosen) for c in chosen]
        mixed = sum(math.log(max(sum(c * math.exp(x - max(u)) for c, x in zip(chosen, u)), 1e-300)) + max(u) for u in units)
        more = sum(c > 0 for c in chosen) - 1
        if more and mixed - max(total) > lang_id.PENALTY * more * math.log(len(units) + 1):
            want = chosen.index(max(chosen)), max(chosen)
        else:
            want = total.index(max(total)), share[total.index(max(total))]
        assert lang[k] == want[0] and abs(score[k] - want[1]) < 1e-3, (k, lang[k], score[k], want)


def test_benchmark_in_blocks_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(rng.choice([f"w{k}" for k in range(30)], n))
    items = [(f"i{k % 25}" if k % 10 else None, word(int(rng.integers(1, 30))) if k % 7 else None) for k in range(60)]
    texts = [word(60) for _ in range(40)] + [f"{word(5)} {t} {word(5)}" for _, t in items if t] + [None, ""]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = {r.doc_id: r for r in decontam.scan(docs, bench).collect()}
    for blocks, passes in ((300, 32), (300, 2)):
        monkeypatch.setattr(decontam, "BENCH_BLOCK", blocks)
        monkeypatch.setattr(decontam, "PASS_BLOCKS", passes)
        parts = {r.doc_id: r for r in decontam.scan(docs, bench).collect()}
        assert {k: (r.n_words, r.n_hit, r.spans, r.items, r.contaminated) for k, r in parts.items()} == {k: (r.n_words, r.n_hit, r.spans, r.items, r.contaminated) for k, r in whole.items()}
    assert any(r.n_hit and not r.items for r in whole.values())


def test_one_row_of_each_group_stays(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(None, one), (None, two), (None, two), (7, one), (8, three), (8, two), (9, three), (8, three), (11, None), (12, "")]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, one), (8, two), (8, three), (11, None)]
    rows = [(None, t, "en", "s", 1) for t in (one, two, two, three)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.text for r in kept.collect()) == [one, two, three]


def test_secrets_inside_longer_runs(spark):
    rng = np.random.default_rng(3)
    draw = lambda k, n=44: "".join(rng.choice(list([a for n, a in secret_scan.ALPHABETS if n == "base64"][k]), n))
    texts, want = [], []
    for k in range(60):
        key = draw(0, 42) + "q7"  # the ends are no marks
        url = "Z5" + draw(1, 40) + "_8"
        for before, secret, after in (("AWS_SECRET_ACCESS_KEY=", key, ""), ("ENC_KEY=", key[:43], "="), ("/v1/my-own/", url, "/end"), ("my-own-name_", key, "-x")):
            texts.append(f"see {before}{secret}{after} here")
            want.append((4 + len(before), 4 + len(before) + len(secret)))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r.found for r in secret_scan.scan(df).collect()}
    hit = [any(s.start <= b and s.end >= a and min(s.end, b) - max(s.start, a) >= 20 for s in out[k]) for k, (a, b) in enumerate(want)]
    for kind in range(4):
        assert sum(hit[kind::4]) > 48, (kind, sum(hit[kind::4]))
    assert all(p > 0.01 for *_, p in secret_scan.candidates("some_long-file/name-of_words=and/other_words-here"))


def test_chosen_blocks_outside_the_container_stay():
    long = "A first sentence, long enough; a second one, too. "
    page = f"<body><div class='lead'><p>{long}</p></div><div class='body'><p>{long * 20}</p></div><footer>Foot, foot.</footer></body>"
    assert html_extract.main_text(page) == (long * 21).strip()
    page = f"<body><article><p>{long * 11}</p></article><div><p>{long * 9}</p></div></body>"
    assert html_extract.main_text(page) == (long * 20).strip()
