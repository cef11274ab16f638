"""Operators that compare documents, against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from oracle import same
from pyspark.sql import functions as F

from hearthframe.llm import ann, components, queries, simhash, suffix_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name])


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, fps):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = list(texts.items()) + [(9001, None), (9000, ""), (9002, " \t\n"), (9003, "one"), (9003, "ONE"), (None, "two words"), (9004, "two\x85words é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps)), key=repr)
    assert sorted(map(tuple, simhash.group(df).collect()), key=repr) == want
    assert simhash.group(df.limit(0)).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in a], np.uint64)
    for radius in (0, 1, 2, 3):
        valid = np.packbits(np.ones(704, bool), bitorder="little").view("<u8")
        got = simhash.lanes(simhash.within(simhash.planes_of(a), simhash.planes_of(b), valid, radius))
        assert got[got < 700].tolist() == np.flatnonzero(np.bitwise_count(a ^ b) <= radius).tolist()
    assert (simhash.planes_of(np.append(a[37:], np.zeros(37, np.uint64)))[:, :10] == simhash.shifted(simhash.planes_of(a), 37)[:, :10]).all()


def test_links_of_split_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(k) for k in rng.choice(16, 3)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = brute_components(fps, fps)
    for split, deeper in ((50, 2), (50, 0), (8, 1), (400, 2)):
        monkeypatch.setattr(simhash, "SPLIT", split)
        monkeypatch.setattr(simhash, "DEEPER", deeper)
        root = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
        assert [root.get(f, f) for f in fps] == want, (split, deeper)


def test_blocks_of_free_bits():
    """Every table's key and its four further blocks are disjoint, and cover all bits two rounds down."""
    for used in simhash.used_bits():
        assert bin(used).count("1") == 28
        for mask in simhash.block_masks(used):
            assert not mask & used and bin(mask).count("1") == 9
        assert sum(simhash.block_masks(used)) == (1 << 64) - 1 - used


def test_simhash_of_long_texts():
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice([f"word{k}" for k in range(500)], 60_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 300), (300, 200), (7, 7)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[300] == got[200] == 100 and all(got[500 + k] == 500 for k in range(1, 30))


def brute_spans(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, {}
    for k in order:
        i, raw = rows[k][0], (rows[k][1] or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for k in order:
        i, raw = rows[k][0], (rows[k][1] or "").encode()
        hit = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] != i:
                hit[p : p + 50] = True
        hit = hit[:-1]
        spans = int((hit & ~np.append(False, hit[:-1])).sum()) if len(raw) else 0
        out[k] = (i, len(raw), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest())
    return sorted(out.values(), key=repr)


def check_spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ranges", F.lit("clash"))
    out = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=repr) == brute_spans(rows)


def test_suffix_dedup_on_documents(spark, sf):
    check_spans(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()])


def test_suffix_dedup_edges(spark):
    p = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(120))
    rows = [(5, p), (3, p[:50]), (9, "é" + p[10:59] + "x"), (9, p), (2, None), (1, ""), (4, p[:49]), (None, p), (None, p), (7, "ab" * 400), (8, "z" + "ab" * 300), (6, "q" * 200), (10, "q" * 90), (11, p + p), (12, p[60:] + p)]
    check_spans(spark, rows)
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffix_dedup_across_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = word(300)
    rows = [(k, word(400) + shared[k * 7 :] + word(200)) for k in range(8)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    import pyarrow as pa

    from hearthframe.llm.frames import utf8_view

    small = suffix_dedup.anchors(*utf8_view(pa.array([t for _, t in rows])))
    monkeypatch.undo()
    large = suffix_dedup.anchors(*utf8_view(pa.array([t for _, t in rows])))
    cover = lambda a: {(int(r), int(s) + j, int(p)) for r, s, n, p in zip(*a[:4]) for j in range(int(n))}
    assert cover(small) == cover(large)


def test_index_family_levels():
    rng = np.random.default_rng(8)
    data = np.concatenate([np.random.default_rng(s).integers(0, 255, 50).astype(np.uint8) for s in range(400)] * 3 + [np.zeros(8, np.uint8)])
    family, seen = suffix_dedup.Family(data), {}
    for batch in range(20):
        strings = rng.integers(0, 400, 60)
        docs = np.sort(rng.integers(batch * 10, batch * 10 + 10, 60))
        got = family.add((strings + 400 * rng.integers(0, 3, 60)) * 50, docs)
        for s, d in zip(strings.tolist(), docs.tolist()):
            seen[s] = min(seen.get(s, d), d)
        assert got.tolist() == [seen[s] < d for s, d in zip(strings.tolist(), docs.tolist())]
    sizes = [len(level.at) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def spelled(data, places):
    return [data[p : p + suffix_dedup.SPAN].tobytes() for p in places]


def test_levels_are_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(9)
    data = np.append(rng.choice(np.frombuffer(b"ab", np.uint8), 6000), np.zeros(8, np.uint8))
    data[1000:1400] = data[3000:3400] = data[5000:5400] = ord("a")
    where = np.arange(6000 - suffix_dedup.SPAN)
    for keys in (suffix_dedup.string_keys, lambda data, at: (at % 3).astype(np.uint64) * 0 + np.uint64(7)):
        # with one key for all strings the fold must tell them apart byte by byte
        monkeypatch.setattr(suffix_dedup, "string_keys", keys)
        family, seen = suffix_dedup.Family(data), {}
        for batch in range(7):
            at = np.sort(rng.choice(where, 700, replace=False))
            docs = np.sort(rng.integers(batch * 5, batch * 5 + 6, 700))
            for s, d in zip(spelled(data, at), docs.tolist()):
                seen[s] = min(seen.get(s, d), d)
            assert family.add(at, docs).tolist() == [seen[s] < d for s, d in zip(spelled(data, at), docs.tolist())]
        levels = [spelled(data, level.at) for level in family.levels]
        for level, words in zip(family.levels, levels):
            assert words == sorted(set(words)) and level.heads.tolist() == [int.from_bytes(w[:8]) for w in words]
            assert level.docs.tolist() == [seen[w] for w in words]
        assert sorted(w for words in levels for w in words) == sorted(seen)


def test_hot_passage_is_asked_for_once_a_block():
    import pyarrow as pa

    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    batch = pa.record_batch([pa.array(range(500), pa.int64()), pa.array(range(500), pa.int32()), pa.array([passage] * 500)], names=["id", "mark", "text"])
    asked = [r for out in suffix_dedup.ask([batch], 4) for r in out.to_pylist()]
    values = [suffix_dedup.unpack(r["packed"], "<i8", "<i4", "<u4", "u1", "<u8", "<u8") for r in asked if r["bucket"] >= 0]
    assert sum(len(v[4]) for v in values) == 0 and 0 < sum(len(v[5]) for v in values) < 400
    known = [r for r in asked if r["bucket"] < 0]
    assert 1 <= len(known) <= 4 and sum(len(suffix_dedup.unpack(r["packed"], "<i8", "<i4", "<u4", "u1")[0]) for r in known) == 500


def brute_neighbours(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float) != 0)]
    out = []
    for q, qv in {i: v for i, v in reversed(good) if i % every == 0}.items():  # ids of queries are given once
        near = sorted((-(qv * v).sum(), i) for i, v in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_edges(spark):
    rows = [(k, [float(k % 3), 1.0, float(k % 5), 0.5]) for k in range(41)] + [(100, None), (120, [0.0] * 4), (140, [1.0, None, 1.0, 1.0]), (160, [float("nan")] * 4), (180, [float("inf"), 1.0, 1.0, 1.0]), (200, [1.0]), (None, [9.0] * 4), (77, [2.0, 1.0, 4.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect())
    want = brute_neighbours(rows, 20, 20)
    assert [x[:3] for x in out] == [x[:3] for x in want] and np.allclose([x[3] for x in out], [x[3] for x in want])
    assert ann.search(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [2.0]), (3, [1.0]), (5, [4.0, 4.0, 4.0]), (20, [0.5, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in ann.search(mixed).collect()) == [(20, 1, 1, 0.25), (40, 1, 3, 2.0)]
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.search(few).collect()] == [(20, 1, 1, 0.5)]


def test_neighbours_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = {}
    for r in ann.query(spark, sf).collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert set(out) == set(ids[ids % 20 == 0].tolist())
    hits = []
    for q, found in out.items():
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(found)) / 20)
    assert np.mean(hits) >= 0.9


def test_leaves_grow_with_the_table(spark, monkeypatch):
    """On clustered vectors a larger table has more leaves, a query reads few of its rows, and held-out queries find theirs."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 16)) * 3
    read = []
    monkeypatch.setattr(ann, "SAMPLE", 1024)
    monkeypatch.setattr(ann, "ROWS_A_LEAF", 64)
    monkeypatch.setattr(ann, "CALIBRATION", 32)
    for n in (2000, 8000):
        m = centres[rng.integers(0, 150, n)] + rng.normal(size=(n, 16)) * 0.3
        m /= np.linalg.norm(m, axis=1)[:, None]
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id bigint, embedding array<double>")
        trees = []
        grown = ann._deepen

        def deepen(rows, tree, dim, top):
            grown(rows, tree, dim, top)
            trees.append(tree)

        monkeypatch.setattr(ann, "_deepen", deepen)
        out = {}
        for r in ann.search(df, every=40).collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        monkeypatch.setattr(ann, "_deepen", grown)
        tree = trees[0]
        sizes = np.bincount(tree.assign(ann.lift(m, 1.0)), minlength=tree.leaves)
        assert sizes.sum() == n and sorted(x for x in tree.leaf_of if x >= 0) == list(range(tree.leaves))
        read.append(tree.leaves)
        hits = []
        for q, found in out.items():
            s = m @ m[q]
            s[q] = -np.inf
            hits.append(len(set(np.lexsort((np.arange(n), -s))[:20].tolist()) & set(found)) / 20)
        assert np.mean(hits) >= 0.9 and len(out) == n // 40
        # the share of rows in the leaves that hold the target's part of all exact neighbours
        leaf, ranks, orders = tree.assign(ann.lift(m, 1.0)), [], []
        for q in out:
            s = m @ m[q]
            s[q] = -np.inf
            orders.append(tree.visits(ann.lift_queries(m[q : q + 1])[0], tree.leaves, sizes, 20))
            place = {x: j for j, x in enumerate(orders[-1])}
            ranks += [place[x] for x in leaf[np.lexsort((np.arange(n), -s))[:20]].tolist()]
        width = int(np.quantile(ranks, ann.TARGET)) + 1
        assert np.mean([sizes[o[:width]].sum() / n for o in orders]) < 0.2
    assert read[1] > 1.5 * read[0]
