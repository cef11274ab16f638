"""Benchmark decontamination with one FM-index per training shard.

The items' words get integer symbols. Of a shard (a block of documents inside a task) only
words that can lie in an occurrence enter the index: runs of item words whose neighbours
are neighbours in some item, and at least as long as the shortest window. Every other word
cannot belong to any occurrence, so nothing is lost. The shard's FM-index is searched
backward for all distinct windows at once; sampled suffix positions locate the
occurrences; overlapping occurrences merge into removal spans.

A word is looked up by a 64-bit key of its bytes and then compared byte for byte, so equal
keys of different words change nothing.

The benchmark is cut in blocks of about ``BENCH_BLOCK`` bytes (by hash of id and text). A worker
loads one block, searches a shard for it, and lets it go before the next one. A pass over the
documents broadcasts at most ``PASS_BLOCKS`` blocks; a larger benchmark takes several passes, each
checkpointed and its broadcasts destroyed, so no node ever holds more of it. No step shuffles documents.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no
window; repeated items count by ``item_id`` once; an item without an id hits words and is no item of
the list; repeated documents are judged alike; other columns pass through. Empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .fm_index import FMIndex
from .frames import LOWER, blocks, column, runs_of, text_pass, utf8_view, word_keys

WINDOW = 13
BENCH_BLOCK, PASS_BLOCKS = 1 << 20, 32
SHARD_BYTES = 4 << 20
#: Bytes of words: digits, letters (upper case is lowered first) and all of non-ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with eight spare ones, starts, ends) of the words of all rows."""
    low = LOWER[data]
    starts, ends = runs_of(WORD[low], offsets)
    return np.append(low, np.zeros(8, np.uint8)), starts, ends


class Patterns:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [(i, (t or "").encode()) for i, t in items]
        offsets = np.cumsum([0, *[len(t) for _, t in raw]])
        data = np.frombuffer(b"".join(t for _, t in raw), np.uint8)
        padded, starts, ends = words_of(data, offsets)
        blob = padded.tobytes()
        spelled = [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.words = sorted(set(spelled))
        number = {w: k + 2 for k, w in enumerate(self.words)}
        symbols = np.array([number[w] for w in spelled], np.int64)
        self.longest = max(map(len, self.words), default=0)
        self.item_names = sorted({i for i, _ in raw if i is not None})
        self.item_names.append(None)  # the items without an id
        item_no = {i: k for k, i in enumerate(self.item_names)}
        borders = np.searchsorted(starts, offsets)
        found: dict[tuple, set[int]] = {}
        pairs = set()
        for (item, _), a, b in zip(raw, borders.tolist(), borders[1:].tolist()):
            seq = symbols[a:b].tolist()
            pairs.update(zip(seq, seq[1:]))
            size = min(window, len(seq))
            for k in range(len(seq) - size + 1 if size else 0):
                found.setdefault(tuple(seq[k : k + size]), set()).add(item_no[item])
        #: per window length: the windows and, as rows of a flat list, their items
        self.groups = []
        for size in sorted({len(w) for w in found}):
            ws = [w for w in found if len(w) == size]
            owners = [sorted(found[w]) for w in ws]
            counts = np.array([len(o) for o in owners], np.int64)
            self.groups.append((size, np.array(ws, np.int64), counts, np.cumsum(counts) - counts, np.array([i for o in owners for i in o], np.int64)))
        self.shortest = self.groups[0][0] if self.groups else 0
        self.pairs = np.array(sorted(a * (len(self.words) + 2) + b for a, b in pairs), np.int64)
        # a multiplier under which the words' keys differ
        blob = b"".join(self.words)
        lens = np.array([len(w) for w in self.words], np.int64)
        at = np.cumsum(lens) - lens
        padded = np.append(np.frombuffer(blob, np.uint8), np.zeros(8, np.uint8))
        self.mult = 0xD6E8FEB86659FD93
        while len(self.words):
            keys = word_keys(padded, at, lens, self.longest, self.mult)
            if len(np.unique(keys)) == len(keys):
                break
            self.mult += 2
        if len(self.words):
            order = np.argsort(keys)
            self.keys, self.numbers = keys[order], order + 2
            self.bloom = np.zeros(1 << 16, bool)
            self.bloom[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True


def sorted_hit(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def occurrences(p: Patterns, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
    """(first words, lengths, window's group and number) of all occurrences in a shard."""
    none = [np.zeros(0, np.int64)] * 4
    if not p.shortest or not len(starts):
        return none
    lens = ends - starts
    keys = word_keys(padded, starts, lens, p.longest, p.mult)
    cand = np.flatnonzero(p.bloom[(keys & np.uint64(0xFFFF)).astype(np.int64)] & (lens <= p.longest))
    at, ok = sorted_hit(p.keys, keys[cand])
    symbol = np.zeros(len(starts), np.int64)
    symbol[cand[ok]] = p.numbers[at[ok]]

    def runs(symbol):
        """Words in runs of linked item words, long enough for a window; and where a run breaks before a word."""
        linked = (symbol[1:] > 0) & (symbol[:-1] > 0) & (doc[1:] == doc[:-1])
        spots = np.flatnonzero(linked)
        if len(spots):
            if len(p.pairs):
                linked[spots] = sorted_hit(p.pairs, symbol[spots] * (len(p.words) + 2) + symbol[spots + 1])[1]
            else:
                linked[:] = False
        word = np.flatnonzero(symbol > 0)
        if not len(word):
            return word, word
        cut = np.append(True, ~linked[word[1:] - 1])
        cut[1:] |= np.diff(word) > 1
        run = np.cumsum(cut) - 1
        long = np.bincount(run)[run] >= p.shortest
        return word[long], run[long]

    word, run = runs(symbol)
    if not len(word):
        return none
    wrong = [w for w, a, b, s in zip(word.tolist(), starts[word].tolist(), ends[word].tolist(), symbol[word].tolist()) if padded[a:b].tobytes() != p.words[s - 2]]
    if wrong:
        symbol[wrong] = 0
        word, run = runs(symbol)
        if not len(word):
            return none
    # the shard's text: runs with symbol 1 between them
    place = np.arange(len(word)) + np.cumsum(np.append(0, run[1:] != run[:-1]))
    text = np.ones(place[-1] + 1, np.int64)
    text[place] = symbol[word]
    back = np.zeros(len(text), np.int64)
    back[place] = word
    dense, text = np.unique(np.append(1, text), return_inverse=True)
    index = FMIndex(text[1:] + 1)
    out = []
    for g, (size, windows, *_) in enumerate(p.groups):
        at = np.minimum(np.searchsorted(dense, windows), len(dense) - 1)
        known = (dense[at] == windows).all(axis=1)
        which = np.flatnonzero(known)
        lo, hi = index.search(at[which] + 1)
        counts = hi - lo
        if not counts.sum():
            continue
        rows = np.repeat(lo - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        first = back[index.locate(rows)]
        out.append((first, np.full(len(first), size), np.full(len(first), g), np.repeat(which, counts)))
    return [np.concatenate(x) for x in zip(*out)] if out else none


def shard(patterns, data: np.ndarray, offsets: np.ndarray):
    """(words, hit words, merged spans, items) of each row of a block; ``patterns`` yields one block of items after the other."""
    padded, starts, ends = words_of(data, offsets)
    borders = np.searchsorted(starts, offsets)
    n_rows = len(offsets) - 1
    doc = np.repeat(np.arange(n_rows), np.diff(borders))
    mark = np.zeros(len(starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_rows)]
    for p in patterns:
        first, size, group, window = occurrences(p, padded, starts, ends, doc)
        if not len(first):
            continue
        np.add.at(mark, first, 1)
        np.add.at(mark, first + size, -1)
        for g in np.unique(group):
            mine = group == g
            _, _, counts, at, owners = p.groups[g]
            seen = np.unique(doc[first[mine]] * len(counts) + window[mine])
            for d, w in zip((seen // len(counts)).tolist(), (seen % len(counts)).tolist()):
                items[d].update(p.item_names[i] for i in owners[at[w] : at[w] + counts[w]])
    hit = np.cumsum(mark[:-1]) > 0
    total = np.append(0, np.cumsum(hit))
    a, b = runs_of(hit, np.minimum(borders, len(hit)))
    spans: list[list[dict]] = [[] for _ in range(n_rows)]
    for x, y in zip(a.tolist(), b.tolist()):
        d = int(doc[x])
        spans[d].append({"first": x - int(borders[d]), "last": y - 1 - int(borders[d]), "start": int(starts[x] - offsets[d]), "end": int(ends[y - 1] - offsets[d])})
    return np.diff(borders), total[borders[1:]] - total[borders[:-1]], spans, [sorted(s - {None}) for s in items]


ADDED = "n_words bigint, n_hit bigint, spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_words``, ``n_hit``, ``spans``, ``items``, ``contaminated``.

    ``spans`` are the merged removal spans: first and last word, and byte positions in the
    UTF-8 text, end exclusive. ``items``: ids as strings, sorted. ``contaminated``: hits are
    at least a twentieth of the words.
    """
    spark = docs.sparkSession
    bench = benchmark.select(column(item_col).cast("string").alias("item"), column(item_text).alias("text")).filter("text IS NOT NULL")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-int(total) // BENCH_BLOCK) or 1
    passes = -(-parts // PASS_BLOCKS)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_hit", "spans", "items", "contaminated")]
    if passes == 1:
        out = _one_pass(docs, _blocks(bench, parts), text_col, keep)[0]
    else:
        checkpoint_ready(spark)
        out = docs.select(*[column(c).alias(f"__c{i}") for i, c in enumerate(keep)], column(text_col).alias("__t"))
        names = out.columns
        out = out.withColumns({"__s": F.expr("CAST(array() AS array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>)"), "__i": F.expr("CAST(array() AS array<string>)"), "__n": F.lit(0).cast("long")})
        for k in range(passes):
            mine = bench.filter(F.pmod(F.xxhash64("item", "text", F.lit(2)), F.lit(passes)) == k)
            found, shared = _one_pass(out, _blocks(mine, -(-parts // passes)), "__t", [*names, "__s", "__i"])
            out = found.select(*names, F.concat("__s", "spans").alias("__s"), F.array_union("__i", "items").alias("__i"), F.col("n_words").alias("__n")).checkpoint()
            for b in shared:
                b.destroy()
        out = out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").alias("n_words"), _merged(F.col("__s")).alias("spans"), F.array_sort("__i").alias("items"))
        out = out.select(*keep_columns(keep), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1).alias("n_hit"), "spans", "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_columns(names: list[str]) -> list[F.Column]:
    return [column(c) for c in names]


def _blocks(bench: DataFrame, parts: int) -> list:
    """Broadcasts of the windows of ``parts`` blocks of items; at most a pass's share of the benchmark is at the driver."""
    rows: list[list] = [[] for _ in range(parts)]
    for k, item, text in bench.select(F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"), "item", "text").toLocalIterator():
        rows[k].append((item, text))
    return [bench.sparkSession.sparkContext.broadcast(Patterns(r, WINDOW)) for r in rows]


def _merged(spans):
    """Spans in order, overlapping and touching ones joined."""
    one = lambda a, b: F.struct(a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))
    empty = F.slice(spans, 1, 0)
    step = lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= x["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one(F.element_at(done, -1), x)))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), empty, step)


def _one_pass(docs: DataFrame, shared: list, text_col: str, keep: list[str]):
    def patterns():
        for b in shared:
            yield b.value
            if len(shared) > 1 and hasattr(b, "_value"):
                del b._value  # the worker's copy; it is read again from the worker's file for the next shard

    def kernel(col: pa.Array) -> list[pa.Array]:
        words, hits, spans, items = [], [], [], []
        for _, _, data, offs in blocks(*utf8_view(col), SHARD_BYTES):
            w, h, s, i = shard(patterns(), data, offs)
            words.append(w), hits.append(h), spans.extend(s), items.extend(i)
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
        span = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
        return [flat(words), flat(hits), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]

    return text_pass(docs, text_col, kernel, ADDED, keep, SHARD_BYTES), shared


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
bp AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bp),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, item_id, dg.k, i FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
