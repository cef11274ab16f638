"""Exact substring dedup over documents with a logarithmic family of suffix arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document of smaller
id. The corpus is far too large for one suffix array, so it is dealt out by content:

1. Anchors. Of the k-grams of every string of ``SPAN`` bytes the one of least hash is its
   anchor, so equal strings have equal anchors at equal places. About one byte in eighteen is
   an anchor. Anchors travel to buckets as eight bytes: 32 bits of the k-gram's hash (others choose the
   bucket) and sixteen each of the ``SIDE`` bytes after and before it. Equal strings agree in the
   k-gram and in at least one side. A block of documents sends a bucket one packed row. There is a bucket,
   and a task, for each ``BUCKET`` bytes of text, so no task grows with the corpus. An anchor that
   documents of one block share needs no answer: of all its copies in the block one value without an owner
   is sent, so a hot passage costs its bucket eight bytes a block.
2. A bucket replies to the documents which of their anchors some other document has as well:
   a bit an anchor, in the order in which the document will find them again. Replies travel packed to
   the documents' homes (a task each for a share of the ids), which hand each document one value.
3. Documents send only those anchors' surroundings, packed, to the bucket of the anchor. Copies
   of surroundings inside one block are sent once, by the smallest document; the other
   documents know then that theirs is taken.
4. In a bucket documents are taken by id, in batches. Equal strings of a batch are folded (by a 64-bit
   key, compared byte for byte); the distinct ones get a suffix array: their places in the order
   of their bytes, up to ``SPAN``, as that is the common prefix an occurrence needs (longer matches are runs of
   neighbouring places). The array is merge-scanned against all levels of the index family,
   and what no level has becomes a level itself; levels of like size merge, both being in order, so
   there are logarithmically many.
5. Ranges return to the documents by their homes and are joined to their texts. Both joins with the texts
   use the same shuffle of them.

Defined cases: a null text is the empty text; texts under ``SPAN`` bytes lose nothing; a null id
comes after all ids; rows of one id never remove from each other; repeated rows each get the
result; other columns are ignored; empty tables work. Texts of any length are processed in
pieces that overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .frames import blocks, column, same_slices, utf8_view

SPAN, GRAM, SIDE = 50, 16, 17
WIDE = SPAN - GRAM + 1  # k-grams of a string
PIECE = 1 << 16  # string starts handled at once, few enough for a core's cache; positions in a piece must fit PLACE bits
PLACE = np.uint64(22)
BATCH_STRINGS = 1 << 20
BLOCK, BUCKET = 2 << 20, 8 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def loads(data: np.ndarray) -> np.ndarray:
    """Eight-byte words at every byte of ``data``, which has eight spare bytes."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Runs of strings with one anchor: (row, first start, strings, anchor's place, its hash); places within the block."""
    out = []
    n = len(data)
    padded = np.append(data, np.zeros(GRAM + SPAN + 16, np.uint8))
    words = loads(padded)
    ends = offsets[1:]
    for lo in range(0, max(n - SPAN + 1, 0), PIECE):
        hi = min(lo + PIECE, n - SPAN + 1)  # string starts lo .. hi - 1
        m = hi - lo + WIDE - 1  # k-grams
        grams = mixed(mixed(words[lo : lo + m] * M1 ^ mixed(words[lo + 8 : lo + 8 + m])))
        least = (grams >> PLACE << PLACE) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= WIDE:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WIDE:
            least = np.minimum(least[: hi - lo], least[WIDE - span : WIDE - span + hi - lo])
        place = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(ends)), np.diff(np.clip(offsets, lo, hi)))
        start = np.arange(lo, hi)
        fits = start + SPAN <= ends[row]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        cut = np.append(True, (np.diff(at) > 1) | (place[at[1:]] != place[at[:-1]]) | (row[at[1:]] != row[at[:-1]]))
        first = np.flatnonzero(cut)
        count = np.diff(np.append(first, len(at)))
        p = place[at[first]]
        out.append((row[at[first]], start[at[first]], count, p + lo, grams[p]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), padded
    row, first, count, place, grams = (np.concatenate(x) for x in zip(*out))
    # a run cut at a piece's border is one run: anchors depend on a text alone, not on its block
    new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (first[1:] != first[:-1] + count[:-1]))
    at = np.flatnonzero(new)
    return row[at], first[at], np.add.reduceat(count, at), place[at], grams[at], padded


def packed(row, place, grams, padded, offsets) -> np.ndarray:
    """32 bits of the k-gram's hash, then sixteen of the bytes after it and sixteen of those before it; 0 where a text has fewer."""
    words, out = loads(padded), np.empty(len(row), np.uint64)

    def side(at, ok):
        at = np.where(ok, at, 0)
        h = mixed(words[at] * M1 ^ mixed(words[at + 8] + mixed(words[at + SIDE - 8] + M2))) >> np.uint64(48)
        return np.where(ok, np.maximum(h, np.uint64(1)), np.uint64(0))

    for lo in range(0, len(row), PIECE):
        part = slice(lo, lo + PIECE)
        begin, end, p = offsets[row[part]], offsets[row[part] + 1], place[part]
        after, before = side(p + GRAM, p + GRAM + SIDE <= end), side(p - SIDE, p - SIDE >= begin)
        out[part] = (grams[part] << np.uint64(32)) | (after << np.uint64(16)) | before
    return out


def sides(value: np.ndarray):
    """The keys that two equal strings' anchors share one of, and where a value has them: k-gram and after, k-gram and before."""
    low = np.uint64(0xFFFF)
    yield value >> np.uint64(16), (value >> np.uint64(16)) & low != 0
    yield (value >> np.uint64(32) << np.uint64(16)) | (value & low), value & low != 0


def told_apart(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a key that another document has too."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    differs = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(differs, np.diff(np.append(first, len(order))))
    return out


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    raw = b"".join([np.array([a.nbytes for a in arrays], "<i8").tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def row_groups(bucket: np.ndarray, row: np.ndarray, buckets: int):
    """(order by bucket and row, per bucket: its number, slice of the order, rows, counts)."""
    key = bucket * (row.max() + 1) + row
    order = np.argsort(key, kind="stable")
    b, r = bucket[order], row[order]
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    sizes = np.diff(np.append(first, len(order)))
    heads = np.flatnonzero(np.append(True, np.diff(b[first]) != 0))
    out = []
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(first)]):
        lo, hi = int(first[x]), int(first[y - 1] + sizes[y - 1])
        out.append((int(b[lo]), slice(lo, hi), r[first[x:y]], sizes[x:y]))
    return order, out


ASKED = ["task", "bucket", "packed"]
WHOLE = b"\xff\xff\xff\xff"


def ask(batches, buckets):
    """Step 1: (bucket's task, bucket, packed counts and anchors) of each block and bucket.

    What a block's documents share among themselves is known at once: rows (their home, bucket -1, packed bits of
    all anchors of texts). An anchor all of whose keys are so shared is not asked for; one
    value without owners, in the bucket's row, stands for all its copies in the block.
    """
    for batch in batches:
        ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for lo, _, data, offs in blocks(*utf8_view(batch.column(2)), BLOCK):
            row, _, _, place, grams, padded = anchors(data, offs)
            if not len(row):
                continue
            value = packed(row, place, grams, padded, offs)
            known, asked = np.zeros(len(row), bool), np.zeros(len(row), bool)
            for key, has in sides(value):
                use = np.flatnonzero(has)
                if len(use):
                    here = told_apart(key[use], ids[lo + row[use]])
                    known[use[here]] = True
                    asked[use[~here]] = True
            order, groups = row_groups(bucket_of(grams, buckets), row, buckets)
            value, sent, common = value[order], asked[order], known[order] & ~asked[order]
            rows = []
            for _, part, r, n in groups:
                bits, v = sent[part], value[part]
                stand = np.unique(v[common[part]])
                rows.append(pack(ids[lo + r].astype("<i8"), marks[lo + r].astype("<i4"), n.astype("<u4"), np.packbits(bits), v[bits].astype("<u8"), stand.astype("<u8")))
            number = pa.array([g[0] for g in groups], pa.int32())
            yield pa.RecordBatch.from_arrays([number, number, binaries(rows)], names=ASKED)
            some = np.unique(row[known])
            if len(some):
                begins, ends = np.searchsorted(row, some), np.searchsorted(row, some, side="right")
                bits = [WHOLE + int(b - a).to_bytes(4, "little") + np.packbits(known[a:b]).tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
                home, rows = to_documents(ids[lo + some], marks[lo + some], bits, buckets)
                yield pa.RecordBatch.from_arrays([home, pa.array(np.full(len(home), -1, np.int32)), rows], names=ASKED)


def home_of(ids: np.ndarray, marks: np.ndarray, homes: int) -> np.ndarray:
    """The task that gathers what buckets say about a text."""
    return (mixed(ids.astype(np.uint64) * M1 ^ mixed(marks.astype(np.int64).astype(np.uint64))) >> np.uint64(20)) % np.uint64(homes)


def to_documents(ids: np.ndarray, marks: np.ndarray, values: list[bytes], homes: int) -> tuple[pa.Array, pa.Array]:
    """(homes, packed values) of texts: one row a home, so rows are as many as tasks and not as texts."""
    home = home_of(ids, marks, homes)
    order = np.argsort(home, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(home[order]) != 0)), len(order)).tolist()
    lens, out = np.array([len(v) for v in values], "<u4"), []
    for a, b in zip(cuts, cuts[1:]):
        part = order[a:b]
        out.append(pack(ids[part].astype("<i8"), marks[part].astype("<i4"), lens[part], np.frombuffer(b"".join(values[k] for k in part.tolist()), np.uint8)))
    return pa.array(home[order[cuts[:-1]]].astype(np.int32)), binaries(out)


def at_home(batches):
    """(id, text's hash, all values of it, joined) from packed values; a text's rows all have one home."""
    parts = [unpack(v.as_py(), "<i8", "<i4", "<u4", "u1") for batch in batches for v in batch.column(0)]
    if not parts:
        return
    ids, marks, lens = (np.concatenate([p[k] for p in parts]) for k in range(3))
    raw = b"".join(p[3].tobytes() for p in parts)
    stops = np.append(0, np.cumsum(lens, dtype=np.int64))
    order = np.lexsort((marks, ids))
    first = np.flatnonzero(np.append(True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)))
    cuts = [*first.tolist(), len(order)]
    spots = [(int(stops[k]), int(stops[k + 1])) for k in order.tolist()]
    values = [b"".join(raw[x:y] for x, y in spots[a:b]) for a, b in zip(cuts, cuts[1:])]
    for at in range(0, len(first), 4096):
        head = order[first[at : at + 4096]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(marks[head]), binaries(values[at : at + 4096])], names=["id", "mark", "said"])


def by_bucket(batches):
    """(bucket, its packed values) from batches (bucket, packed) sorted by bucket; rows of bucket -1 come one by one."""
    held, values = None, []
    for batch in batches:
        for b, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != held or b < 0:
                if values:
                    yield held, values
                held, values = b, []
            values.append(v.as_py())
    if values:
        yield held, values


def gather(values: list[bytes], *kinds: str) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*[unpack(v, *kinds) for v in values])]


def reply(batches, homes):
    """Step 2: (home, packed: bucket and a bit for each anchor there) of documents that share any; known rows pass."""
    names, passed = ["home", "packed"], []

    def asked():
        for batch in batches:
            known = pa.array(np.asarray(batch.column(1)) < 0)
            passed.append(pa.RecordBatch.from_arrays([batch.column(0).filter(known), batch.column(2).filter(known)], names=names))
            other = pa.array(np.asarray(batch.column(1)) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(other), batch.column(2).filter(other)], names=["bucket", "packed"])

    for bucket, values in by_bucket(asked()):
        while passed:
            yield passed.pop()
        ids, marks, counts, bits, value, stand = ([], [], [], [], [], [])
        for v in values:
            i, m, n, b, x, s = unpack(v, "<i8", "<i4", "<u4", "u1", "<u8", "<u8")
            ids.append(i), marks.append(m), counts.append(n), value.append(x), stand.append(s)
            bits.append(np.unpackbits(b)[: int(n.sum())].astype(bool))
        ids, marks, counts, sent, value, stand = map(np.concatenate, (ids, marks, counts, bits, value, stand))
        doc = ids[np.repeat(np.arange(len(ids)), counts)[sent]]
        # a value without owner is two documents' at least: two entries under ids that no other entry has
        both = np.concatenate((value, stand, stand))
        held_by = np.concatenate((np.unique(ids, return_inverse=True)[1][np.repeat(np.arange(len(ids)), counts)[sent]], np.full(len(stand), -1), np.full(len(stand), -2)))
        found = np.zeros(len(doc), bool)
        for key, has in sides(both):
            use = np.flatnonzero(has)
            if len(use):
                apart = use[told_apart(key[use], held_by[use])]
                found[apart[apart < len(doc)]] = True
        shared = np.zeros(len(sent), bool)
        shared[np.flatnonzero(sent)[found]] = True
        stops = np.append(0, np.cumsum(counts, dtype=np.int64))
        total = np.append(0, np.cumsum(shared))
        some = np.flatnonzero(total[stops[1:]] > total[stops[:-1]])
        if len(some):
            head = int(bucket).to_bytes(4, "little")
            bits = [head + int(stops[k + 1] - stops[k]).to_bytes(4, "little") + np.packbits(shared[stops[k] : stops[k + 1]]).tobytes() for k in some.tolist()]
            yield pa.RecordBatch.from_arrays(list(to_documents(ids[some], marks[some], bits, homes)), names=names)
    while passed:
        yield passed.pop()


def send(batches, buckets):
    """Step 3: packed surroundings for buckets (bucket >= 0), and ranges that are known already (bucket -1)."""
    for batch in batches:
        ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        said = batch.column(3).to_pylist()
        for lo, hi, data, offs in blocks(*utf8_view(batch.column(2)), BLOCK):
            row, start, count, _, grams, padded = anchors(data, offs)
            if not len(row):
                continue
            bucket = bucket_of(grams, buckets)
            order, groups = row_groups(bucket, row, buckets)
            wanted = np.zeros(len(row), bool)
            told, borders = {}, np.searchsorted(row, np.arange(hi - lo + 1))
            known = np.zeros(len(row), bool)
            for k, x in enumerate(said[lo:hi]):
                at = 0
                while at < len(x):
                    bucket_no, n = x[at : at + 4], int.from_bytes(x[at + 4 : at + 8], "little")
                    bits, at = x[at + 8 : at + 8 + -(-n // 8)], at + 8 + -(-n // 8)
                    if bucket_no == WHOLE:
                        known[borders[k] : borders[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
                    else:
                        told[k, int.from_bytes(bucket_no, "little")] = n, bits
            for b, part, rows, sizes in groups:
                at = part.start
                for r, n in zip(rows.tolist(), sizes.tolist()):
                    x = told.get((r, b))
                    if x is not None and x[0] == n:
                        wanted[at : at + n] = np.unpackbits(np.frombuffer(x[1], np.uint8))[:n]
                    at += n
            keep = order[wanted | known[order]]
            if not len(keep):
                continue
            row, start, count, grams, bucket = row[keep], start[keep], count[keep], grams[keep], bucket[keep]
            length = count + SPAN - 1
            # copies inside the block: the smallest document sends, the others are covered
            words = loads(padded)
            key = grams ^ (length.astype(np.uint64) * M1)
            for at in (*range(0, SPAN - 7, 8), SPAN - 8):
                key = mixed(key + words[start + at] * M1)
            tail = start + length - 8
            for back in range(0, WIDE - 1, 8):
                key = mixed(key + words[np.maximum(tail - back, start)] * M2)
            doc = ids[lo + row]
            order = np.lexsort((start, doc, key))
            first = np.append(True, np.diff(key[order]) != 0)
            head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = (doc[order] > doc[head]) & (length[order] == length[head])
            copy, source = order[later], head[later]
            if len(copy) and not same_slices(padded, start[copy], start[source], length[copy], length[source]):
                copy = copy[:0]
            bucket[copy] = -1
            order, groups = row_groups(bucket + 1, row, buckets + 1)
            start, count, length, row = start[order], count[order], length[order], row[order]
            places = start - offs[row]
            out = []
            for b, part, rows, sizes in groups:
                text = np.zeros(0, np.uint8)
                if b:
                    n = length[part]
                    stop = np.append(0, np.cumsum(n))
                    text = padded[np.repeat(start[part] - stop[:-1], n) + np.arange(stop[-1])]
                out.append(pack(ids[lo + rows].astype("<i8"), marks[lo + rows].astype("<i4"), sizes.astype("<u4"), places[part].astype("<i8"), count[part].astype("<u4"), text))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] - 1 for g in groups], pa.int32()), binaries(out)], names=["bucket", "packed"])


class Level:
    """A suffix array: places of distinct strings in the order of their bytes, their first eight bytes and least document."""

    __slots__ = ("at", "heads", "docs")

    def __init__(self, at, heads, docs):
        self.at, self.heads, self.docs = at, heads, docs


#: Where the words of a string begin that order it: the last one overlaps.
STEPS = (*range(8, SPAN - 7, 8), SPAN - 8)


def string_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words, out = loads(data), np.empty(len(at), np.uint64)
    for lo in range(0, len(at), PIECE):
        part = at[lo : lo + PIECE]
        key = np.zeros(len(part), np.uint64)
        for k in (0, *STEPS):
            key = mixed(key + words[part + k] * M1)
        out[lo : lo + PIECE] = key
    return out


def equal_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words, out = loads(data), np.empty(len(a), bool)
    for lo in range(0, len(a), PIECE):
        x, y = a[lo : lo + PIECE], b[lo : lo + PIECE]
        same = np.ones(len(x), bool)
        for k in (0, *STEPS):
            same &= words[x + k] == words[y + k]
        out[lo : lo + PIECE] = same
    return out


def big_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as numbers that order like the bytes."""
    return np.ndarray((len(data) - 7,), np.dtype(">u8"), data, 0, (1,))[at].astype(np.uint64)


def text_order(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of distinct strings by their bytes, their first words in this order): ties of a word are settled by the next."""
    heads = big_words(data, at)
    order = np.argsort(heads)
    heads = heads[order]
    group = np.cumsum(np.append(True, heads[1:] != heads[:-1])) if len(at) else np.zeros(0, np.int64)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    group = group[tied]
    for k in STEPS:
        if not len(tied):
            break
        word = big_words(data, at[order[tied]] + k)
        sub = np.lexsort((word, group))
        order[tied] = order[tied][sub]
        group, word = group[sub], word[sub]
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        still = np.bincount(group)[group] > 1
        tied, group = tied[still], group[still]
    return order, heads


def less(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the string at ``a`` comes before that at ``b``; their first words are equal."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for k in STEPS:
        x, y = big_words(data, a[open_] + k), big_words(data, b[open_] + k)
        out[open_[x < y]] = True
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


class Family:
    """Levels of suffix arrays over one bucket's bytes, sizes growing geometrically."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.levels: list[Level] = []

    def add(self, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch of strings (documents not smaller than any before); which of them a smaller document has."""
        own, who, kind = self._fold(at, docs)
        order, heads = text_order(self.data, own)
        own, who, hit, fresh = own[order], who[order], np.zeros(len(own), bool), np.ones(len(own), bool)
        for level in self.levels:
            place = self._merge_scan(level, own, heads)
            p = np.minimum(place, len(level.at) - 1)
            same = np.flatnonzero((place < len(level.at)) & (level.heads[p] == heads))
            same = same[equal_strings(self.data, own[same], level.at[p[same]])]
            hit[same] |= level.docs[p[same]] < who[same]
            fresh[same] = False
        if fresh.any():
            self._push(Level(own[fresh], heads[fresh], who[fresh]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return hit[back[kind]] | (docs > who[back[kind]])

    def _fold(self, at: np.ndarray, docs: np.ndarray):
        """(a place and the least document of each distinct string, which of these each string is)."""
        keys = string_keys(self.data, at)
        order = np.argsort(keys)
        first = np.append(True, np.diff(keys[order]) != 0)
        one = np.minimum.reduceat(order, np.flatnonzero(first))  # the first of each: of the least document
        kind = np.empty(len(at), np.int64)
        kind[order] = np.cumsum(first) - 1
        own, who = at[one], docs[one]
        rest = np.flatnonzero(at != own[kind])  # in order of place: neighbours' copies are neighbours
        odd = rest[~equal_strings(self.data, at[rest], own[kind[rest]])]
        if len(odd):  # equal keys of different strings, one pair in 2**64: told apart by their bytes
            names, whole = {}, np.unique(kind[odd])
            for j in np.flatnonzero(np.isin(kind, whole)).tolist():
                kind[j] = names.setdefault(self.data[at[j] : at[j] + SPAN].tobytes(), len(own) + len(names))
            kind = np.unique(kind, return_inverse=True)[1]
            own, who = np.empty(kind.max() + 1, np.int64), np.full(kind.max() + 1, np.iinfo(np.int64).max)
            own[kind] = at
            np.minimum.at(who, kind, docs)
        return own, who, kind

    def _merge_scan(self, level: Level, at: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """How many of a level's strings come before each of the batch's: both sides run in order."""
        n = len(level.heads)
        runs = np.argsort(np.concatenate((heads, level.heads)), kind="stable")  # two ascending runs: one merge
        lo = np.empty(len(at), np.int64)
        mine = np.flatnonzero(runs < len(at))
        lo[runs[mine]] = mine - np.arange(len(mine))
        open_ = np.flatnonzero((lo < n) & (level.heads[np.minimum(lo, n - 1)] == heads))
        hi = np.searchsorted(level.heads, heads[open_], side="right")
        while len(open_):  # inside equal first words: halve
            mid = (lo[open_] + hi) >> 1
            before = less(self.data, level.at[mid], at[open_])
            lo[open_[before]] = mid[before] + 1
            hi[~before] = mid[~before]
            more = lo[open_] < hi
            open_, hi = open_[more], hi[more]
        return lo

    def _push(self, new: Level) -> None:
        while self.levels and len(self.levels[-1].at) < 2 * len(new.at):
            old = self.levels.pop()
            place = self._merge_scan(old, new.at, new.heads) + np.arange(len(new.at))
            rest = np.ones(len(old.at) + len(new.at), bool)
            rest[place] = False
            columns = []
            for a, b in ((old.at, new.at), (old.heads, new.heads), (old.docs, new.docs)):
                both = np.empty(len(rest), a.dtype)
                both[place], both[rest] = b, a
                columns.append(both)
            new = Level(*columns)
        self.levels.append(new)


def resolve(batches, homes):
    """Step 4: (home, packed ranges of bytes) from buckets; known ranges pass."""
    for bucket, values in by_bucket(batches):
        if bucket < 0:
            for v in values:
                ids, marks, sizes, start, count, _ = unpack(v, "<i8", "<i4", "<u4", "<i8", "<u4", "u1")
                yield ranges_of(ids, marks, np.repeat(np.arange(len(ids)), sizes), start, count.astype(np.int64), homes)
            continue
        ids, marks, sizes, start, count, data = gather(values, "<i8", "<i4", "<u4", "<i8", "<u4", "u1")
        count = count.astype(np.int64)
        length = count + SPAN - 1
        owner, base = np.repeat(np.arange(len(ids)), sizes), np.cumsum(length) - length
        data = np.append(data, np.zeros(8, np.uint8))
        by_id = np.argsort(ids[owner], kind="stable")
        owner, start, count, base = owner[by_id], start[by_id], count[by_id], base[by_id]
        batch = np.cumsum(count) // BATCH_STRINGS
        family, found = Family(data), []
        for part in np.split(np.arange(len(count)), np.flatnonzero(np.diff(batch)) + 1):
            n = count[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = np.repeat(owner[part], n)
            hit = family.add(np.repeat(base[part], n) + within, ids[who])
            found.append((who[hit], (np.repeat(start[part], n) + within)[hit]))
        who, pos = (np.concatenate(x) for x in zip(*found))
        if len(who):
            order = np.lexsort((pos, who))
            who, pos = who[order], pos[order]
            first = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (np.diff(pos) != 1)))
            yield ranges_of(ids, marks, who[first], pos[first], np.diff(np.append(first, len(pos))), homes)


def ranges_of(ids, marks, owner, start, count, homes) -> pa.RecordBatch:
    """Rows (home, packed pairs of first byte and end); ``owner`` ascends."""
    pair = np.stack((start, start + count + SPAN - 1), axis=1).astype("<i8").tobytes()
    first = np.flatnonzero(np.append(True, np.diff(owner) != 0)) if len(owner) else np.zeros(0, int)
    cuts, rows = [*(first * 16).tolist(), len(start) * 16], owner[first]
    return pa.RecordBatch.from_arrays(list(to_documents(ids[rows], marks[rows], [pair[a:b] for a, b in zip(cuts, cuts[1:])], homes)), names=["home", "packed"])


def remove(raw: bytes, ranges: bytes | None) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, maximal removed runs) of a text."""
    if not ranges:
        return raw, []
    pairs = np.frombuffer(ranges, "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    runs = list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:] - 1, len(reach) - 1)].tolist()))
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans array of (start, end) in bytes) of every row.

    The texts' bytes are counted first: there is a bucket, and a task, for each ``bucket_bytes`` of them.
    """
    spark = docs.sparkSession
    ship(spark)
    last = 2**63 - 1
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(last)).alias("id"), F.hash(text).alias("mark"), text.alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    key = ["id", "mark"]
    asked = rows.mapInArrow(lambda b: ask(b, buckets), "task int, bucket int, packed binary")
    asked = asked.repartitionById(buckets, F.col("task")).sortWithinPartitions("bucket")

    def gathered(df: DataFrame, name: str) -> DataFrame:
        home = df.repartitionById(buckets, F.col("home")).select("packed")
        return home.mapInArrow(at_home, "id bigint, mark int, said binary").withColumnRenamed("said", name)

    replies = gathered(asked.mapInArrow(lambda b: reply(b, buckets), "home int, packed binary"), "shared")
    sent = rows.join(replies, key).select("id", "mark", "text", "shared").mapInArrow(lambda b: send(b, buckets), "bucket int, packed binary")
    # known ranges need no bucket's company: they are dealt out evenly
    own = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("packed"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    dealt = sent.repartitionById(buckets, own).sortWithinPartitions("bucket")
    ranges = gathered(dealt.mapInArrow(lambda b: resolve(b, buckets), "home int, packed binary"), "ranges")
    joined = rows.join(ranges, key, "left").select("id", "text", "ranges")

    def finish(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for lo, hi, data, offs in blocks(*utf8_view(batch.column(1)), 8 << 20):
                raw = data.tobytes()
                done = [remove(raw[a:b], r) for a, b, r in zip(offs.tolist(), offs[1:].tolist(), lists[lo:hi])]
                gone = [sum(b - a for a, b in runs) for _, runs in done]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(gone, pa.int64()), pa.array([len(r) for _, r in done], pa.int64()), binaries([k for k, _ in done]), pa.array([[{"start": a, "end": b} for a, b in r] for _, r in done], span)],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    out = joined.mapInArrow(finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumn("id", F.nullif("id", F.lit(last))).withColumnRenamed("id", "doc_id")


def query(spark, sf_dir):
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
