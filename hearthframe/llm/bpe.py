"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation runs on arrays. Every codepoint gets a class; the pieces of the public
pattern then begin where classes change, with three corrections: a space joins the piece
after it, a run of white space gives up its last character, and an apostrophe may open a
contraction. The contraction automaton is the only part with memory. Each symbol is a
function from state to state; functions compose associatively, so a doubling scan gives
the state at every position at once. Only symbols near an apostrophe enter the scan, as
all others are constant functions.

Slices of the text go through a bounded cache of piece -> ids. The pieces a block lacks
are merged together: all adjacent pairs of all pieces look up their rank in one hash
table, each piece merges its lowest pair, until no piece has a pair left. A piece of more than
``LONG_PIECE`` bytes merges by itself, by a queue of its pairs.

Defined cases: a null text is the empty text; empty text has no ids; bytes that are not
UTF-8 are read as U+FFFD; repeated rows are encoded again; other columns pass through.
One document is the least unit of work, so memory follows the longest document.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import blocks, same_slices, text_pass, utf8_view, word_keys

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = 0, 1, 2, 3, 4, 5
CACHE_PIECES, LONG_PIECE = 150_000, 512
#: White_Space codepoints besides the space.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for lo in (0, 0x20000, 0x30000, 0xE0000):  # the planes with letters or numbers
        for cp in range(lo, lo + (0x20000 if lo == 0 else 0x10000)):
            kind = unicodedata.category(chr(cp))[0]
            table[cp] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[WHITE] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


# The contraction automaton. States: OPEN (an apostrophe here opens a contraction), SHUT, Q (just
# after such an apostrophe), R (after 'r or 'v: e must follow), L (after 'l: l must follow).
# A word of one letter ends in OPEN, like any letter. Its input symbols:
OPEN, SHUT, Q, R, L = range(5)
SYMBOLS = {"word": 0, "shut": 1, "quote": 2, "short": 3, "rv": 4, "e": 5, "l": 6}
STEP = np.zeros((7, 5), np.uint8)
STEP[0] = OPEN  # letters, numbers, blanks other than the space
STEP[1] = SHUT  # the space and all symbols
STEP[2] = [Q, SHUT, SHUT, Q, Q]  # after 'r a quote follows a letter
STEP[3] = OPEN  # s t m d
STEP[4] = [OPEN, OPEN, R, OPEN, OPEN]  # r v
STEP[5] = OPEN  # e
STEP[6] = [OPEN, OPEN, L, OPEN, OPEN]  # l


def scan_states(functions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """State before each symbol, given each symbol's function and where runs start (state OPEN).

    Doubling: after round k a row holds the composition of the last 2**k functions of its run.
    """
    n, states = functions.shape
    f = functions.copy()
    f[start] = f[start][:, :1]  # a run starts in OPEN whatever came before
    step = 1
    while step < n:
        open_rows = np.flatnonzero((f != f[:, :1]).any(axis=1))
        open_rows = open_rows[open_rows >= step]
        if not len(open_rows):
            break
        f[open_rows] = np.take_along_axis(f[open_rows], f[open_rows - step], axis=1)
        step *= 2
    before = np.empty(n, np.uint8)
    before[0] = OPEN
    before[1:] = f[:-1, 0]
    before[start] = OPEN
    return before


def piece_starts(cp: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a piece begins. ``first`` marks the first codepoint of each text."""
    n = len(cp)
    kind = table[np.minimum(cp, 0x10FFFF)]
    quote = kind == QUOTE
    core = np.where(quote, OTHER, kind).astype(np.uint8)
    white = (kind == SPACE) | (kind == BLANK)
    was = np.empty_like(core)
    was[0], was[1:] = OTHER, core[:-1]
    was_white = np.empty(n, bool)
    was_white[0], was_white[1:] = False, white[:-1]
    last = np.empty(n, bool)  # the next codepoint is in this text and not white
    last[-1] = False
    last[:-1] = ~white[1:] & ~first[1:]
    begin = np.where(white, ~was_white | last, (was != core) & (was != SPACE)) | first
    if quote.any():
        at = np.flatnonzero(quote)
        near = np.unique((at[:, None] + np.arange(-1, 4)).ravel())
        near = near[(near >= 0) & (near < n)]
        sym = np.full(len(near), SYMBOLS["shut"], np.uint8)
        k, c = kind[near], cp[near]
        sym[(k == LETTER) | (k == NUMBER) | (k == BLANK)] = SYMBOLS["word"]
        sym[k == QUOTE] = SYMBOLS["quote"]
        for chars, name in (("stmd", "short"), ("rv", "rv"), ("e", "e"), ("l", "l")):
            sym[np.isin(c, [ord(x) for x in chars])] = SYMBOLS[name]
        begin_run = first[near].copy()
        begin_run[0] = True
        # a gap in ``near`` is bridged by a symbol whose own function is constant: its first row is no quote
        gap = np.flatnonzero(np.diff(near) > 1) + 1
        functions = STEP[sym]
        if len(gap):
            # what precedes a gap's first row is unknown; that row is never a quote, so its function is made constant
            lone = gap[~first[near[gap]]]
            functions[lone] = functions[lone][:, :1]
        before = scan_states(functions, begin_run)
        # an apostrophe that opens, and the length of what it opens
        opens = (sym == SYMBOLS["quote"]) & ((before == OPEN) | (before == R) | (before == L))
        length = np.zeros(len(near), np.int64)
        follow = lambda j: np.append(sym[j:], np.full(j, 255, np.uint8))
        inside = lambda j: np.append((near[j:] - near[:-j] == j), np.zeros(j, bool))
        length[opens & inside(1) & (follow(1) == SYMBOLS["short"])] = 2
        length[opens & inside(2) & (follow(1) == SYMBOLS["rv"]) & (follow(2) == SYMBOLS["e"])] = 3
        length[opens & inside(2) & (follow(1) == SYMBOLS["l"]) & (follow(2) == SYMBOLS["l"])] = 3
        where = np.flatnonzero(length)
        for size in (2, 3):
            a = near[where[length[where] == size]]
            ok = np.ones(len(a), bool)
            for j in range(1, size):
                ok &= ~first[a + j]
            a = a[ok]
            begin[a] = True
            for j in range(1, size):
                begin[a + j] = False
            after = a + size
            after = after[after < n]
            begin[after[~white[after]]] = True
    return begin


class Ranks:
    """A vocabulary of ranks with a hash table of its pair merges."""

    SIZE = 1 << 20

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.bytes_of = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # each way a token splits in two tokens is a pair that merges to it
        lefts, rights, made = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    lefts.append(a), rights.append(b), made.append(rank)
        key = (np.array(lefts, np.uint64) << np.uint64(32)) | np.array(rights, np.uint64)
        self.table = np.full(self.SIZE, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.zeros(self.SIZE, np.int32)
        value, slot = np.array(made, np.int32), self._slot(key)
        while len(key):
            free = self.table[slot] == np.iinfo(np.uint64).max
            put, at = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[at]
            self.table[put], self.value[put] = key[chosen], value[chosen]
            rest = np.ones(len(key), bool)
            rest[chosen] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) % self.SIZE
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lens = np.array([len(b) for b in self.bytes_of], np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        self.cache: dict[bytes, bytes] = {}
        self.pairs: dict[int, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), self.NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = self.table[slot]
            hit = found == key
            out[todo[hit]] = self.value[slot[hit]]
            more = ~hit & (found != np.iinfo(np.uint64).max)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) % self.SIZE
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit bytes, all pieces at once."""
        out: list[bytes] = [b""] * len(pieces)
        lens = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        rank = np.full(len(ids), self.NONE, np.int32)  # of the pair (i, i + 1)
        near = np.flatnonzero(owner[:-1] == owner[1:])
        rank[near] = self.pair_ranks(ids[near], ids[near + 1])
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        while len(ids):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(begin, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, begin), sizes)
            live = least != self.NONE
            if not live.all():
                done_ids.append(ids[~live]), done_owner.append(owner[~live])
            pick = (rank == least) & live
            # of overlapping equal pairs every second one merges, from the left
            if (pick[1:] & pick[:-1]).any():
                idx = np.arange(len(pick))
                run_start = np.maximum.accumulate(np.where(pick & ~np.append(False, pick[:-1]), idx, 0))
                pick &= (idx - run_start) % 2 == 0
            at = np.flatnonzero(pick)
            ids[at] = rank[at]
            live[at + 1] = False
            place = np.cumsum(live)[at] - 1  # of the merged symbols, once the others have closed up
            ids, owner, rank = ids[live], owner[live], rank[live]
            if not len(ids):
                break
            stale = np.zeros(len(ids), bool)
            stale[place] = True
            stale[place[place > 0] - 1] = True
            rank[stale] = self.NONE
            fresh = np.flatnonzero(stale[:-1])
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self.pair_ranks(ids[fresh], ids[fresh + 1])
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        flat = all_ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(all_owner, minlength=len(pieces))) * 4).tolist()
        a = 0
        for k, b in enumerate(ends):
            out[k] = flat[a:b]
            a = b
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece by a queue of pairs: merges cost their logarithm and not a pass over the piece."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks != self.NONE)
        queue = list(zip(ranks[at].tolist(), at.tolist()))
        heapq.heapify(queue)
        if not self.pairs:
            filled = np.flatnonzero(self.table != np.iinfo(np.uint64).max)
            self.pairs.update(zip(self.table[filled].tolist(), self.value[filled].tolist()))
        pairs, ids, n = self.pairs, ids.tolist(), len(piece)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = pop(queue)
            j = after[i] if alive[i] else n
            if j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue  # an entry of a pair that is gone
            ids[i], alive[j], k = rank, False, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    push(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                push(queue, (r, h))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def look_up(self, slices: list[bytes]) -> list[bytes]:
        cache = self.cache
        try:
            return [cache[s] for s in slices]
        except KeyError:
            pass
        new = set(slices).difference(cache)
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = set(slices)
        ranks, rest = self.ranks, []
        for p in new:
            if p in ranks:
                cache[p] = ranks[p].to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                cache[p] = self.merge_long(p)
            else:
                rest.append(p)
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            cache.update(zip(part, self.merge(part)))
        return [cache[s] for s in slices]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, by the offsets of tokens in the vocabulary's blob."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.at[ids] - (ends - lens), lens) + np.arange(ends[-1])].tobytes()


_LOADED: dict = {}


def load(path: str) -> Ranks:
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def classes() -> np.ndarray:
    if "classes" not in _LOADED:
        _LOADED["classes"] = class_table()
    return _LOADED["classes"]


def split_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of pieces with the end added, pieces of each row as row + 1 borders)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        cp = data.astype(np.uint32)
    else:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = at[piece_starts(cp, first[:-1][lead], classes())]
    return np.append(begin, len(data)), np.searchsorted(begin, offsets)


def clean(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block as valid UTF-8: where bytes are not, each row is repaired on its own."""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        return data, offsets
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def encode_block(ranks: Ranks, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, each row's border among them). Equal slices are looked up once."""
    cut, rows = split_block(data, offsets)
    starts, lens = cut[:-1], np.diff(cut)
    if not len(starts):
        return np.zeros(0, "<u4"), rows
    padded = np.append(data, np.zeros(8, np.uint8))
    keys = word_keys(padded, starts, lens, int(lens.max()), 0xD6E8FEB86659FD93)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    if not same_slices(padded, starts, starts[first[which]], lens, lens[first[which]]):
        first = which = np.arange(len(starts))  # two slices share a key: each is looked up by itself
    raw = data.tobytes()
    found = ranks.look_up([raw[a : a + n] for a, n in zip(starts[first].tolist(), lens[first].tolist())])
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    each = sizes[which]
    stop = np.append(0, np.cumsum(each))
    return flat[np.repeat(at[which] - stop[:-1], each) + np.arange(stop[-1])], stop[rows]


def binary_rows(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Rows of a flat array as a binary column."""
    data = np.ascontiguousarray(values)
    at = (borders * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False, offsets: bool = False) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (long), ``ids`` (binary, little-endian 32-bit).

    ``decoded=True`` adds ``decoded``, the bytes that the ids give back; ``offsets=True`` adds
    ``token_ends`` (binary, little-endian 32-bit byte offset of each token's end in the text).
    """

    def kernel(col: pa.Array) -> list[pa.Array]:
        ranks = load(path)
        ids, counts, texts, ends = [], [], [], []
        for _, _, data, offs in blocks(*utf8_view(col)):
            data, offs = clean(data, offs)
            own, rows = encode_block(ranks, data, offs)
            counts.append(np.diff(rows))
            ids.append(binary_rows(own, rows))
            if decoded or offsets:
                stop = np.append(0, np.cumsum(ranks.lens[own]))
                if decoded:
                    texts.append(binary_rows(np.frombuffer(ranks.decode(own), np.uint8), stop[rows]))
                if offsets:
                    ends.append(binary_rows((stop[1:] - np.repeat(stop[rows[:-1]], np.diff(rows))).astype("<u4"), rows))
        join = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        made = [pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()), join(ids)]
        return made + [join(texts)] * decoded + [join(ends)] * offsets

    added = "n_tokens bigint, ids binary" + ", decoded binary" * decoded + ", token_ends binary" * offsets
    return text_pass(df, text_col, kernel, added, keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary) from a column of ids; null ids give empty bytes."""

    def kernel(col: pa.Array) -> list[pa.Array]:
        ranks = load(path)
        return [pa.array([ranks.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in col], pa.binary())]

    return text_pass(df, ids_col, kernel, "decoded binary", keep)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, vocabulary(), keep=["doc_id"], decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
