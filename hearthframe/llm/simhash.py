"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of whole texts come from one Arrow pass. Distinct fingerprints then meet in
``TABLES`` tables: the 64 bits split in four blocks of 16, the other 48 bits again in four
blocks of 12; two fingerprints that differ in at most three bits agree in one outer and
one inner block, so they share one of 16 keys of 28 bits. Inside a table's bucket the
comparison is bit-sliced: fingerprints are stored as vertical bit planes, the distances of
64 pairs a machine word are counted by carry-save counters of three bits, and a block of
words is abandoned once every pair in it is beyond the radius.

A bucket emits a spanning forest of its links and not its pairs, so a group of n alike
fingerprints makes n - 1 edges a table. Copies of one text are one fingerprint from the
first step on. Components are found by stars over the edges, without any document.

Buckets of more than ``SPLIT`` fingerprints are dealt anew by four blocks of further bits (one of
which near fingerprints share), ``DEEPER`` times if need be; what is still too large is split in parts, and every
pair of parts is compared by a task of its own, so no bucket has to fit one task.

Defined cases: null, empty and wordless texts have fingerprint zero, linked like any other;
a null id never names a component, a component of null ids only has a null id; repeated
rows come out as often as they came; other columns are ignored by ``group`` and pass
``fingerprints``. Empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .components import components
from .frames import blocks, column, text_pass, utf8_view

SEED, SHINGLE, RADIUS = 42, 3, 3
SPLIT, DEEPER = 4_096, 2
LANES = 64  # words of a block that is abandoned together: 4096 pairs


def fingerprint(raw: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[: len(words) - SHINGLE]]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fp`` (long: the 64 bits as a signed number)."""

    def kernel(col: pa.Array) -> list[pa.Array]:
        out = []
        for _, _, data, offs in blocks(*utf8_view(col)):
            raw = data.tobytes()
            out.extend(fingerprint(raw[a:b]) for a, b in zip(offs.tolist(), offs[1:].tolist()))
        return [pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())]

    return text_pass(df, text_col, kernel, "fp bigint", keep)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row k holds bit k of every fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(fps) % 64
    bits = np.concatenate((bits, np.zeros((pad, 64), np.uint8)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes moved down by ``by`` fingerprints."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    width = planes.shape[1]
    if words < width:
        out[:, : width - words] = planes[:, words:] >> np.uint64(bits)
        if bits and words + 1 < width:
            out[:, : width - words - 1] |= planes[:, words + 1 :] << np.uint64(64 - bits)
    return out


#: Order in which planes are added up: spread, so that unlike pairs leave early in any table.
ORDER = [(k * 27) % 64 for k in range(64)]


def within(left: np.ndarray, right: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit mask (packed words) of lanes whose planes differ in at most ``radius`` (3 or less) places."""
    live = valid.copy()
    words = np.flatnonzero(live)
    one = np.zeros(len(words), np.uint64)
    two, over = one.copy(), one.copy()
    for step, k in enumerate(ORDER):
        differs = left[k][words] ^ right[k][words]
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if step % 8 == 7:
            # whole blocks of words of which every lane is over the radius leave
            dead = (~over & live[words]) == 0
            if dead.any():
                live[words[dead]] = 0
                stay = ~dead
                words, one, two, over = words[stay], one[stay], two[stay], over[stay]
                if not len(words):
                    return live
    count_over = over
    if radius < 3:
        count_over = over | (two & (one if radius == 2 else np.uint64(0xFFFFFFFFFFFFFFFF))) | (one if radius == 0 else np.uint64(0))
    live[words] &= ~count_over
    return live


def lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little"))


class Forest:
    """Union-find over positions, with labels for filtering whole arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join_all(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins every pair; the pairs that joined two trees."""
        apart = self.up[a] != self.up[b]
        made = []
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                made.append((x, y))
        if made:
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
        return made


def bucket_edges(keys: np.ndarray, fps: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest edges of the links inside each run of equal keys (sorted).

    Pairs at offset d of all buckets are compared in one sweep; the sweeps end at the
    largest bucket. ``side``: where given, only pairs of different sides count (parts of a split
    bucket; pairs inside a part are another task's).
    """
    n = len(fps)
    if not n:
        return []
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, n))
    size, reach = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes)  # of each row's bucket: size and end
    forest, edges = Forest(n), []
    index, d, planes = np.flatnonzero(size > 1), 1, None
    while len(index) > d:
        ok = np.zeros(len(index), bool)
        ok[:-d] = (index[d:] - index[:-d] == d) & (index[:-d] + d < reach[index[:-d]])
        if side is not None:
            ok[:-d] &= side[index[d:]] != side[index[:-d]]
        if ok.any():
            if planes is None:
                planes = planes_of(fps[index])
            valid = np.packbits(np.append(ok, np.zeros(-len(ok) % 64, bool)), bitorder="little").view("<u8")
            at = lanes(within(planes, shifted(planes, d), valid, radius))
            edges += forest.join_all(index[at], index[at + d])
        d += 1
        stay = size[index] > d
        if not stay.all():
            index, planes = index[stay], None
    return edges


OUTER, INNER = 4, 4


def table_keys(fp) -> list:
    """Sixteen (table, key) structs of a signed 64-bit fingerprint column."""
    out = []
    for o in range(OUTER):
        outer = F.shiftrightunsigned(fp, 16 * o).bitwiseAND(F.lit(0xFFFF))
        rest = [k for k in range(OUTER) if k != o]
        joined = F.lit(0).cast("long")
        for place, k in enumerate(rest):
            joined = joined.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("long"), 16 * place))
        for i in range(INNER):
            inner = F.shiftrightunsigned(joined, 12 * i).bitwiseAND(F.lit(0xFFF))
            table = o * INNER + i
            out.append(F.lit(table).cast("long") * F.lit(1 << 28) + outer.cast("long") * F.lit(1 << 12) + inner.cast("long"))
    return out


def block_masks(used: int, parts: int = 4) -> list[int]:
    """The bits that a key has not used yet, in ``parts`` blocks: fingerprints within three bits agree in one of them."""
    free = [k for k in range(64) if not used >> k & 1]
    return [sum(1 << k for k in free[i::parts]) for i in range(parts)]


def used_bits() -> list[int]:
    """The bits that each of the sixteen tables' keys holds."""
    out = []
    for o in range(OUTER):
        rest = [k for k in range(64) if k // 16 != o]
        out += [(0xFFFF << 16 * o) | sum(1 << k for k in rest[12 * i : 12 * i + 12]) for i in range(INNER)]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links between distinct fingerprints (column ``fp``).

    A bucket of more than ``SPLIT`` fingerprints is dealt anew by four blocks of the bits its key leaves, so a
    row of it is copied four times whatever the bucket's size; buckets that stay too large after
    ``DEEPER`` rounds are split in parts, every pair of parts a cell.
    """
    ship(distinct.sparkSession)
    tables = F.array(*[F.struct(k.alias("key"), F.lit(i).alias("path")) for i, k in enumerate(table_keys(F.col("fp")))])
    keyed = distinct.select(F.explode(tables).alias("t"), "fp").select("t.key", "t.path", "fp")
    used, found = used_bits(), None
    for depth in range(DEEPER + 1):
        large = keyed.groupBy("key").count().filter(F.col("count") > SPLIT).checkpoint()
        some = not large.isEmpty()
        if depth == DEEPER and some:
            edges = _compare(keyed, large.select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), radius)
        else:
            edges = _compare(keyed.join(large, "key", "left_anti") if some else keyed, None, radius)
        found = edges if found is None else found.unionByName(edges)
        if not some or depth == DEEPER:
            break
        masks = [block_masks(u) for u in used]
        flat = F.array(*[F.array(*[F.lit(signed(m)) for m in ms]) for ms in masks])
        deal = F.transform(F.element_at(flat, F.col("path") + 1), lambda m, j: F.struct(F.xxhash64("key", j, F.col("fp").bitwiseAND(m)).alias("key"), (F.col("path") * 4 + j).alias("path")))
        keyed = keyed.join(large.select("key"), "key", "left_semi").select(F.explode(deal).alias("t"), "fp").select("t.key", "t.path", "fp")
        used = [u | m for u, ms in zip(used, masks) for m in ms]
    return found.distinct()


def _compare(keyed: DataFrame, large: DataFrame | None, radius: int) -> DataFrame:
    """Edges inside every bucket (rows of one key); ``large``: keys with the parts that they are split in."""
    if large is None:
        dealt = keyed.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "fp")
    else:
        dealt = keyed.join(large, "key", "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("x"), F.greatest(k, part).alias("y")))
        whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
        dealt = dealt.select("key", "fp", F.coalesce(part, F.lit(0)).alias("part"), F.explode(F.when(F.col("parts").isNull(), whole).otherwise(others)).alias("cell"))
        dealt = dealt.select("key", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "part", "fp")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "fp")
    schema = "a bigint, b bigint"

    def run(batches):
        rest: list[np.ndarray] | None = None

        def solve(cols):
            key, x, y, part, fp = cols
            group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(key) else key
            mixed = x != y
            edges = []
            for mask, side in ((~mixed, None), (mixed, part)):
                at = np.flatnonzero(mask)
                if len(at):
                    found = bucket_edges(group[at], fp[at].view(np.uint64), None if side is None else side[at], radius)
                    edges += [(int(fp[at[a]]), int(fp[at[b]])) for a, b in found]
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            n = len(cols[0])
            if not n:
                continue
            # the last group may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield solve([c[:cut] for c in cols])
        if rest is not None:
            yield solve(rest)

    return dealt.mapInArrow(run, schema)


def rooted_classes(rows: DataFrame, least) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint: the minimum of ``least`` over its rows, and its component's root."""
    classes = rows.groupBy("fp").agg(F.min(least).alias("least")).checkpoint()
    roots = components(links(classes.select("fp")))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def text_key(text) -> list:
    """Two 64-bit hashes that stand for a text in keys."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(text, F.lit(1)).alias("text_b")]


def heads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_a, text_b) of one row of every component: the least id, null last, then the least ``text_key``."""
    from ..session import checkpoint_ready

    checkpoint_ready(docs.sparkSession)
    text = column(text_col)
    rows = fingerprints(docs.select(column(id_col).alias("doc_id"), text.alias("text"), *text_key(text)), "text", ["doc_id", "text_a", "text_b"]).checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    return rooted_classes(rows, order).groupBy("root").agg(F.min("least").alias("h")).select("h.doc_id", "h.text_a", "h.text_b")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    from ..session import checkpoint_ready

    checkpoint_ready(docs.sparkSession)
    rows = fingerprints(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "text", ["doc_id"]).checkpoint()
    rooted = rooted_classes(rows, F.col("doc_id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
