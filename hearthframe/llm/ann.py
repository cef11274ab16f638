"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree's top is fitted on the driver to at most ``SAMPLE`` vectors (by hash of the id). Leaves that then
hold over ``ROWS_A_LEAF`` rows are split by trees fitted in executors, each to about ``SUB_SAMPLE`` of its leaf's
rows, so leaves grow in number with the table, up to SAMPLE / LEAF * SUB_SAMPLE / LEAF. Largest inner
product becomes nearest point by the usual extra coordinate sqrt(1 - |x|^2 / M^2). Every row
descends to one leaf.

A query visits leaves from a priority queue of tree nodes, nearest centre first. How many it
visits is calibrated: for ``CALIBRATION`` queries the exact neighbours are found by brute
force over all rows (in blocks; a task keeps the best k only), and the visits are widened until
the mean recall of these reaches ``TARGET``. A query also goes on until its leaves hold more than k rows.
Vectors without any clusters make the calibrated visits many (README gives figures): the recall is
kept then, not the saving.

Neighbouring leaves make up cells of bounded sizes. Queries and rows travel in packed blobs, a blob a cell
and block, a query once to each cell with the leaves that it visits there; inside a cell a query meets the rows
of these leaves only. A leaf that a third of all rows share is a cell dealt in parts of the rows' and of the queries'
blobs. Cells return their best k for each query and a ranked window joins them. Scores are sums of products in double precision over the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different dimensions are searched each among their own;
a query's own id is no candidate, repeated rows of other ids are candidates each; of several vectors under one
query id (of one dimension) the least by its components asks; ties go to the smaller id; with k
candidates or fewer all are returned; no query or no candidate gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready, ship
from .frames import column

K, TARGET = 20, 0.93
SAMPLE, LEAF, BRANCH, CALIBRATION = 16_384, 32, 16, 256
ROWS_A_LEAF, SUB_SAMPLE = 4_096, 4_096
ROWS_A_CELL, QUERIES_A_CELL, QUERIES_A_TASK = 8_192, 2_048, 512
SLACK = 1e-9


class Tree:
    """Centres of all nodes, children of inner nodes, numbers of leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.least = leaf
        self.centres, self.children, self.leaf_of = [points.mean(axis=0)], [[]], [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            parts = self._split(own, rng) if len(own) > 2 * leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for part in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), part))
                self.centres.append(part.mean(axis=0))
                self.children.append([])
                self.leaf_of.append(-1)
        self.centres = np.array(self.centres)

    def _split(self, own: np.ndarray, rng) -> list[np.ndarray]:
        k = min(BRANCH, max(2, len(own) // self.least))
        centres = own[rng.choice(len(own), k, replace=False)]
        for _ in range(8):
            near = ((centres**2).sum(axis=1) - 2 * own @ centres.T).argmin(axis=1)
            used = np.unique(near)
            centres = np.array([own[near == c].mean(axis=0) for c in used])
        near = ((centres**2).sum(axis=1) - 2 * own @ centres.T).argmin(axis=1)
        return [own[near == c] for c in np.unique(near)]

    def graft(self, trees: dict[int, Tree]) -> None:
        """Trees grown in leaves take these leaves' places."""
        for node in [n for n, leaf in enumerate(self.leaf_of) if leaf in trees]:
            tree, base = trees[self.leaf_of[node]], len(self.leaf_of) - 1  # the tree's root is the node itself
            new = lambda n, node=node, base=base: node if n == 0 else base + n
            for n, (kids, leaf) in enumerate(zip(tree.children, tree.leaf_of)):
                kids = [new(kid) for kid in kids]
                if n == 0:
                    self.children[node], self.leaf_of[node] = kids, 0 if leaf >= 0 else -1
                else:
                    self.children.append(kids), self.leaf_of.append(0 if leaf >= 0 else -1)
            self.centres = np.vstack((self.centres, tree.centres[1:]))
        self.leaves = 0
        for n, leaf in enumerate(self.leaf_of):
            if leaf >= 0:
                self.leaf_of[n] = self.leaves
                self.leaves += 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, by descent."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf_of[node]
                continue
            c = self.centres[kids]
            near = ((c**2).sum(axis=1) - 2 * points[own] @ c.T).argmin(axis=1)
            todo += [(kid, own[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def visits(self, point: np.ndarray, least: int, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves, best bin first: ``least`` of them, and more until they hold over ``rows`` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < least or held <= rows):
            _, node = heapq.heappop(queue)
            if (leaf := self.leaf_of[node]) >= 0:
                if sizes[leaf]:
                    out.append(leaf)
                    held += int(sizes[leaf])
                continue
            kids = self.children[node]
            d = ((self.centres[kids] - point) ** 2).sum(axis=1)
            for x, kid in zip(d.tolist(), kids):
                heapq.heappush(queue, (x, kid))
        return out


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """Rows with the extra coordinate."""
    scaled = vectors / top
    return np.hstack((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))[:, None]))


def lift_queries(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
    return np.hstack((unit, np.zeros((len(unit), 1))))


def best(q_ids, queries, v_ids, vectors, k: int):
    """(query's row, vector's row, score) of the k best of each query; ties to the smaller id."""
    out_q, out_v, out_s = [], [], []
    step = max(1, (1 << 22) // max(1, len(vectors)))
    for lo in range(0, len(queries), step):
        rough = queries[lo : lo + step] @ vectors.T
        rough[q_ids[lo : lo + step, None] == v_ids[None, :]] = -np.inf
        if k < len(vectors):
            limit = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            limit = limit - SLACK * (1 + np.abs(limit))
        else:
            limit = np.full(len(rough), -np.finfo(float).max)
        take = (rough >= limit[:, None]) & (rough > -np.inf)
        q, v = np.nonzero(take)
        score = np.empty(len(q))
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = (queries[lo + q[part]] * vectors[v[part]]).sum(axis=1)
        order = np.lexsort((v_ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        begin = np.searchsorted(q, np.arange(len(rough)))
        first = np.arange(len(q)) - begin[q] < k
        out_q.append(lo + q[first]), out_v.append(v[first]), out_s.append(score[first])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_q, int), cat(out_v, int), cat(out_s, float)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part, whatever their dimension."""
    rows = df.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad).filter(F.exists("embedding", lambda x: x != 0))


SCHEMA = "query_id bigint, vec_id bigint, score double"
BLOB = "cell int, n int, packed binary"


def table_of(q, v, s) -> pa.Table:
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def packed(cell: np.ndarray, row: np.ndarray, leaf: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> pa.RecordBatch:
    """Blobs of at most ``most`` rows of one cell: ids, vectors, and the leaves of each row in that cell.

    Entry k says that ``row[k]`` belongs to ``leaf[k]`` in ``cell[k]``; a row has one leaf, a query one a visit.
    """
    order = np.lexsort((row, cell))
    cell, row, leaf = cell[order], row[order], leaf[order]
    first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (row[1:] != row[:-1]))) if len(cell) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(cell)))
    cells = cell[first]
    borders = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist() if len(cells) else []
    names, sizes, out = [], [], []
    for lo, hi in zip(borders, [*borders[1:], len(cells)]):
        for at in range(lo, hi, most):
            end = min(at + most, hi)
            rows = row[first[at:end]]
            names.append(int(cells[lo])), sizes.append(end - at)
            leaves = leaf[first[at] : first[end] if end < len(first) else len(leaf)]
            out.append(b"".join((np.array([end - at], "<i8").tobytes(), ids[rows].astype("<i8").tobytes(), vectors[rows].astype("<f8").tobytes(), counts[at:end].astype("<i4").tobytes(), leaves.astype("<i4").tobytes())))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["cell", "n", "packed"])


def unpacked(blobs: list[bytes], dim: int):
    """(ids, vectors, row of each leaf entry, its leaf) of blobs."""
    ids, vectors, rows, leaves, seen = [np.zeros(0, "<i8")], [np.zeros((0, dim), "<f8")], [np.zeros(0, np.int64)], [np.zeros(0, "<i4")], 0
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        at = 8 + 8 * n
        ids.append(np.frombuffer(blob, "<i8", n, 8)), vectors.append(np.frombuffer(blob, "<f8", n * dim, at).reshape(n, dim))
        counts = np.frombuffer(blob, "<i4", n, at + 8 * n * dim)
        rows.append(seen + np.repeat(np.arange(n), counts)), leaves.append(np.frombuffer(blob, "<i4", offset=at + 8 * n * dim + 4 * n))
        seen += n
    return np.concatenate(ids), np.concatenate(vectors), np.concatenate(rows), np.concatenate(leaves)


def in_cell(queries, rows, k: int):
    """(query id, vector's id, score): the k best of each query among the rows of the leaves that it visits here."""
    q_ids, asking, q_row, q_leaf = queries
    v_ids, vectors, v_row, v_leaf = rows
    by_q, by_v = np.argsort(q_leaf, kind="stable"), np.argsort(v_leaf, kind="stable")
    found = []
    for leaf in np.intersect1d(q_leaf, v_leaf).tolist():
        q = q_row[by_q[slice(*np.searchsorted(q_leaf[by_q], [leaf, leaf + 1]))]]
        v = v_row[by_v[slice(*np.searchsorted(v_leaf[by_v], [leaf, leaf + 1]))]]
        a, b, score = best(q_ids[q], asking[q], v_ids[v], vectors[v], k)
        found.append((q[a], v_ids[v[b]], score))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q, v, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, np.arange(len(q_ids)))[q] < k
    return q_ids[q[first]], v[first], score[first]


def search(df: DataFrame, every: int = 20, k: int = K, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark), checkpoint_ready(spark)
    rows = usable(df, id_col, vector_col)
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(size).alias("m"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim, count, longest, asked in dims.orderBy("dim").collect():
        if asked:
            out = out.unionByName(_search(rows.filter(F.size("embedding") == dim), dim, count, asked, float(np.sqrt(longest)), every, k, target))
    return out


def _deepen(rows: DataFrame, tree: Tree, dim: int, top: float) -> None:
    """Splits the leaves that hold over ``ROWS_A_LEAF`` rows, each by a tree fitted in an executor to a sample of its rows."""
    spark = rows.sparkSession
    first = spark.sparkContext.broadcast(tree)

    def leaves(batches):
        for b in batches:
            leaf, n = np.unique(first.value.assign(lift(matrix(b.column(1), dim), top)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(n, pa.int64())], names=["leaf", "n"])

    counts = rows.mapInArrow(leaves, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > ROWS_A_LEAF).collect()
    if not counts:
        return
    sizes = np.zeros(tree.leaves)
    for leaf, n in counts:
        sizes[leaf] = n

    def sampled(batches):
        for b in batches:
            points = lift(matrix(b.column(1), dim), top)
            leaf = first.value.assign(points)
            chance = ((np.asarray(b.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) / float(1 << 24)
            keep = np.flatnonzero(chance * sizes[leaf] < np.where(sizes[leaf] > 0, SUB_SAMPLE, 0))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[keep].astype(np.int32)), pa.array([points[k].tobytes() for k in keep.tolist()], pa.binary())], names=["leaf", "point"])

    def fit(group: pa.Table) -> pa.Table:
        leaf = group["leaf"][0].as_py()
        points = np.frombuffer(b"".join(group["point"].to_pylist()), float).reshape(group.num_rows, -1)
        grown = Tree(points, max(LEAF, int(len(points) * ROWS_A_LEAF / sizes[leaf])))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(grown)], pa.binary())})

    made = rows.mapInArrow(sampled, "leaf int, point binary").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect()
    tree.graft({leaf: pickle.loads(raw) for leaf, raw in made})


def _search(rows: DataFrame, dim: int, count: int, asked: int, top: float, every: int, k: int, target: float) -> DataFrame:
    """The search among ``count`` rows of one dimension with ``asked`` queries; ``top`` is the longest vector's length."""
    spark = rows.sparkSession
    chance = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    sample = rows.filter(chance < int(min(1.0, SAMPLE / count) * (1 << 30))).select("embedding")
    points = np.array([r[0] for r in sample.collect()], float).reshape(-1, dim)
    if not len(points):
        points = np.array([rows.first()[1]], float)
    tree = Tree(lift(points, top))
    _deepen(rows, tree, dim, top)
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE / LEAF * SUB_SAMPLE / LEAF leaves

    def counted(batches):
        for b in batches:
            leaf, n = np.unique(shared.value.assign(lift(matrix(b.column(1), dim), top)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(n, pa.int64())], names=["leaf", "n"])

    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in rows.mapInArrow(counted, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[leaf] = n
    # neighbouring leaves share a cell of about ROWS_A_CELL rows; a larger leaf is a cell of its own
    cell_of = np.unique((np.cumsum(sizes) - sizes) // ROWS_A_CELL + np.cumsum(sizes > ROWS_A_CELL), return_inverse=True)[1].astype(np.int32)
    cell_sizes = np.bincount(cell_of, sizes).astype(np.int64)

    def place(batches):
        for b in batches:
            ids, vectors = np.asarray(b.column(0)), matrix(b.column(1), dim)
            leaf = shared.value.assign(lift(vectors, top))
            yield packed(cell_of[leaf], np.arange(len(ids)), leaf, ids, vectors, ROWS_A_CELL)

    placed = rows.mapInArrow(place, BLOB)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("q"))
    trial = queries.orderBy(F.xxhash64("query_id", F.lit(5)), "query_id").limit(CALIBRATION).collect()
    t_ids, t_vectors = np.array([r[0] for r in trial]), np.array([r[1] for r in trial], float)

    def brute(batches):
        kept = None
        for b in batches:
            ids, vectors = np.asarray(b.column(0)), matrix(b.column(1), dim)
            q, v, s = best(t_ids, t_vectors, ids, vectors, k)
            now = (q, ids[v], s, shared.value.assign(lift(vectors[v], top)))
            if kept is not None:
                now = tuple(np.concatenate(x) for x in zip(kept, now))
            order = np.lexsort((now[1], -now[2], now[0]))
            now = tuple(x[order] for x in now)
            first = np.arange(len(order)) - np.searchsorted(now[0], np.arange(len(t_ids)))[now[0]] < k
            kept = tuple(x[first] for x in now)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.float64()), pa.array(kept[3], pa.int32())], names=["t", "vec_id", "score", "leaf"])

    by_trial = Window.partitionBy("t").orderBy(F.desc("score"), "vec_id")
    exact = rows.mapInArrow(brute, "t bigint, vec_id bigint, score double, leaf int").withColumn("r", F.row_number().over(by_trial)).filter(F.col("r") <= k).select("t", "leaf").collect()
    lifted = lift_queries(t_vectors)
    orders = [{leaf: j for j, leaf in enumerate(tree.visits(x, tree.leaves, sizes, k))} for x in lifted]
    ranks = np.sort([orders[t][leaf] for t, leaf in exact])
    width = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1

    def spread(batches):
        for b in batches:
            ids, vectors = np.asarray(b.column(0)), matrix(b.column(1), dim)
            found = [shared.value.visits(x, width, sizes, k) for x in lift_queries(vectors)]
            leaf = np.array([x for f in found for x in f], np.int64)
            yield packed(cell_of[leaf], np.repeat(np.arange(len(ids)), [len(f) for f in found]), leaf, ids, vectors, QUERIES_A_CELL)

    dealt = queries.repartition(-(-asked // QUERIES_A_TASK), "query_id")
    visits = dealt.mapInArrow(spread, BLOB).checkpoint()
    q_sizes = {r[0]: r[1] for r in visits.groupBy("cell").agg(F.sum("n")).collect()}
    parts = spark.createDataFrame([(i, max(1, int(-(-n // ROWS_A_CELL)) if n > 2 * ROWS_A_CELL else 1), int(-(-q_sizes.get(i, 1) // QUERIES_A_CELL))) for i, n in enumerate(cell_sizes.tolist())], "cell int, v_parts int, q_parts int")
    parts = F.broadcast(parts)  # a row a cell, at most as many as leaves
    own = lambda n: F.pmod(F.xxhash64("packed", F.lit(11)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(parts, "cell").select("cell", upto("v_parts").alias("v_part"), own("q_parts").alias("q_part"), "packed")
    right = placed.join(parts, "cell").select("cell", own("v_parts").alias("v_part"), upto("q_parts").alias("q_part"), "packed")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return table_of([], [], [])
        return table_of(*in_cell(unpacked(a["packed"].to_pylist(), dim), unpacked(b["packed"].to_pylist(), dim), k))

    keys = ["cell", "v_part", "q_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, SCHEMA)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
