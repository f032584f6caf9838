"""Approximate nearest neighbours by a hierarchical k-means tree (operator 5).

The tree is fitted on a bounded sample of the vectors, and where there are very many, each of its
branches goes on with a tree that a task fits on a sample of that branch; every vector is then put
into its leaf. A query goes through the tree best bin first: a priority queue holds the branches not taken yet by
their distance, and the nearest is opened next, which gives the order in which the query would
visit all leaves. How many it does visit is widened until the recall on a calibration set, against
brute force over all rows, reaches the target. Visits and vectors meet by leaf; a leaf that holds
very many vectors is split into blocks. Many queries are split into lots of near ones, and a leaf's
vectors go only to the lots that visit it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import written

K = 5
BRANCHES = 8
#: The tree has a leaf for so many vectors, but never fewer or more leaves than these: every task
#: holds the tree.
LEAF_VECTORS = 512
LEAVES, MAX_LEAVES = 128, 65_536
#: Leaves of the part that the driver fits; each of them goes on with a tree of its own, if more are
#: wanted.
TOP_LEAVES = 2048
#: Vectors for each leaf that the tree is fitted on, about: those whose hashed id falls under
#: their share of all. The driver fits on about 131,072 at most.
SAMPLE_PER_LEAF = 64
#: Vectors that a task fits a branch on, at most; those of the smallest hashed ids.
BRANCH_SAMPLE = 32_768
#: Queries on which recall is measured, and what it has to be.
CALIBRATION = 128
TARGET_RECALL = 0.97
#: Vectors of a leaf that one task searches; larger leaves are split.
BLOCK_VECTORS = 8192
#: Leaves that are searched by one task together, and most queries, about, that it answers.
LEAVES_TOGETHER = 4
QUERIES_TOGETHER = 16384


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node]
    leaf: int = -1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=k)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return centres, (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


class KMeansTree:
    """A tree whose largest leaf is split by k-means until it has the wanted number of leaves."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaves: int = LEAVES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.root = Node(sample.mean(0) if len(sample) else np.zeros(sample.shape[1]), [])
        heap, n, tie = [(-len(sample), 0, self.root, sample)], 1, 1
        done: list[Node] = []
        while heap:
            size, _, node, x = heapq.heappop(heap)
            if n + branches - 1 > leaves or -size < 4 * branches or (x == x[0]).all():
                done.append(node)
                continue
            centres, of = _kmeans(x, branches, rng)
            for c in range(branches):
                if (of == c).any():
                    child = Node(centres[c], [])
                    node.children.append(child)
                    heapq.heappush(heap, (-int((of == c).sum()), tie, child, x[of == c]))
                    tie += 1
            n += len(node.children) - 1
        self._number(done)

    def _number(self, ends: list[Node]) -> None:
        for i, node in enumerate(ends):
            node.leaf = i
        self.leaves = len(ends)

    def graft(self, branches: dict[int, KMeansTree]) -> None:
        """Each of these leaves becomes the root of its tree."""
        ends, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if not node.children and node.leaf in branches:
                node.children, node.leaf = branches.pop(node.leaf).root.children, -1
            stack += node.children
            if not node.children:
                ends.append(node)
        self._number(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, by the nearest centre at each branching."""
        out = np.zeros(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not node.children:
                out[rows] = node.leaf
                continue
            of = _squared(x[rows], np.stack([c.centre for c in node.children])).argmin(1)
            stack += [(c, rows[of == i]) for i, c in enumerate(node.children) if (of == i).any()]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best-bin-first traversal from a query, as far as they are asked for."""
        queue, tie = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            while node.children:
                d = _squared(q[None], np.stack([c.centre for c in node.children]))[0]
                first = int(d.argmin())
                for i, c in enumerate(node.children):
                    if i != first:
                        heapq.heappush(queue, (float(d[i]), tie, c))
                        tie += 1
                node = node.children[first]
            yield node.leaf


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T + (x**2).sum(1)[:, None]


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # Dividing by the largest component first keeps squares from under- or overflowing.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _near_one(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision. Sums go from the first component to
    the last, whatever the batch, so that equal vectors get equal scores. Vectors are first brought
    near one by powers of two: that changes no digit, and keeps sums from under- or overflowing."""
    q, x = _near_one(q[None])[0], _near_one(x)
    dot, qq, xx = np.zeros(len(x)), 0.0, np.zeros(len(x))
    for j in range(x.shape[1]):
        dot += q[j] * x[:, j]
        qq += q[j] * q[j]
        xx += x[:, j] * x[:, j]
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def nearest(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, its k nearest rows by (-cosine, id), without the query's own id."""
    unit = _unit(x)
    for at in range(0, len(q), 256):
        rough = _unit(q[at : at + 256]) @ unit.T
        rough[qids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(rough):
            n = min(k, int((row > -np.inf).sum()))
            if not n:
                continue
            cut = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero(row >= cut - 1e-9)
            score = cosine(q[at + i], x[near])
            best = np.lexsort((ids[near], -score))[:n]
            yield at + i, near[best], score[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: id and vector not null, of the usual
    number of components, all finite and not all zero."""
    v = F.col(vector_col).cast("array<double>")
    picked = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return picked.filter(finite & F.exists("v", lambda x: x != 0))


def _exact(base: DataFrame, qids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """Brute force of a bounded set of queries against all rows: (query_id, vec_id, score, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
                for i, near, score in nearest(ids, x, qids, q, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), qids[i])), pa.array(ids[near]), pa.array(score), pa.array(leaf[near])], names=["query_id", "vec_id", "score", "leaf"])

    found = base.select("vec_id", "v", "leaf").mapInArrow(run, "query_id bigint, vec_id bigint, score double, leaf int")
    return _best(found, k).toPandas()


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def calibrated_visits(tree: KMeansTree, exact: pd.DataFrame, qids: np.ndarray, q: np.ndarray, target: float) -> tuple[int, float]:
    """(fewest leaf visits with which recall reaches the target, that recall)."""
    needed = []
    for i, vector in zip(qids, _unit(q), strict=True):
        place = {leaf: n for n, leaf in enumerate(tree.visits(vector), 1)}
        needed += [place[leaf] for leaf in exact.loc[exact["query_id"] == i, "leaf"]]
    if not needed:
        return tree.leaves, 1.0
    needed = np.sort(needed)
    for visits in range(1, tree.leaves + 1):
        recall = float((needed <= visits).mean())
        if recall >= target:
            break
    return visits, recall


def fitted_tree(base: DataFrame, rows: int, leaves: int, sample_per_leaf: int) -> KMeansTree:
    """A tree of about so many leaves for base(vec_id, v) of so many rows."""

    def drawn(share: float) -> DataFrame:
        return base.filter(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select("vec_id", "v")

    top = drawn(sample_per_leaf * min(leaves, TOP_LEAVES) / rows).toArrow().sort_by("vec_id")
    tree = KMeansTree(_unit(_matrix(top.column("v").combine_chunks())), leaves=min(leaves, TOP_LEAVES))
    if leaves <= TOP_LEAVES:
        return tree
    shared = base.sparkSession.sparkContext.broadcast(tree)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.assign(_unit(_matrix(b.column(1)))), pa.int32())], names=["vec_id", "v", "leaf"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        wanted = -(-len(frame) // sample_per_leaf)
        branch = KMeansTree(_unit(_matrix(frame.sort_values("vec_id")["v"])), leaves=max(2, wanted), branches=min(BRANCHES, max(2, wanted)))
        return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "tree": [pickle.dumps(branch)]})

    dealt = drawn(sample_per_leaf * leaves / rows).mapInArrow(assigned, "vec_id bigint, v array<double>, leaf int")
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id", F.lit(19)), "vec_id"))
    some = dealt.withColumn("place", place).filter(F.col("place") <= BRANCH_SAMPLE).drop("place")
    branches = some.groupBy("leaf").applyInPandas(fitted, "leaf int, tree binary").collect()  # centres: one for each node of the tree
    tree.graft({r.leaf: pickle.loads(r.tree) for r in branches})
    return tree


def dealt_lots(queries: dict[int, int]) -> tuple[dict[int, tuple[int, int]], int]:
    """({leaf: (first lot, number of lots)}, lots): queries of neighbouring leaves share a lot, up
    to about QUERIES_TOGETHER; those of a leaf with more are dealt out over lots of their own."""
    lots, lot, room = {}, 0, QUERIES_TOGETHER
    for leaf, n in sorted(queries.items()):
        parts = max(1, -(-n // QUERIES_TOGETHER))
        if n > room and room < QUERIES_TOGETHER:
            lot, room = lot + 1, QUERIES_TOGETHER
        lots[leaf] = (lot, parts)
        if parts > 1:
            lot, room = lot + parts, QUERIES_TOGETHER
        else:
            room -= n
    return lots, lot + (room < QUERIES_TOGETHER)


def nearest_neighbours(vectors: DataFrame, query_every: int = 50, k: int = K, target_recall: float = TARGET_RECALL, sample_per_leaf: int = SAMPLE_PER_LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every its k
    nearest rows found, nearest first, equal ones by id; all the others, if these are fewer.

    Ids are integers. Rows with a null id, or with vectors that are null, empty, zero or hold null
    or non-finite components, take no part, nor do vectors of another length than most.
    A row repeated under one id is a candidate once; equal vectors under different ids are
    candidates each. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector_col)
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    width = lengths[0]
    base = base.filter(F.size("v") == width).select(F.col("vec_id").cast("long"), "v")
    base = base.groupBy("vec_id").agg(F.min("v").alias("v"))
    is_query = F.col("vec_id") % query_every == 0

    leaves = min(MAX_LEAVES, max(LEAVES, lengths[1] // LEAF_VECTORS))
    tree = fitted_tree(base, lengths[1], leaves, sample_per_leaf)
    shared = spark.sparkContext.broadcast(tree)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(_unit(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    index = written(base.mapInArrow(indexed, "vec_id bigint, v array<double>, leaf int"), "ann-index")
    probe = index.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(CALIBRATION).toArrow()
    qids, q = probe.column("vec_id").to_numpy(), _matrix(probe.column("v").combine_chunks()).reshape(-1, width)
    if not len(qids):
        return spark.createDataFrame([], out)
    visits, _ = calibrated_visits(tree, _exact(index, qids, q, k), qids, q, target_recall)
    # No fewer leaves than hold k others: a small leaf alone could not fill the result.
    sizes = dict(index.groupBy("leaf").count().collect())  # one row for each leaf
    blocks = {leaf: -(-n // BLOCK_VECTORS) for leaf, n in sizes.items() if n > BLOCK_VECTORS}
    lots, n_lots = dealt_lots(dict(index.filter(is_query).groupBy("leaf").count().collect()))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, groups, block, leaves, row, lot = b.column(0).to_numpy(), [], [], [], [], []
            own, salt = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, vector in enumerate(_unit(_matrix(b.column(1))) if b.num_rows else []):
                filled, chosen = 0, {}
                first, parts = lots[own[i]]
                for n, leaf in enumerate(shared.value.visits(vector)):
                    if n >= visits and filled > k:
                        break
                    if leaf in sizes:
                        filled += sizes[leaf]
                        for part in range(blocks.get(leaf, 1)):
                            chosen.setdefault((leaf // LEAVES_TOGETHER, part), []).append(leaf)
                for (group, part), found in chosen.items():
                    row.append(i)
                    groups.append(group)
                    block.append(part)
                    leaves.append(found)
                    lot.append(first + salt[i] % parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row] if len(row) else [], pa.int64()), b.column(1).take(pa.array(row, pa.int64())), pa.array(groups, pa.int32()), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), pa.array(lot, pa.int32())], names=["query_id", "q", "g", "block", "leaves", "lot"])

    salted = index.filter(is_query).select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)).alias("salt"))
    visits_of = salted.mapInArrow(visiting, "query_id bigint, q array<double>, g int, block int, leaves array<int>, lot int")
    members = index.withColumn("g", F.floor(F.col("leaf") / LEAVES_TOGETHER).cast("int"))
    if blocks:
        of_leaf = spark.createDataFrame(list(blocks.items()), "leaf int, parts bigint")
        members = members.join(of_leaf, "leaf", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        members = members.withColumn("block", F.lit(0))
    if n_lots > 1:
        visits_of = written(visits_of, "ann-visits")
        members = members.join(visits_of.select("g", "block", F.col("lot").alias("visiting")).distinct(), ["g", "block"]).withColumnRenamed("visiting", "lot")
    else:
        members = members.withColumn("lot", F.lit(0))

    def search(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(m) and len(v):
            x, q, ids, of, qids = _matrix(m["v"]), _matrix(v["q"]), m["vec_id"].to_numpy(), m["leaf"].to_numpy(), v["query_id"].to_numpy()
            for leaf in np.unique(of):
                rows, asks = np.flatnonzero(of == leaf), np.flatnonzero([leaf in leaves for leaves in v["leaves"]])
                for i, near, score in nearest(ids[rows], x[rows], qids[asks], q[asks], k):
                    found.append(pd.DataFrame({"query_id": qids[asks[i]], "vec_id": ids[rows[near]], "score": score}))
        whole = pd.concat(found)
        return whole.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    found = visits_of.groupBy("g", "block", "lot").cogroup(members.groupBy("g", "block", "lot")).applyInPandas(lambda v, m: search(m, v), "query_id bigint, vec_id bigint, score double")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
