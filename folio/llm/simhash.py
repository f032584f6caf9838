"""SimHash near-duplicates by pivot distance tables (operator 1).

Every distinct fingerprint gets a table of Hamming distances to many reference fingerprints: one
base reference, and for each block of bits one that differs from the base in just that block. By
the triangle inequality, fingerprints at distance d differ by at most d in every distance, so a
pair is discarded when its largest difference exceeds d; those left are verified. The difference
between the distances to the base and to a block's reference is the number of bits of the block
that differ from the base, and of all these block coordinates at most d can differ. So, with the
blocks dealt into groups, d groups at most hold a difference, and two close fingerprints agree in
all coordinates of some choice of the other groups: that is the key by which they meet.

Equal fingerprints are one node, so that copies are never paired; a task links its nodes to the
smallest one that it can reach, so that it emits fewer links than it has nodes; groups of nodes
beyond a size are split into blocks, and every two blocks meet in a task of their own.

keep_one() removes near-duplicates by the Jaccard similarity of their word shingles, which 64 bits
are too few to key: at similarity 0.8 fingerprints differ in some ten bits. There, texts meet by
bands of minimum hashes, the distance tables discard pairs by a wide radius, and the shingle sets
themselves decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import scratch_name, slices, written
from folio.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCK_BITS = 2
#: Nodes of a key that one task compares; more are split into blocks of so many.
TASK_NODES = 4096

#: Near-duplicates of keep_one(): words of a shingle, and the least Jaccard similarity.
NEAR_WORDS = 5
SIMILARITY = 0.8
#: Minimum hashes: so many bands of so many. A pair at similarity 0.8 shares no band, and is
#: missed, once in some 2,800 times.
BANDS, BAND_HASHES = 20, 5
#: Bits by which fingerprints of sets at similarity 0.8 may differ: the mean is 10, and more than 22
#: occur once in some 17,000 times.
NEAR_BITS = 22
#: Shingles of a key's nodes that make a block, besides TASK_NODES.
TASK_SHINGLES = 2_000_000


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the XXH64 hashes of the word shingles.

    A-Z in lower case; words apart at ASCII white space; repeated shingles count; fewer words than
    a shingle are one shingle; no words give zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) for each row; the 64 bits as a signed number. Null text counts as empty."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {key}, fp bigint")


def references(block_bits: int = BLOCK_BITS) -> np.ndarray:
    """The reference fingerprints: the base (digits of the golden ratio), then one for each block."""
    base, block = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << block_bits) - 1)
    return np.array([base, *(base ^ (block << np.uint64(at)) for at in range(0, 64, block_bits))], np.uint64)


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference, as bytes."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.uint8)


def group_count(nodes: int, max_bits: int = MAX_BITS) -> int:
    """Into how many groups to deal the blocks: as few as make some 2^8 nodes of a key likely."""
    groups = max_bits + 1
    while groups < max_bits + 4 and nodes >> int(44 * (groups - max_bits) / groups) > 256:
        groups += 1
    return groups


def keyed(fps: np.ndarray, table: np.ndarray, groups: int, max_bits: int = MAX_BITS, block_bits: int = BLOCK_BITS) -> np.ndarray:
    """For each fingerprint, the key of each choice of groups that may agree."""
    blocks = ((table[:, :1].astype(np.int16) - table[:, 1:] + block_bits) // 2).astype(np.uint8)
    parts = np.array_split(np.arange(blocks.shape[1]), groups)
    keys = []
    for k, chosen in enumerate(itertools.combinations(parts, groups - max_bits)):
        packed = np.full(len(fps), k + 1, np.uint64)
        for column in np.concatenate(chosen):  # a hash of the coordinates; a clash only adds pairs to verify
            packed = (packed ^ blocks[:, column]) * np.uint64(0x9E3779B97F4A7C15)
            packed ^= packed >> np.uint64(29)
        keys.append(packed)
    return np.stack(keys, 1).view(np.int64)


def close_pairs(fps: np.ndarray, table: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS, block: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group and at most max_bits apart, in runs of bounded size.

    Sorted by the first distance, each fingerprint of a group meets those within max_bits of it
    there. One reference after another discards pairs; the fingerprints themselves decide on those
    left. block: where it isn't negative, only pairs of different blocks are wanted.
    """
    lead = group.astype(np.int64) * 512 + table[:, 0]
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    n = np.searchsorted(lead, lead + max_bits, "right") - np.arange(len(order)) - 1
    after = np.cumsum(n)
    at = 0
    while at < len(order):
        before = after[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(after, before + (1 << 20), "right")))
        some = n[at:stop]
        i = np.repeat(np.arange(at, stop), some)
        j = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + i + 1
        i, j = order[i], order[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        if block is not None:
            i, j = i[k := (block[i] < 0) | (block[i] != block[j])], j[k]
        for p in range(1, table.shape[1], 4):
            if not len(i):
                break
            gap = np.abs(table[i, p : p + 4].astype(np.int8) - table[j, p : p + 4].astype(np.int8)).max(1)
            i, j = i[k := gap <= max_bits], j[k]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        yield i[near], j[near]
        at = stop


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each index reaches."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (again := root[root]).tobytes() != root.tobytes():
                root = again
    return root


def link_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS, block_bits: int = BLOCK_BITS, task_nodes: int = TASK_NODES) -> DataFrame:
    """(a, b): links between nodes(node, fp) that join all whose fingerprints are at most max_bits
    apart, directly or in steps; fingerprints are distinct. No link of nodes further apart is made
    but between ends of a chain of close ones."""
    pivots, kind = references(block_bits), nodes.schema["node"].dataType.simpleString()
    n_nodes = nodes.count()
    groups = group_count(n_nodes, max_bits)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_numpy().view(np.uint64)
            table = distance_table(fps, pivots)
            keys = keyed(fps, table, groups, max_bits, block_bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in table], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "fp", "distances", "keys"])

    spread = nodes.select("node", "fp").mapInArrow(tabled, f"node {kind}, fp bigint, distances binary, keys array<bigint>").select("node", "fp", "distances", F.explode("keys").alias("key"))
    spread = written(spread, "pivots")
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(task_nodes)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = spread.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "fp", "distances")

    def linked(whole: pa.Table) -> pa.RecordBatch:
        """Links within the groups of whole."""
        fps = whole.column("fp").to_numpy().view(np.uint64)
        table = np.frombuffer(b"".join(whole.column("distances").to_pylist()), np.uint8).reshape(len(fps), -1)
        own, apart = whole.column("own").to_numpy(), whole.column("low").to_numpy() != whole.column("high").to_numpy()
        root = _roots(len(fps), close_pairs(fps, table, np.cumsum(_starts(whole)), max_bits, np.where(apart, own, -1)))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        node = whole.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(moved)), node.take(pa.array(root[moved]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole_groups(batches, linked)

    # Many small groups go through one task together, in order; a group is bounded by two blocks.
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_nodes // 50_000))
    grouped = met.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high", "own", "node")
    return grouped.mapInArrow(run, f"a {kind}, b {kind}")


def _whole_groups(batches: Iterator[pa.RecordBatch], linked: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """linked() of whole groups of key, low and high, which come in order."""
    rest: list[pa.RecordBatch] = []  # rows of the group that the next batch may go on with
    for b in batches:
        whole = pa.Table.from_batches([*rest, b])
        last = int(np.flatnonzero(_starts(whole))[-1]) if len(whole) else 0
        if last:
            yield linked(whole.slice(0, last))
        rest = whole.slice(last).to_batches()
    if rest:
        yield linked(pa.Table.from_batches(rest))


def _starts(whole: pa.Table) -> np.ndarray:
    """Where a row begins a new group of key, low and high; the first row does."""
    new = np.ones(len(whole), bool)
    if len(whole):
        new[1:] = np.logical_or.reduce([np.diff(whole.column(c).to_numpy()) != 0 for c in ("key", "low", "high")])
    return new


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row.

    fingerprint: 16 hex digits. component_id: the smallest id whose fingerprint is reached in steps
    of at most max_bits bits. Null text counts as empty, and empty texts share the fingerprint
    zero. Rows with a null id get the component of the rows they equal in fingerprint, or null if
    those have no id either; they make no links. Repeated rows stay. Other columns are not read; an
    empty table stays empty.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("node")).filter("node IS NOT NULL"), "nodes")
    components = connected_components(link_fingerprints(nodes, max_bits))
    of_fp = nodes.join(components, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, rows["fp"] == of_fp["of"], "left").select(F.col(id_col), hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str, width: int = NEAR_WORDS) -> np.ndarray:
    """XXH64 hashes of the distinct word shingles, in order; words as for fingerprint()."""
    words = text.encode().lower().split()
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))) if len(words) > width else {b" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of distinct shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


_FACTOR, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_HASHES), np.uint64)
_FACTOR = 2 * _FACTOR + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes of a shingle set."""
    least = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * _FACTOR + _PLUS).min(0))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, BAND_HASHES))]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two shingle sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _similar_roots(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Smallest index that each index reaches by pairs of similar sets; pairs already joined are not compared."""
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in pairs:
        for at in range(0, len(i), 4096):
            while (again := root[root]).tobytes() != root.tobytes():
                root[:] = again
            x, y = i[at : at + 4096], j[at : at + 4096]
            x, y = x[k := root[x] != root[y]], y[k]
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if (p := find(a)) != (q := find(b)) and similar(sets[a], sets[b], least):
                    root[max(p, q)] = min(p, q)
    while (again := root[root]).tobytes() != root.tobytes():
        root[:] = again
    return root


def link_similar(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, width: int = NEAR_WORDS, task_nodes: int = TASK_NODES, task_shingles: int = TASK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links that join all nodes(whole, node, fp, size, keys) that share a key and whose
    shingle sets are similar, directly or in steps. Sets are worked out again from docs, only for
    nodes that share a key with others."""
    pivots, kind = references(), nodes.schema["node"].dataType.simpleString()
    spread = nodes.select("whole", "node", "fp", "size", F.explode("keys").alias("key"))
    ident = [F.bit_xor(F.xxhash64("whole")).alias("x"), F.bit_xor(F.xxhash64("node", "whole")).alias("y")]
    sizes = spread.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *ident).filter("n > 1")
    # Near copies share most of their keys: of keys with the same nodes, one is enough.
    sizes = written(sizes.groupBy("n", "shingles", "x", "y").agg(F.min("key").alias("key")), "bands")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(task_nodes)), F.ceil(F.col("shingles") / F.lit(task_shingles)), F.lit(1)).cast("int")
    met = written(spread.join(sizes.select("key", blocks.alias("blocks")), "key"), "met")
    n_met = met.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingle_set(t or "", width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, found), pa.binary()), pa.array(found, pa.binary())], names=["node", "whole", "shingle_set"])

    wanted = met.select("node").distinct()
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("t")).join(wanted, "node", "left_semi")
    found = texts.mapInArrow(sets, f"node {kind}, whole binary, shingle_set binary").dropDuplicates(["node", "whole"]).drop("node")
    own = F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "whole", "node", "fp").join(found, "whole").drop("whole")

    def linked(whole: pa.Table) -> pa.RecordBatch:
        """Links within the groups of whole."""
        fps = whole.column("fp").to_numpy().view(np.uint64)
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column("shingle_set")]
        own, apart = whole.column("own").to_numpy(), whole.column("low").to_numpy() != whole.column("high").to_numpy()
        pairs = close_pairs(fps, distance_table(fps, pivots), np.cumsum(_starts(whole)), NEAR_BITS, np.where(apart, own, -1))
        root = _similar_roots(held, pairs, similarity)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        node = whole.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(moved)), node.take(pa.array(root[moved]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole_groups(slices(batches), linked)

    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_met // 20_000))
    grouped = met.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high", "own", "node")
    return grouped.mapInArrow(run, f"a {kind}, b {kind}")


def _digest(shingles: bytes) -> bytes:
    return xxhash.xxh3_128_digest(shingles)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component, that with the smallest id, with all columns of
    documents and no others. Rows that share that id: one of them. Rows with a null id stay.

    Near-duplicates have at least that Jaccard similarity of their sets of word shingles, directly
    or in steps; texts without words are equal."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t or "", width) for t in b.column(1).to_pylist()]
            fps = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            arrays = [b.column(0), pa.array([_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(fps), pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "whole", "fp", "size", "keys"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(sketch, f"node {kind}, whole binary, fp bigint, size bigint, keys array<bigint>")
    # Equal sets are one node; what else is told of them is equal, too.
    nodes = written(rows.groupBy("whole").agg(F.min("node").alias("node"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")]), "nodes")
    components = connected_components(link_similar(docs, nodes, similarity, width, id_col=id_col, text_col=text_col))
    kept = nodes.join(components, "node", "left").filter(F.coalesce("component", "node") == F.col("node")).select(F.col("node").alias("kept_id")).distinct()
    have_id = docs.filter(F.col(id_col).isNotNull())
    stay = have_id.join(kept, have_id[id_col] == kept["kept_id"], "left_semi")
    n = scratch_name(docs, "n")
    stay = stay.withColumn(n, F.row_number().over(Window.partitionBy(id_col).orderBy(id_col))).filter(F.col(n) == 1).drop(n)
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))

