"""Periodic runs of words, found by probing a harmonic grid (operator 13).

A run is a stretch of words with smallest period p that repeats at least four times, is at least six
words long and can't be extended. It holds three or more neighbouring pairs of grid points jp and
(j+1)p, so for every p only the words of those points are compared: n/p comparisons, n log n for all
periods. Where three pairs in a row are equal, the stretch is extended to both sides by comparing
chunks of arrays that double in size.

Points deep in a run that is found already are skipped: two runs share fewer words than the sum of
their periods, so a point that lies p + q words or more before the end of a run of period q < p starts
nothing new. That holds for runs that repeat twice or more, and so for those here.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm._common import slices

#: A run repeats its period so many times, and has so many words, at least.
MIN_REPEATS, MIN_WORDS = 4, 6
#: Words that the first chunk of an extension compares.
CHUNK = 64

RESULT = ["n_runs", "start", "length", "period", "exponent_milli"]


def _first_unequal(w: np.ndarray, at: int, p: int) -> int:
    """The first i >= at with w[i] != w[i + p], or the last place where there is no i + p."""
    end, size = len(w) - p, CHUNK
    while at < end:
        to = min(end, at + size)
        unequal = w[at:to] != w[at + p : to + p]
        first = int(unequal.argmax())
        if unequal[first]:
            return at + first
        at, size = to, 2 * size
    return end


def _first_equal(w: np.ndarray, at: int, p: int, least: int) -> int:
    """The smallest i >= least such that w equals itself p further on from i to at."""
    size = CHUNK
    while at > least:
        to = max(least, at - size)
        unequal = (w[to:at] != w[to + p : at + p])[::-1]
        last = int(unequal.argmax())
        if unequal[last]:
            return at - last
        at, size = to, 2 * size
    return least


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    n, found = len(w), []
    # Of the runs over each place: the largest end, and the largest end less period.
    ends = deep = None
    for p in range(1, n // MIN_REPEATS + 1):
        equal = w[: n - p : p] == w[p::p]
        if np.count_nonzero(equal) < 3:
            continue
        points = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        k = 0
        while k < len(points):
            i = int(points[k]) * p
            least = 0
            if deep is not None and deep[i] - i >= p:  # deep in a run: go to its last points
                j = (int(deep[i]) - p) // p + 1
                least = int(deep[i]) - p + 1
                k = int(np.searchsorted(points, j))
                if k == len(points):
                    break
                i = int(points[k]) * p
                if deep[i] - i >= p:  # deep in the next one
                    continue
                least = max(0, least) if i < least + 2 * p else 0
            # The end of a run over the point is where an extension is likely to end: looked at first.
            e = -1 if ends is None else int(ends[i])
            x = next((b for b in (e - p, e) if i <= b <= i + 2 * p and b < n - p and w[b] != w[b + p]), None)
            if x is None:
                x = _first_unequal(w, i, p)
            if x > i + 2 * p:
                y = _first_equal(w, i, p, min(least, i))
                if x - y + p >= max(MIN_WORDS, MIN_REPEATS * p) and not (y and w[y - 1] == w[y - 1 + p]):
                    if ends is None:
                        ends, deep = np.full(n, -1), np.full(n, -1)
                    if ends[y] < x + p:  # not within a run of a smaller period
                        found.append((y, x + p - y, p))
                        np.maximum(ends[y : x + p], x + p, out=ends[y : x + p])
                        np.maximum(deep[y : x + p], x, out=deep[y : x + p])
            k = int(np.searchsorted(points, x // p + 1))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    stays = np.ones(n, bool)
    for start, length, period in found:
        stays[start + period : start + length] = False
    return stays


def word_numbers(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The report's text: where the id's CRC-32 is a multiple of ten, the words behind one of them go
    round in a circle. A null id changes nothing."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with runs (array of start, length, period) and collapsed, the text without what repeats,
    its words a space apart. Columns of these names are replaced.

    Null and empty texts have no runs; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, texts = [], []
            for t in b.column(at).to_pylist():
                words = (t or "").encode().split()
                found = runs(word_numbers(words))
                stays = without_repeats(found, len(words))
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(None if t is None else b" ".join(w for w, s in zip(words, stays, strict=True) if s).decode())
            kept = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name not in ("runs", "collapsed")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, shape), pa.array(texts, pa.string())], names=[*names, "runs", "collapsed"])

    shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    names = [f.name for f in fields]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("runs", T.ArrayType(kind)), T.StructField("collapsed", T.StringType())]))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row,
    over its looped() text; the longest run, of equally long ones the first, then that of the smaller
    period.

    Rows are treated one by one: null and repeated ids stay, null text is empty, a text without a run
    has four nulls. Other columns are not read. An empty table stays empty. Very long texts take time
    in proportion to their number of words, times its logarithm."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text).hexdigest()
        for b in slices(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = looped((t or "").encode().split(), i)
                found = runs(word_numbers(words))
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                digest = sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode())
                left = sha(b" ".join(w for w, s in zip(words, without_repeats(found, len(words)), strict=True) if s) if found else b" ".join(words))
                out.append((len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest, left))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            made = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["i", *RESULT, "runs_sha256", "collapsed_sha256"])

    schema = f"i {key}, " + ", ".join(f"{c} bigint" for c in RESULT) + ", runs_sha256 string, collapsed_sha256 string"
    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return found.withColumnRenamed("i", id_col)
