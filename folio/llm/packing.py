"""Best-fit packing with bound-certified repacking (operator 2).

Documents are tokenized once, cut into pieces of at most the capacity, and dealt into groups of a
few thousand pieces. Each group runs best-fit decreasing; lower bounds from dual-feasible functions
certify its number of bins. Groups whose bins don't meet the bound, and bins that stay open, have a
gap: their documents are exchanged (dealt into fewer, new groups) and best-fit decreasing runs
again, until the bound over all lengths is met or a round saves nothing. Only a histogram of at most
`capacity` rows and a few sums ever reach the driver.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import slices, written

CAPACITY = 4096
END_ID = 1
#: Pieces of a group: what one task packs at a time.
GROUP_PIECES = 4096
#: A bin with more free room than this share of the capacity is open: its documents may move.
OPEN_SHARE = 1 / 64

#: Words that a Python worker remembers, some 200 bytes each, before it starts afresh.
MEMO_WORDS = 1_200_000

#: A character that stands on its own between words that are encoded together.
_APART = "\x01"


class WordTokenizer:
    """Ids of whole texts by way of remembered words.

    For tokenizers that drop white space and never merge across it, which makes the ids of a text
    those of its words. Texts are split and their words numbered by Arrow; each distinct word is
    looked up once, and numpy lays the words' ids end to end. Words not met before are encoded
    together, as one text with a character between them whose id then tells them apart. A word
    that holds this character, and a text with a separator character, which Arrow would wrongly
    take for white space, go through the library on their own.
    """

    def __init__(self, path: str, entries: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library, self._entries = Tokenizer.from_file(path), entries
        (self._apart,) = self._ids(_APART)
        self._forget()

    def _forget(self) -> None:
        """places: each word's number; its ids are store[ends[number - 1] : ends[number]]."""
        self.places: dict[str, int] = {"": 0}
        self._ends, self._store = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, missing: list[str]) -> None:
        ids, sizes, order = [], [], [w for w in missing if _APART not in w]
        for at in range(0, len(order), 4096):
            found = self._ids(f" {_APART} ".join(order[at : at + 4096]))
            apart = found == self._apart
            sizes.append(np.diff(np.flatnonzero(np.concatenate(([True], apart, [True])))) - 1)
            ids.append(found[~apart])
        for w in missing:
            if _APART in w:
                order.append(w)
                ids.append(self._ids(w))
                sizes.append(np.array([len(ids[-1])]))
        self.places.update(zip(order, range(len(self.places), len(self.places) + len(order)), strict=True))
        self._ends = np.concatenate([self._ends, self._store.size + np.cumsum(np.concatenate(sizes))])
        self._store = np.concatenate([self._store, *ids])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words, index = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        missing = [w for w in words if w not in self.places]
        if len(self.places) + len(missing) > self._entries:
            self._forget()
            missing = [w for w in words if w]
        if missing:
            self._learn(missing)
        place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        start = self._ends[np.maximum(place, 1) - 1]
        size = np.where(place > 0, self._ends[place] - start, 0)[index]
        after = np.cumsum(size)
        laid = self._store[np.repeat(start[index] - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        cuts = np.concatenate(([0], after))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [self._ids(texts[i].as_py()) if odd[i] else laid[a:z] for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document.

    A document is its ids and the end id; only longer ones are cut, into pieces of the capacity.
    Null text counts as empty: one piece that holds the end id.
    """
    key = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for b in slices(batches, 1024):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1))):
                raw = np.append(ids, end).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins): longest first, each into the fullest bin that it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    rooms = n = 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fitting := rooms >> need:
            room = need + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - need:
            free.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Fewest bins that items can need, by dual-feasible functions; histogram[l] items have length l.

    Two families: items over capacity - t count as whole bins and items under t as nothing, for
    every t up to half the capacity; and rounding down to multiples of 1/k of the capacity.
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    count, total = np.cumsum(histogram), np.cumsum(histogram * lengths)
    best = -(-int(total[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = total[capacity - t] - total[t - 1]
    if len(t):
        best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = np.where((k + 1) * lengths % capacity == 0, lengths * k, (k + 1) * lengths // capacity * capacity)
        best = max(best, -(-int((scaled * histogram).sum()) // (capacity * k)))
    return best


_PACKED = ["sequence_id", "offset", "fill", "open"]


def _pack_groups(pieces: DataFrame, round_no: int, capacity: int) -> DataFrame:
    """Pack each group anew; from the second round on, a packing that saves no bin isn't taken."""
    names = [c for c in pieces.columns if c not in ("group", *_PACKED)]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        lengths = g["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        certified = n == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        out = g[names].copy()
        if round_no and n >= g["sequence_id"].nunique():
            return out.assign(**{c: g[c] for c in _PACKED})
        fill = np.bincount(bins, lengths, n).astype(np.int64)[bins] if len(g) else bins
        is_open = capacity - fill > (capacity * OPEN_SHARE if certified else 0)
        return out.assign(sequence_id=(round_no << 48) + (int(g["group"].iloc[0]) << 16) + bins, offset=offsets, fill=fill, open=is_open)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return pieces.groupBy("group").applyInPandas(pack, f"{kept}, sequence_id bigint, offset bigint, fill bigint, open boolean")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every row of pieces (with its column length, 1 to capacity) with sequence_id and offset.

    Rows of a sequence lie one after another from offset 0 and fill at most the capacity. Repeated
    rows are pieces of their own. Null ids stay. An empty table gives an empty table.
    """
    groups = lambda n: max(1, -(-n // group_pieces))
    of_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in of_length:
        histogram[length] = n
    bound = lower_bound(histogram, capacity)
    # Rows are numbered, not hashed by content: repeated rows must not meet in one group.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups(int(histogram.sum())))))
    table, done, closed, exchanged = written(_pack_groups(dealt, 0, capacity), "packed"), [], 0, None
    for round_no in itertools.count(1):
        first = F.col("offset") == 0  # one row of each bin
        n_bins, n_open, open_rows = table.agg(F.count_if(first), F.count_if(first & F.col("open")), F.count_if("open")).first()
        if closed + n_bins <= bound or n_open < 2 or n_bins == exchanged:
            break
        done.append(table.filter("NOT open"))
        closed, exchanged = closed + n_bins - n_open, n_open
        to_group = F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(groups(open_rows)))
        table = written(_pack_groups(table.filter("open").withColumn("group", to_group), round_no, capacity), "packed")
    for part in done:
        table = table.unionByName(part)
    return table.drop("fill", "open")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    tokenizer_path is opened in the Python workers. See tokenized_pieces and pack_pieces for nulls,
    long texts, repeated rows and empty tables; columns but the two named are not read.
    """
    return pack_pieces(written(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
