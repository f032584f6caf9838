"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 6).

Token lists form a monoid under "join": a piece of text is encoded by encoding its halves, and
two neighbouring lists are joined by encoding afresh a window around the seam. The window grows
until its outermost tokens come out as they were. A list is the encoding of its bytes exactly
when every two neighbours are the encoding of theirs, so an unchanged outermost token proves
that everything further out stays. Decoding is a homomorphism: bytes of parts are concatenated
up the same tree.

Texts are first cut by the tokenizer's pattern; each match is encoded on its own, so that above
the matches the join is mere concatenation. What is met again and again is remembered up to a fixed
number of entries: matches, halves of them, and the windows of one token on each side of a seam.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import Memo, slices

#: Bytes up to which a piece is a leaf of the tree, which is merged outright.
LEAF_BYTES = 4
#: Bytes up to which merging looks through all pairs for the next one; beyond, a heap has them.
SCAN_BYTES = 48
#: Bytes up to which the encoding of a match, or of a part of one, is remembered.
MEMO_BYTES = 64
#: Matches that a Python worker remembers, some 250 bytes each, before it starts afresh.
MEMO_MATCHES = 1_000_000
#: Parts that a node of the decoding tree joins.
FAN_OUT = 64


class ByteBpe:
    """Encoder and decoder for a table of ranks (token bytes to rank; the rank is the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.matches = regex.compile(pattern, regex.V0).findall
        self.memo = Memo(self.encode_match, MEMO_MATCHES)
        self.parts = Memo(self.tree)
        self.seams = Memo(lambda pair: self.merge(self.token_bytes[pair[0]] + self.token_bytes[pair[1]]))

    def merge(self, piece: bytes) -> list[int]:
        """The encoding of a piece: the neighbours of lowest rank merge first, leftmost first."""
        return self._merge_scan(piece) if len(piece) <= SCAN_BYTES else self._merge_heap(piece)

    def _merge_scan(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])

    def _merge_heap(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ends[j] != end:
                continue
            ends[i], after[i], alive[j] = end, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from the encodings of each."""
        if not left or not right:
            return left or right
        width, window = 1, self.seams[left[-1], right[0]]
        while True:
            a, b = left[-width:], right[:width]
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2
            window = self.merge(self.decode(left[-width:] + right[:width]))

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of a piece: its halves', joined."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        part = self.parts.__getitem__ if len(piece) <= 2 * MEMO_BYTES else self.tree
        return self.join(part(piece[:half]), part(piece[half:]))

    def encode_match(self, match: str) -> list[int]:
        piece = match.encode()
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def encode(self, text: str) -> list[int]:
        matches = self.matches(text)
        if max(map(len, matches), default=0) <= MEMO_BYTES:
            return list(chain.from_iterable(map(self.memo.__getitem__, matches)))
        return list(chain.from_iterable(self.memo[m] if len(m) <= MEMO_BYTES else self.encode_match(m) for m in matches))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree."""
        parts = list(map(self.token_bytes.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[at : at + FAN_OUT]) for at in range(0, len(parts), FAN_OUT)]
        return parts[0] if parts else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row: the ids of the whole text.

    ranks_path is opened in the Python workers: the tokenizer's files are part of every
    machine's Python environment. Null text: empty array. Null ids and repeated rows stay as they are; other columns
    are not read. An empty table gives an empty table.
    """
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks_path, pattern).encode
        for b in slices(batches):
            ids = pa.array([encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {key.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for each row of ids. Null ids: empty bytes; an id without a token is an error."""
    key = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks_path, pattern).decode
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(i or []) for i in b.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {key.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode the ids, digest both.

    As encode_documents and decode_documents in one pass, so that no id array leaves its task.
    Null text counts as empty (no tokens, digests of nothing).
    """
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        names = {i: str(i) for i in bpe.token_bytes}
        for b in slices(batches):
            n, of_ids, of_bytes = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {key.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
