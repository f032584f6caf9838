"""Byte BPE, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import byte_bpe, packing, token_counts

RANKS, PIECES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
BPE = byte_bpe.codec(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
COUNTER = token_counts.compiled(PIECES)
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
LIBRARY = Tokenizer.from_file(WORDS)
PARTS = ["a", "B", " ", "  ", "\n", "é", "漢", "字", "\U0001F600", "▁", "\t", "The", " th", "ing", "0", "12", "'s", "!!", "aaa", "\x00", "\x01", "\x1c", "\x85", " ", "<s>", "<|endoftext|>", "ﬁ", "Å", "́", "²", "İ", "Σ", "_"]
TEXT = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=60).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe(text):
    ids = BPE.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text) and BPE.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(0, 400))
def test_join_is_encoding_of_the_whole(piece, cut):
    assert BPE.join(BPE.merge(piece[:cut]), BPE.merge(piece[cut:])) == BPE.merge(piece) == BPE.tree(piece)


def test_matches_outside_the_vocabulary_go_up_the_tree(spark, monkeypatch):
    """On documents, each match of more bytes than a leaf that is no token is made by joins, and
    ids are tiktoken's."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    bpe = byte_bpe.ByteBpe(BPE.ranks, P.PATTERN)
    joined, join = set(), bpe.join

    def counted(left, right):
        out = join(left, right)
        joined.add(bpe.decode(left) + bpe.decode(right))
        return out

    monkeypatch.setattr(bpe, "join", counted)
    assert [bpe.encode(t) for t in texts] == TIKTOKEN.encode_ordinary_batch(texts)
    outside = {m.encode() for t in texts for m in bpe.matches(t)} - set(bpe.ranks)
    tall = {m for m in outside if len(m) > byte_bpe.LEAF_BYTES}
    assert tall <= joined and len(tall) > 0.9 * len(outside) > 1000


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_token_counts(text, chunk):
    want = len(SP.encode(text))
    assert COUNTER.count(text) == COUNTER.count(text, chunk) == want


@settings(max_examples=100, deadline=None)
@given(TEXT.filter(bool), st.integers(1, 9))
def test_prefix_scan_agrees_with_prefixes(text, size):
    marked = "▁" + text.replace(" ", "▁")
    maps, chunks, _ = COUNTER.state_maps(marked, size)
    assert "".join(chunks) == marked
    for k, m in enumerate(COUNTER.scan(maps)):
        pieces = COUNTER.encode("".join(chunks[: k + 1]))
        assert m[COUNTER.start][1] == sum(1 if x in COUNTER.pieces else len(x.encode()) for x in pieces)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.data())
def test_scan_is_that_of_any_order(sizes, data):
    """On any partial functions of three states: the scan is composition from left to right."""
    maps = [{s: (data.draw(st.integers(0, 2)), data.draw(st.integers(0, 9))) for s in range(n)} for n in sizes]
    want = maps[:1]
    for m in maps[1:]:
        want.append(COUNTER.compose(want[-1], m))
    assert COUNTER.scan(maps) == want


def test_maps_are_composed_on_documents(spark):
    """Ordinary documents have several chunks; the scan composes them, and never lacks a state."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    n = [len(COUNTER.state_maps("▁" + t.replace(" ", "▁"), token_counts.CHUNK_CHARS)[0]) for t in texts if t]
    assert np.median(n) > 1 and [COUNTER.count(t) for t in texts] == [len(x) for x in SP.encode(texts)]


def test_states_that_were_not_foreseen(monkeypatch):
    """Without any foreseen state the scan finds them one by one."""
    monkeypatch.setattr(COUNTER, "entries", lambda text, at: set())
    for text in ("abcdefgh" * 40, "=" * 333, "thethethe then" * 9):
        assert COUNTER.count(text, 16) == len(SP.encode(text))


def test_texts_without_seams_cost_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        COUNTER.count("a" * n)
        began = time.process_time()
        assert COUNTER.count("a" * n) == len(SP.encode("a" * n))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize("run", ["a" * 5000, "=" * 3001, "ab" * 2000, " " * 999])
def test_long_runs(run):
    assert BPE.encode(run) == TIKTOKEN.encode_ordinary(run)
    assert COUNTER.count(run, 100) == len(SP.encode(run))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(2, 50))
def test_word_ids(texts, entries):
    got = packing.WordTokenizer(WORDS, entries).encode(pa.array([*texts, None], pa.string()))
    assert [g.tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


@pytest.mark.parametrize("seed", range(5))
def test_bounds_and_best_fit(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 100) for _ in range(rng.randint(1, 300))])
    bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
    assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= n
    for b in range(n):
        at = np.sort(offsets[bins == b])
        order = np.argsort(offsets[bins == b])
        assert (at == np.concatenate(([0], np.cumsum(lengths[bins == b][order])[:-1]))).all() and lengths[bins == b].sum() <= 100


def test_lower_bound_beats_the_sum():
    assert packing.lower_bound(np.bincount([60] * 5, minlength=101), 100) == 5
    assert packing.lower_bound(np.bincount([34] * 6, minlength=101), 100) == 3


def check_packing(rows, texts, capacity=4096):
    bins, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= capacity
    want = defaultdict(int)
    for i, t in texts:
        want[i] += len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1
    assert docs == want
    return len(bins)


def test_packing_of_odd_rows(spark, odd, no_docs):
    rows = packing.pack_documents(odd, WORDS).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(no_docs, WORDS).count() == 0
    r = next(r for r in rows if r.doc_id == 7)
    ids = np.array(LIBRARY.encode("é漢字 \U0001F600 A b", add_special_tokens=False).ids + [1], "<u4")
    assert r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_exchanges_meet_the_bound(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, rng.randint(1, 60)) for i in range(3000)], "k int, length bigint").repartition(4)
    rows = packing.pack_pieces(d, 100, group_pieces=64).collect()
    assert sorted(r.k for r in rows) == list(range(3000))
    total = sum(r.length for r in rows)
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100 and len(fill) <= -(-total // 100) * 1.01 + 1
    # Lengths that no two of fit together: the first packing is certified, and no round saves a bin.
    d = spark.createDataFrame([(i, 51 + i % 30) for i in range(500)], "k int, length bigint").repartition(4)
    assert packing.pack_pieces(d, 100, group_pieces=64).select("sequence_id").distinct().count() == 500


def test_odd_rows_through_spark(spark, odd, no_docs):
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    got = sorted(byte_bpe.round_trip_digests(odd, RANKS, P.PATTERN).collect(), key=lambda r: repr((r.doc_id, r.n_tokens)))
    want = sorted(((i, len(ids := TIKTOKEN.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=lambda r: repr(r[:2]))
    assert [tuple(r) for r in got] == want
    counts = sorted((tuple(r) for r in token_counts.count_tokens(odd, PIECES).collect()), key=repr)
    assert counts == sorted(((i, len(t.encode()), n := len(SP.encode(t)), n > 4096) for i, t in texts), key=repr)
    encoded = byte_bpe.encode_documents(odd, RANKS, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()) == sorted(t.encode() for _, t in texts)
    assert token_counts.count_tokens(no_docs, PIECES).count() == byte_bpe.round_trip_digests(no_docs, RANKS, P.PATTERN).count() == 0


def test_most_maps_have_several_states_and_composition_matters(spark, monkeypatch):
    """At fixed cuts of ordinary documents, most chunks have more than one state that may come in, and
    they are not all alike; a scan that takes a wrong one for them counts wrongly."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect() if r.text]
    later = [m for t in texts for m in COUNTER.state_maps("▁" + t.replace(" ", "▁"), token_counts.CHUNK_CHARS)[0][1:]]
    differ = [m for m in later if len({n for _, n in m.values()}) > 1]
    assert len(later) > 1000 and sum(len(m) > 1 for m in later) > 0.9 * len(later) and len(differ) > 0.3 * len(later)
    want = [len(x) for x in SP.encode(texts)]
    assert COUNTER.counts(texts) == want
    real = token_counts.prefix_scan

    def wrong(of):
        """As if whatever comes in were the first state of the map."""
        return real([[{s: next(iter(m.values())) for s in m} for m in maps] for maps in of])

    monkeypatch.setattr(token_counts, "prefix_scan", wrong)
    assert sum(a != b for a, b in zip(COUNTER.counts(texts), want, strict=True)) > 20


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 30))
def test_counts_of_many_texts_at_once(texts, size):
    assert COUNTER.counts(texts, size) == [len(x) for x in SP.encode(texts)]
