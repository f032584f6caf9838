"""Toxicity from subword-bag embeddings averaged into a linear softmax (operator 9).

A word is the bag of its character n-grams; each n-gram's bucket has an embedding. The embeddings
of a window of neighbouring words are averaged and go into a linear softmax over (clean, toxic).
Embeddings and softmax are trained jointly in numpy, so that misspellings and inflections that were
never seen share the n-gram vectors of those that were. A text is as toxic as its worst window: in
a long text a few words would vanish in the average over all of it. Labels are of texts, so
training first averages whole texts and then goes back and forth between finding each text's worst
window and learning from those. The score is the softmax of the worst window; its temperature and
its prior are fitted on texts that training didn't see: each of several trainings leaves out another
part of them. Averaging their logits is averaging the models, since all is linear up to the window.

A run without blanks that is longer than WORD_CHARS is split at marks, and what is still longer into
overlapping pieces; each counts as a word, so that nothing of it is left out or vanishes in it.

Scoring covers whole texts of all rows. Only the fit uses a bounded sample of the labelled rows.
Arrow splits the texts of a batch and numbers their words; numpy hashes the n-grams of all its
distinct words at once, and finds the worst windows of all its texts at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm._common import slices

#: Words of a window.
WINDOW = 2
#: Characters of a word; longer runs are split, into pieces that begin half as many apart.
WORD_CHARS = 64
NGRAMS = (3, 4, 5)
#: How often the bucket of a whole word counts beside those of its n-grams.
WHOLE_WEIGHT = 3
BUCKETS = 1 << 18
DIM = 8
#: Most labelled texts of each class, and most bytes of text of all of them, that the fit takes;
#: they are chosen by a hash of their id.
MAX_DOCS_PER_CLASS = 3000
MAX_TRAIN_BYTES = 48 << 20
EPOCHS = 16
#: Epochs at the start in which a text's average is over all of its words, or over a stretch of so
#: many at random.
WHOLE_EPOCHS, WHOLE_WORDS = 1, 4096
#: Windows at random that each clean text adds to its worst one.
ANYWHERE = 3
#: What is left of all weights after each epoch.
DECAY = 0.95
#: Parts of the texts, each left out of one training; the logits of all trainings are averaged.
FOLDS = 5
#: A toxic text that is missed weighs as much as so many clean ones that are rejected, in the choice of the prior.
MISS_WEIGHT = 3
#: Rows, and bytes of text, that are scored together.
SCORED_ROWS, SCORED_BYTES = 4096, 8 << 20
#: Words whose windows are looked at together, unless one text has more.
WORDS_TOGETHER = 1 << 18

_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”‘’¿¡…–—"
_MARKS = re.compile(f"[{re.escape(_EDGE)}]+")


def split_run(word: str) -> list[str]:
    """The words of a run without blanks: itself, or its parts and overlapping pieces of them if it
    is too long; none where nothing but marks stands there."""
    w = word.strip(_EDGE)
    if len(w) <= WORD_CHARS:
        return [w] if w else []
    step = WORD_CHARS // 2
    return [p[at : at + WORD_CHARS] for p in _MARKS.split(w) if p for at in range(0, max(1, len(p) - step), step)]


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct, at, ends): the distinct words of some texts in lower case, without marks around
    them; the number of each word where it stands; and where each text's words end, from 0."""
    # Trimmed first: Arrow may miss white space that ends a text.
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    numbered = split.flatten().dictionary_encode()
    distinct, at = pc.utf8_trim(numbered.dictionary, characters=_EDGE), numbered.indices.to_numpy()
    ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    size = pc.utf8_length(distinct).to_numpy()
    long = np.flatnonzero(size > WORD_CHARS)
    if len(long):
        parts = [split_run(w) for w in distinct.take(pa.array(long)).to_pylist()]
        begin = np.arange(len(distinct))
        count = (size > 0).astype(np.int64)
        count[long] = list(map(len, parts))
        begin[long] = len(distinct) + np.cumsum(count[long]) - count[long]
        distinct = pa.concat_arrays([distinct, pa.array([w for p in parts for w in p], pa.string())])
    else:
        begin, count = np.arange(len(distinct)), (size > 0).astype(np.int64)
    after = np.concatenate(([0], np.cumsum(count[at])))
    return distinct, _ragged(begin[at], count[at]), after[ends]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (size of them) for each entry, one entry after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngram_buckets(words: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(per n: (bucket at each character, whether an n-gram begins there), begin of each word, buckets
    of whole words): n-grams of characters with the ends of words marked, hashed at once."""
    marked = pc.binary_join_element_wise("<", words, ">", "")
    _, offsets, raw = marked.buffers()
    raw = raw.to_pybytes()[: np.frombuffer(offsets, np.int32)[len(marked)]] if len(marked) else b""
    code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(marked).to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(code))  # characters to the word's end
    padded, rolled, found = np.concatenate((code, np.zeros(max(NGRAMS), np.uint64))), np.zeros(len(code), np.uint64), []
    for n in range(max(NGRAMS)):
        rolled = rolled * np.uint64(0x100000001B3) + padded[n : n + len(code)]
        if n + 1 in NGRAMS:
            found.append(((_mixed(rolled + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), left > n))
    whole = np.add.reduceat(_mixed(code + (left.astype(np.uint64) << np.uint64(32))), begin) if len(words) else np.zeros(0, np.uint64)
    return found, begin, (_mixed(whole) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _parts(words: pa.Array) -> Iterator[pa.Array]:
    """Some words at a time, to bound what is held in between."""
    return (words.slice(first, 1 << 14) for first in range(0, len(words), 1 << 14))


def word_rows(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat, at): the buckets of word i are flat[at[i] : at[i + 1]]."""
    flats, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for some in _parts(words):
        found, begin, whole = ngram_buckets(some)
        of = np.repeat(np.arange(len(some)), np.diff(np.append(begin, len(found[0][0]))))
        flat, word = np.concatenate([b[v] for b, v in found] + [whole] * WHOLE_WEIGHT), np.concatenate([of[v] for _, v in found] + [np.arange(len(some))] * WHOLE_WEIGHT)
        flats.append(flat[np.argsort(word, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(word, minlength=len(some)))
    return np.concatenate(flats), np.cumsum(np.concatenate(sizes))


def word_means(words: pa.Array, per_bucket: np.ndarray) -> np.ndarray:
    """Mean over the buckets of each word."""
    means = [np.zeros(0)]
    for some in _parts(words):
        found, begin, whole = ngram_buckets(some)
        total = np.add.reduceat(sum(np.where(v, per_bucket[b], 0) for b, v in found).astype(np.float64), begin) + WHOLE_WEIGHT * per_bucket[whole]
        means.append(total / (WHOLE_WEIGHT + np.add.reduceat(sum(v.astype(np.int64) for _, v in found), begin)))
    return np.concatenate(means)


def worst_windows(of_word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, mean) of each text's worst window of words; of_word: a value for each word of all
    texts; a shorter text is one window. Texts without words: no number."""
    if len(of_word) > WORDS_TOGETHER and len(ends) > 2:  # by halves, to bound what is held at a time
        half = min(max(1, int(np.searchsorted(ends, len(of_word) // 2))), len(ends) - 2)
        cut = ends[half]
        parts = worst_windows(of_word[:cut], ends[: half + 1]), worst_windows(of_word[cut:], ends[half:] - cut)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    begin, size = ends[:-1], np.diff(ends)
    n = np.maximum(size - WINDOW + 1, (size > 0).astype(np.int64))
    starts = _ragged(begin, n)
    width = np.repeat(np.minimum(size, WINDOW), n)
    mean = np.zeros(len(starts))
    for k in range(WINDOW):
        mean += np.where(width > k, of_word[np.minimum(starts + k, len(of_word) - 1)], 0)
    mean /= np.maximum(width, 1)
    some = n > 0
    top = np.full(len(n), np.nan)
    first = np.cumsum(n) - n
    if some.any():
        top[some] = np.maximum.reduceat(mean, first[some])
    at = np.zeros(len(n), np.int64)
    hit = np.flatnonzero(mean == np.repeat(top, n))
    text = np.repeat(np.arange(len(n)), n)[hit]
    at[text[::-1]] = starts[hit[::-1]] - begin[text[::-1]]  # the first of equal ones
    return at, top


@dataclass
class ToxicityModel:
    """bucket_logit: each bucket's embedding times the softmax's weights (toxic less clean), which
    is all that scoring needs, since averaging and the linear layer commute. bias: the softmax's,
    with the prior that was fitted; temperature: what its logit is divided by. empty: the score of
    a text without words."""

    bucket_logit: np.ndarray
    bias: float
    temperature: float
    empty: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Softmax of the worst window of each text; null counts as empty."""
        distinct, at, ends = numbered_words(texts)
        _, top = worst_windows(word_means(distinct, self.bucket_logit)[at], ends)
        z = np.clip((np.nan_to_num(top) + self.bias) / self.temperature, -500, 500)
        return np.where(np.isnan(top), self.empty, 1 / (1 + np.exp(-z)))


class _Sample:
    """Training texts: words as rows of buckets, and where the texts hold them."""

    def __init__(self, texts: list[str]):
        distinct, word, self.ends = numbered_words(pa.array(texts, pa.string()))
        self.word = word.astype(np.int32)
        self.flat, self.at = word_rows(distinct)
        self.size = np.diff(self.at)

    def word_means(self, per_bucket: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(per_bucket[self.flat], self.at[:-1], dtype=np.float64) if len(self.size) else np.zeros(0)
        return (total / self.size)[self.word]

    def buckets_of(self, docs: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight): buckets of some windows, and the weight of each in its average."""
        ids = self.word[_ragged(self.ends[docs] + start, width)]
        size = self.size[ids]
        row = np.repeat(np.repeat(np.arange(len(docs)), width), size)
        return row, self.flat[_ragged(self.at[ids], size)], np.repeat(1 / (size * np.repeat(width, width)), size).astype(np.float32)


def _trained(s: _Sample, y: np.ndarray, train: np.ndarray, rng: np.random.Generator, epochs: int) -> np.ndarray:
    """Each bucket's logit after training on some of the texts from a random start."""
    words = np.diff(s.ends)
    clean = train[y[train] == 0]
    width = np.minimum(words, WINDOW)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    emb_sq, soft_sq, bias_sq = np.full(BUCKETS, 1e-6, np.float32), 1e-6, 1e-6
    for epoch in range(epochs):
        if epoch < WHOLE_EPOCHS:
            docs, wide = train, np.minimum(words[train], WHOLE_WORDS)
            start = rng.integers(0, words[train] - wide + 1)
        else:
            at, _ = worst_windows(s.word_means(emb @ (soft[:, 1] - soft[:, 0])), s.ends)
            more = np.repeat(clean, ANYWHERE)
            docs = np.concatenate((train, more))
            start = np.concatenate((at[train], rng.integers(0, words[more] - width[more] + 1)))
            wide = width[docs]
        for k in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // (16 if epoch < WHOLE_EPOCHS else 64))):
            row, buckets, weight = s.buckets_of(docs[k], start[k], wide[k])
            h = np.add.reduceat(emb[buckets] * weight[:, None], np.flatnonzero(np.diff(row, prepend=-1)))
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), y[docs[k]]] -= 1
            back = (p @ soft.T)[row] * weight[:, None]
            g_soft, g_bias = h.T @ p / len(p), p.mean(0)
            soft_sq, bias_sq = soft_sq + (g_soft**2).mean(), bias_sq + (g_bias**2).mean()
            soft -= (0.2 * g_soft / np.sqrt(soft_sq)).astype(np.float32)
            bias -= (0.1 * g_bias / np.sqrt(bias_sq)).astype(np.float32)
            np.add.at(emb_sq, buckets, (back**2).mean(1))
            np.subtract.at(emb, buckets, 0.2 * back / np.sqrt(emb_sq[buckets])[:, None])
        emb *= DECAY
        soft *= DECAY
    return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)


def fit_model(texts: list[str], toxic: list[int], seed: int = 7, epochs: int = EPOCHS, natural: float | None = None) -> ToxicityModel:
    """Train on (text, 0/1), FOLDS times, each time without another part of the texts, by which prior
    and temperature are fitted; natural is the share of toxic texts where they come from, by which the two kinds of error are weighed there.

    Without texts of both classes every text is as those that there are, or clean if there are none.
    """
    y = np.array(toxic, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if len(set(toxic)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 1e6 if share else -1e6, 1.0, share)
    s = _Sample(texts)
    words = np.diff(s.ends)
    fold, some = np.arange(len(y)) % FOLDS, words > 0
    logits, top = [], np.full(len(y), np.nan)
    for k in range(FOLDS):
        seen = np.flatnonzero(some & (fold != k))
        if len(set(y[seen])) < 2:  # too few texts to leave any out
            seen = np.flatnonzero(some)
        logits.append(_trained(s, y, seen, np.random.default_rng(seed + k), epochs))
        left = fold == k
        top[left] = worst_windows(s.word_means(logits[-1]), s.ends)[1][left]
    logit = np.mean(logits, axis=0, dtype=np.float32)

    # Prior and temperature, by what each training makes of the texts that it didn't see: half lies
    # where fewest errors are made, in the middle of the gap; the temperature is the likeliest one.
    check = np.flatnonzero(some)
    order = check[np.argsort(top[check], kind="stable")]
    below = np.concatenate(([0], np.cumsum(y[order] == 1)))  # toxic ones called clean
    above = np.concatenate((np.cumsum((y[order] == 0)[::-1])[::-1], [0]))  # clean ones called toxic
    natural = share if natural is None else natural
    wrong = MISS_WEIGHT * natural * below / max(1, below[-1]) + (1 - natural) * above / max(1, above[0])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = best[len(best) // 2]
    edge = np.concatenate(([top[order[0]] - 1], top[order], [top[order[-1]] + 1]))
    z = top[order] - (edge[cut] + edge[cut + 1]) / 2
    spread = max(1e-6, float(z.std())) * np.geomspace(0.02, 2, 60)
    loss = [np.logaddexp(0, np.where(y[order] == 1, -z, z) / t).mean() for t in spread]
    return ToxicityModel(logit, -float(edge[cut] + edge[cut + 1]) / 2, float(spread[np.argmin(loss)]), share)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS_PER_CLASS, max_bytes: int = MAX_TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most max_docs labelled texts of each class, max_bytes in all.

    Rows of labels with a null id or label are left out; of repeated ids the largest label holds.
    Which rows of labels may be learned from is the caller's choice.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    in_class = dict(one.groupBy(F.col("y") > 0).count().collect())
    natural = in_class.get(True, 0) / max(1, sum(in_class.values()))
    chosen = [r for c in (0, 1) for r in one.filter(F.col("y") == c).orderBy(F.xxhash64("i"), "i").limit(max_docs).collect()]
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("i", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())])
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    sized = texts.join(F.broadcast(spark.createDataFrame(chosen, schema)), "i").groupBy("i", "y").agg(F.min(F.octet_length("t")).alias("n")).collect()
    taken, total = [], 0
    for i, y, n in sorted(sized, key=lambda r: zlib.crc32(str(r[0]).encode())):
        if total + n <= max_bytes:
            taken.append((i, y))
            total += n
    rows = texts.join(F.broadcast(spark.createDataFrame(taken, schema)), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
    return fit_model([r[2] for r in rows], [r[1] for r in rows], natural=natural)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int) for each row, over its whole text.

    Null text counts as empty; empty texts get the share of toxic texts in training. A score of
    exactly 0.5 counts as toxic. Null ids and repeated rows stay; other columns are not read; an
    empty table stays empty.
    """
    key, shared = docs.schema[id_col].dataType, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SCORED_ROWS, SCORED_BYTES):
            scores = shared.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {key.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns and no others."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SCORED_ROWS, SCORED_BYTES):
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
