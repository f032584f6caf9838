"""Language-model scores by prediction by partial matching (operator 8).

A byte-context trie holds, for every context of up to ORDER bytes, how often each byte followed it
in the training documents. A byte is predicted from the longest context that the trie has; if it
never followed there, an escape (method D: half a count for each distinct follower) leads to
the next shorter context, where the followers already ruled out are excluded. The followers of a
context also followed its suffixes, so what is excluded at one length is just what followed the
context one byte longer; its mass is worked out once for each context, and whole arrays of bytes
are scored at a time.

All grams count. Up to MAX_GRAMS the whole trie is sent to every task. Beyond it, the scores of the
more frequent ones are sent, and all other grams of a text meet the counts of the grams with the
same SPLIT bytes before the last in one task, which holds those parts of the trie that decide on
them; so scores don't depend on where the limit lies.

Beside it stands the base, a unigram model of words with add-one smoothing. Words are counted over
all training documents; the more frequent ones are sent to every task, up to a fixed number, and
the rest are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import slices, written

ORDER = 5
#: Bytes that no UTF-8 text holds: before a text, and after it.
PAD, END = 0xFE, 0xFF
SYMBOLS = 256
#: Grams that are sent to every task; others are joined.
MAX_GRAMS = 4_000_000
#: Bytes of context by which joined grams are dealt out; levels of fewer bytes are sent to all.
SPLIT = 3
#: Counted grams for each task that joins, at most about.
TASK_GRAMS = 2_000_000
#: Grams that a Python worker remembers with their scores.
REMEMBERED = 2_000_000
#: Words that are sent to every task.
MAX_SENT_WORDS = 200_000
#: The one token that no word can be: the end of a text.
END_TOKEN = "\n"
#: Distinct words or contexts that a task counts before it hands them on.
COUNTED = 500_000


def words(text: str) -> list[bytes]:
    """Words of a whole text, A-Z in lower case; apart at ASCII white space."""
    return text.encode().lower().split()


def gram_keys(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text): for each byte of each text (words one space apart, then END), the byte with
    the order bytes before it as one number; and which text it is of."""
    parts = [b" ".join(w) + bytes([END]) for w in texts]
    pad = bytes([PAD]) * order
    buf = np.frombuffer(b"".join(pad + p for p in parts), np.uint8)
    keys = np.zeros(max(0, len(buf) - order), np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | buf[j : j + len(keys)]
    own = buf[order:] != PAD
    return keys[own], np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class Trie:
    """levels[j]: (grams, counts) of j bytes of context and one more, for j from 0 to the order."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for level in levels:
            self._add(*level)

    def _add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        j, at = len(self.levels), np.argsort(grams)
        grams, counts = grams[at], _narrow(counts[at])
        contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
        ruled_out = np.zeros(len(contexts))
        if j and len(grams):  # count, one byte of context less, of all that followed this one
            shorter, n = self.levels[-1][:2]
            ruled_out = np.bincount(of, n[np.searchsorted(shorter, grams & _mask(j))], len(contexts))
        self.levels.append((grams, counts, contexts, _narrow(total), _narrow(distinct), _narrow(ruled_out)))

    def with_grams(self, grams: np.ndarray, counts: np.ndarray, order: int) -> Trie:
        """These levels, and those up to the order of the grams given."""
        more = Trie([])
        more.levels = list(self.levels)
        while len(more.levels) <= order:
            keys, at = np.unique(grams & _mask(len(more.levels) + 1), return_inverse=True)
            more._add(keys, np.bincount(at, counts, len(keys)))
        return more

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after the bytes before it."""
        score, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        out_total, out_distinct = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(len(self.levels) - 1, -1, -1):
            grams, counts, contexts, total, distinct, ruled_out = self.levels[j]
            if not len(grams):
                continue
            gram = keys & _mask(j + 1)
            c = np.minimum(np.searchsorted(contexts, gram >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == gram >> np.uint64(8)
            g = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            found = known & (grams[g] == gram) & ~done
            left = distinct[c] - out_distinct
            whole = 2 * (total[c] - out_total)
            score[found] += np.log10((2.0 * counts[g[found]] - 1) / whole[found])
            escapes = known & ~done & ~found & (left > 0)
            score[escapes] += np.log10(left[escapes] / whole[escapes])
            done |= found
            out_total, out_distinct = np.where(known, ruled_out[c], 0.0), np.where(known, distinct[c], 0.0)
        score[~done] -= np.log10(SYMBOLS - out_distinct[~done])
        return score


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest unsigned type that holds them all; every task holds the trie."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


class Remembered:
    """A model that remembers the grams it has scored, and starts afresh beyond a fixed number."""

    def __init__(self, model: Trie | Sent, entries: int = REMEMBERED):
        self._model, self._entries = model, entries
        self._keys, self._scores = np.zeros(0, np.uint64), np.zeros(0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """As the model's; keys in order, each once."""
        at = np.searchsorted(self._keys, keys)
        met = at < len(self._keys)
        met[met] = self._keys[at[met]] == keys[met]
        score = np.empty(len(keys))
        score[met] = self._scores[at[met]]
        if not met.all():
            new = keys[~met]
            score[~met] = self._model.log10(new)
            if len(self._keys) + len(new) > self._entries:
                self._keys, self._scores = new, score[~met]
            else:
                both = np.concatenate((self._keys, new))
                order = np.argsort(both, kind="stable")  # two sorted runs: a merge
                self._keys, self._scores = both[order], np.concatenate((self._scores, score[~met]))[order]
        return score


def text_scores(model: Remembered, texts: list[list[bytes]], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(score, grams, times): log10 probability of each text, without that of the grams that the
    model leaves open, which are listed. Every distinct gram of the batch is scored once."""
    keys, of = gram_keys(texts, order)
    distinct, at = np.unique(keys, return_inverse=True)
    score = model.log10(distinct)[at]
    known = ~np.isnan(score)
    return np.bincount(of[known], score[known], len(texts)), *left_over(of[~known], keys[~known], len(texts))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys from several tables of counts."""
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys))


def count_training(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(word, gram, n): counts of words and, in rows with null word, of grams over whole texts."""

    def rows(seen: Counter, grams: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        w, (key, n) = [x.decode() for x in seen], grams
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(w, pa.string()), pa.nulls(len(key), pa.string())]),
                pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(key.astype(np.int64))]),
                pa.concat_arrays([pa.array(seen.values(), pa.int64(), size=len(w)), pa.array(n.astype(np.int64))]),
            ],
            names=["word", "gram", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts = Counter(), []
        for b in slices(batches):
            texts = [words(t or "") for t in b.column(0).to_pylist()]
            for w in texts:
                seen.update(w)
            seen[END_TOKEN.encode()] += len(texts)
            parts.append(np.unique(gram_keys(texts, order)[0], return_counts=True))
            if len(parts) > 4:
                parts = [_summed(parts)]
            if len(seen) > COUNTED or len(parts[0][0]) > 2 * COUNTED:
                yield rows(seen, _summed(parts))
                seen, parts = Counter(), []
        if parts:
            yield rows(seen, _summed(parts))

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, gram bigint, n bigint")
    return counted.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, room: int) -> int:
    """Least count so that no more than room rows have it or more; all rows if they fit.

    Counts are told apart by eighths of powers of two: at most some 500 rows reach the driver."""
    step = F.floor(F.log2("n") * 8)
    total, least = 0, 1
    for _, n, low in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("low")).collect(), reverse=True):
        total += n
        if total > room:
            break
        least = low
    else:
        return 1
    return least if total > n else 1 << 62


def read_trie(grams: DataFrame, order: int = ORDER) -> Trie:
    """The trie of all counted grams, of contexts of up to order bytes."""
    levels = []
    for j in range(order + 1):
        table = grams.groupBy(F.col("gram").bitwiseAND(int(_mask(j + 1))).alias("g")).agg(F.sum("n").alias("n")).toArrow()
        levels.append((table.column("g").to_numpy().astype(np.uint64), table.column("n").to_numpy()))
    return Trie(levels)


class Sent:
    """log10 of the probabilities of some grams that occurred in training."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray):
        at = np.argsort(grams)
        self.grams, self.scores = grams[at], scores[at]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """As Trie.log10; not a number for other grams."""
        if not len(self.grams):
            return np.full(len(keys), np.nan)
        g = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        return np.where(self.grams[g] == keys, self.scores[g], np.nan)


def read_frequent(grams: DataFrame, least: int) -> Sent:
    """Scores of the grams that occurred so often; all grams count in their contexts."""
    context = F.shiftrightunsigned("gram", 8)
    total = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    often = grams.filter(F.col("n") >= least).withColumn("context", context).join(total, "context")
    table = often.select("gram", F.log10((2.0 * F.col("n") - 1) / (2.0 * F.col("total"))).alias("score")).toArrow()
    return Sent(table.column("gram").to_numpy().astype(np.uint64), table.column("score").to_numpy())


def left_over(of: np.ndarray, keys: np.ndarray, texts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text, its distinct keys and how often each occurs; of: the text of each key."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order].astype(np.int64)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    times, cuts = np.diff(np.append(first, len(of))), np.searchsorted(of[first], np.arange(1, texts))
    return np.split(keys[first], cuts), np.split(times, cuts)


def _parts_of_contexts(contexts: DataFrame, tasks: int) -> DataFrame:
    """(of, parts): into how many parts each context goes that has more than a task's share of the rows;
    there are fewer of them than tasks, so the table may be broadcast."""
    counts = contexts.groupBy("of").agg(F.count("*").alias("rows"))
    share = max(1, (counts.agg(F.sum("rows")).first()[0] or 0) // tasks)
    hot = [(r.of, min(-(-r.rows // share), tasks, 1 << 20)) for r in counts.filter(F.col("rows") > share).collect()]
    return F.broadcast(contexts.sparkSession.createDataFrame(hot, "of bigint, parts int"))


def score_joined(wanted: DataFrame, grams: DataFrame, low: Trie, order: int, tasks: int) -> DataFrame:
    """(row, score): log10 of the probability of wanted(row, gram, times), summed in each row in
    parts. low has the levels of all grams with less than SPLIT bytes of context.

    Grams meet by the bytes of context that low lacks. Of one such context there are no more than
    256^3 counted grams, whatever the corpus; what is wanted in it may be any share of all. A context in
    which more is wanted than a task's share is therefore dealt to several tasks, by gram, and its
    counted grams go to each of them."""
    split, shared = len(low.levels), wanted.sparkSession.sparkContext.broadcast(low)
    none = F.lit(None).cast("long")
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(int(_mask(split)))
    parts = _parts_of_contexts(wanted.select(context.alias("of")), tasks)
    share = lambda d, part: d.withColumn("of", context).join(parts, "of", "left").withColumn("context", F.shiftleft("of", 20) + part)
    everywhere = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    counted = share(grams.withColumn("row", none), F.lit(0)).withColumn("part", everywhere).withColumn("context", F.col("context") + F.col("part"))
    asked = share(wanted.withColumnRenamed("times", "n"), F.pmod(F.xxhash64("gram"), F.coalesce("parts", F.lit(1))))
    both = counted.select("gram", "row", "n", "context").unionByName(asked.select("gram", "row", "n", "context"))
    dealt = both.repartition(tasks, "context").sortWithinPartitions("context", F.col("row").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A context's counted grams come before its wanted ones. held: those of the last context.
        last, held, trie = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            gram, n, context = b.column(0).to_numpy().astype(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy()
            counted = b.column(1).is_null().to_numpy(zero_copy_only=False)
            if counted.any() or context[0] != last or context[-1] != last:
                trie = None
                held = held if context[0] == last else []
                held.append((gram[counted], n[counted], context[counted]))
            if not counted.all():
                if trie is None:
                    keys, times, _ = (np.concatenate(x) for x in zip(*held, strict=True))
                    trie = shared.value.with_grams(keys, times, order)
                distinct, at = np.unique(gram[~counted], return_inverse=True)
                row, of = np.unique(b.column(1).drop_null().to_numpy(), return_inverse=True)
                score = np.bincount(of, trie.log10(distinct)[at] * n[~counted], len(row))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score)], names=["row", "score"])
            if context[-1] != last:
                last, trie = context[-1], None
                held = [tuple(x[k] for x in h) for h in held if (k := h[2] == last).any()]
                held = held or [(gram[:0], n[:0], context[:0])]

    return dealt.select("gram", "row", "n", "context").mapInArrow(run, "row bigint, score double")


def score_documents(docs: DataFrame, held_out_col: str, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", max_grams: int = MAX_GRAMS, max_sent_words: int = MAX_SENT_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Learns from the rows whose held_out_col is false or null, and scores all, over whole texts.
    Null text counts as empty: one token, the end. Null ids stay; a repeated row counts and is
    scored as often as it occurs. Without training rows all bytes are equally likely and no token
    is known. Other columns are not read; an empty table stays empty. score is log10 of the
    probability of the text's tokens as the base has them: words in lower case, one space apart.
    max_grams and max_sent_words bound what every task holds; results don't depend on them.
    """
    spark, key = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(held_out_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    counts = written(count_training(picked.filter("NOT held_out"), order, "t"), "lm-counts")
    vocabulary = counts.filter("word IS NOT NULL").select("word", "n")
    n_train, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least_count(vocabulary, max_sent_words)
    sent = vocabulary.filter(F.col("n") >= least).toArrow()
    frequent = {w.encode(): n for w, n in zip(sent.column("word").to_pylist(), sent.column("n").to_pylist(), strict=True)}
    end_count = frequent.pop(END_TOKEN.encode(), None)
    if end_count is None:
        end_count = (vocabulary.filter(F.col("word") == END_TOKEN).first() or ("", 0))[1]
    grams = counts.filter("gram IS NOT NULL").select("gram", "n")
    least_gram = _least_count(grams, max_grams)
    model = read_trie(grams, order) if least_gram <= 1 else read_frequent(grams, least_gram)
    shared = spark.sparkContext.broadcast(({w: np.log10(n + 1.0) for w, n in frequent.items()}, model))
    end_log = float(np.log10(end_count + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, model = shared.value[0], Remembered(shared.value[1])
        for b in slices(batches):
            texts = [words(t or "") for t in b.column(2).to_pylist()]
            known, total, rest = [], [], []
            for w in texts:
                found = list(map(logs.get, w))
                rare = [x.decode() for x, f in zip(w, found, strict=True) if f is None] if None in found else []
                known.append(len(w) - len(rare) + int(end_count > 0))
                total.append(sum(f for f in found if f is not None) + end_log)
                rest.append(rare)
            score, left, times = text_scores(model, texts, order)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), pa.array(rest, pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array(left, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["i", "held_out", "n_tokens", "known", "total", "rest", "score", "grams", "times"],
            )

    scored = written(picked.mapInArrow(run, f"i {key}, held_out boolean, n_tokens bigint, known bigint, total double, rest array<string>, score double, grams array<bigint>, times array<bigint>").withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rest = scored.select("row", F.explode("rest").alias("word")).groupBy("word", "row").agg(F.count("*").alias("tf"))
    rare = vocabulary.filter((F.col("n") < least) & (F.col("word") != END_TOKEN))
    summed = rest.join(rare, "word").groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("more"))
    if least_gram > 1:
        wanted = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", "g.grams", "g.times").withColumnRenamed("grams", "gram")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // TASK_GRAMS))
        joined = score_joined(wanted, grams, read_trie(grams, min(SPLIT, order) - 1), order, tasks)
        scored = scored.join(joined.groupBy("row").agg(F.sum("score").alias("more_score")), "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    nothing = F.lit(0)
    return scored.join(summed, "row", "left").select(
        F.col("i").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", nothing)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_train + n_distinct + 1)))).alias("base_score"),
        "score",
    )
