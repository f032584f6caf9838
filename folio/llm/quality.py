"""Quality rules as weak supervision (operator 4).

Every rule votes "good" or "bad" or abstains on a document. All documents that pass the base test
enter the fit, as vote patterns with counts (those that fail it are decided already). Expectation-
maximisation estimates, without labels, how often each rule casts each vote on good and on bad
documents, and what share is good; a rule is held to be right more often than wrong, in that it
calls few good documents bad. A document is kept by its posterior probability of being good, not
by passing every rule.

Texts are measured once, and what was found is written; all that follows is a count of patterns and
a join with their posteriors, of which there are 3^rules at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm._common import scratch_name, slices, written

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Documents with at least this posterior probability of being good are kept.
THRESHOLD = 0.5
#: No rule is taken to call more than this share of the good documents bad.
MOST_WRONG = 0.05

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def _without(raw: bytes, some: bytes) -> int:
    """How many bytes of raw are among some."""
    return len(raw) - len(raw.translate(None, some))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of 3 words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    n = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair = n[:-1] * len(numbers) + n[1:]
    if len(numbers) > 1_000_000:  # three factors would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, of, count = np.unique(pair[:-1] * len(numbers) + n[2:], return_inverse=True, return_counts=True)
    twice = count[of] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def measures(text: str) -> dict[str, float]:
    """What the rules look at, over the whole text."""
    raw = text.encode()
    words = raw.split()
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - _without(raw, WHITE),
        "n_symbols": _without(raw, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_upper": _without(raw, _UPPER),
        "n_letters": _without(raw, _LETTERS),
        "n_marks": _without(raw, b"!?"),
        "n_distinct": len(distinct),
        "n_marked": sum(w[-1] in SYMBOLS for w in distinct),
        "n_lone": raw.count(b" | "),
        "n_stops": sum(map(raw.count, (b". ", b".\n", b"! ", b"? "))),
    }


def _three_way(value: float, good: float, bad: float) -> int:
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


#: Name and vote of each rule. Each has a band between its two limits in which it abstains.
RULES = [
    ("symbols", lambda m: _three_way(m["n_symbols"] / m["n_words"], 0.05, 0.1)),
    ("marked_words", lambda m: _three_way(m["n_marked"] / m["n_distinct"], 0.02, 0.1)),
    ("cells", lambda m: _three_way(m["n_lone"] / m["n_words"], 0.02, 0.1)),
    ("upper_case", lambda m: _three_way(m["n_upper"] / max(1, m["n_letters"]), 0.15, 0.4)),
    ("marks", lambda m: _three_way(m["n_marks"] / m["n_words"], 0.1, 0.4)),
    ("duplicate_lines", lambda m: ABSTAIN if m["n_lines"] < 4 else _three_way(m["n_dup_lines"] / m["n_lines"], 0.1, 0.3)),
    ("repeated_words", lambda m: _three_way(m["n_repeat_words"] / m["n_words"], 0.1, 0.3)),
    ("sentences", lambda m: _three_way(m["n_words"] / (1 + m["n_stops"]), 20, 40)),
    ("word_length", lambda m: _three_way(abs(m["word_chars"] / m["n_words"] - 6.5), 3.5, 5)),
]


def votes(m: dict[str, float]) -> bytes:
    """One byte for each rule; all abstain on a text without words."""
    return bytes(vote(m) for _, vote in RULES) if m["n_words"] else bytes([ABSTAIN]) * len(RULES)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; table[c, r, v]: probability that rule r votes v on class c
    (0 bad, 1 good)."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of votes."""
        r = np.arange(patterns.shape[1])
        log = [np.log(p) + np.log(self.table[c, r, patterns]).sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """For each rule: probability that its vote is right, given that it votes."""
        right = self.prior * self.table[1, :, GOOD] + (1 - self.prior) * self.table[0, :, BAD]
        wrong = self.prior * self.table[1, :, BAD] + (1 - self.prior) * self.table[0, :, GOOD]
        return right / (right + wrong)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85) -> LabelModel:
    """Expectation-maximisation from a start where rules are right more often than not.

    Smoothing: a tenth of a percent of the documents is spread over each rule's votes as the start
    has them, so that few documents, or a rule that never votes, leave the start in place.
    """
    k = patterns.shape[1] if patterns.ndim == 2 else len(RULES)
    start = np.empty((2, k, 3))
    start[1] = [0.01, 0.89, 0.10]  # on good ones: bad, good, abstain
    start[0] = [0.40, 0.40, 0.20]
    model = LabelModel(prior, start)
    total = counts.sum()
    if not total:
        return model
    seen = np.stack([patterns == v for v in range(3)], 2).astype(float)
    weight = max(1.0, 0.001 * total)
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        share = (good.sum() + weight * prior) / (total + weight)
        table = np.stack([np.einsum("p,prv->rv", w, seen) for w in (counts - good, good)]) + weight * start
        table /= table.sum(2, keepdims=True)
        wrong = np.minimum(table[1, :, BAD], MOST_WRONG)
        table[1, :, [GOOD, ABSTAIN]] *= (1 - wrong) / (1 - table[1, :, BAD])
        table[1, :, BAD] = wrong
        moved = np.abs(table - model.table).max()
        model = LabelModel(float(share), table)
        if moved < 1e-9:
            break
    return model


def base_failed(m: dict[str, float], min_words: int = MIN_WORDS) -> bool:
    return m["n_words"] < min_words or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def fit_quality(measured: DataFrame, failed_col: str = "base_failed", votes_col: str = "votes") -> LabelModel:
    """Fit over all measured documents that pass the base test: the driver gets at most 3^rules
    patterns with their counts."""
    found = sorted(measured.filter(~F.col(failed_col)).groupBy(F.col(votes_col).alias("v")).count().collect())
    patterns = np.array([list(r[0]) for r in found], np.int64).reshape(-1, len(RULES))
    return fit_label_model(patterns, np.array([r[1] for r in found], float))


def posteriors(measured: DataFrame, model: LabelModel, votes_col: str = "votes") -> DataFrame:
    """(votes, p_good) for each pattern that there is: at most 3^rules rows, so it may be broadcast."""
    found = [bytes(r[0]) for r in measured.select(F.col(votes_col).alias("v")).distinct().collect()]
    p = model.posterior(np.array([list(v) for v in found], np.int64).reshape(-1, len(RULES)))
    return F.broadcast(measured.sparkSession.createDataFrame(list(zip(found, p.tolist(), strict=True)), "votes binary, p_good double"))


def quality_report(docs: DataFrame, model: LabelModel | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good)
    for each row.

    Null text has no words, and so fails the base. Null ids and repeated rows stay (a repeated row
    counts as often as it occurs). Other columns are not read. An empty table stays empty. Ties at
    the threshold are kept.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [measures(t or "") for t in b.column(1).to_pylist()]
            columns = [pa.array([m[c] for m in found], pa.int64()) for c in BASE]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(map(base_failed, found), pa.bool_()), pa.array(map(votes, found), pa.binary())], names=["i", *BASE, "base_failed", "votes"])

    schema = f"i {key}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, votes binary"
    measured = written(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema), "quality")
    judged = measured.join(posteriors(measured, model or fit_quality(measured)), "votes", "left")
    return judged.select(F.col("i").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")


def keep_good(docs: DataFrame, model: LabelModel | None = None, threshold: float = THRESHOLD, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of documents that are kept, with all their columns and no others. min_words: what the
    base test asks for here; the fit is over the documents that pass it."""
    at, failed, voted = docs.columns.index(text_col), scratch_name(docs, "base_failed"), scratch_name(docs, "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [measures(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base_failed(m, min_words) for m in found], pa.bool_()), pa.array(map(votes, found), pa.binary())], names=[*b.schema.names, failed, voted])

    schema = T.StructType([*docs.schema.fields, T.StructField(failed, T.BooleanType()), T.StructField(voted, T.BinaryType())])
    measured = written(docs.mapInArrow(run, schema), "quality")
    good = posteriors(measured, model or fit_quality(measured, failed, voted), voted).filter(F.col("p_good") >= threshold)
    return measured.filter(~F.col(failed)).join(good.withColumnRenamed("votes", voted), voted, "left_semi").select(*docs.columns)
