"""Token counts by finite-state tokenizer compilation (operator 10).

A subword BPE is compiled to a deterministic transducer that reads characters and emits, on each
transition, by how many tokens the encoding of what was read so far grows (or shrinks). A state
holds, for every suffix of the text that some longer piece may still cover, the last token before
that suffix and how many tokens it is behind. A list of tokens is the encoding of its text exactly
when all neighbours are, so the last token of a longer text is the one piece that fits the token
before it. States and transitions are made when first needed and kept.

Texts are cut into chunks of a fixed length, wherever that is. A chunk's state map sends each state
that may come in to the state that goes out and the tokens in between: a token may begin at any place
in the reach of the longest pieces before the cut, and each of these places gives a state. Maps are
functions on finite sets of states, a monoid under composition. A parallel prefix scan composes those
of all texts of a batch at once, level by level, as arrays of the numbers of states and tokens. Should
a state come in that was not foreseen, the chunk's map gets it as well, and the scan is run again:
counts are exact in any case.

Two characters that stand together in no piece are a seam: no token reaches over it, so that what
comes behind it in a chunk is the same for all states that come in, and is counted once for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import Memo, slices

#: The mark that stands for a space.
MARK = "▁"
#: Characters of a chunk.
CHUNK_CHARS = 512
#: Words up to so many characters are remembered with their counts.
MEMO_CHARS = 64
#: Transitions after which the compiled part is dropped and made afresh as needed.
MAX_TRANSITIONS = 1_000_000


class State:
    """items: (suffix, last token before it, tokens behind), shortest suffix first; step: character
    to (next state, tokens emitted)."""

    __slots__ = ("items", "step")

    def __init__(self, items: tuple):
        self.items, self.step = items, {}


class CountingTransducer:
    """The compiled tokenizer. pieces: text of a piece to its score (higher merges first)."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.starts = {p[:i] for p in pieces for i in range(1, len(p))}
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.longest = max(map(len, pieces), default=1)
        #: Whether every word begins at a seam, or with further marks.
        self.word_seams = not any(b == MARK != a for a, b in self.together)
        self.start = State((("", None, 0),))
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._forget()
        self.words = Memo(self.count_word)

    def _forget(self) -> None:
        self._states: dict[tuple, State] = {}
        self._made = 0
        self.start.step.clear()
        self._states[self.start.items] = self.start

    def _state(self, items: tuple) -> State:
        found = self._states.get(items)
        if found is None:
            found = self._states[items] = State(items)
        return found

    def encode(self, text: str) -> list[str]:
        """The pieces of a short text by merging outright; used to compile, not to count."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _is_whole(self, piece: str) -> bool:
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.encode(piece) == [piece]
        return known

    def _fit(self, left: str | None, right: str) -> bool:
        """Whether right may follow left in an encoding."""
        if left is None:
            return self._is_whole(right)
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = self.encode(left + right) == [left, right]
        return known

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        if self._made >= MAX_TRANSITIONS:
            self._forget()
        self._made += 1
        token = grown = None
        for suffix, before, behind in state.items:
            piece = suffix + char
            if (not suffix or piece in self.pieces) and self._fit(before, piece):
                token, grown = piece, (1 if piece in self.pieces else len(piece.encode())) - behind
                break
        if token is None:
            raise ValueError(f"no piece fits at {char!r}")
        items = [("", token, 0)]
        items += [(suffix + char, before, behind + grown) for suffix, before, behind in state.items if suffix + char in self.starts]
        reached = state.step[char] = (self._state(tuple(items)), grown)
        return reached

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            reached = state.step.get(char)
            state, n = reached if reached is not None else self._compile(state, char)
            total += n
        return state, total

    def count_word(self, word: str) -> int:
        """Tokens of a word with its mark put before it."""
        return self.run(self.start, MARK + word)[1]

    def words_of(self, text: str) -> tuple[State, int]:
        """(state, tokens) after a text from the start on; words are remembered with their counts."""
        if not self.word_seams or MARK + MARK in text:
            return self.run(self.start, text)
        first, *rest = text.split(MARK)
        if not rest:
            return self.run(self.start, text)
        total = self.run(self.start, first)[1] if first else 0
        last = rest.pop()
        total += sum(self.words[w] if len(w) <= MEMO_CHARS else self.count_word(w) for w in rest)
        state, n = self.run(self.start, MARK + last)
        return state, total + n

    def seam(self, text: str, at: int, end: int) -> int | None:
        """The first seam from one place to before another."""
        return next((i for i in range(at, end) if text[i - 1 : i + 1] not in self.together), None)

    def last_seam(self, text: str, at: int) -> int | None:
        """The last seam that lies before a place and not further back than tokens can matter."""
        return next((i for i in range(at - 1, max(0, at - 2 * self.longest), -1) if text[i - 1 : i + 1] not in self.together), None)

    def entries(self, text: str, at: int) -> set[State]:
        """The states that may come in at a cut: a token begins at one of the places before it. Before
        the last seam there is no need to look."""
        seam = self.last_seam(text, at)
        return {self.run(self.start, text[b:at])[0] for b in range(max(0, at - 2 * self.longest) if seam is None else seam, at + 1)}

    def out_of(self, text: str, at: int) -> State | None:
        """The state at a place, where a seam before it decides it."""
        seam = self.last_seam(text, at)
        return None if seam is None else self.run(self.start, text[seam:at])[0]

    def state_map(self, text: str, a: int, z: int, states: set[State]) -> dict[State, tuple[State, int]]:
        """Each state that comes in to (state, tokens) after text[a:z]."""
        first, out = self.seam(text, a + 1, z), self.out_of(text, z)
        if first is None:
            found = {s: self.run(s, text[a:z]) for s in states}
        else:
            reached, rest = self.words_of(text[first:z])
            found = {s: (reached, self.run(s, text[a:first])[1] + rest) for s in states}
        # A seam this side of the cut decides what goes out, by the name that the next chunk knows it by.
        within = out is not None and self.last_seam(text, z) >= a
        return {s: (out, n) for s, (_, n) in found.items()} if within else found

    @staticmethod
    def compose(a: dict, b: dict) -> dict:
        """The map of two neighbouring chunks; associative. Where b doesn't go on, neither does it."""
        return {state: (b[out][0], n + b[out][1]) for state, (out, n) in a.items() if out in b}

    def scan(self, maps: list[dict]) -> list[dict]:
        """The maps of all beginnings of a list of chunks."""
        (places, tokens), prefixes = prefix_scan([maps]), maps[:1]
        for k in range(1, len(maps)):
            chunk = list(maps[k].values())
            came = [(s, places[k - 1, e], int(tokens[k - 1, e])) for e, s in enumerate(maps[0])]
            prefixes.append({s: (chunk[p][0], n + chunk[p][1]) for s, p, n in came if p >= 0})
        return prefixes

    def state_maps(self, text: str, size: int) -> tuple[list[dict], list[str], list[int]]:
        """(maps, chunks, where each begins) of a text with its spaces as marks."""
        cuts = list(range(0, len(text), size))
        come_in = [self.entries(text, at) if at else {self.start} for at in cuts]
        ends = [*cuts[1:], len(text)]
        return [self.state_map(text, a, z, states) for a, z, states in zip(cuts, ends, come_in, strict=True)], [text[a:z] for a, z in zip(cuts, ends, strict=True)], cuts

    def counts(self, texts: list[str], chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """Tokens of each whole text; the scan runs over all of them at once."""
        marked = [MARK + t.replace(" ", MARK) for t in texts if t]
        made = [self.state_maps(t, chunk_chars) for t in marked]
        found, still = [0] * len(made), list(range(len(made)))
        while still:
            places, tokens = prefix_scan([made[i][0] for i in still])
            again, at = [], 0
            for i in still:
                maps, _, cuts = made[i]
                came = places[at : at + len(maps), 0]  # from the start, the only state that comes in first
                if came[-1] >= 0:
                    found[i] = int(tokens[at + len(maps) - 1, 0])
                else:
                    # What went out of the first chunk without a place is not among what the next one foresaw.
                    miss = int((came < 0).argmax()) + 1
                    state = self._went_out(maps, miss)
                    end = cuts[miss + 1] if miss + 1 < len(cuts) else len(marked[i])
                    maps[miss].update(self.state_map(marked[i], cuts[miss], end, {state}))
                    again.append(i)
                at += len(maps)
            still = again
        counted = iter(found)
        return [next(counted) if t else 0 for t in texts]

    def _went_out(self, maps: list[dict], at: int) -> State:
        state = self.start
        for m in maps[:at]:
            state = m[state][0]
        return state

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text."""
        return self.counts([text], chunk_chars)[0]


def out_names(chunk_map: dict) -> list:
    """The states that go out of a chunk, each once."""
    return list(dict.fromkeys(out for out, _ in chunk_map.values()))


def prefix_scan(texts: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of the state maps of each text's chunks: (places, tokens), with a row for each
    chunk of each text and a column for each state that comes into the text's first chunk: the number of the
    state that goes out, among those of the next chunk (of the last: among out_names()), or -1 where a
    chunk in between lacks it, and the tokens until then.

    In every round, each chunk's map is composed with that of the chunks before it, twice as many each
    time; rounds are as many as the logarithm of the most chunks of a text."""
    maps = [m for text in texts for m in text]
    if not maps:
        return np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
    place = np.concatenate([np.arange(len(text)) for text in texts])  # in its text
    last = np.concatenate([np.arange(len(text)) == len(text) - 1 for text in texts])
    width = max(map(len, maps))
    places, tokens = np.full((len(maps), width), -1), np.zeros((len(maps), width), np.int64)
    for k, m in enumerate(maps):
        names = {s: e for e, s in enumerate(out_names(m) if last[k] else maps[k + 1])}
        for e, (out, n) in enumerate(m.values()):
            places[k, e], tokens[k, e] = names.get(out, -1), n
    reach = 1
    while reach <= place.max():
        at = np.flatnonzero(place >= reach)
        into, before = places[at - reach], tokens[at - reach]
        goes = into >= 0
        into = np.where(goes, into, 0)
        places[at], tokens[at] = np.where(goes, np.take_along_axis(places[at], into, 1), -1), np.where(goes, before + np.take_along_axis(tokens[at], into, 1), 0)
        reach *= 2
    return places, tokens


@lru_cache(maxsize=2)
def compiled(path: str) -> CountingTransducer:
    """The transducer for a sentencepiece BPE model with byte fallback and no normalisation of
    characters; one for each Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return CountingTransducer({sp.id_to_piece(i): sp.get_score(i) for i in ordinary})


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, over its whole text.

    model_path is opened in the Python workers. Null text counts as empty (0 bytes, 0 tokens).
    Null ids and repeated rows stay; other columns are not read; an empty table stays empty.
    Texts of any length run in chunks, whose maps are composed by arrays of a batch.
    """
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = compiled(model_path).counts
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts([t or "" for t in b.column(1).to_pylist()]), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(run, f"`{id_col}` {key.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
