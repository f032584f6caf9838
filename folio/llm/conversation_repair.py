"""Repair of the structure of conversations by a determinised weighted automaton (operator 11).

The roles of a sound conversation spell (s?(ua)+)?. Its automaton has four states; what it costs to get
from a state through the rest of a conversation is a vector of four costs. Less their minimum, these
vectors are few: they become the states of a deterministic automaton, worked out when first met and
kept in a table. One scan of the table, from the last turn to the first, gives the cost. A trace
against the scan follows the arcs that are tight, the least letter first, and gives the edits.

Rows meet by conversation in two kinds: a small one for each turn, without its text, and then the
texts, in the same order. A task so knows all edits of a conversation before its first text comes, and
hashes the repaired texts as they stream by. It never holds a conversation's texts: what it holds is
a few bytes a turn, as the audit itself is one text of a letter a turn. SHA-256 reads a conversation from
its first byte to its last, so one task must see each whole one; what can be pre-aggregated (repeated
turns, first occurrences) is, before that shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._common import slices, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn of the user or the assistant leads to, the only one that fits.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 0 must be deleted; else 1 + 2 * role (s, u, a, other) + truncated.
MUST_DELETE = 0
SYMBOLS = 9
FAULTS = ["", "blank", "duplicate", "truncated"]
_ROLES = {"s": 0, "u": 1, "a": 2}


def _kept(q: int, symbol: int) -> int | None:
    """The state after a turn that is kept, if the grammar has one."""
    role = (symbol - 1) // 2
    if role == 0:
        return SYSTEM if q == START else None
    return NEXT[q] if role < 3 and (USER, ASSISTANT)[role - 1] == NEXT[q] else None


def _arcs(q: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn, letters in ASCII order."""
    arcs = [("D", DELETE, q)]
    if symbol != MUST_DELETE:
        late = TRUNCATED if (symbol - 1) % 2 else 0
        if (to := _kept(q, symbol)) is not None:
            arcs.append(("K", KEEP + late, to))
        arcs.append(("R", REROLE + late, NEXT[q]))
    return arcs


class Automaton:
    """Vectors of costs to go as states, with transitions that are worked out when first met."""

    def __init__(self):
        #: Costs from each state at the end: nothing if it accepts, else insertions until it does.
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._steps: list[list[tuple[int, int] | None]] = []
        self._traces: dict[tuple[int, int, int], tuple[bytes, int]] = {}
        self.end = self._id(self._with_inserts([0, 1 << 20, 1 << 20, 0]))

    @staticmethod
    def _with_inserts(costs: list[int]) -> tuple[int, ...]:
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return tuple(costs)

    def _id(self, vector: tuple[int, ...]) -> int:
        if vector not in self._ids:
            self._ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self._steps.append([None] * SYMBOLS)
        return self._ids[vector]

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """(vector before a turn, cost taken out of it) from the vector behind it."""
        known = self._steps[after][symbol]
        if known is None:
            v = self.vectors[after]
            costs = self._with_inserts([min(c + v[to] for _, c, to in _arcs(q, symbol)) for q in range(4)])
            least = min(costs)
            known = self._steps[after][symbol] = (self._id(tuple(c - least for c in costs)), least)
        return known

    def scan(self, symbols: bytes | bytearray) -> tuple[int, array]:
        """Least cost, and the vector before each turn and at the end."""
        vectors, state, cost, steps = array("H", bytes(2 * len(symbols) + 2)), self.end, 0, self._steps
        vectors[-1] = state
        for i in range(len(symbols) - 1, -1, -1):
            state, more = steps[state][symbols[i]] or self.step(state, symbols[i])
            cost += more
            vectors[i] = state
        return cost + self.vectors[state][START], vectors

    def tight(self, q: int, symbol: int, after: int) -> tuple[bytes, int]:
        """Letters up to and with that of a turn, by tight arcs from q, ASCII-least; and the state then."""
        found = self._traces.get((q, symbol, after))
        if found is None:
            before, taken = self.step(after, symbol)
            v, w, letters, at = self.vectors[before], self.vectors[after], "", q
            while not letters or letters[-1] == "I":
                options = [(x, to) for x, c, to in _arcs(at, symbol) if c + w[to] == v[at] + taken]
                if INSERT + v[NEXT[at]] == v[at]:
                    options.append(("I", NEXT[at]))
                letter, at = min(options)
                letters += letter
            found = self._traces[q, symbol, after] = letters.encode(), at
        return found

    def audit(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """Least cost and the edits that reach it."""
        cost, vectors = self.scan(symbols)
        q, letters = START, bytearray()
        for i, symbol in enumerate(symbols):
            some, q = self.tight(q, symbol, vectors[i + 1])
            letters += some
        letters += {START: b"", ASSISTANT: b"", USER: b"I", SYSTEM: b"II"}[q]
        return cost, letters.decode()


def symbol_of(initial: str, fault: int) -> int:
    return MUST_DELETE if fault in (1, 2) else 1 + 2 * _ROLES.get(initial, 3) + (fault == 3)


class _Conversation:
    """What a task knows of the conversation that streams by: first its turns, then their texts."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.symbols, self.copies, self.turns = bytearray(), {}, 0
        self.faults, self.illegal = [0] * 4, 0
        self.first_turn = self.last_turn = None
        self.distinct, self.initial = 0, None
        self.letters = None

    def turn(self, turn: int | None, initial: str, fault: int, repeat_fault: int, copies: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.distinct = turn, self.distinct + 1
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        self.faults[fault] += 1
        self.faults[repeat_fault] += copies - 1
        self.symbols.append(symbol_of(initial, fault))
        if copies > 1:
            self.copies[self.turns] = copies
            self.symbols.extend(bytes([MUST_DELETE]) * (copies - 1))
        self.turns += 1

    def repair(self) -> None:
        self.cost, self.letters = self.automaton.audit(self.symbols)
        self.symbols, self.at, self.q, self.k = None, 0, START, 0
        self.sha, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def text(self, role: str, text: str) -> None:
        """The text of the next turn, of which there may be copies."""
        if self.letters is None:
            self.repair()
        left = self.copies.get(self.k, 1)
        self.k += 1
        while left:
            letter = self.letters[self.at]
            self.at += 1
            if letter == "I":
                self._insert()
                continue
            left -= 1
            if letter != "D":
                system = letter == "K" and self.q == START and role[:1] == "s"
                self.q = SYSTEM if system else NEXT[self.q]
                self._line(role if letter == "K" else ROLE_OF[self.q], text)

    def _insert(self) -> None:
        self.q = NEXT[self.q]
        self._line(ROLE_OF[self.q], "")

    def result(self) -> tuple:
        if self.letters is None:
            self.repair()
        for _ in self.letters[self.at :]:
            self._insert()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return gaps, *self.faults[1:], self.illegal, self.cost, self.letters, self.sha.hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_DROPPED, _TURN, _TEXT = 0, 1, 2


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of the report's rows after damage; copies 0: dropped, 2: there
    twice. Null roles and texts are one space, as are null ids and turns in the text that decides."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", spaced(conv_col), spaced(turn_col))) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(spaced(text_col), ".!?", "")).otherwise(spaced(text_col))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(how == 4, "user").otherwise(spaced(role_col)).alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"))



def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows(conv,
    turn, role, text, copies), as damaged() gives them; a row for each conv, null too.

    Turns are in order, null first; those of one number by a digest of role and text, copies beside
    each other. No column but conv and turn may be null. Conversations of dropped rows only have
    zeros, no edits and the hash of nothing. An empty table stays empty."""
    key = rows.schema["conv"].dataType.simpleString()
    body = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    seen = rows.withColumn("digest", digest).withColumn("blank", F.length(body) == 0).withColumn("cut", ~F.substring(body, -1, 1).isin(".", "!", "?"))
    # Repeated turns become one row with a number before anything is shuffled.
    turns = seen.filter("copies > 0").groupBy("conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "cut").agg(F.sum("copies").alias("copies"))
    turns = written(turns, "turns")
    # Where a role and text of a conversation come first: one small row for each of them.
    order = lambda c: F.struct(c.isNotNull().alias("n"), c.alias("turn"))
    first = turns.groupBy(F.col("conv").alias("of"), F.col("digest").alias("same")).agg(F.min(order(F.col("turn"))).alias("first"))
    again = F.when(F.col("blank"), 1).otherwise(2)
    fault = F.when(F.col("blank"), 1).when(order(F.col("turn")) != F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    small = turns.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))).select("conv", F.lit(_TURN).alias("kind"), "turn", "digest", F.col("initial").alias("role"), F.lit(None).cast("string").alias("text"), fault.cast("int").alias("fault"), again.cast("int").alias("again"), "copies")
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("fault", "int"), ("again", "int"))]
    gone = rows.filter("copies = 0").select("conv").distinct().select("conv", F.lit(_DROPPED).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *rest, F.lit(0).cast("long").alias("copies"))
    # Blank turns are deleted, so that they need no text.
    texts = seen.filter("copies > 0").select("conv", F.lit(_TEXT).alias("kind"), "turn", "digest", "role", F.when(~F.col("blank"), F.col("text")).alias("text"), *rest, "copies")
    streamed = small.unionByName(gone).unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, id_, last, out, held = Automaton(), None, None, None, [], 0
        for b in slices(batches):
            for conv, kind, turn, digest, role, text, fault_, again_, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != id_:
                    if now is not None:
                        out.append((id_, *now.result()))
                        held += len(out[-1][7])
                    now, id_, last = _Conversation(automaton), conv, None
                if kind == _TURN:
                    now.turn(turn, role, fault_, again_, copies)
                elif kind == _TEXT and (turn, digest) != last:
                    now.text(role, text or "")
                    last = turn, digest
            if len(out) >= 1024 or held > 1 << 22:
                yield _batch(out, b.schema.field(0).type)
                out, held = [], 0
        if now is not None:
            out.append((id_, *now.result()))
            yield _batch(out, b.schema.field(0).type)

    schema = f"conv {key}, " + ", ".join(f"{c} bigint" for c in RESULT[:6]) + ", audit string, repaired_sha256 string"
    return streamed.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", *RESULT])


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): repair() of the
    damaged() rows, for every conversation that there was.

    Null ids are one conversation; null turns come first and don't count for gaps; null roles and texts
    are one space. Other columns are not read."""
    return repair(damaged(conversations, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)
