"""Conversation repair, sharding and periodic runs against plain loops, SQL and their laws."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import conversation_repair as cr
from folio.llm import periodic_runs, sharding
from folio.llm.repair_sql import SQL

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault): every state's best rest, from the end."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for (q, x), to in go.items():
                if x != "s" and best.get(to):
                    cost, audit, lines = best[to]
                    best[q] = min(best.get(q, (9e9,)), (cost + 2, "I" + audit, [name[x] + ":", *lines]))
        return best

    best = inserted({0: (0, "", []), 3: (0, "", [])})
    for role, text, fault in reversed(rows):
        late, now = int(fault == "truncated"), {}
        for q in range(4):
            options = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            for (at, x), to in go.items():
                if at == q and fault not in ("blank", "duplicate"):
                    cost, audit, lines = best[to]
                    if role[:1] == x:
                        options.append((cost + late, "K" + audit, [f"{role}:{text}", *lines]))
                    if x != "s":
                        options.append((cost + 2 + late, "R" + audit, [f"{name[x]}:{text}", *lines]))
            now[q] = min(options)
        best = inserted(now)
    return best[0]


def plain_repair(rows):
    """{conv: result} of (conv, turn, role, text), as the report defines it; turns of one number by a hash."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            how = zlib.crc32(key.encode()) % 20
            text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
            role = "user" if how == 4 else role
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            kept += [(turn is not None, turn or 0, digest, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        kept.sort(key=lambda r: r[:3])
        seen, judged = set(), []
        for *_, role, text in kept:
            body = text.strip(WHITE)
            judged.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {r[3] for r in kept} - {None}
        cost, audit, lines = plain_edits(judged)
        faults = [f for *_, f in judged]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(rows):
    return {r[0]: tuple(r[1:]) for r in cr.repair_report(rows).collect()}


def test_repair_equals_sql_and_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = repaired(table)
    db = duckdb.connect()
    db.execute(f"create view conversations as from '{SF}/conversations.parquet'")
    assert got == {r[0]: tuple(r[1:]) for r in db.execute(SQL).fetchall()}
    assert got == plain_repair([tuple(r) for r in table.collect()])


def test_repair_of_odd_conversations(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "What", "", " \t\n", None, "Ünïcode?", "\x1c", "a.b"]
    rows = [(rng.choice([*range(25), None]), rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (101, 5, "user", "x" * 300_000 + "."), (101, 2**40, "assistant", "Far.")]
    rows += [(102, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(103, 1, "user", "Same.")] * 500
    dropped = next(i for i in range(200, 9999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "Gone."))
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("kind", F.lit("clash")).withColumn("digest", F.lit(None).cast("string")).repartition(5)
    got = repaired(table)
    assert got == plain_repair(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_report(table.limit(0)).count() == 0
    named = [("null", 1, "user", "A."), (None, 1, "user", "A."), ("x:4", 1, "user", "A."), ("x", 1, "4:us", "erA.")]
    assert repaired(spark.createDataFrame(named, "conv_id string, turn bigint, role string, text string")) == plain_repair(named)


def test_vectors_are_few_and_edits_least():
    a, rng = cr.Automaton(), random.Random(6)
    for _ in range(500):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), "t.", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(40))]
        symbols = bytes(cr.symbol_of(r[:1], {"": 0, "blank": 1, "truncated": 3}[f]) for r, _, f in rows)
        assert a.audit(symbols) == plain_edits(rows)[:2]
    assert len(a.vectors) <= 16  # the automaton is finite: all vectors that there can be


def plain_shards(rows, shards, seed=42):
    """Shard and slot of (id, text, source), by sorting fractions in plain loops."""
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 16
    key = lambda i, t: hashlib.md5(f"{seed}:{'' if i is None else i}:{size(t)}:{crc(t)}".encode()).hexdigest()
    of = {}
    for i, t, s in rows:
        of.setdefault(s, []).append((key(i, t), i, t))
    placed = sorted(((2 * k + 1) / (2 * len(group)), h, "" if s is None else f"={s}", i, size(t), crc(t)) for s, group in of.items() for k, (h, i, t) in enumerate(sorted(group, key=lambda g: g[0])))
    out, slots = [], {}
    for pos, (*_, i, n, c) in enumerate(placed):
        shard = pos * shards // len(placed)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, n, c, "rows", shard, slots[shard], None))
    return out


def test_shards_equal_plain_loops_and_match_the_mixture(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_documents(table)
    rows = [tuple(r)[:7] for r in got.collect()]
    assert sorted(rows, key=str) == sorted(plain_shards([(r.doc_id, r.text, r.source) for r in table.collect()], 40), key=str)
    other = sharding.shard_documents(table.repartition(7))  # the order of the input doesn't matter
    assert sorted(rows, key=str) == sorted((tuple(r)[:7] for r in other.collect()), key=str)
    sizes = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    whole = {r.source: r["count"] for r in table.groupBy("source").count().collect()}
    found = {(r.shard, r.source): r.n for r in sharding.mixture(got).collect()}
    assert all(abs(found.get((k, s), 0) - n / 40) <= 2 for s, n in whole.items() for k in range(40))


def test_shards_of_odd_rows(spark, odd, no_docs):
    rows = [tuple(r)[:7] for r in sharding.shard_documents(odd, shards=4).collect()]
    assert sorted(rows, key=str) == sorted(plain_shards([(r.doc_id, r.text, None) for r in odd.collect()], 4), key=str)
    assert sharding.shard_documents(no_docs).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    mix = {}
    for r in sharding.mixture(sharding.shard_documents(hot, shards=10)).collect():
        mix.setdefault(r.source, []).append(r.n)
    assert max(mix[None]) - min(mix[None]) <= 6 and len(mix[None]) == 10  # a third of all rows, spread evenly
    few = sharding.shard_documents(hot.limit(3), shards=40).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def plain_runs(w):
    """Runs by comparing all words of all periods, and a search for the smallest period of each stretch."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            start = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(6, 4 * p):
                s = w[start : start + length]
                if all(s[q:] != s[:-q] for q in range(1, p)):
                    out.append((start, length, p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    k, n, w = rng.choice([1, 2, 2, 3, 5]), rng.randrange(150), []
    if rng.random() < 0.3:
        return [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    while len(w) < n:
        w += [rng.randrange(k) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 8)
        w = w[: len(w) - rng.randrange(4)]
    if rng.random() < 0.5:
        w = w * rng.randrange(1, 6)
    if w and rng.random() < 0.5:
        w[rng.randrange(len(w))] = 9
    return w


def test_runs_equal_plain_loops():
    rng, seen = random.Random(8), 0
    for _ in range(3000):
        w = odd_words(rng)
        expected = plain_runs(w)
        assert periodic_runs.runs(np.array(w, np.int32)) == expected, w
        seen += len(expected)
    assert seen > 2000


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_report_equals_plain_loops(spark, odd, no_docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    assert sorted(map(tuple, periodic_runs.run_report(table).collect())) == sorted(plain_report(r.doc_id, r.text) for r in table.collect())
    short = odd.filter("text IS NULL OR length(text) < 1000")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, periodic_runs.run_report(short).collect()), key=key) == sorted((plain_report(r.doc_id, r.text) for r in short.collect()), key=key)
    assert periodic_runs.run_report(odd).count() == odd.count() and periodic_runs.run_report(no_docs).count() == 0
    looped = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    made = spark.createDataFrame([(i, " ".join(f"w{(k * k) % 23}" for k in range(3 * i))) for i in looped], "doc_id bigint, text string")
    got = sorted(map(tuple, periodic_runs.run_report(made).collect()))
    assert got == sorted(plain_report(r.doc_id, r.text) for r in made.collect()) and sum(r[1] for r in got) > 5


def test_found_runs_and_collapsed_texts(spark):
    d = spark.createDataFrame([(1, "go a b a b a b a b end", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, runs string")
    got = {r.id: r for r in periodic_runs.find_runs(d).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "go a b end"
    assert got[2].runs == [] and got[2].collapsed is None and got[3].collapsed == ""


@pytest.mark.parametrize("shape", ["same", "broken", "loop"])
def test_very_long_texts_take_no_square_of_time(shape):
    n = 200_000
    w = {"same": np.zeros(n, np.int32), "broken": (np.arange(n) == n // 2).astype(np.int32), "loop": (np.arange(n) % 100).astype(np.int32)}[shape]
    began = time.perf_counter()
    found = periodic_runs.runs(w)
    assert len(found) == (2 if shape == "broken" else 1)
    assert time.perf_counter() - began < 20
