"""WARC round trips, nearest neighbours and the pipeline."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import ann, quality, secret_scan, simhash, toxicity, warc
from folio.llm.queries import ORACLE_SQL, QUERIES, toxicity_model

SF = "/root/testdata/sf0.01"


def test_warc_round_trip(spark):
    trick = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(5, "http://b.example.com/x?q=1", "same"), (2, "https://www.a.example.com/", "same"), (3, None, None), (4, "http://b.example.com/x?q=1", ""), (6, "http://[bad", trick), (7, "a b\r\nc", trick + "é漢"), (2, "https://www.a.example.com/", "same"), (None, "http://c.example.com", "only"), (8, "http://b.example.com/x", "y" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("first", F.lit(1)).withColumn("d", F.lit(2)).repartition(3)
    got = warc.archive_and_index(pages).collect()
    keys = [(r.urlkey, r.timestamp, r.page_id or -1) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(-1, "response", None, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "revisit", 2, 4), (6, "response", None, len(trick)), (7, "response", None, len(trick) + 5), (8, "response", None, 100_000)]
    assert all(r.payload_digest == warc.payload_digest((dict((i, h) for i, _, h in rows).get(r.page_id) or "").encode()) for r in got)
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_warc_ids(spark):
    """Beyond 2^53, with nulls in one range, over many runs; ids that are no integers are an error."""
    big = 2**53 + 1
    rows = [(None if i % 5 == 0 else big + i, f"http://a.example.com/{i % 3}", "same" if i % 2 else f"own {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = warc.archive_and_index(pages).collect()
    first = min(i for i, _, t in rows if t == "same" and i is not None)
    assert sorted(r.page_id or 0 for r in got) == sorted(i or 0 for i, *_ in rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {first} and first > 2**53
    with pytest.raises(TypeError):
        warc.archive_and_index(pages.withColumn("page_id", F.lit("x")))


def test_surt():
    assert warc.surt("https://user@WWW.Example.com:443/a?b=1") == "com,example)/a?b=1"
    assert warc.url_key("http://[bad") == "http://[bad"


@pytest.mark.parametrize("runs", [0, 1, 2, 7, 16])
def test_loser_tree(runs):
    rng = random.Random(runs)
    parts = [sorted(((str(rng.randint(0, 9)), "t", rng.choice([None, 1, 2, 3])) for _ in range(rng.randint(0, 20))), key=warc._order) for _ in range(runs)]
    assert list(warc.LoserTree([iter(p) for p in parts])) == sorted((x for p in parts for x in p), key=warc._order)


def brute(ids, x, every, k):
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
    return out


def test_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.stack(t.column("embedding").to_numpy()).astype(float)
    want, got = brute(ids, x, 50, 5), {}
    for r in ann.nearest_neighbours(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (7, [0.0, 1.0]), (8, None), (9, []), (100, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, [None, 1.0]), (None, [1.0, 1.0]), (14, [1.0, 2.0, 3.0]), (7, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("score", F.lit(1))
    got = [tuple(r) for r in ann.nearest_neighbours(d, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 50, 1.0), (50, 1, 0, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 1.0)]
    assert ann.nearest_neighbours(d.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")
    assert ann.nearest_neighbours(one).count() == 0


def test_neighbours_do_not_depend_on_lots_and_blocks(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    monkeypatch.setattr(ann, "LEAVES", 16)
    monkeypatch.setattr(ann, "LEAF_VECTORS", 10)  # more leaves than the fewest
    found = lambda: sorted(tuple(r) for r in ann.nearest_neighbours(d, query_every=10).collect())
    whole = found()
    monkeypatch.setattr(ann, "QUERIES_TOGETHER", 20)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 8)
    assert found() == whole and len(whole) == 5 * d.filter("vec_id % 10 = 0").count()


def test_captures_are_in_global_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 3)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    captures = [tuple(r) for r in warc.archive_and_index(pages).collect()]
    assert len(captures) == pages.count() and captures == sorted(captures, key=warc._order)


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(2000, 8))
    tree = ann.KMeansTree(x, leaves=40)
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and len(set(tree.assign(x))) == tree.leaves and order[0] == tree.assign(x[:1])[0]
    tree.graft({3: ann.KMeansTree(x[:200], leaves=9), 5: ann.KMeansTree(x[:50], leaves=2)})
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 40 and order[0] == tree.assign(x[:1])[0]


def test_lots():
    assert ann.dealt_lots({}) == ({}, 0) and ann.dealt_lots({2: 5, 9: 7}) == ({2: (0, 1), 9: (0, 1)}, 1)
    n = ann.QUERIES_TOGETHER
    assert ann.dealt_lots({1: n - 1, 2: 3, 3: 2 * n + 1, 4: 1}) == ({1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (5, 1)}, 6)


def test_neighbours_of_extreme_vectors(spark):
    rows = [(0, [1e200, 1.0]), (50, [1e200, 2.0]), (2, [1.0, 1e200]), (3, [3e-200, 4e-200]), (4, [5e-324, 0.0]), (5, [-1.7e308, 1.7e308])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.nearest_neighbours(d).filter("query_id = 0").orderBy("rank").collect()]
    assert [r[2] for r in got] == [4, 50, 3, 2, 5] and [r[3] for r in got] == pytest.approx([1, 1, 0.6, 0, -(0.5**0.5)])
    assert ann.cosine(np.array([3.0, 4.0]), np.array([[4.0, 3.0]]))[0] == 24 / 25


def test_recall_beyond_the_calibration_set(spark):
    """Each second vector is a query; the visits are calibrated on 128 of them, the others count."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.stack(t.column("embedding").to_numpy()).astype(float)
    want, got = brute(ids, x, 2, 5), {}
    seen = {r.vec_id for r in e.filter("vec_id % 2 = 0").orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(ann.CALIBRATION).select("vec_id").collect()}
    for r in ann.nearest_neighbours(e, query_every=2).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    found = [len(set(got[q]) & set(w)) / len(w) for q, w in want.items() if q not in seen]
    print("recall", np.mean(found), "on", len(found))
    assert len(found) > 800 and np.mean(found) >= 0.9


def test_recall_with_branches_fitted_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "TOP_LEAVES", 8)
    test_recall(spark)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
        assert kept.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    left = simhash.near_duplicates(kept).groupBy("component_id").count()
    assert left.filter("count > 1").count() <= 2  # masks change a fingerprint here and there
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4] and packed.filter("length > 4096 OR offset + length > 4096").count() == 0

    # The last three stages by brute force: all pairs of shingle sets, the library's ids of masked texts.
    model = toxicity_model(spark, SF, docs)
    before = quality.keep_good(toxicity.drop_toxic(docs, model), min_words=1).collect()
    left = {r.doc_id: quality.measures(r.text) for r in docs.collect() if model.scores(pa.array([r.text]))[0] < 0.5}
    left = {i: quality.votes(m) for i, m in left.items() if m["n_words"] and 2 * m["n_repeat_words"] <= m["n_words"]}
    patterns = sorted(Counter(left.values()).items())
    fitted = quality.fit_label_model(np.array([list(v) for v, _ in patterns]), np.array([float(n) for _, n in patterns]))
    assert {r.doc_id for r in before} == {i for i, v in left.items() if fitted.posterior(np.array([list(v)]))[0] >= 0.5}
    clean = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id").collect()
    stay = {r.doc_id for r in quality.keep_good(docs, min_words=1).collect()}
    assert sum(r.doc_id in stay for r in clean) >= 0.98 * len(clean)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in before}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids, least = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    assert {r.doc_id for r in kept.collect()} == {i for i, v in least.items() if i == v}
    forest, library = secret_scan.fit_forest(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in before:
        if least[r.doc_id] == r.doc_id:
            text = r.text
            for z, y in reversed([(z, y) for z, y, score in secret_scan.scan([text], forest)[0] if score >= 0.5]):
                text = text[:z] + secret_scan.MASK + text[y:]
            found = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
            for k in range(0, len(found), 4096):
                want[r.doc_id, k // 4096] = (k, len(found[k : k + 4096]), zlib.crc32(found[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed.collect()} == want


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_warc_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(ORACLE_SQL["op3_warc"])
    got = QUERIES["op3_warc"](spark, SF)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in got.collect())
