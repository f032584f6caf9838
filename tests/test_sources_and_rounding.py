"""Exact rounding, the SQLite history, images as they arrive, dropped items and progress."""

import math
import os
import random
import shutil
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import domain as D
from folio.engine import Engine
from folio.functions import text
from folio.operators import merge, scorers
from folio.operators.classify import classify
from folio.sources import images, sqlite
from folio.sources.history import COLUMNS, History
from folio.streaming.drop_folder import watch_images


def test_rounding_is_python_s(spark):
    rng = random.Random(3)
    values = [0.0625, 0.12365, 0.12345, 0.5, 0.0, -0.0, 1.0, 0.00005, 0.00015, 2.5, 1e-300, 123.45675, -0.12365, -0.00004, 0.9999500000000001]
    values += [rng.random() for _ in range(150_000)] + [rng.uniform(-1000, 1000) for _ in range(50_000)]
    values += [k / 2**n for n in range(1, 18) for k in range(1, 2**n, max(1, 2**n // 500))]  # many of them ties
    values += [(2 * k + 1) / 20000 for k in range(10_000)] + [math.nextafter((2 * k + 1) / 20000, s) for k in range(10_000) for s in (0, 1)]
    d = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    got = d.select("v", text.rounded(F.col("v"), 4).alias("r"), text.percent(F.col("v")).alias("p"), text.percent(F.col("v"), 0).alias("w")).toPandas()
    v = got["v"].tolist()
    assert len(v) > 230_000
    assert [repr(x) for x in got["r"].abs()] == [repr(abs(round(x, 4))) for x in v]
    assert got["p"].tolist() == [f"{x:.1%}" for x in v] and got["w"].tolist() == [f"{x:.0%}" for x in v]
    odd = spark.createDataFrame([(None,), (float("inf"),), (1e300,), (float("nan"),)], "v double").select(text.rounded(F.col("v"), 4).alias("r")).collect()
    assert odd[0].r is None and odd[1].r == float("inf") and odd[2].r == 1e300 and math.isnan(odd[3].r)


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "h.db"
    kinds = {"confianca": "REAL", "miniatura": "BLOB"}
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE laudos (id INTEGER PRIMARY KEY AUTOINCREMENT, " + ", ".join(f"{c} {kinds.get(c, 'TEXT')}" for c in COLUMNS) + ")")
        rows = [(i, *[None if (i + k) % 11 == 0 and k > 2 else i / 7000 if c == "confianca" else bytes([i % 256]) if c == "miniatura" else f"{c}{i % 50}" for k, c in enumerate(COLUMNS)]) for i in range(1, 7001) if i % 13]
        db.executemany(f"INSERT INTO laudos VALUES ({', '.join('?' * (len(COLUMNS) + 1))})", rows)
    return str(path), rows


def test_sqlite_history_is_read_in_ranges(spark, database):
    path, rows = database
    d = sqlite.sqlite_history(spark, f"file://{path}")
    assert d.rdd.getNumPartitions() == 7
    assert sorted((r.id, r.miniatura and bytes(r.miniatura), *tuple(r)[1:-1]) for r in d.collect()) == sorted((r[0], r[-1], *r[1:-1]) for r in rows)
    for condition, keep in (("id BETWEEN 100 AND 300 AND motor = 'motor5'", lambda r: 100 <= r[0] <= 300 and r[3] == "motor5"), ("id IN (1, 13, 6999)", lambda r: r[0] in (1, 6999)), ("confianca > 0.9 AND arquivo < 'arquivo2'", lambda r: (r[7] or 0) > 0.9 and r[1] < "arquivo2"), ("motor IS NULL", lambda r: r[3] is None), ("id > 9000", lambda r: False)):
        assert sorted(r.id for r in d.filter(condition).select("id").collect()) == [r[0] for r in rows if keep(r)], condition
    assert d.filter("id BETWEEN 100 AND 300").rdd.getNumPartitions() == 1
    reader = sqlite.HistoryReader(path, ["id", "motor"], 4)
    left = list(reader.pushFilters([sqlite.EqualTo(("motor",), "motor5"), sqlite.LessThan(("arquivo",), "x"), sqlite.GreaterThan(("id",), 6000)]))
    assert len(left) == 1 and len(reader.partitions()) == 1 and [b.schema.names for b in reader.read(reader.partitions()[0])] == [["id", "motor"]]


def picture(value):
    return images.png(np.full((5, 7, 3), value, np.uint8))


def stub(items):
    return classify(scorers.stub_scores(items)).join(items.select("pos", F.length("imagem").alias("_n")), "pos").drop("_n")


def test_images_that_arrive_are_kept_once(spark, tmp_path):
    folder, checkpoint, h = tmp_path / "in", tmp_path / "cp", History(spark, str(tmp_path / "h"))
    folder.mkdir()
    for name in ("a.png", "b.JPG", "c.txt", "d.png"):
        (folder / name).write_bytes(b"" if name == "d.png" else picture(3))
    watch = lambda: watch_images(spark, str(folder), h, str(checkpoint), stub).awaitTermination()
    watch()
    assert sorted((r.id, r.arquivo) for r in h.rows.collect()) == [(1, "a.png"), (2, "b.JPG")]
    # As if the driver had been lost after the history's commit and before the checkpoint's.
    done = sorted(os.listdir(checkpoint / "commits"))
    for name in done:
        os.unlink(checkpoint / "commits" / name)
    for name in os.listdir(checkpoint / "commits"):
        os.unlink(checkpoint / "commits" / name)
    watch()
    assert h.total() == 2 and h.rows.count() == 2
    (folder / "e.png").write_bytes(picture(4))
    watch()
    assert sorted((r.id, r.arquivo) for r in h.rows.collect()) == [(1, "a.png"), (2, "b.JPG"), (3, "e.png")]
    shutil.rmtree(checkpoint)  # another query: all of it arrives anew
    watch()
    assert h.total() == 6


def test_items_without_a_record_are_counted(spark, tmp_path):
    rows = [(i, f"f{i}", [0.9] + [0.1 / 11] * 11) for i in range(8)]
    items = spark.createDataFrame(rows, "pos bigint, arquivo string, p array<double>")
    half = lambda i: classify(i.filter("pos % 2 = 0"))
    none = lambda i: classify(i.limit(0))
    e, told = Engine(spark, str(tmp_path / "h"), half, none), []
    for mode, left in ((merge.AUTO, 4), (merge.COMPARE, 4), (merge.ONLY_CNN, 4), (merge.ONLY_VLM, 8)):
        got, warnings = e.analyse(items, mode, progress=lambda done, known: told.append((done, known)))
        assert got.count() == 8 - left and warnings == [f"{left} items have no record and were left out"], mode
    assert told and told[-1][0] > 0 and all(0 <= a <= b for a, b in told)
    whole = Engine(spark, str(tmp_path / "w"), classify, none)
    assert whole.analyse(items)[1] == [] and whole.analyse(items.limit(0))[1] == [] and whole.history.total() == 8
    assert e.analyse(items, merge.AUTO, keep=False)[1] == ["4 items have no record and were left out"]
    assert D.CNN in {r.motor for r in e.history.rows.collect()}
