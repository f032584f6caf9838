"""The history under several writers, its ids, pictures and snapshots."""

import threading

import pytest
from pyspark.sql import functions as F

from folio import domain as D
from folio.engine import Engine, serialised
from folio.operators import merge
from folio.operators.classify import classify
from folio.sources.history import History

RECORD = {"arquivo": "a", "data_hora": "2024-01-01T10:00:00", "motor": D.CNN}


def many(spark, first, n, parts=5):
    d = spark.range(first, first + n, 1, parts).select(F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("arquivo"), F.lit("2024-01-01T10:00:00").alias("data_hora"), F.lit(D.CNN).alias("motor"))
    return d.orderBy(F.xxhash64("pos"))


def test_ids_are_dense_and_in_the_order_of_the_batch(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    got, first = h.save_all(many(spark, 0, 500))
    assert first == 1 and {r.pos: r.id_historico for r in got.collect()} == {i: i + 1 for i in range(500)}
    assert h.save(RECORD) == 501 and h.save_all(many(spark, 0, 3))[1] == 502
    assert [r.id for r in h.page(4).collect()] == [504, 503, 502, 501] and h.total() == 504 == h.rows.count()
    assert h.get(37)["arquivo"] == "f36" and h.get(501)["arquivo"] == "a" and h.get(505) is None
    none, first = h.save_all(many(spark, 0, 0))
    assert none.count() == 0 and first == 0 and h.save(RECORD) == 505


def test_point_lookups_read_one_file(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        h.save_all(many(spark, 0, 400))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    state = h.state()
    assert len(state.batches[0].files) == 4
    batch, file = state.file_of(250)
    assert h._read([batch], [file[0]]).inputFiles()[0].endswith(file[0]) and file[2] <= 250 <= file[3] and file[1] < 400
    assert h.get(250)["arquivo"] == "f249"


def test_several_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "h"), []
    History(spark, path)

    def write(k):
        try:
            h = History(spark, path)
            for n in range(3):
                h.save_all(many(spark, 1000 * k + 10 * n, 7, 2))
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    h = History(spark, path)
    rows = sorted((r.id, r.arquivo) for r in h.rows.collect())
    assert not failed and [i for i, _ in rows] == list(range(1, 85))
    assert sorted(a for _, a in rows) == sorted(f"f{1000 * k + 10 * n + i}" for k in range(4) for n in range(3) for i in range(7))
    for at in range(0, 84, 7):  # a batch's ids are beside each other and in its order
        names = [int(a[1:]) for _, a in rows[at : at + 7]]
        assert names == list(range(names[0], names[0] + 7))


def test_a_commit_that_another_writer_was_faster_with_is_put_again(spark, tmp_path, monkeypatch):
    h, other = History(spark, str(tmp_path / "h")), History(spark, str(tmp_path / "h"))
    h.save_all(many(spark, 0, 3))
    real, raced = h._put, []

    def slow(version, commit):
        if not raced:
            raced.append(other.save(RECORD))
        real(version, commit)

    monkeypatch.setattr(h, "_put", slow)
    assert h.save(RECORD | {"arquivo": "b"}) == 5 and raced == [4] and h.get(4)["arquivo"] == "a" and h.get(5)["arquivo"] == "b"
    raced.clear()
    assert h.delete(2) and raced == [6] and h.total() == 5


def test_deletes_clear_and_snapshots_never_use_an_id_twice(spark, tmp_path, monkeypatch):
    h = History(spark, str(tmp_path / "h"))
    h.save_all(many(spark, 0, 20))
    h.save_all(many(spark, 100, 5))
    assert h.delete(3) and h.delete(25) and not h.delete(3) and not h.delete(26)
    before = sorted(map(tuple, h.rows.collect()))
    assert h.compact() and sorted(map(tuple, h.rows.collect())) == before and h.total() == 23
    state = h.state()
    assert len(state.batches) == 1 and not state.gone and state.next_id == 26
    assert h.get(3) is None and h.get(24)["arquivo"] == "f103" and not h.delete(25) and h.delete(24)
    assert h.save(RECORD) == 26
    assert h.vacuum(older_than_hours=0) == 2 and h.total() == 23 and h.rows.count() == 23
    assert h.clear() == 23 and h.total() == 0 and h.rows.count() == 0 and h.save(RECORD) == 27
    # What others do while a snapshot is written stays; after a clear, nothing comes back.
    other, real = History(spark, str(tmp_path / "h")), h._files
    monkeypatch.setattr(h, "_files", lambda *a: (other.save(RECORD), real(*a))[1])
    assert h.compact() and sorted(r.id for r in h.rows.collect()) == [27, 28]
    monkeypatch.setattr(h, "_files", lambda *a: (other.clear(), real(*a))[1])
    assert not h.compact() and h.total() == 0 and h.rows.count() == 0


def test_batches_that_pile_up_are_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(History, "MOST_BATCHES", 3)
    monkeypatch.setattr(History, "MOST_DELETES", 1)
    h = History(spark, str(tmp_path / "h"))
    for n in range(6):
        assert h.save(RECORD | {"arquivo": str(n)}) == n + 1
    assert len(h.state().batches) <= 3 and h.delete(1) and h.delete(4)
    assert len(h.state().gone) <= 1 and sorted(r.arquivo for r in h.rows.collect()) == ["1", "2", "4", "5"]


def test_numbered_batches_are_inserted_once(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    for n, added in ((0, 4), (0, 0), (1, 4), (0, 0), (1, 0)):
        assert h.save_all(many(spark, 10 * n, 4), numbered=("drop", n))[0].count() == added
    h.compact()
    assert h.save_all(many(spark, 0, 4), numbered=("drop", 1))[1] == 0 and h.save_all(many(spark, 0, 4), numbered=("other", 0))[1] == 9


def test_required_values(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    with pytest.raises(ValueError, match="motor"):
        h.save_all(many(spark, 0, 2).drop("motor"))
    with pytest.raises(Exception, match="motor is required"):
        h.save_all(many(spark, 0, 2).withColumn("motor", F.when(F.col("pos") > 0, "x")))
    assert h.total() == 0


def test_engine_returns_ids_that_pictures_are_found_by(spark, tmp_path):
    rows = [(0, "a", [0.9] + [0.1 / 11] * 11, b"one"), (1, "b", [1 / 12] * 12, b"two"), (2, "c", [0.9] + [0.1 / 11] * 11, b"one"), (3, "d", [0.9] + [0.1 / 11] * 11, None)]
    items = spark.createDataFrame(rows, "pos bigint, arquivo string, p array<double>, miniatura binary")
    e = Engine(spark, str(tmp_path / "h"), classify, lambda i: classify(i).withColumn("motor", F.lit(D.VLM)))
    got, warnings = e.analyse(items, merge.COMPARE)
    shown = {(r.pos, r.motor): r.id_historico for r in got.collect()}
    assert not warnings and sorted(shown.values()) == list(range(1, 9))
    assert shown == {(p, m): 2 * p + k + 1 for p in range(4) for k, m in enumerate((D.CNN, D.VLM))}
    assert all(e.history.thumbnail(i) == rows[p][3] for (p, _), i in shown.items())
    assert e.history._pictures().count() == 2  # eight records, three items with a picture, two pictures
    e.analyse(items, merge.ONLY_CNN)
    assert e.history._pictures().count() == 2 and e.history.thumbnails().count() == 9
    assert got.filter("pos = 0").first().ranking[0].id_classe == "apple_healthy"
    assert '"id_historico":1' in serialised(got).orderBy("pos").first().documento
    assert not (tmp_path / "h-answers").exists() or not list((tmp_path / "h-answers").iterdir())
    with e:
        loose, _ = e.analyse(items, merge.ONLY_CNN, keep=False)
        assert loose.count() == 4 and "id_historico" not in loose.columns and e.history.total() == 12
    assert not list((tmp_path / "h-answers").iterdir())
