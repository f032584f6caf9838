"""The remote engine: what it is sent, when it is asked, and what a job that was killed leaves."""

import base64
import os
import time

import fake_engine
import pytest
from pyspark.sql import functions as F

from folio import cli
from folio.operators import merge, remote
from folio.operators.remote import AnswerStore, Pace, RemoteEngine, Refused, Request
from folio.sources import images


@pytest.fixture(autouse=True)
def shipped(spark):
    spark.sparkContext.addPyFile(fake_engine.__file__)


def items(spark, n, same=0):
    rows = [(i, f"f{i}", f"image {0 if i < same else i}".encode()) for i in range(n)]
    return spark.createDataFrame(rows, "pos bigint, arquivo string, imagem binary").repartition(3)


def calls(path):
    os.makedirs(path, exist_ok=True)
    return str(path)


def flaky(folder, every=3):
    """Fails every third call of a process."""
    count = [0]

    def ask(request):
        fake_engine.note(folder, request)
        count[0] += 1
        if count[0] % every == 0:
            raise ConnectionError("try again")
        return fake_engine.answer(request.arquivo)

    return ask


def test_failed_calls_are_tried_again_and_answers_asked_for_once(spark, tmp_path):
    folder = calls(tmp_path / "calls")
    engine = RemoteEngine(AnswerStore(spark, f"file://{tmp_path}/a"), flaky(folder), wait=0.01, tries=5)
    got = engine(items(spark, 20, same=4))
    assert {r.pos: r.especie for r in got.collect()} == {i: "Ef0" if i < 4 else f"Ef{i}" for i in range(20)}
    first = fake_engine.noted(folder)
    assert len({d for _, d in first}) == 17 and len(first) > 17  # 17 images, some tried again
    assert engine(items(spark, 20, same=4)).count() == 20 and fake_engine.noted(folder) == first
    other = RemoteEngine(engine.store, flaky(folder), version="2", wait=0.01, tries=5)
    assert other(items(spark, 2)).count() == 2 and len(fake_engine.noted(folder)) >= len(first) + 2


def test_a_killed_job_asks_only_for_what_is_open(spark, tmp_path):
    """The first job dies with its worker in the middle; the second asks for none of what was answered."""
    folder, died = calls(tmp_path / "calls"), tmp_path / "died"

    def deadly(request):
        if not died.exists() and len(fake_engine.noted(folder)) >= 6:
            died.write_text("x")
            os._exit(1)
        return flaky_once(request)

    seen = set()

    def flaky_once(request):
        fake_engine.note(folder, request)
        if request.arquivo.endswith("3") and request.arquivo not in seen:
            seen.add(request.arquivo)
            raise ConnectionError("try again")
        return fake_engine.answer(request.arquivo)

    store = AnswerStore(spark, str(tmp_path / "a"))
    make = lambda: RemoteEngine(store, deadly, lanes=1, in_flight=1, wait=0.01)
    with pytest.raises(Exception, match="crashed|EOF|exited|connection"):
        make()(items(spark, 15))
    answered = {r.digest for r in store.answers().collect()}
    before = len(fake_engine.noted(folder))
    assert died.exists() and 1 <= len(answered) <= 6
    assert make()(items(spark, 15)).count() == 15
    again = fake_engine.noted(folder)[before:]
    assert not {d for _, d in again} & answered
    (next((tmp_path / "a" / "lines").iterdir())).open("ab").write(b'{"digest": "cut o')  # as a kill may leave it
    assert store.answers().count() == 15 and store.compact() >= 2 and store.answers().count() == 15
    assert make()(items(spark, 15)).count() == 15 and len(fake_engine.noted(folder)) == before + len(again)


def test_errors_make_the_engine_unavailable_or_leave_items_out(spark, tmp_path):
    folder = calls(tmp_path / "calls")

    def ask(request):
        fake_engine.note(folder, request)
        if request.arquivo == "f1":
            raise Refused("invalid key")
        return fake_engine.answer(request.arquivo) | ({"condicao": "?"} if request.arquivo == "f2" else {})

    store = AnswerStore(spark, str(tmp_path / "a"))
    with pytest.raises(merge.EngineUnavailable, match="invalid key|form that was asked"):
        RemoteEngine(store, ask, wait=0.01)(items(spark, 4))
    asked = [n for n, _ in fake_engine.noted(folder)]
    assert asked.count("f1") == 1 and asked.count("f2") == 3 and asked.count("f0") == 1
    got = RemoteEngine(store, ask, wait=0.01, partial_ok=True)(items(spark, 4))
    assert sorted(r.arquivo for r in got.collect()) == ["f0", "f3"] and [n for n, _ in fake_engine.noted(folder)].count("f0") == 1


def test_requests_and_the_form_of_answers():
    r = Request("a", b"\xff\xd8x", "look")
    assert base64.b64decode(r.base64) == b"\xff\xd8x" and r.mime == "image/jpeg" and Request("a", b"\x89PNG", "").mime == "image/png"
    assert set(r.schema["required"]) == set(r.schema["properties"]) and r.schema["properties"]["confianca"]["enum"]
    with pytest.raises(ValueError):
        remote.checked(fake_engine.answer("x") | {"e_planta": "yes"})
    with pytest.raises(ValueError):
        remote.checked("no json")


def test_the_rate_is_shared(spark, tmp_path):
    pace, began = Pace(0.05), time.monotonic()
    for _ in range(5):
        pace.wait()
    assert time.monotonic() - began >= 0.2
    folder = calls(tmp_path / "calls")
    engine = RemoteEngine(AnswerStore(spark, str(tmp_path / "a")), flaky(folder, 99), lanes=2, per_minute=600)
    began = time.monotonic()
    assert engine(items(spark, 20)).count() == 20
    assert time.monotonic() - began >= 20 / 10 - 0.6


def test_names_without_images(spark, tmp_path):
    folder = calls(tmp_path / "calls")
    engine = RemoteEngine(AnswerStore(spark, str(tmp_path / "a")), flaky(folder, 99))
    assert engine(items(spark, 3).drop("imagem")).count() == 3 and engine(items(spark, 3).limit(0)).count() == 0


def test_command_line_asks_the_remote_engine(spark, tmp_path, capsys, monkeypatch):
    import numpy as np

    folder = tmp_path / "photos"
    folder.mkdir()
    for k, name in enumerate(("a.png", "b.png", "c.png")):
        (folder / name).write_bytes(images.png(np.full((6, 9, 3), 40 * min(k, 1), np.uint8)))
    monkeypatch.setenv("FAKE_ENGINE_CALLS", calls(tmp_path / "calls"))
    args = [str(folder), "--motor", "vlm", "--vlm", "fake_engine:always", "--respostas", str(tmp_path / "answers"), "--saida", str(tmp_path / "o")]
    monkeypatch.setattr("fake_engine.always", lambda r, note=fake_engine.note, answer=fake_engine.answer, to=str(tmp_path / "calls"): (note(to, r), answer(r.arquivo))[1])
    for _ in range(2):
        assert cli.main(args) == 0
    assert "'do_vlm': 3" in capsys.readouterr().out
    assert len(fake_engine.noted(tmp_path / "calls")) == 2  # two of the pictures are the same; the second time none
    assert cli.main([str(tmp_path / "none"), "--motor", "comparacao", "--saida", str(tmp_path / "o")]) == 1
