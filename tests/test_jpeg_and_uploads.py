"""The JPEG encoder, read back by Spark; files in memory through the engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.engine import Engine
from folio.operators import merge, scorers
from folio.operators.classify import classify
from folio.sources import images, jpeg

Y, X = np.mgrid[0:150, 0:203]
WAVES = (127 + 120 * np.sin(X / 9)[:, :, None] * np.cos(Y / 7)[:, :, None] * np.array([1, 0.5, -1])).astype(np.uint8)


def read(spark, folder):
    rows = spark.read.format("image").load(str(folder)).select("image.*").collect()
    return {r.origin.rsplit("/", 1)[1].split(".")[0]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, 2::-1] for r in rows}


def test_jpegs_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {"waves": WAVES, "one": np.full((1, 1, 3), 77, np.uint8), "flat": np.full((17, 33, 3), [200, 30, 60], np.uint8), "slope": np.stack([X, Y, X + Y], 2).clip(0, 255).astype(np.uint8), "grey": np.repeat(rng.integers(0, 256, (40, 24, 1)), 3, 2).astype(np.uint8)}
    for name, pixels in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encoded(pixels, 85))
    got = read(spark, tmp_path)
    error = {n: np.abs(got[n].astype(int) - made[n]).mean() for n in made}
    assert all(got[n].shape == made[n].shape for n in made)
    assert error["waves"] < 2.5 and error["one"] <= 1 and error["flat"] <= 1 and error["slope"] < 1.5 and error["grey"] < 8, error
    assert len(jpeg.encoded(WAVES, 30)) < len(jpeg.encoded(WAVES, 82)) < len(jpeg.encoded(WAVES, 95)) < WAVES.size / 4


def test_quality_and_codes(spark, tmp_path):
    assert jpeg.steps(50)[0].tolist() == jpeg.LUMINANCE and jpeg.steps(100)[1].max() == 1
    (tmp_path / "a.jpg").write_bytes(jpeg.encoded(WAVES, 100))
    assert np.abs(read(spark, tmp_path)["a"].astype(int) - WAVES).mean() < 1.2
    lengths = jpeg.code_lengths(np.array([2**k for k in range(40)]))  # would be 40 bits deep
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) == 1 and lengths[jpeg._NOTHING] == max(lengths.values())
    assert jpeg._ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg._ZIGZAG) == list(range(64))


def test_thumbnails_and_requests(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(images.png(np.repeat(np.repeat(WAVES, 8, 0), 8, 1)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG")
    d = images.decoded(spark, str(tmp_path))
    small = {r.arquivo: r.miniatura for r in images.thumbnails(d).collect()}
    assert small["bad.png"] is None and bytes(small["big.png"][:2]) == b"\xff\xd8"
    (tmp_path / "out").mkdir()
    (tmp_path / "out/t.jpg").write_bytes(small["big.png"])
    (tmp_path / "out/r.jpg").write_bytes(next(r.imagem for r in images.requests(d).collect() if r.imagem))
    got = read(spark, tmp_path / "out")
    assert got["t"].shape == (355, 480, 3) and got["r"].shape == (757, 1024, 3)
    assert abs(got["t"].mean() - WAVES.mean()) < 2


def test_uploads_go_through_the_engine(spark, tmp_path):
    whole = jpeg.encoded(WAVES, 85)
    contents = {"a.jpg": whole, "b.png": images.png(WAVES), "empty.png": b"", "cut.jpg": whole[: len(whole) // 2], "text.jpg": b"hello", "broken.png": b"\x89PNG\r\n\x1a\n" + b"x" * 50 + b"IEND\xaeB`\x82"}
    engine = lambda i: classify(scorers.stub_scores(i))
    e = Engine(spark, str(tmp_path / "h"), engine, engine)
    got, warnings = e.analyse_uploads(contents, merge.ONLY_CNN)
    assert {r.arquivo: r.id_historico for r in got.collect()} == {"a.jpg": 1, "b.png": 2}
    assert sorted(w.split(":")[0] for w in warnings) == ["broken.png", "cut.jpg", "empty.png", "text.jpg"]
    (tmp_path / "out").mkdir()
    for k in (1, 2):
        (tmp_path / "out" / f"{k}.jpg").write_bytes(e.history.thumbnail(k))
    assert all(p.shape == WAVES.shape for p in read(spark, tmp_path / "out").values())
    with pytest.raises(ValueError, match="vazio"):
        e.analyse_uploads({"x.png": b""})
    seen = images.decoded_bytes(spark.createDataFrame([(7, "n", images.png(WAVES))], "pos bigint, arquivo string, content binary"))[0]
    assert seen.select("pos", "arquivo", "largura", "altura", F.length("dados")).first()[:] == (7, "n", 203, 150, WAVES.size)
