"""Image preparation and folders of images to records, on files made here."""

import base64
import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import cli, domain as D
from folio.operators import scorers
from folio.sources import files, images
from tiny_onnx import write_model

RED, GREEN = [200, 10, 20], [5, 250, 30]


def flat(colour, height=5, width=9):
    return np.tile(np.array(colour, np.uint8), (height, width, 1))


def jpeg(spark, path, orientation=None, width=32, height=16):
    """A JPEG made by the JVM: left half red, right half green; with an EXIF orientation."""
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(width, height, 1)
    for x in range(width):
        for y in range(height):
            picture.setRGB(x, y, 0xC80A14 if x < width // 2 else 0x05FA1E)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(path)))
    if orientation:
        tiff = b"MM\x00*\x00\x00\x00\x08\x00\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0) + b"\x00\x00\x00\x00"
        body = b"Exif\x00\x00" + tiff
        raw = path.read_bytes()
        path.write_bytes(raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[2:])


def test_resize_keeps_flat_colours_and_means():
    assert np.allclose(images.resized(np.full((10, 7, 3), 93, np.uint8)), 93)
    noise = np.random.default_rng(0).integers(0, 256, (448, 448, 3))
    assert abs(images.resized(noise).mean() - noise.mean()) < 0.5
    assert images.fitted_size(2000, 1000, 480) == (480, 240) and images.fitted_size(100, 50, 480) == (100, 50)
    assert images.rescaled(np.array([0, 127.5, 255], np.float32)).tolist() == [-1, 0, 1]


def test_model_inputs(spark, tmp_path):
    (tmp_path / "red.png").write_bytes(images.png(flat(RED)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG nothing")
    got = {r.arquivo: r.tensor for r in images.model_inputs(images.decoded(spark, str(tmp_path))).collect()}
    assert got["bad.png"] is None
    assert np.allclose(np.frombuffer(got["red.png"], np.float32).reshape(224, 224, 3), RED)


@pytest.mark.parametrize("how", range(1, 9))
def test_orientations_bring_the_corner_back(how):
    """Each orientation, as EXIF defines it, of a picture whose upright form is known."""
    upright = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    turned = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.transpose(1, 0, 2), 6: np.rot90(upright, 1), 7: upright[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(upright, -1)}
    assert (images.upright(turned[how], how) == upright).all()


def test_orientation_of_files(spark, tmp_path):
    jpeg(spark, tmp_path / "a.jpg", 6)
    jpeg(spark, tmp_path / "b.jpg")
    (tmp_path / "c.png").write_bytes(images.png(flat(RED)))
    d = images.decoded(spark, str(tmp_path))
    assert {r.arquivo: r.orientacao for r in d.select("arquivo", "orientacao").collect()} == {"a.jpg": 6, "b.jpg": 1, "c.png": 1}
    pixels = {r.arquivo: np.frombuffer(r.tensor, np.float32).reshape(8, 8, 3) for r in images.model_inputs(d, 8).collect()}
    near = lambda x, colour: np.abs(x - colour).max() < 40
    assert near(pixels["b.jpg"][4, 0], RED) and near(pixels["b.jpg"][4, 7], GREEN)
    assert near(pixels["a.jpg"][0, 4], RED) and near(pixels["a.jpg"][7, 4], GREEN)  # turned right
    assert [images.orientation(x) for x in (None, b"", b"\xff\xd8\xff\xe1\x00\x10Exif\x00\x00MM\x00*", b"\xff\xd8\xff\xe1\x00\x10Exif\x00\x00xx\x00*\x00\x00")] == [1] * 4


def test_pictures(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(images.png(flat(RED, 300, 600)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG nothing")
    d = images.decoded(spark, str(tmp_path))
    small = {r.arquivo: r.imagem for r in images.pictures(d, 100).collect()}
    assert small["bad.png"] is None
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "t.png").write_bytes(small["big.png"])
    r = images.decoded(spark, str(tmp_path / "out")).first()
    assert (r.largura, r.altura) == (100, 50) and list(r.dados[:3]) == RED[::-1]
    text = images.pictures(d, images.REQUEST_SIDE, as_text=True).filter("arquivo = 'big.png'").first().imagem
    assert base64.b64decode(text) == images.png(flat(RED, 300, 600))


@pytest.fixture
def model(tmp_path):
    """Class 1 for red images, class 3 for green ones."""
    w = np.zeros((4, 4, 3, 12), np.float32)
    w[..., 0, 1], w[..., 1, 3] = 0.01, 0.01
    write_model(tmp_path / "m.onnx", w.reshape(48, 12), 4)
    return str(tmp_path / "m.onnx")


def test_onnx_scores(spark, model):
    tensor = lambda c: bytearray(flat(c, 4, 4).astype(np.float32).tobytes())
    d = spark.createDataFrame([(7, "a", tensor(RED), "x"), (8, "b", None, None)], "pos bigint, arquivo string, tensor binary, more string")
    got = scorers.onnx_scores(d, model, 4)
    assert got.columns == ["pos", "arquivo", "more", "p"]
    a, b = got.orderBy("pos").collect()
    assert (a.pos, a.more, b.p) == (7, "x", None) and int(np.argmax(a.p)) == 1 and sum(a.p) == pytest.approx(1)
    with pytest.raises(Exception, match="4 x 4 x 3"):
        scorers.onnx_scores(d.withColumn("tensor", F.lit(bytearray(b"1234"))), model, 4).collect()
    assert scorers.onnx_scores(d.limit(0), model, 4).count() == 0


def test_a_folder_of_images_becomes_records(spark, tmp_path, model, capsys):
    folder = tmp_path / "photos"
    folder.mkdir()
    (folder / "b.PNG").write_bytes(images.png(flat(RED)))
    jpeg(spark, folder / "a.jpg", width=8)
    (folder / "bad.png").write_bytes(b"\x89PNG nothing")
    (folder / "note.txt").write_text("no image")
    out = tmp_path / "out"
    assert cli.main([str(folder), "--modelo", model, "--lado", "4", "--motor", "cnn", "--saida", str(out), "--limiar", "0.3"]) == 0
    said = capsys.readouterr()
    assert "bad.png could not be decoded" in said.err and "[CNN] b.PNG" + " " * 27 in said.out
    doc = json.loads(next(out.glob("photos_*.json")).read_text(encoding="utf-8"))
    assert [r["arquivo"] for r in doc["resultados"]] == ["a.jpg", "b.PNG"] and doc["resultados"][1]["diagnostico"] == "Sarna-da-macieira"
    made = datetime.datetime.fromisoformat(doc["resultados"][0]["data_hora"])
    assert abs(datetime.datetime.now() - made) < datetime.timedelta(minutes=10)
    (tmp_path / "none").mkdir()
    assert cli.main([str(tmp_path / "none"), "--modelo", model, "--saida", str(out)]) == 1


def test_listings(spark, tmp_path):
    for path in ("Apple___healthy/1.png", "Apple___healthy/2.JPG", "Rose/3.png", "Rose/x.txt", "node_modules/m.js", "out/a.csv", "out/b.json", "out/c.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(images.png(flat(RED)))
    labelled = files.labelled_images(spark, str(tmp_path))
    assert "content" not in labelled.columns
    assert sorted((r.rotulo, r.arquivo) for r in labelled.collect()) == [("Apple___healthy", "1.png"), ("Apple___healthy", "2.JPG"), ("Rose", "3.png")]
    every = files.all_files(spark, str(tmp_path))
    assert {"Rose/x.txt", "node_modules/m.js", "out/a.csv"} <= {r.caminho for r in every.collect()}
    assert "node_modules/m.js" not in {r.caminho for r in files.package_files(every).collect()}
    assert [r.arquivo for r in files.exported_files(spark, str(tmp_path / "out")).collect()] == ["a.csv", "b.json"]
    chosen = files.listed_images(spark, [str(tmp_path / "Rose/3.png"), str(tmp_path / "Apple___healthy/2.JPG")])
    assert [r.arquivo for r in chosen.collect()] == ["2.JPG", "3.png"]
    with pytest.raises(FileNotFoundError):
        files.image_files(spark, str(tmp_path / "out"))


def test_uploads_are_set_aside_with_a_reason(spark):
    whole = images.png(flat(RED))
    good, bad = files.set_aside(files.uploads(spark, {"a.png": whole, "b.png": b"", "c.gif": b"GIF89a....", "d.png": whole[:-12], "e.jpg": b"\xff\xd8\xff\xe0" + b"x" * 30 + b"\xff\xd9"}))
    assert [r.arquivo for r in good.orderBy("pos").collect()] == ["a.png", "e.jpg"]
    assert {r.arquivo: r.motivo for r in bad.collect()} == {"b.png": "vazio", "c.gif": "nem PNG nem JPEG", "d.png": "incompleto"}
    assert D.MISSING == "—"


def test_training_pictures_are_resized_by_another_filter(spark, tmp_path):
    steep = np.zeros((64, 64, 3), np.uint8)
    steep[::4] = 255
    plain = np.array([[np.interp((k + 0.5) * 64 / 8 - 0.5, np.arange(64), steep[:, 0, 0].astype(float)) for k in range(8)]])
    assert np.allclose(images.resized(steep, 8, 8, smooth=False)[:, 0, 0], plain) and np.allclose(images.resized(steep, 8, 8)[2:6, 0, 0], 255 / 4, atol=8)
    assert np.allclose(images.resized(steep[:8, :8], 32, 32), images.resized(steep[:8, :8], 32, 32, smooth=False))  # no difference when enlarging
    (tmp_path / "a.png").write_bytes(images.png(steep))
    d = images.decoded(spark, str(tmp_path))
    a, b = (np.frombuffer(images.model_inputs(d, 8, t).first().tensor, np.float32) for t in (False, True))
    assert not np.allclose(a, b) and np.allclose(b, images.resized(steep, 8, 8, smooth=False).ravel())
