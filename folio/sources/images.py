"""Preparing decoded images for a model, in Arrow batches.

Spark's image source decodes, and doesn't look at how a camera was held: that is read from the files'
first bytes. Pictures made here (thumbnails, what a remote engine is sent) are JPEG or PNG.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import scratch_folder
from folio.sources import jpeg
from folio.sources.tree import planted

SIDE = 224
#: Longer sides of a thumbnail, and of what a remote engine is sent.
THUMBNAIL_SIDE, REQUEST_SIDE = 480, 1024
#: And their qualities as JPEG.
THUMBNAIL_QUALITY, REQUEST_QUALITY = 82, 85
#: Bytes of a file in which its orientation is looked for.
HEAD_BYTES = 1 << 17


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, arquivo, largura, altura, canais, dados, orientacao) of the images of a folder, and with
    altura -1 what could not be decoded. dados: rows of pixels, channels in the order blue, green,
    red[, alpha]; orientacao: 1 to 8 as in EXIF, 1 where the file says nothing."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    d = spark.read.format("image").load(folder).select("image.*").withColumn("path", plain(F.col("origin")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(orientation, b.column(1).to_pylist()), pa.int32())], names=["path", "orientacao"])

    files = spark.read.format("binaryFile").load(folder).select(plain(F.col("path")).alias("path"), F.substring("content", 1, HEAD_BYTES).alias("head"))
    held = files.mapInArrow(run, "path string, orientacao int")
    columns = {"largura": "width", "altura": "height", "canais": "nChannels", "dados": "data"}
    return d.join(held, "path", "left").select("path", F.substring_index("path", "/", -1).alias("arquivo"), *[F.col(c).alias(n) for n, c in columns.items()], F.coalesce("orientacao", F.lit(1)).alias("orientacao"))


def orientation(head: bytes | None) -> int:
    """The EXIF orientation from the first bytes of a JPEG file; 1 if there is none."""
    if not head or head[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", head, at + 2)
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\x00\x00":
            return _orientation_tag(body[6:])
        at += 2 + size
    return 1


def _orientation_tag(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (first,) = struct.unpack_from(f"{order}I", tiff, 4)
        (entries,) = struct.unpack_from(f"{order}H", tiff, first)
        for i in range(entries):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * i)
            if tag == 0x0112 and kind == 3 and 1 <= value <= 8:
                return value
    except struct.error:  # cut off, or no such header
        pass
    return 1


def upright(pixels: np.ndarray, how: int) -> np.ndarray:
    """Pixels turned and mirrored as an orientation asks for."""
    if how in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if how in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if how in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def _rgb(height: int, width: int, channels: int, data: bytes, how: int) -> np.ndarray:
    pixels = upright(np.frombuffer(data, np.uint8).reshape(height, width, channels), how)
    return pixels[:, :, 2::-1] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, 2)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def pictures(images: DataFrame, most: int = THUMBNAIL_SIDE, as_text: bool = False, quality: int | None = None) -> DataFrame:
    """(path, arquivo, imagem): each decoded image upright, its longer side at most so many pixels, as
    PNG or, with a quality, as JPEG: bytes or base64 text. Images that could not be decoded have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, c, data, how in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if h is None or h <= 0 or not data:
                    out.append(None)
                    continue
                rgb = _rgb(h, w, c, data, how)
                wide, high = fitted_size(rgb.shape[1], rgb.shape[0], most)
                if (high, wide) != rgb.shape[:2]:
                    rgb = np.clip(np.rint(resized(rgb, high, wide)), 0, 255).astype(np.uint8)
                out.append(png(rgb) if quality is None else jpeg.encoded(rgb, quality))
            made = pa.array([base64.b64encode(x).decode() if x else None for x in out], pa.string()) if as_text else pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], names=["path", "arquivo", "imagem"])

    return images.select("path", "arquivo", "largura", "altura", "canais", "dados", "orientacao").mapInArrow(run, f"path string, arquivo string, imagem {'string' if as_text else 'binary'}")


def thumbnails(images: DataFrame) -> DataFrame:
    """(path, arquivo, miniatura): what the history keeps of decoded images."""
    return pictures(images, THUMBNAIL_SIDE, quality=THUMBNAIL_QUALITY).withColumnRenamed("imagem", "miniatura")


def requests(images: DataFrame) -> DataFrame:
    """(path, arquivo, imagem): what a remote engine is sent of decoded images."""
    return pictures(images, REQUEST_SIDE, quality=REQUEST_QUALITY)


def decoded_bytes(rows: DataFrame) -> tuple[DataFrame, str]:
    """(as decoded(), with pos; the folder they are read from) of rows(pos, arquivo, content): tasks write
    the contents to a scratch folder, from where Spark's image source decodes them. The folder may be
    removed when nothing reads the table any more."""
    spark = rows.sparkSession
    folder = scratch_folder(spark, "uploads")
    planted(rows.select(F.concat(F.col("pos").cast("string"), F.lit(".img")).alias("caminho"), "content"), folder, lambda r: r["content"] or b"")
    found = decoded(spark, folder).withColumn("pos", F.substring_index("arquivo", ".", 1).cast("long")).drop("arquivo")
    return found.join(rows.select("pos", "arquivo"), "pos"), folder


def _weights(size: int, wanted: int, smooth: bool = True) -> np.ndarray:
    """Triangle filter from size to wanted samples; smooth: widened when shrinking so that it averages,
    else always of the two nearest samples."""
    scale = size / wanted
    reach = max(1.0, scale) if smooth else 1.0
    centre = (np.arange(wanted)[:, None] + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(size)[None] + 0.5 - centre) / reach)
    return w / w.sum(1, keepdims=True)


def resized(pixels: np.ndarray, height: int = SIDE, width: int = SIDE, smooth: bool = True) -> np.ndarray:
    """Bilinear resize of height x width x channels to float32, values in the range they had. Training
    pictures are resized without smoothing, those to be diagnosed with it."""
    rows, columns = _weights(pixels.shape[0], height, smooth), _weights(pixels.shape[1], width, smooth)
    return np.einsum("ih,hwc,jw->ijc", rows, pixels.astype(np.float64), columns, optimize=True).astype(np.float32)


def fitted_size(width: int, height: int, most: int) -> tuple[int, int]:
    """Size with its longer side at most so many pixels, sides in proportion; never enlarged."""
    scale = min(1.0, most / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def model_inputs(images: DataFrame, side: int = SIDE, training: bool = False) -> DataFrame:
    """(path, arquivo, tensor) of decoded images: float32 red, green, blue from 0 to 255, side x side x 3,
    as bytes. Images that could not be decoded have a null tensor. For training they are as the camera
    held them, and resized without smoothing; else upright, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, c, data, how in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                there = h is not None and h > 0 and data
                out.append(resized(_rgb(h, w, c, data, 1 if training else how), side, side, not training).tobytes() if there else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["path", "arquivo", "tensor"])

    return images.select("path", "arquivo", "largura", "altura", "canais", "dados", "orientacao").mapInArrow(run, "path string, arquivo string, tensor binary")


def rescaled(tensors: np.ndarray) -> np.ndarray:
    """Values from 0..255 to -1..1, as networks of this kind expect them inside."""
    return tensors / np.float32(127.5) - np.float32(1)
