"""Image stages: decoding by Spark's image source, normalising to PNG, descriptions and vectors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Protocol

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, clean_name, clean_path, scaled_size
from .models import Generator, clean_ocr, each_row, generated

EXPLAIN = "Describe the image in a few sentences."
READ = "Write down all text that can be read in the image."


class ImageEmbedder(Protocol):
    def embed_images(self, images: list[bytes]) -> np.ndarray: ...


class HashImageEmbedder:
    """Vectors from the bytes; equal files, equal vectors."""

    def __init__(self, size: int = 32) -> None:
        self.size = size

    def embed_images(self, images):
        seeds = [int.from_bytes(hashlib.blake2b(i, digest_size=8).digest(), "little") for i in images]
        return np.array([np.random.default_rng(s).standard_normal(self.size) for s in seeds], np.float32).reshape(len(images), self.size)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(`path`, `width`, `height`, `channels`, `data`, `error`) of all files; one that is no image (or an SVG, which
    the JVM can't draw) has null pixels and an error. Pixels go row by row, blue first."""
    read = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    good = F.col("height") > 0
    return read.select(
        F.col("origin").alias("path"),
        *(F.when(good, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))),
        F.when(~good, "not an image").alias("error"),
    )


def resized(pixels: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """Pixels (rows, columns, channels) at another size, by windowed sinc in each direction."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(1.0, old / new)
        x = ((np.arange(old) + 0.5)[None, :] - (np.arange(new) + 0.5)[:, None] * old / new) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        return w / w.sum(1, keepdims=True)

    rows, columns = weights(pixels.shape[0], height), weights(pixels.shape[1], width)
    tall = np.tensordot(rows, pixels.astype(np.float64), (1, 0))
    return np.clip(np.rint(np.tensordot(columns, tall, (1, 1)).transpose(1, 0, 2)), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def normalised(images: DataFrame, pixels: int = 512 * 512) -> DataFrame:
    """(`image`, `content`, `error`): decoded images as RGB PNG files of at most `pixels`, under their cleaned name."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):  # one by one: a batch of results can be large
                content, error = None, r.error
                if error is None:
                    try:
                        raw = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                        rgb = raw[:, :, 2::-1] if raw.shape[2] > 1 else raw.repeat(3, 2)
                        content = png(rgb if (r.new_width, r.new_height) == (r.width, r.height) else resized(rgb, int(r.new_width), int(r.new_height)))
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"image": [r.image], "content": [content], "error": [error]})

    size = scaled_size(F.col("width"), F.col("height"), pixels)
    named = images.withColumn("image", F.concat(clean_name(basename(F.col("path"))), F.lit(".png"))).withColumn("_s", size)
    return named.select("*", F.col("_s.width").alias("new_width"), F.col("_s.height").alias("new_height")).drop("_s", "path").mapInPandas(
        rows, "image string, content binary, error string"
    )


def described(images: DataFrame, generator: Generator, explain: str = EXPLAIN, read: str = READ) -> DataFrame:
    """(`image`, `explanation`, `ocr`, `error`) from `path`: two calls for each image; a failed one is its error."""
    one = F.array("path")
    asked = images.select("path").withColumn("_e", generated(generator, F.lit(explain), one)).withColumn("_o", generated(generator, F.lit(read), one))
    return asked.select(clean_path(F.col("path")).alias("image"), F.col("_e.text").alias("explanation"), F.col("_o.text").alias("ocr"), F.coalesce("_e.error", "_o.error").alias("error"))


def metadata(descriptions: DataFrame, detections: DataFrame) -> DataFrame:
    """Descriptions with the OCR text cleaned and the boxes, none being an empty list."""
    boxes = detections.where("bboxes is not null").select("image", "bboxes").dropDuplicates(["image"])
    rows = descriptions.select("image", "explanation", clean_ocr(F.col("ocr")).alias("ocr")).join(boxes, "image", "left")
    return rows.withColumn("bboxes", F.coalesce("bboxes", F.array().cast("array<array<int>>")))


def image_vectors(images: DataFrame, model: ImageEmbedder, batch: int = 16) -> DataFrame:
    """(`image`, `stem`, `vector`, `error`) from `image`, `stem`, `content`: vectors of length one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                files = [bytes(c) for c in part["content"]]
                made, errors = each_row(lambda ks: list(model.embed_images([files[k] for k in ks])), list(range(len(files))))  # noqa: B023
                unit = [made[k] / (np.linalg.norm(made[k]) or 1) if k in made else None for k in range(len(files))]
                yield pd.DataFrame({"image": part["image"], "stem": part["stem"], "vector": unit, "error": [errors.get(k) for k in range(len(files))]})

    return images.select("image", "stem", "content").mapInPandas(rows, "image string, stem string, vector array<float>, error string")


def reference_vectors(files: DataFrame, titles: DataFrame, model: ImageEmbedder) -> DataFrame:
    """(`ref_id`, `vector`, `error`): the files (`image`, `stem`, `content`) that are named like an image id of `titles`."""
    wanted = titles.select(F.explode("image").alias("stem")).distinct()
    return image_vectors(files.join(wanted, "stem", "left_semi"), model).select(F.col("stem").alias("ref_id"), "vector", "error")
