"""Rasters from files: portable any-maps are decoded here, other formats by a decoder that callers give."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "image string, width int, height int, bands int, pixels array<double>, error string"


def decode_pnm(content: bytes) -> np.ndarray:
    """A binary PGM or PPM file as an array of bands x height x width."""
    fields, at = [], 0
    while len(fields) < 4:
        if at >= len(content):
            raise ValueError("the header ends early")
        end = at
        while content[end : end + 1] not in (b" ", b"\n", b"\t", b"\r", b""):
            end += 1
        word = content[at:end]
        if word.startswith(b"#"):
            at = content.index(b"\n", at) + 1
            continue
        if word:
            fields.append(word)
        at = end + 1
    bands = {b"P5": 1, b"P6": 3}[fields[0]]
    width, height, most = map(int, fields[1:])
    values = np.frombuffer(content, np.dtype(">u2" if most > 255 else "u1"), bands * width * height, at)
    return values.reshape(height, width, bands).transpose(2, 0, 1)


def encode_pnm(pixels: np.ndarray) -> bytes:
    """A PGM or PPM file of an array of bands x height x width; a second band gets an empty third."""
    bands, height, width = pixels.shape
    if bands == 2:
        pixels = np.concatenate([pixels, np.zeros((1, height, width), pixels.dtype)])
        bands = 3
    head = f"{'P5' if bands == 1 else 'P6'}\n{width} {height}\n255\n".encode()
    return head + np.ascontiguousarray(pixels.transpose(1, 2, 0)).astype(np.uint8).tobytes()


def read_rasters(spark: SparkSession, path: str, glob: str = "*", decoder: Callable[[bytes], np.ndarray] = decode_pnm, mask: bool = False) -> DataFrame:
    """Rasters below ``path``; a mask is 1 where its first band isn't 0.  Broken files keep a row with their error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    a = decoder(content)
                    a = (a[:1] > 0).astype(float) if mask else a.astype(float)
                    rows.append((name, a.shape[2], a.shape[1], a.shape[0], a.ravel().tolist(), None))
                except Exception as error:
                    rows.append((name, None, None, None, None, f"{type(error).__name__}: {error}"))
            frame = pd.DataFrame(rows, columns=["image", "width", "height", "bands", "pixels", "error"])
            yield frame.astype({"width": "Int32", "height": "Int32", "bands": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, RASTER)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array of bands x height x width with 8 bits; a second band gets an empty third."""
    bands, height, width = pixels.shape
    if bands == 2:
        pixels, bands = np.concatenate([pixels, np.zeros((1, height, width), pixels.dtype)]), 3
    lines = np.zeros((height, 1 + width * bands), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = pixels.transpose(1, 2, 0).reshape(height, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


ENCODERS = {"png": encode_png, "pnm": encode_pnm}


def write_images(rasters: DataFrame, folder: str, extension: str = "png", suffix: str = "png") -> DataFrame:
    """Image files ``folder/<image>.<suffix>`` of rasters, by the executors; gives ``image, path, bytes`` when it is run.

    ``rasters`` has ``image, width, height, bands, pixels`` (values 0..255).  A task that runs again writes
    the same files, under their names only when they are whole.  ``folder`` must be shared.
    """
    encode = ENCODERS[extension]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for name, width, height, bands, pixels in zip(batch["image"], batch["width"], batch["height"], batch["bands"], batch["pixels"]):
                data = encode(np.clip(np.rint(np.asarray(pixels, float)), 0, 255).astype(np.uint8).reshape(bands, height, width))
                path = os.path.join(folder, f"{name}.{suffix}")
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as file:
                    file.write(data)
                os.replace(file.name, path)
                rows.append((name, path, len(data)))
            yield pd.DataFrame(rows, columns=["image", "path", "bytes"])

    return rasters.where("pixels is not null").select(F.col("image").cast("string").alias("image"), "width", "height", "bands", "pixels").mapInPandas(run, "image string, path string, bytes bigint")


def read_images(spark: SparkSession, path: str, mask: bool = False, rgb: bool = False) -> DataFrame:
    """PNG, JPEG, BMP and GIF files (8 bits a band), decoded in the JVM, as :func:`read_rasters` gives them.

    A mask is 1 where its first band isn't 0; ``rgb`` makes three bands of one.  Broken files keep a row.
    """
    held = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    # the decoder interleaves blue, green, red (and alpha)
    size, n = F.col("width") * F.col("height"), F.col("nChannels")

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, width, height, bands, data in zip(batch["origin"], batch["width"], batch["height"], batch["nChannels"], batch["data"]):
                if width <= 0:
                    rows.append((name, None, None, None, None, "not an image"))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(height, width, bands)
                a = (a[:, :, [2, 1, 0, *range(3, bands)]] if bands >= 3 else a).transpose(2, 0, 1).astype(float)
                a = (a[:1] > 0).astype(float) if mask else np.repeat(a, 3, axis=0) if rgb and bands == 1 else a
                rows.append((name, width, height, len(a), a.ravel().tolist(), None))
            frame = pd.DataFrame(rows, columns=["image", "width", "height", "bands", "pixels", "error"])
            yield frame.astype({"width": "Int32", "height": "Int32", "bands": "Int32"})

    return held.withColumn("nChannels", F.when(size > 0, n).otherwise(0)).mapInPandas(planes, RASTER)


def stacked_masks(rasters: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """One raster per ``key`` with a band per kind of mask, in the order of ``kinds``; NULL pixels where one is missing.

    ``rasters`` has ``key, kind, width, height, pixels``.
    """
    own = [F.first(F.when(F.col("kind") == k, F.col("pixels")), ignorenulls=True) for k in kinds]
    grouped = rasters.groupBy(key).agg(F.max("width").alias("width"), F.max("height").alias("height"), *[c.alias(f"_{i}") for i, c in enumerate(own)])
    return grouped.select(key, "width", "height", F.lit(len(kinds)).alias("bands"), F.concat(*[F.col(f"_{i}") for i in range(len(kinds))]).alias("pixels"))


def band_rows(rasters: DataFrame) -> DataFrame:
    """Long form ``image, band, row, col, v``."""
    rows = rasters.where("pixels is not null").select("image", "width", "height", F.posexplode("pixels").alias("i", "v"))
    size = F.col("width") * F.col("height")
    return rows.select("image", F.floor(F.col("i") / size).cast("int").alias("band"), F.floor((F.col("i") % size) / F.col("width")).cast("int").alias("row"), (F.col("i") % F.col("width")).alias("col"), "v")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-1 of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha1("content").alias("sha1"))
