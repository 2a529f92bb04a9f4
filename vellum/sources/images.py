"""Page images as rows: bytes, digest, pixels; EXIF orientation and size limits; errors as a column."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.kernels import image as I
from vellum.model import IMAGE_SUFFIXES
from vellum.session import prepared


class ImageError(ValueError):
    """A file that is missing or cannot be decoded."""


def exif_orientation(data: bytes) -> int:
    """Tag 0x0112 of a JPEG, or 1."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0":
            t = part[6:]
            e = "<" if t[:2] == b"II" else ">"
            try:
                first = struct.unpack(e + "I", t[4:8])[0]
                for k in range(struct.unpack(e + "H", t[first : first + 2])[0]):
                    tag, _, _, value = struct.unpack(e + "HHI4s", t[first + 2 + 12 * k : first + 14 + 12 * k])
                    if tag == 0x0112:
                        return struct.unpack(e + "H", value[:2])[0]
            except struct.error:
                return 1
        at += 2 + size
    return 1


def upright(img: np.ndarray, orientation: int) -> np.ndarray:
    """The eight EXIF orientations undone."""
    turns, flip = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}.get(orientation, (0, False))
    out = np.rot90(img, turns)
    return np.ascontiguousarray(out[:, ::-1] if flip else out)


def png(img: np.ndarray) -> bytes:
    """BGR, BGRA or grey pixels as PNG."""
    if img.ndim == 2:
        kind, rows = 0, img[..., None]
    else:
        kind, rows = (2, img[..., ::-1]) if img.shape[2] == 3 else (6, img[..., [2, 1, 0, 3]])
    h, w = rows.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, -1)], 1).tobytes()
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a path, recursively, by suffix in any case: path, sha256, content, length."""
    all_ = prepared(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = all_.where(F.lower("path").rlike(f"[.]({'|'.join(IMAGE_SUFFIXES)})$"))
    return named.select("path", F.sha2("content", 256).alias("sha256"), "content", "length")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """What the JVM decodes (JPEG, PNG, BMP, GIF): path, height, width, n_channels, data; what it cannot is missing here."""
    img = prepared(spark).read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return img.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Three channels of BGR from any the source gives."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[..., :3]


def _same(path):
    """The two sources write a local file's scheme with one slash or with three."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


LOADED = "path string, sha256 string, width_px int, height_px int, scale double, data binary, warnings array<string>, error string"


def load(spark: SparkSession, path: str, max_side: int = 5000) -> DataFrame:
    """One row for each image file: upright BGR pixels within max_side, with the size before shrinking; undecodable files carry an error."""
    raw = files(spark, path).drop("length").join(pixels(spark, path).withColumnRenamed("path", "image_path"), _same(F.col("path")) == _same(F.col("image_path")), "left")

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            out = []
            for r in f.itertuples():
                row = {"path": r.path, "sha256": r.sha256, "width_px": None, "height_px": None, "scale": None, "data": None, "warnings": [], "error": None}
                if r.data is None or r.height != r.height:
                    row["error"] = "cannot decode image"
                else:
                    img = upright(decoded(int(r.height), int(r.width), int(r.n_channels), r.data), exif_orientation(r.content))
                    h, w = img.shape[:2]
                    small, k = I.fitted(img, max_side)
                    row.update(width_px=w, height_px=h, scale=k, data=png(small), warnings=[f"image downscaled to {max_side}px"] if k < 1 else [])
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOADED.split(", ")], dtype=object)

    return raw.mapInPandas(run, LOADED)


def from_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG that `png` wrote."""
    at, parts, head = 8, [], None
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + n
    w, h, _, kind = head[:4]
    c = {0: 1, 2: 3, 6: 4}[kind]
    x = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * c)[:, 1:].reshape(h, w, c)
    return x[..., 0] if c == 1 else np.ascontiguousarray(x[..., ::-1]) if c == 3 else np.ascontiguousarray(x[..., [2, 1, 0, 3]])
