"""PNG: annotations in, label and grey pictures out. Eight-bit grey, RGB and RGBA without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import listed, read_bytes, write_bytes

_MARK = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3)."""
    if data[:8] != _MARK:
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    width, height, depth, color, _, _, interlace = head
    channels = {0: 1, 2: 3, 6: 4}.get(color)
    if depth != 8 or channels is None or interlace:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        above = out[y - 1].astype(np.int32) if y else np.zeros_like(line)
        if kind == 0:
            own = line
        elif kind == 2:
            own = line + above
        elif kind == 1:
            own = line.reshape(width, channels).cumsum(axis=0).ravel()
        else:
            own = np.zeros_like(line)
            for i in range(len(line)):
                left = own[i - channels] if i >= channels else 0
                corner = above[i - channels] if i >= channels else 0
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
                own[i] = (line[i] + guess) & 255
        out[y] = own & 255
    out = out.reshape(height, width, channels)
    return np.repeat(out, 3, axis=2) if channels == 1 else out[:, :, :3]


def encode(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    return _MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def label_of(r, g, b):
    """Class by the strictly dominant channel: red 0, green 1, blue 2, else -1."""
    return F.when((r > g) & (r > b), 0).when((g > r) & (g > b), 1).when((b > r) & (b > g), 2).otherwise(-1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, x, y, label)."""

    def run(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                rgb = decode(read_bytes(p))
                y, x = np.indices(rgb.shape[:2], np.int32)
                c = rgb.reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(c)), pa.array(x.ravel()), pa.array(y.ravel()), *(pa.array(c[:, k]) for k in range(3))], ["image_id", "x", "y", "r", "g", "b"])

    files = listed(path)
    pixels = spark.createDataFrame([(p,) for p in files], "path string").repartition(len(files)).mapInArrow(run, "image_id string, x int, y int, r int, g int, b int")
    return pixels.select("image_id", "x", "y", label_of(F.col("r"), F.col("g"), F.col("b")).alias("label"))


def label_colors(df: DataFrame, label: str = "label") -> DataFrame:
    """Red, green, blue for classes 0 to 2, white for others."""
    c = F.col(label)
    on = lambda k: F.when((c == k) | ~c.isin(0, 1, 2), 255).otherwise(0)
    return df.withColumns({"r": on(0), "g": on(1), "b": on(2)})


def grey(df: DataFrame, low: float, high: float) -> DataFrame:
    """v stretched between two values to 0 .. 255 in all channels."""
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("v") - low) / max(high - low, 1e-12) * 255 + 0.5))).cast("int")
    return df.withColumns({"r": v, "g": v, "b": v})


def write(df: DataFrame, path: str) -> DataFrame:
    """Images (image_id, x, y, r, g, b), each as path/<image_id>.png by one task."""

    def run(pdf):
        import pandas as pd

        name = f"{path}/{pdf['image_id'].iloc[0]}.png"
        rgb = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 3), np.uint8)
        rgb[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]]
        write_bytes(name, encode(rgb))
        return pd.DataFrame({"path": [name]})

    return df.groupBy("image_id").applyInPandas(run, "path string")
