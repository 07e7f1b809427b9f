"""Frames as PNG files, for subjects that read pictures, and back."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit picture of height, width and 1 or 3 channels, stored blue first as readers of this kind give them."""
    h, w, c = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels[:, :, ::-1].astype(np.uint8).reshape(h, w * c)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode(frames: DataFrame) -> DataFrame:
    """name, content of every frame (frame_pos, h, w, c, px): eight digits and .png. Values are rounded and clipped."""

    def of(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series) -> pd.Series:
        return pd.Series([png(np.clip(np.rint(np.asarray(p, float)), 0, 255).reshape(a, b, d)) for a, b, d, p in zip(h, w, c, px, strict=True)])

    content = F.pandas_udf(of, "binary")
    return frames.select(F.concat(F.lpad(F.col("frame_pos").cast("string"), 8, "0"), F.lit(".png")).alias("name"), content("h", "w", "c", "px").alias("content"))


def save_clip(frames: DataFrame, folder: str) -> int:
    """Write a clip of the size of a fixture anew, picture by picture, to a local folder; the number of frames."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    for old in where.glob("*.png"):
        old.unlink()
    n = 0
    for row in encode(frames).toLocalIterator():
        (where / row.name).write_bytes(row.content)
        n += 1
    return n
