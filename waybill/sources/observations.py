"""Ingest of observations and the sinks of reports."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import LOADER_OUTPUT, Declaration, StreamContract


class Adapter(Protocol):
    """A subject: gives what it delivered, as data. ``calls`` are the recorded function calls of the same draws."""

    name: str

    def observe(self, spark: SparkSession, declaration: Declaration) -> DataFrame: ...

    def calls(self, spark: SparkSession, declaration: Declaration) -> DataFrame: ...


class AdapterError(RuntimeError):
    """A subject that can't be driven; its gates are skipped."""


class GeneratorReached(RuntimeError):
    """A generator was called although its output lay there beforehand."""


def observed(frames: DataFrame, subject: str, boundary: str = LOADER_OUTPUT, seed: int = 0, draw: Column | int = 0, claimed: Column | None = None, dtype: str = "uint8") -> DataFrame:
    """Frames (stream, frame_pos, h, w, c, px) as observations. A boundary is said once, here, and never changed."""
    return frames.select(
        F.lit(subject).alias("subject"), F.lit(boundary).alias("boundary"), F.lit(seed).cast("long").alias("seed"), (F.lit(draw) if isinstance(draw, int) else draw).cast("int").alias("draw"), "stream", "frame_pos",
        (claimed if claimed is not None else F.lit(None)).cast("int").alias("claimed_frame_id"), "h", "w", "c", F.lit(dtype).alias("dtype"), "px",
    )


def to_hwc(px: Column, h: Column, w: Column, c: Column) -> Column:
    """A channel-first array in height, width, channel order."""
    return F.transform(F.sequence(F.lit(0), h * w * c - 1), lambda i: F.get(px, F.pmod(i, c) * h * w + F.floor(i / c).cast("int")))


def read_images(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """A folder of pictures as frames, in order of their names. Bytes come as unsigned values, channels as stored."""
    got = spark.read.format("image").load(path).select("image.*")
    order = F.row_number().over(_by_origin())
    px = F.transform(F.regexp_extract_all(F.hex("data"), F.lit("(..)")), lambda byte: F.conv(byte, 16, 10).cast("double"))
    return got.select(F.lit(stream).alias("stream"), (order - 1).alias("frame_pos"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), px.alias("px"))


def _by_origin():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.regexp_replace("origin", "[^/]*$", "")).orderBy("origin")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Observations kept as Parquet."""
    return spark.read.parquet(path)


def contract_of_range(lo: float, hi: float, channels: int, anchors: bool = True) -> StreamContract:
    """A range whose ends are reached (``anchors``), and channels that differ where there are several."""
    return StreamContract(lo=lo, hi=hi, require_extrema=anchors, channels=channels, require_distinct=channels > 1)


# Sinks and files --------------------------------------------------------------------------------------------------


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with its header, which an empty report has too."""
    if rows.isEmpty():
        rows = rows.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns))
        rows.coalesce(1).write.mode("overwrite").csv(path, header=False)
    else:
        rows.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report read back, all columns text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """name, outcome of each line of a manifest (digest, two spaces, name) against the files: ok, changed, missing;
    files it doesn't name are unlisted."""
    lines = spark.read.text(manifest).select(F.regexp_extract("value", "^([0-9a-f]{64})  (.+)$", 1).alias("said"), F.regexp_extract("value", "^[0-9a-f]{64}  (?:.*/)?([^/]+)$", 1).alias("name")).where("said <> ''")
    both = lines.join(file_digests(spark, folder).where(F.col("name") != F.lit(Path(manifest).name)), "name", "full")
    return both.select("name", F.when(F.col("said").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("said") != F.col("sha256"), "changed").otherwise("ok").alias("outcome"))


def write_certificate(document: dict, path: str) -> None:
    """One certificate as JSON, written only if it is valid."""
    from ..plans.certificate import violations

    found = violations(document)
    if found:
        raise ValueError("; ".join(found))
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(json.dumps(document, indent=2) + "\n")
