"""What the operators share: staged tables in the cluster's shared folder, and the ASCII word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
#: ``bytes.split()`` cuts at exactly these six characters.
ASCII_SPACE = "\\x20\\x09-\\x0D"

#: Sorts after every document that has an id.
NO_ID = (1 << 63) - 1

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it (tests); there a temporary folder is made once.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="waybill-")
    return _local_dir


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a lost executor
    costs a reread and never a recomputation, and several consumers share one computation."""
    return staged(df, label)[0]


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`stage_table`, with the path, for tables that are dropped before the query ends."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def append_table(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to a table of the shared folder."""
    df.write.mode("append").parquet(path)


def own_dir(spark: SparkSession) -> str:
    """The staged tables of one application lie together."""
    return f"{shared_dir(spark)}/waybill/{spark.sparkContext.applicationId}"


def drop_all(spark: SparkSession) -> None:
    """Delete every staged table of this application, once the results that read them are written. Operators drop
    what they alone read; what their lazy results read stays until this is called."""
    drop_staged(spark, own_dir(spark))


def quoted(names: list[str]) -> list[str]:
    """Column names as ``select`` takes them, dots and backticks included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no live plan reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
