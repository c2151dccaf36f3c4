"""Small helpers that the operators share: shared folder, size-checked joins, tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids broadcast at most: a hash table of so many bigint keys takes about 100 MB.
BROADCAST_IDS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of this machine, but only if all tasks run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        here, master = spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
        if not here and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = here.rsplit("/", 1)[0] if here else "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def give_back() -> None:
    """Returns memory that a Python worker has freed but still holds; the worker lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(df: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi, anti or left join with distinct, already written ids: broadcast when counted to be few, else a shuffled join with the same result."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, keys, how)
