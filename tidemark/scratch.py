"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet there and reading it back: the table survives the loss of any executor, is
columnar and compressed (``checkpoint()`` writes plain rows), and its size is known before it is used again.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and the master is local."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step", path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back.

    It is joined by sorted partitions unless it is broadcast by name: Spark would broadcast it by the bytes of its files, and these
    are compressed and know nothing of the copies that an explode makes, so rows many times larger would come to the driver.
    """
    path = path or new_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    table._tm_path = path
    _written.add(path)
    tidy(df.sparkSession)
    return table


#: Seconds between two collections of the driver's garbage, and when the last one was.
TIDY_SECONDS = 3.0
_tidied = -TIDY_SECONDS


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, unless that was done just now.

    Plans, broadcast tables and shuffle files of a step that is written stay until the driver collects, and it does so only
    when its heap has grown as far as it may: an operator of many steps would hold them all. A full collection also gives memory back.
    """
    global _tidied
    if time.monotonic() - _tidied >= TIDY_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


#: Paths written in this process that may still be there.
_written: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Delete everything that :func:`materialize` wrote in this process, when no result that depends on it is to be read any more."""
    for path in list(_written):
        remove(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these tables; nothing that is still to be read may depend on them."""
    for table in tables:
        remove(table.sparkSession, table._tm_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


#: A side is broadcast only when it was counted and holds at most so many rows, and so many bytes by Spark's estimate.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Copies of each row of the small side when it is too large to broadcast and the large side may be skewed.
SALTS = 16


def join_checked(large: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a possibly skewed ``large`` side to a materialised ``small`` side with unique keys.

    ``small`` is counted first. Up to ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast; beyond, each hot key of ``large`` is spread over
    ``SALTS`` tasks by the hash of column ``spread`` and ``small`` is repeated once per salt, and never broadcast.
    """
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES and small.limit(max_rows + 1).count() <= max_rows:
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_tm_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = small.withColumn("_tm_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [*on, "_tm_salt"], how).drop("_tm_salt")
