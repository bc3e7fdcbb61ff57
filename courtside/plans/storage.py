"""Where intermediate results go: the checkpoint folder the cluster shares."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a folder of this machine in local mode, as in tests; an error on a cluster.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoints go to :func:`shared_folder`, unless the context has a folder already."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: it is computed once and outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to compressed columns in the shared folder and read it from there.

    Wide rows whose values repeat take a small part of what a checkpoint does. The folder stays until its owner clears it.
    """
    path = posixpath.join(shared_folder(df.sparkSession), f"rows-{uuid.uuid4().hex}")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, dealt_by: str, make: Callable[[DataFrame], DataFrame], key: str, *order: str) -> DataFrame:
    """:func:`written`, in buckets by the hash of ``key``, so that nothing that is grouped or joined by the key is shuffled again.

    Rows are shuffled by ``dealt_by``, which ``make`` calls ``key`` where they have met. Only a table of the catalog is read
    by its buckets; its name is taken back at once, its files stay.
    """
    spark, name = df.sparkSession, f"rows_{uuid.uuid4().hex}"
    buckets = partitions(spark)
    path = posixpath.join(shared_folder(spark), name)
    make(df.repartition(buckets, dealt_by)).write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).option("compression", "zstd").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _weight(df: DataFrame) -> Column:
    """Bytes of a row, about: of texts their length, of numbers eight, of anything nested its length as JSON and eight."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        size = F.octet_length(c) if isinstance(f.dataType, (StringType, BinaryType)) else F.octet_length(F.to_json(F.struct(c))) if nested else F.lit(0)
        parts.append(F.coalesce(size, F.lit(0)) + 8)
    return sum(parts, F.lit(0))


def small_side(df: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, counted and weighed: marked for broadcast if it has ``most_rows`` rows and ``most_bytes`` bytes at most, else as it is, so that the join shuffles.

    What has too many rows is not weighed.
    """
    kept = saved(df)
    if kept.count() > most_rows:
        return kept
    size = kept.agg(F.coalesce(F.sum(_weight(kept)), F.lit(0))).first()[0]
    return F.broadcast(kept) if size <= most_bytes else kept


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
