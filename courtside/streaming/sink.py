"""A sink of micro-batches that may come again (X01, X02): a folder for each epoch of a stream, and a manifest.

Rows of an epoch go to a folder of its own, which a repeated epoch overwrites; one entry in the manifest, written last,
makes them visible. A crash at any time leaves an epoch that is whole or not there, so what :func:`committed` returns has
each epoch once. A stream is known by the id that its checkpoint keeps, so that one with a new checkpoint does not take
an old one's epochs for its own. One stream at a time writes to a target.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from courtside.plans.storage import remove, saved

RUN, EPOCH, DAY = "ingest_run", "ingest_epoch", "ingest_day"
MANIFEST = f"n bigint, replaces array<struct<{RUN}: string, {EPOCH}: bigint>>, {RUN} string, {EPOCH} bigint"


def _data(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(RUN, StringType()), StructField(EPOCH, LongType()), StructField(DAY, DateType())])).parquet(f"{target}/data")


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The epochs that are whole: ``(n, replaces, run, epoch)``."""
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def create(spark: SparkSession, target: str, schema: StructType) -> None:
    """Make the folders of an empty target; one that is there stays as it is."""
    empty = StructType([*schema.fields, StructField(DAY, DateType())])
    spark.createDataFrame([], empty).write.mode("append").partitionBy(DAY).parquet(f"{target}/data")
    spark.createDataFrame([], MANIFEST).write.mode("append").partitionBy(RUN, EPOCH).parquet(f"{target}/manifest")


def committed(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of all whole epochs, with their run, epoch and day; folders of others are not read."""
    entries = manifest(spark, target)
    replaced = entries.select(F.inline("replaces"))
    live = entries.select(RUN, EPOCH).join(replaced, [RUN, EPOCH], "left_anti")
    return _data(spark, target, schema).join(F.broadcast(live), [RUN, EPOCH], "left_semi")  # a row an epoch


def _commit(rows: DataFrame, target: str, run: str, epoch: int, replaces: DataFrame) -> None:
    spark, at = rows.sparkSession, f"{RUN}={run}/{EPOCH}={epoch}"
    # hot days are split, small ones share a task
    rows.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(f"{target}/data/{at}")
    n = spark.read.schema(rows.schema).parquet(f"{target}/data/{at}").count()
    replaces.select(F.lit(n).cast("bigint").alias("n"), "replaces").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{at}")  # one row by one row


def _replacing(entries: DataFrame) -> DataFrame:
    return entries.agg(F.collect_list(F.struct(RUN, EPOCH)).alias("replaces"))


def write_epoch(batch: DataFrame, epoch: int, target: str, day: Column, rows: Callable[[DataFrame], DataFrame]) -> None:
    """Commit ``rows(batch)`` as an epoch of the running stream, unless it is committed already; ``day`` is the partition of a row."""
    spark = batch.sparkSession
    run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if manifest(spark, target).where((F.col(RUN) == run) & (F.col(EPOCH) == epoch)).isEmpty():
        _commit(rows(batch).withColumn(DAY, day), target, run, epoch, _replacing(manifest(spark, target).where("false")))


def compact(spark: SparkSession, target: str, schema: StructType) -> None:
    """Lay all whole epochs together in few files a day, in one step of the manifest; then delete the folders they came from."""
    entries = saved(manifest(spark, target))
    kept = committed(spark, target, schema).select(*schema.fieldNames(), DAY)
    _commit(kept, target, f"compact-{uuid.uuid4().hex}", 0, _replacing(entries))
    for e in entries.select(RUN, EPOCH).collect():  # a row an epoch
        remove(spark, f"{target}/data/{RUN}={e[RUN]}/{EPOCH}={e[EPOCH]}")
