"""Keyed tables (S07, S16): rows laid out by the hash of their key, so that an upsert rewrites the touched buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from courtside.plans.storage import saved

BUCKET = "key_bucket"


def open_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 256) -> tuple[list[str], int]:
    """``(keys, number of buckets)`` of a keyed table; it is made if it is not there, and else keeps what it was made with.

    Take as many buckets as make a bucket fit a task at the size the table is to have.
    """
    spark.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.mode("ignore").parquet(f"{path}/layout")
    spark.createDataFrame([], StructType([*schema.fields, StructField(BUCKET, IntegerType())])).write.mode("append").partitionBy(BUCKET).parquet(f"{path}/rows")
    made = spark.read.parquet(f"{path}/layout").first()
    return list(made["keys"]), made["buckets"]


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(f"{path}/rows")


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a keyed table."""
    return _rows(spark, path, schema).drop(BUCKET)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def lookup(spark: SparkSession, path: str, schema: StructType, **key) -> DataFrame:
    """The row of one key, which stands in one bucket: no other one's files are read."""
    keys, buckets = open_table(spark, path, schema, list(key))
    if {*keys} != {*key}:
        raise ValueError(f"the table's key is {keys}")
    types = {f.name: f.dataType for f in schema.fields}
    values = [F.lit(key[k]).cast(types[k]) for k in keys]
    at = spark.range(1).select(F.pmod(F.xxhash64(*values), F.lit(buckets)).alias("b")).first().b
    rows = _rows(spark, path, schema).where(F.col(BUCKET) == at)
    for k, v in zip(keys, values):
        rows = rows.where(F.col(k) == v)
    return rows.drop(BUCKET)


def upsert(new: DataFrame, path: str, keys: list[str], newest_by: str, buckets: int = 256) -> None:
    """The new rows replace those of the same key; of several new ones of a key the latest stays, rows without a full key are left out.

    Only the buckets that the new rows touch are read and written again (dynamic partition overwrite); files of the
    others stay. The result is written to the checkpoint folder first, so a lost executor or a failed write never reads
    a bucket that is half replaced, and doing an upsert again changes nothing. One writer at a time.
    """
    spark, schema = new.sparkSession, new.schema
    keys, buckets = open_table(spark, path, schema, keys, buckets)
    known = new
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    latest = F.max_by(F.struct(*schema.fieldNames()), F.struct(newest_by, F.xxhash64(*schema.fieldNames()))).alias("row")
    fresh = saved(known.groupBy(*keys).agg(latest).select("row.*").withColumn(BUCKET, bucket_of(keys, buckets)))
    touched = [b for (b,) in fresh.select(BUCKET).distinct().collect()]  # numbers of buckets
    old = _rows(spark, path, schema).where(F.col(BUCKET).isin(touched))
    both = saved(old.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh))
    both.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/rows")
