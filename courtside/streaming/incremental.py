"""Structured Streaming (X01, X02): exactly-once ingest of keyed documents, and running figures of entities.

What is kept does not depend on when it comes: no watermark drops a late document, and no state is held for ever. The
target itself says what is known; only the partitions of the batch's days are asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from courtside.plans.storage import saved
from courtside.streaming import sink


def _stream(spark: SparkSession, source: str, schema: StructType, format_: str) -> DataFrame:
    return spark.readStream.schema(schema).format(format_).load(source)


def first_of_keys(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each full key, the first by an order and then by the row's hash; two rows at a time are compared, so a hot key is combined before the shuffle."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    whole = F.min_by(F.struct(*rows.columns), F.struct(*order, F.xxhash64(*rows.columns))).alias("row")
    return rows.groupBy(*keys).agg(whole).select("row.*")


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, at: str, key_keeps_day: bool = True, format_: str = "parquet") -> StreamingQuery:
    """Each document of new files once, by its key, however late it comes; documents without a key are left out.

    Of documents of one key in a batch the first by time stays; those the target has are skipped. By default a key
    belongs to one day, so that the check reads the key column of the batch's days only; with ``key_keeps_day=False`` it
    reads the key column of all days. See :mod:`courtside.streaming.sink` for repeated batches, and read the result with
    :func:`ingested`.
    """
    sink.create(spark, target, schema)
    time = F.col(at).cast("timestamp")

    def fresh(batch: DataFrame) -> DataFrame:
        rows = saved(first_of_keys(batch, [key], [time]))
        known = sink.committed(batch.sparkSession, target, schema)
        if key_keeps_day:
            days = [d for (d,) in rows.select(F.to_date(time)).distinct().collect()]  # a row a day
            known = known.where(F.col(sink.DAY).isin([d for d in days if d is not None]) | (F.col(sink.DAY).isNull() if None in days else F.lit(False)))
        return rows.join(known.select(key), key, "left_anti").select(*schema.fieldNames())

    stream = _stream(spark, source, schema, format_)
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink.write_epoch(batch, epoch, target, F.to_date(time), fresh)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """What :func:`ingest` has stored."""
    return sink.committed(spark, target, schema).select(*schema.fieldNames())


def running(df: DataFrame, key: str, value: str, at: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Count, sum, mean, least and greatest value of each entity and time window; for batches and streams alike."""
    rows = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay) if df.isStreaming else df
    grouped = rows.groupBy(F.window(at, window).alias("w"), key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return grouped.select(F.col("w.start").alias("window_start"), key, "n", "total", "mean", "least", "most")


# --- running moments --------------------------------------------------------------------------------------------------

#: What a segment keeps of each value: how many there are, their sum and squared deviations, and of their numbers within
#: the segment the sum, the sum of squares and the sum of products with the value.
MOMENTS = ("n", "sum", "m2", "x", "xx", "xy")


def segments(rows: DataFrame, keys: list[str], at: str, values: list[str], order: list[str]) -> DataFrame:
    """Mergeable moments of each entity and day, with the day's number of rows and their first and last time."""
    c, day = F.col, F.to_date(at)
    nth = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(*order)) - 1
    numbered = rows.withColumn("__day", day).withColumn("__nth", nth)
    out = []
    for v in values:
        x, y = F.when(c(v).isNotNull(), c("__nth").cast("double")), c(v).cast("double")
        sums = (F.count(v), F.sum(y), F.var_pop(y) * F.count(v), F.sum(x), F.sum(x * x), F.sum(x * y))
        out += [F.coalesce(s, F.lit(0.0) if k else F.lit(0)).alias(f"{v}_{m}") for k, (m, s) in enumerate(zip(MOMENTS, sums))]
    return numbered.groupBy(*keys, "__day").agg(F.count("*").alias("rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), *out).drop("__day")


def merged(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Games, mean, total, deviation and trend of each value of every entity, from its segments in order of their days.

    A segment's numbers count on from the segments before it, so days may come in any order; rows of one day that come
    in several batches count in the order of the batches. Deviations are merged around the common mean. The trend is the
    slope over the number of the row, 0 for fewer than three rows.
    """
    c, own = F.col, Window.partitionBy(*keys)
    before = own.orderBy("first_at", sink.RUN, sink.EPOCH).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"__o": F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("double"), **{f"{v}_mean": F.sum(f"{v}_sum").over(own) / F.nullif(F.sum(f"{v}_n").over(own), F.lit(0)) for v in values}})
    sums = [F.sum("rows").alias("games"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    for v in values:
        n, s, m2, x, xx, xy = (c(f"{v}_{m}") for m in MOMENTS)
        apart, o = s / F.nullif(n, F.lit(0)) - c(f"{v}_mean"), c("__o")
        sums += [F.sum(n).alias(f"{v}_n"), F.first(f"{v}_mean").alias(f"avg_{v}"), F.sum(s).alias(f"total_{v}"), F.sum(m2 + F.coalesce(n * apart * apart, F.lit(0.0))).alias(f"{v}_m2")]
        sums += [F.sum(x + o * n).alias(f"{v}_x"), F.sum(xx + 2 * o * x + o * o * n).alias(f"{v}_xx"), F.sum(xy + o * s).alias(f"{v}_xy")]
    out = rows.groupBy(*keys).agg(*sums)
    figures = []
    for v in values:
        n, x, xx, xy = (c(f"{v}_{m}") for m in ("n", "x", "xx", "xy"))
        slope = (n * xy - x * c(f"total_{v}")) / F.nullif(n * xx - x * x, F.lit(0.0))
        figures += [f"avg_{v}", f"total_{v}", F.sqrt(c(f"{v}_m2") / F.nullif(n, F.lit(0))).alias(f"std_{v}"), F.when(c("games") >= 3, slope).otherwise(0.0).alias(f"trend_{v}")]
    return out.select(*keys, "games", "first_at", "last_at", *figures)


def ingest_moments(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], at: str, values: list[str], order: list[str], format_: str = "parquet") -> StreamingQuery:
    """The moments of new files, added once for each batch; what the stream keeps is a row for each entity, day and batch, whatever the number of events. Read the figures with :func:`moments`."""
    stream = _stream(spark, source, schema, format_)
    sink.create(spark, target, segments(spark.createDataFrame([], schema), keys, at, values, order).schema)
    add = lambda batch, epoch: sink.write_epoch(batch, epoch, target, F.trunc("first_at", "year"), lambda b: segments(b, keys, at, values, order))
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moments(spark: SparkSession, target: str, schema: StructType, keys: list[str], at: str, values: list[str], order: list[str]) -> DataFrame:
    """The figures of every entity, from what :func:`ingest_moments` has stored."""
    kept = segments(spark.createDataFrame([], schema), keys, at, values, order).schema
    return merged(sink.committed(spark, target, kept), keys, values)
