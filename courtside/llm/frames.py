"""Small helpers that the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from courtside.plans.storage import saved


def quoted(names: list[str]) -> list[Column]:
    """The columns of these names, dots in them and all."""
    return [F.col(f"`{n}`") for n in names]


def with_fields(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The schema of the columns ``keep`` of ``df``, whatever their names, followed by the fields of ``ddl``."""
    kept = df.select(*quoted(keep)).schema.fields if keep else []
    return StructType([*kept, *_parse_datatype_string(f"struct<{ddl}>").fields])


#: Rows and bytes in an Arrow batch of texts, by the session's settings and their defaults.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20))


def map_texts(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches that stay small however long the texts are.

    A session that has limits of its own keeps them.
    """
    conf = df.sparkSession.conf
    for key, default, limit in BATCHES:
        if int(re.sub(r"\D", "", conf.get(key))) == default:
            conf.set(key, str(limit))
    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: str, most: int, rows: int, salt: int = 7) -> DataFrame:
    """All of ``df`` if its ``rows`` are ``most`` or fewer, else the rows whose key hashes below the share that makes about
    ``most`` (within a few per cent for thousands): the same rows in every run, without a sort or a gathering task. A sample
    of a sample needs another ``salt``."""
    whole = 1 << 30
    return df if rows <= most else df.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(whole)) < int(whole * most / rows))


def one_row_each(df: DataFrame, id_col: str, digest: Column, decided: DataFrame, order: Column) -> DataFrame:
    """The rows of ``df`` whose id and digest ``decided (id, digest, kept, copies)`` keeps, one of each: the largest by ``order``, then by the hash of the row's columns as JSON.

    Ids compare null-safe. Rows that ``decided`` keeps and has one copy of are not gathered by key.
    """
    marked = df.withColumn("__digest", digest)
    aside = saved(decided.where("not kept or copies > 1").select(F.col("id").alias("__id"), F.col("digest").alias("__of"), "kept"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of"))
    rest = marked.join(aside, same, "left_anti").select(*quoted(df.columns))
    again = aside.where("kept")
    if again.isEmpty():
        return rest
    whole = F.struct(*quoted(df.columns))
    row = F.max_by(whole, F.struct(order.alias("o"), F.xxhash64(F.to_json(whole)).alias("h"))).alias("__row")
    return rest.unionByName(marked.join(again, same, "left_semi").groupBy(id_col, "__digest").agg(row).select("__row.*"))
