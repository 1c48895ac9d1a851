"""Helpers on plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import shared_path


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    The optimiser copies an ordinary column's expression into every filter and column that uses it; it does not look
    through a generator, so what follows refers to the value."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows starts from there."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: str, out: str = "rank") -> DataFrame:
    """``df``, stored, with the place of each row in the order of column ``order``, from 1.

    Rows are dealt by ranges and sorted in their tasks; only the number of rows of each task is added up in one place."""
    dealt = df.repartitionByRange(order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id()
    dealt = stored(dealt.withColumn("_task", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    tasks = dealt.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1))  # a row a task
    tasks = tasks.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(tasks, "_task").withColumn(out, F.col("_before") + F.col("_at") + 1).select(*df.columns, out)
