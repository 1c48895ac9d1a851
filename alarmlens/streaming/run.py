"""Run a stream over what is there and read the result as a table."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_path


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for streams that start inside."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    was = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def run_into(stream: DataFrame, batch: Callable[[DataFrame, int], object], mode: str = "append") -> None:
    """Give all batches of what is available now to ``batch``, however long it takes.  The state is in the folder of
    ``spark.checkpoint.dir``."""
    state = shared_path(stream.sparkSession, "stream-states")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, epoch: (batch(df, epoch), None)[1]).start()
    try:
        query.awaitTermination()  # a stream stopped before its end has written a part of its result
    finally:
        query.stop()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all data that is available now; returns the written result."""
    out = shared_path(stream.sparkSession, "streams")
    write = "overwrite" if mode == "complete" else "append"
    run_into(stream, lambda df, epoch: df.write.mode(write).parquet(out), mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_until_told(stream: DataFrame, every: str = "1 second") -> DataFrame:
    """Run a stream that speaks rarely until it has given its first rows, and return these."""
    spark, told = stream.sparkSession, threading.Event()
    state, out = shared_path(spark, "stream-states"), shared_path(spark, "streams")

    def keep(df: DataFrame, epoch: int) -> None:
        if told.is_set():
            return
        df.write.mode("append").parquet(out)
        if not spark.read.schema(stream.schema).parquet(out).isEmpty():
            told.set()

    query = stream.writeStream.option("checkpointLocation", state).trigger(processingTime=every).foreachBatch(keep).start()
    try:
        while query.isActive and not told.wait(0.2):
            pass
        if not told.is_set():
            raise RuntimeError(f"the stream ended: {query.exception()}")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)
