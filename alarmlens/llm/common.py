"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract does not say otherwise: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.  Where it is unset, a session in one
    process gets a temporary one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-alarmlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class _Open(threading.local):
    """For each ``settled`` that this thread is in: the paths drawn since."""

    def __init__(self):
        self.drawn: list[list[str]] = []


_open = _Open()


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the ``settled`` that it is drawn in, or when the application
    ends."""
    path = f"{shared_dir(spark)}/alarmlens/{name}-{uuid.uuid4().hex}"
    files, hadoop_path = _file_system(spark, path)
    files.deleteOnExit(hadoop_path)
    if _open.drawn:
        _open.drawn[-1].append(path)
    return path


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it ends, not when the driver's garbage is collected."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, was)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written once; the tables that were written on the way to it are deleted, and shuffle files
    job by job.

    Nothing else may read these tables: what ``make`` does not return must not leave it."""
    _open.drawn.append([])
    try:
        with _without_shuffle_files(spark):
            made = make()
            drawn = _open.drawn.pop()
            _open.drawn.append([])
            kept = materialize(made, name)
    finally:
        left = _open.drawn.pop()
        if _open.drawn:
            _open.drawn[-1] += left
    for path in drawn:
        files, hadoop_path = _file_system(spark, path)
        files.delete(hadoop_path, True)
        files.cancelDeleteOnExit(hadoop_path)
    return kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    append(df, path)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to the Parquet table at ``path``.  The shuffle files of the job are given back when it ends."""
    with _without_shuffle_files(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def numbered(df: DataFrame, name: str, col: str = "_row") -> DataFrame:
    """``df`` with a number for each row, null or repeated ids included, as a written table.

    The number of a row depends on how a scan is split, so it is drawn once and stored with the row: all that is found
    for a number must be joined with this table, never with another scan of ``df``."""
    return materialize(df.withColumn(col, F.monotonically_increasing_id()), name)


def boxed(df: DataFrame) -> DataFrame:
    """(_doc): each row as one struct, so that no name of its columns meets a name of ours; ``select("_doc.*")`` gives
    it back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))


def as_bytes(text: object) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def text_chunks(pdf: pd.DataFrame, col: str, most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Consecutive slices of about ``most`` characters, so that memory follows the slice, not the Arrow batch."""
    sizes = np.cumsum([len(x) if isinstance(x, str) else 0 for x in pdf[col]])
    cuts = np.unique(np.searchsorted(sizes, np.arange(most, (sizes[-1] if len(sizes) else 0) + most, most)) + 1)
    start = 0
    for stop in np.minimum([*cuts.tolist(), len(pdf)], len(pdf)).tolist():
        if stop > start:
            yield pdf.iloc[start:stop]
            start = stop


class BoundedCache(dict):
    """word -> make(word), forgotten as a whole beyond ``most`` words."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def fitted_in_a_task(rows: DataFrame, train: Callable[[pd.DataFrame], Any]) -> Any:
    """``train`` on a bounded sample, in one task: neither the sample nor the work comes to the driver, only the model."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pdf = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        yield pd.DataFrame({"model": [pickle.dumps(train(pdf))]})

    found = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else train(pd.DataFrame(columns=columns))
