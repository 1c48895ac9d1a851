"""Reading and writing journals, directories, weather and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import midnight

OBSERVATION = "event_id string, channel_id string, occurred_at timestamp_ntz, is_alarm boolean, raw_value string"


def _all_text(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_journal_csv(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", escape: str = "\\") -> DataFrame:
    """Strict text CSV with the header ``columns`` (file name -> our name), in that order.  A ragged row or another
    header fails the job; rows are read whole, so that pruning hides no ragged one."""
    names = list(columns)
    if len(set(names)) != len(names) or len(set(columns.values())) != len(names):
        raise ValueError("duplicate column")
    first = spark.read.text(path).limit(1).first()
    header = first[0].lstrip("﻿").split(sep) if first else []
    if [h.strip('"') for h in header] != names:
        raise ValueError(f"header {header} is not {names}")
    reader = spark.read.schema(_all_text(names)).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("sep", sep)
    bad = "_broken"
    checked = reader.schema(_all_text([*names, bad])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True).option("escape", escape).csv(path)
    whole = F.when(F.col(bad).isNotNull(), F.raise_error(F.concat(F.lit("ragged row: "), F.col(bad)))).otherwise(F.col(names[0]))
    return checked.select(whole.alias(columns[names[0]]), *[F.col(n).alias(columns[n]) for n in names[1:]])


def scan_observations(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of yearly Parquet files, only the columns of an observation."""
    names = [f.name for f in T._parse_datatype_string(OBSERVATION).fields]
    return spark.read.parquet(*paths).select(*names)


def scan_directory(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """Directory CSV as text: (file name -> our name)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select(*[F.col(a).alias(b) for a, b in mapping.items()])


def scan_weather(spark: SparkSession, path: str, columns: dict[str, str], pressure_factor: float = 0.750062) -> DataFrame:
    """Weather CSV: ts and doubles; pressure is turned from hPa to mmHg."""
    rows = scan_directory(spark, path, columns)
    rows = rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.col(c).cast("double").alias(c) for c in rows.columns if c != "ts"])
    return rows.withColumn("pressure", F.col("pressure") * pressure_factor) if "pressure" in rows.columns else rows


def scan_telemetry(spark: SparkSession, path: str, sensors: list[str], id_col: str = "pump_id", ts_col: str = "timestamp", label_col: str = "fault_type") -> DataFrame:
    """Sensor CSV with the chosen columns."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(id_col), F.col(ts_col).cast("timestamp_ntz").alias("ts"), F.col(label_col), *[F.col(s).cast("double") for s in sensors])


def write_once(df: DataFrame, path: str) -> None:
    """Publish ``df`` at ``path`` only if nothing is there; a job that fails publishes nothing."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def channel_day(obs: DataFrame) -> DataFrame:
    return obs.groupBy("channel_id", midnight(F.col("occurred_at")).alias("day")).agg(
        F.count("*").alias("row_count"), F.count_if("is_alarm").alias("alarm_count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )


CHANNEL_DAY = "channel_id string, day timestamp_ntz, row_count long, alarm_count long, first_at timestamp_ntz, last_at timestamp_ntz"


def write_channel_day(obs: DataFrame, path: str, spread: int = 8) -> None:
    """Channel-day aggregates of whole days, in folders of year and date.

    The days that ``obs`` holds are written anew and all others stay, so a job that runs again, or one that corrects a few
    days, replaces what it wrote.  The channels of a day are spread over ``spread`` tasks, of a file each."""
    rows = channel_day(obs).withColumns({"year": F.year("day"), "date": F.col("day").cast("date")})
    dealt = rows.repartition("date", F.pmod(F.xxhash64("channel_id"), F.lit(spread)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "date").parquet(path)


def read_channel_day(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """What ``write_channel_day`` has written, from day ``first`` to day ``last``: only their folders are read."""
    rows = spark.read.schema(f"{CHANNEL_DAY}, year int, date date").parquet(path)
    for day, within in ((first, F.col("date") >= F.lit(first).cast("date")), (last, F.col("date") <= F.lit(last).cast("date"))):
        rows = rows.filter(within) if day else rows
    return rows.drop("year", "date")


def stream_observations(spark: SparkSession, path: str, schema: str = OBSERVATION, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
