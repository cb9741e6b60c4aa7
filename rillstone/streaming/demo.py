"""Streams made up for trying things out, and tables replayed as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .run import read_files, ticks


def range_stream(spark: SparkSession, rate: int = 1, offset: int = 0) -> DataFrame:
    """``value``: offset, offset + 1, ..."""
    return ticks(spark, rate).select((F.col("value") + offset).alias("value"))


def noisy_linear_stream(spark: SparkSession, rate: int = 1, seed: int = 0) -> DataFrame:
    """``x``: 0, 1, ...; ``y``: x plus noise between -1 and 1, the same for the same x."""
    noise = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1.0
    return ticks(spark, rate).select(F.col("value").cast("double").alias("x"), (F.col("value") + noise).alias("y"))


def custom_stream(spark: SparkSession, generators: Mapping[str, Column | Callable[[Column], Column]], rate: int = 1) -> DataFrame:
    """Columns made from the running number of each row."""
    n = F.col("value")
    return ticks(spark, rate).select(*[(g(n) if callable(g) and not isinstance(g, Column) else g).alias(c) for c, g in generators.items()])


def replay_batches(df: DataFrame, time: str = "_time", most: int = 10_000) -> DataFrame:
    """A table as a stream whose batches are the rows of equal time, in order; more than ``most`` times are an error.

    Each batch is a folder in the shared folder, read one a trigger.
    """
    spark = df.sparkSession
    times = [r[0] for r in df.select(time).distinct().orderBy(time).limit(most + 1).collect()]
    if len(times) > most:
        raise ValueError(f"more than {most} batches")
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    for i, t in enumerate(times):
        df.where(F.col(time).eqNullSafe(F.lit(t))).coalesce(1).write.parquet(f"{path}/batch={i:06d}")
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return read_files(spark, path, kinds + ", batch int", "parquet", files_per_batch=1).drop("batch")


def replay_csv(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """The csv files of a folder as a stream, some at a time."""
    return read_files(spark, path, schema, "csv", files_per_batch=files_per_batch, header="true")


def scripted(spark: SparkSession, batches: list[list[tuple]], schema: str) -> DataFrame:
    """Written-out batches as a table of changes: the columns and ``_time`` 2, 4, ..."""
    names = spark.createDataFrame([], schema).columns
    rows = pd.DataFrame([(*r, 2 * i + 2) for i, b in enumerate(batches) for r in b], columns=[*names, "_time"])
    return spark.createDataFrame(list(rows.itertuples(index=False, name=None)), schema + ", _time bigint")
