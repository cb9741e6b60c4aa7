"""Structured Streaming: sources, windows with watermarks, stateful deduplication, keyed targets, subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "json", pattern: str | None = None, files_per_batch: int | None = None, **options: str) -> DataFrame:
    """A growing folder as a stream; files_per_batch bounds what a batch takes."""
    r = spark.readStream.schema(schema).format(kind).options(**options)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock: ``timestamp``, ``value``."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def windowed(stream: DataFrame, time: str, duration: str, aggs: Mapping[str, Column], instance: Sequence[str] = (), hop: str | None = None, cutoff: str = "0 seconds") -> DataFrame:
    """Tumbling or sliding windows (from a Monday) of a stream; rows later than cutoff behind the watermark are dropped, and state goes with them."""
    w = F.window(time, duration, hop or duration, "4 days" if "week" in duration else "0 seconds")
    g = stream.withWatermark(time, cutoff).groupBy(w.alias("_w"), *instance)
    return g.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *instance, *aggs)


def interval_joined(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: str, upper: str, on: Sequence[str], late: str = "1 minute", how: str = "inner") -> DataFrame:
    """Stream-stream join of rows within an interval; watermarks bound the state."""
    l, r = left.withWatermark(left_time, late).alias("l"), right.withWatermark(right_time, late).alias("r")
    cond = F.expr(f"r.{right_time} >= l.{left_time} + interval {lower} AND r.{right_time} <= l.{left_time} + interval {upper}")
    for c in on:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return l.join(r, cond, how)


def deduplicated(stream: DataFrame, key: Sequence[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """First row of each key; with a time the keys are forgotten when they are late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key)) if time else stream.dropDuplicates(list(key))


def accept_stateful(stream: DataFrame, key: str, schema: str, acceptor: Callable[[dict, dict | None], bool]) -> DataFrame:
    """Rows that acceptor(row, accepted row) takes, the last accepted one being kept per key (as Json) across batches."""
    import json

    import pandas as pd

    def step(k, frames, state):
        held = json.loads(state.get[0]) if state.exists else None
        out = []
        for f in frames:
            for r in f.to_dict("records"):
                if held is None or acceptor(r, held):
                    held = r
                    out.append(r)
        if held is not None:
            state.update((json.dumps(held, default=str),))
        if out:
            yield pd.DataFrame(out)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "held string", "append", "NoTimeout")


def upsert_into(stream: DataFrame, path: str, key: Sequence[str], checkpoint: str, order: Sequence[str] = (), upsert_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """A keyed target kept by the stream: each batch's last row per key replaces the old one (or removes it).

    The target is a folder of versions, each a parquet folder named by batch,
    and a batch that is run again writes the same version.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("_l")).select(*key, "_l.*")
        old = latest_version(spark, path, n - 1)
        keep = [c for c in batch.columns if c != upsert_col]
        new = (last.where(F.col(upsert_col)) if upsert_col else last).select(*keep)
        if old is not None:
            new = old.join(last.select(*key), list(key), "left_anti").select(*keep).unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/version={n:09d}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest_version(spark: SparkSession, path: str, most: int | None = None) -> DataFrame | None:
    """The newest version of a keyed target, or the newest up to a batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("version="))
    names = [n for n in names if most is None or int(n[8:]) <= most]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def subscribe(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, on_end: Callable[[], None] | None = None, output: str = "append") -> StreamingQuery:
    """on_batch(rows, batch number) for every batch; on_end when the input that is there has been taken."""
    q = stream.writeStream.outputMode(output).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if on_end:
        q.awaitTermination()
        on_end()
    return q


def to_memory(stream: DataFrame, name: str, output: str = "append") -> DataFrame:
    """What the stream gives from the input that is there, as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(output).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def with_update_time(stream: DataFrame, name: str = "updated_timestamp_utc") -> DataFrame:
    return stream.withColumn(name, F.current_timestamp())
