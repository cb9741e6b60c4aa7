"""Databases, lakes and queues through Spark's connectors, where their packages are on the class path; and sinks by client functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: JDBC address prefixes of the databases.
_JDBC = {"postgres": "jdbc:postgresql", "mysql": "jdbc:mysql", "mssql": "jdbc:sqlserver", "questdb": "jdbc:postgresql", "clickhouse": "jdbc:clickhouse", "duckdb": "jdbc:duckdb"}


def jdbc_url(kind: str, host: str, port: int, database: str) -> str:
    sep = f"//{host}:{port};databaseName={database}" if kind == "mssql" else database if kind == "duckdb" else f"//{host}:{port}/{database}"
    return f"{_JDBC[kind]}:{sep}"


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 16, **properties: str) -> DataFrame:
    """A table, read in ranges of a column if one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_column:
        r = r.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **properties).mode(mode).save()


def read_kafka(spark: SparkSession, servers: str, topic: str, *, streaming: bool = True, start: str = "earliest", max_per_batch: int | None = None, **options: str) -> DataFrame:
    r = (spark.readStream if streaming else spark.read).format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}, **options)
    return (r.option("maxOffsetsPerTrigger", max_per_batch) if max_per_batch else r).load()


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    out = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*df.columns)).alias("value"))
    out.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def read_lake(spark: SparkSession, kind: str, path: str, *, streaming: bool = False, changes: bool = False, **options: str) -> DataFrame:
    """A Delta or Iceberg table; changes gives its change feed."""
    r = (spark.readStream if streaming else spark.read).format(kind).options(**options)
    return (r.option("readChangeFeed", "true") if changes else r).load(path)


def write_lake(df: DataFrame, kind: str, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    df.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)


def write_by(df: DataFrame, send: Callable[[Sequence[Mapping]], None], batch: int = 1_000) -> None:
    """Rows to a client function in batches, from the tasks; send is called again for a batch when its task is retried."""
    names = df.columns

    def part(rows: Iterable) -> None:
        held = []
        for r in rows:
            held.append(dict(zip(names, r, strict=True)))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(part)


def post_json(url: str, timeout: float = 30) -> Callable[[Sequence[Mapping]], None]:
    """A send function for write_by: a batch as a Json array in the body of a request."""

    def send(rows: Sequence[Mapping]) -> None:
        import json
        import urllib.request

        body = json.dumps(rows, default=str).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).read()

    return send


def read_python(spark: SparkSession, source: type, **options: str) -> DataFrame:
    """A source written in Python with Spark's data source interface."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()
