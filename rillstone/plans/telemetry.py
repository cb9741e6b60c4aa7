"""Queries p3, p5, p6 and p7: metrics and change_feed through the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regrid import regular_grid
from ..operators.replay import apply_changes
from ..operators.spikes import flag_readings
from ..operators.widen import attribute_names, pivot_blocks
from ..session import table

#: Columns of the wide table that have a name and a type of their own.
WIDE_NAMES = {"operator.latency": "latency_ms", "operator.insertions": "rows_positive", "operator.deletions": "rows_negative"}
WIDE_TYPES = {"operator.insertions": "bigint", "operator.deletions": "bigint"}

ENTITY = ["run_id", "worker_id", "operator_id", "timestamp"]
#: Attributes of a block: few, so that these few names are pivoted in blocks like thousands.
WIDE_BLOCK = 2


def metrics_in_runs(spark: SparkSession, d: str) -> DataFrame:
    """metrics with plain names, without the rows outside the time of their run. A run that isn't listed has no bounds."""
    plain = F.translate(F.lower(F.btrim(F.col("name"), F.lit(" \t\r\n"))), "_-", "..")
    m = table(spark, d, "metrics").withColumn("name", plain)
    runs = table(spark, d, "resources").select("run_id", F.unix_micros("started_at").alias("_from"), F.unix_micros("finished_at").alias("_to"))
    us = F.col("timestamp") * 1000
    inside = F.coalesce(us >= F.col("_from"), F.lit(True)) & F.coalesce(us <= F.col("_to"), F.lit(True))
    return m.join(runs, "run_id", "left").where(inside).drop("_from", "_to")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    m = metrics_in_runs(spark, d).where("operator_id is null")
    return regular_grid(m, ["run_id", "worker_id", "name"], "timestamp", "value", "arrived_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where("n_readings = 0").select("run_id", "worker_id", "name", "period_start")


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    m = metrics_in_runs(spark, d).where("operator_id is not null")
    return pivot_blocks(m, ENTITY, "name", "value", attribute_names(m, "name"), "arrived_at", WIDE_TYPES, WIDE_NAMES, WIDE_BLOCK)


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table turned back into its cells."""
    wide = p5_wide(spark, d)
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns if c not in (*ENTITY, "unfit")]
    unfit = F.coalesce(F.transform(F.map_entries("unfit"), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("value"))), F.array().cast("array<struct<name:string,value:double>>"))
    return wide.select(*ENTITY, F.explode(F.concat(F.array(*cells), unfit)).alias("x")).select(*ENTITY, "x.*").where("value is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    wide = p5_wide(spark, d)
    missing = lambda c: F.col(c).isNull() & ~F.coalesce(F.map_contains_key("unfit", F.lit(c)), F.lit(False))
    empty = F.array(*[F.when(missing(c) if c in wide.columns else F.lit(True), F.lit(n)) for n, c in WIDE_NAMES.items()])
    return wide.select(*ENTITY, F.explode(F.filter(empty, lambda x: x.isNotNull())).alias("name"))


def pivot_many_attributes(spark: SparkSession, d: str) -> DataFrame:
    """200 attributes of suppliers in blocks of 64, turned back into cells."""
    names = [f"part {i}" for i in range(200)]
    l = table(spark, d, "lineitem").withColumn("name", F.concat(F.lit("part "), F.col("l_partkey") % 200)).withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    wide = pivot_blocks(l, ["l_suppkey"], "name", "l_quantity", names, "at")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("quantity")) for n in names])
    return wide.select("l_suppkey", F.explode(cells).alias("x")).select("l_suppkey", "x.*").where("quantity is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_changes(table(spark, d, "change_feed"), ["k"], ["v"], "time", "diff")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    m = metrics_in_runs(spark, d).where("operator_id is null")
    kind = F.when(F.col("name").startswith("process.cpu."), "total").when(F.col("name").startswith("process.memory."), "level").otherwise("upward")
    return flag_readings(m, ["run_id", "worker_id", "name"], "timestamp", "value", kind, "arrived_at").withColumnRenamed("time", "timestamp")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_scores(spark, d).where("size(reasons) > 0").select("run_id", "worker_id", "name", "timestamp")


QUERIES = {f.__name__: f for f in (p3_found, p3_grid, p5_found, p5_wide, p5_cells, pivot_many_attributes, p6_found, p7_found, p7_scores)}

_USABLE = """
WITH m AS (
  SELECT m.run_id, m.worker_id, m.operator_id, m.timestamp, m.value, m.arrived_at,
         replace(replace(lower(trim(m.name)), '_', '.'), '-', '.') AS name
  FROM metrics m LEFT JOIN resources r ON m.run_id = r.run_id
  WHERE coalesce(m.timestamp * 1000 >= epoch_us(r.started_at), true) AND coalesce(m.timestamp * 1000 <= epoch_us(r.finished_at), true)
)"""

ORACLES = {
    "p3_found": _USABLE
    + """, p AS (
  SELECT DISTINCT run_id, worker_id, name, timestamp - timestamp % 30000 AS p
  FROM m WHERE operator_id IS NULL AND value IS NOT NULL AND NOT isnan(value)
), g AS (
  SELECT run_id, worker_id, name, unnest(range(min(p), max(p), 30000)) AS period_start FROM p GROUP BY 1, 2, 3
)
SELECT g.run_id, g.worker_id, g.name, g.period_start FROM g ANTI JOIN p
  ON g.run_id IS NOT DISTINCT FROM p.run_id AND g.worker_id IS NOT DISTINCT FROM p.worker_id AND g.name IS NOT DISTINCT FROM p.name AND g.period_start = p.p
""",
    "p5_found": _USABLE
    + """, e AS (SELECT DISTINCT run_id, worker_id, operator_id, timestamp FROM m WHERE operator_id IS NOT NULL),
n AS (SELECT unnest(['operator.latency', 'operator.insertions', 'operator.deletions']) AS name)
SELECT e.run_id, e.worker_id, e.operator_id, e.timestamp, n.name FROM e CROSS JOIN n
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id IS NOT DISTINCT FROM e.run_id AND m.worker_id IS NOT DISTINCT FROM e.worker_id
  AND m.operator_id = e.operator_id AND m.timestamp IS NOT DISTINCT FROM e.timestamp AND m.name = n.name AND m.value IS NOT NULL AND NOT isnan(m.value))
""",
    "p5_cells": _USABLE
    + """
SELECT run_id, worker_id, operator_id, timestamp,
  CASE name WHEN 'operator.latency' THEN 'latency_ms' WHEN 'operator.insertions' THEN 'rows_positive' WHEN 'operator.deletions' THEN 'rows_negative' ELSE name END AS name,
  last(value ORDER BY arrived_at NULLS FIRST, value) AS value
FROM m WHERE operator_id IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY run_id, worker_id, operator_id, timestamp, name
""",
    "pivot_many_attributes": """
SELECT l_suppkey, 'part ' || (l_partkey % 200) AS name, last(l_quantity ORDER BY l_orderkey * 10 + l_linenumber, l_quantity)::DOUBLE AS quantity
FROM lineitem GROUP BY l_suppkey, l_partkey % 200
""",
    "p6_found": """
SELECT k, max(v) AS v FROM change_feed c
WHERE diff = 1 AND time = (SELECT max(time) FROM change_feed x WHERE x.k = c.k)
GROUP BY k
""",
}
