"""Percentiles and items that appear together."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import together
from rillstone.llm.percentiles import RANK_ERROR, answer_percentiles, merge_percentiles, partial_percentiles


def test_percentiles_of_parts(spark):
    """Partial results of any parts answer within the bound, heavy tails and ties included."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.pareto(1.1, 60_000), np.repeat(3.0, 20_000), rng.normal(0, 1e6, 20_000)])
    df = spark.createDataFrame([(float(x), i % 7) for i, x in enumerate(v)], "value double, part int").withColumn("n", F.lit("clash"))
    m = merge_percentiles(partial_percentiles(df.withColumn("g", F.lit(None).cast("string")), ["g"], "value", F.col("part")), ["g"])
    r = answer_percentiles(m, ["g"], [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]).first()
    assert r["n"] == len(v) and r["p0"] == v.min() and r["p100"] == v.max()
    for p, c in ((0.01, "p1"), (0.5, "p50"), (0.9, "p90"), (0.999, "p99_9")):
        assert (v < r[c]).mean() - RANK_ERROR <= p <= (v <= r[c]).mean() + RANK_ERROR


def test_percentiles_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", float("inf")), ("b", 1.0), ("b", 1.0), (None, 5.0)], "g string, v double")
    p = partial_percentiles(df, ["g"], "v", F.lit(1))
    r = {x["g"]: (x["n"], x["p50"]) for x in answer_percentiles(merge_percentiles(p, ["g"]), ["g"], [0.5]).collect()}
    assert r == {"b": (3, 1.0), None: (1, 5.0)}
    assert partial_percentiles(df.limit(0), ["g"], "v", F.lit(1)).count() == 0


def pairs(df, least=1):
    p, t = together.pairs_together(df, "u", "i", least)
    return {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in together.with_counts(p, t).collect()}


@pytest.mark.parametrize("chunk", [3, 512])
def test_pairs_by_brute_force(spark, monkeypatch, chunk):
    """Large baskets cut into chunks (here of 3) give the same as whole ones."""
    monkeypatch.setattr(together, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([*range(-3, 30), None]), "x", 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "u int, i int, left string, chunk int")
    baskets = {}
    for u, i, *_ in rows:
        if u is not None and i is not None:
            baskets.setdefault(u, set()).add(i)
    n = lambda *items: sum(set(items) <= b for b in baskets.values())
    every = sorted(set().union(*baskets.values()))
    want = {(a, b): (n(a, b), n(a), n(b)) for a, b in combinations(every, 2) if n(a, b)}
    assert pairs(df) == want
    assert pairs(df, 3) == {k: v for k, v in want.items() if v[0] >= 3}


def test_pairs_flush(spark, monkeypatch):
    """Stripes written out before the task ends are added up all the same."""
    monkeypatch.setattr(together, "_CODES", 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"left": [[1, 2, 3, 4, 5, 6, 7]] * 40, "right": [[]] * 40}, schema=pa.schema([("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))
    total = {}
    for out in together._to_stripes(iter([batch, batch])):
        for r in out.to_pylist():
            for b, c in zip(r["neighbours"], r["counts"], strict=True):
                total[r["item"], b] = total.get((r["item"], b), 0) + c
    assert total == {p: 80 for p in combinations(range(1, 8), 2)}


def test_pairs_empty(spark):
    df = spark.createDataFrame([], "u int, i int")
    assert pairs(df) == {}
    assert pairs(spark.createDataFrame([(1, 5), (1, 5), (2, None)], "u int, i int")) == {}


def test_significance(spark):
    r = spark.range(1).select(together.log_likelihood_ratio(F.lit(10), F.lit(20), F.lit(50), F.lit(100)).alias("even"), together.log_likelihood_ratio(F.lit(20), F.lit(20), F.lit(20), F.lit(100)).alias("same")).first()
    assert r["even"] == pytest.approx(0, abs=1e-9) and r["same"] == pytest.approx(2 * (20 * np.log(5) + 80 * np.log(1.25)))
