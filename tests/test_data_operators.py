"""Grids, pivots, replayed changes and implausible readings: edge cases, and brute force where SQL can't state them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.operators.regrid import regular_grid
from rillstone.operators.replay import apply_changes
from rillstone.operators.spikes import Rules, flag_readings, judge
from rillstone.operators.widen import attribute_names, pivot_blocks

READING = "s string, t bigint, v double, o bigint, period_start string, value string"


def grid(spark, rows, **kw):
    df = spark.createDataFrame([(s, t, v, o, "x", "y") for s, t, v, o in rows], READING)
    out = regular_grid(df, ["s"], "t", "v", "o", **kw).collect()
    return {(r["s"], r["period_start"]): (r["value"], r["n_readings"], r["status"]) for r in out}


def test_grid_marks_and_fills(spark):
    rows = [("a", 1_000, 1.0, 1), ("a", 2_000, 3.0, 1), ("a", 95_000, 5.0, 1), ("a", 400_000, 2.0, 1), (None, 10, 7.0, 1), ("a", None, 1.0, 1), ("a", 50_000, None, 1), ("a", 50_001, float("nan"), 1)]
    g = grid(spark, rows)
    assert g["a", 0] == (2.0, 2, "observed") and g["a", 90_000] == (5.0, 1, "observed")
    assert g["a", 30_000][2] == g["a", 60_000][2] == "filled" and 2.0 < g["a", 30_000][0] < g["a", 60_000][0] < 5.0
    assert {g["a", p] for p in range(120_000, 390_000, 30_000)} == {(None, 0, "missing")}
    assert g[None, 0] == (7.0, 1, "observed")
    assert len(g) == 1 + 14


def test_grid_repeated_last_arrival_infinite(spark):
    g = grid(spark, [("a", 0, 1.0, 1), ("a", 0, 9.0, 2), ("a", 0, 9.0, 2), ("a", 60_000, float("inf"), 1), ("a", 120_000, 4.0, 1)])
    assert g["a", 0] == (9.0, 1, "observed") and g["a", 60_000] == (None, 1, "observed")
    assert g["a", 30_000][2] == "missing" and g["a", 90_000][2] == "missing"


def test_grid_empty(spark):
    assert grid(spark, []) == {}


def _pchip(x, y, at):
    """Monotone cubic interpolation, one point at a time."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    m[0], m[-1] = d[0], d[-1]
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])
    i = np.searchsorted(x, at) - 1
    u = (at - x[i]) / h[i]
    return (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h[i] * m[i] + u * u * (3 - 2 * u) * y[i + 1] + u * u * (u - 1) * h[i] * m[i + 1]


@pytest.mark.parametrize("shard", [2, 5, 1000])
def test_grid_shards_do_not_show(spark, shard):
    """Whatever the shards, values are those of one interpolation over the whole source."""
    rng = random.Random(shard)
    periods = sorted(rng.sample(range(-20, 80), 45))
    rows = [("a", 30_000 * p + rng.randrange(30_000), rng.uniform(-5, 5), 1) for p in periods]
    g = grid(spark, rows, shard_periods=shard, max_fill=3)
    y = {p: v for p, (_, _, v, _) in zip(periods, rows, strict=True)}
    x = np.array(periods, float)
    for p in range(periods[0], periods[-1] + 1):
        value, _, status = g["a", 30_000 * p]
        if p in y:
            assert (value, status) == (pytest.approx(y[p]), "observed")
        else:
            left, right = max(q for q in periods if q < p), min(q for q in periods if q > p)
            assert status == ("filled" if right - left - 1 <= 3 else "missing")
            if status == "filled":
                assert value == pytest.approx(_pchip(x, np.array([y[q] for q in periods]), p))


def test_grid_long_gap(spark):
    g = grid(spark, [("a", 0, 1.0, 1), ("a", 30_000 * 10_000, 1.0, 1)])
    assert len(g) == 10_001 and sum(s == "missing" for _, _, s in g.values()) == 9_999


EAV = "e bigint, f string, a string, v double, o bigint, unfit string"


def test_pivot_blocks_equal_one_block(spark):
    rng = random.Random(1)
    names = [f"a{i}" for i in range(23)]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["x", None]), rng.choice([*names, "other", None]), rng.choice([1.0, 2.5, None, float("nan")]), rng.randrange(5), "z") for _ in range(400)]
    df = spark.createDataFrame(rows, EAV)
    wide = lambda b: sorted(map(str, pivot_blocks(df, ["e", "f"], "a", "v", names, "o", block=b).collect()))
    assert wide(4) == wide(100) == wide(1)
    want = {}
    for e, f, a, v, o, _ in rows:
        cell = want.setdefault((e, f), {})
        if a in names and v is not None and v == v:
            cell[a] = max(cell.get(a, (-1, 0)), (o, v))
    for r in pivot_blocks(df, ["e", "f"], "a", "v", names, "o", block=5).collect():
        assert {n: r[n] for n in names if r[n] is not None} == {n: v for n, (_, v) in want[r["e"], r["f"]].items()}


@pytest.mark.parametrize("count", [3, 130, 640])
def test_pivot_scans_and_shuffles_once(spark, sf, count):
    """One scan and one exchange, whatever the number of blocks."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("a", F.concat(F.lit("a"), F.col("l_partkey") % count))
    plan = pivot_blocks(df, ["l_suppkey"], "a", "l_quantity", [f"a{i}" for i in range(count)], "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "SortMergeJoin" not in plan


def test_pivot_types_and_clashes(spark):
    df = spark.createDataFrame([(1, "x", "n", 2.0, 1, "z"), (1, "x", "m", 2.5, 1, "z"), (2, "x", "n", float("inf"), 1, "z")], EAV)
    out = {r["e"]: r for r in pivot_blocks(df, ["e"], "a", "v", ["n", "m"], "o", {"n": "bigint", "m": "bigint"}, {"n": "count"}).collect()}
    assert (out[1]["count"], out[1]["m"], out[1]["unfit"]) == (2, None, {"m": 2.5}) and out[2]["unfit"] == {"count": float("inf")}
    with pytest.raises(ValueError):
        pivot_blocks(df, ["e"], "a", "v", ["n"], names={"n": "E"})
    with pytest.raises(ValueError):
        attribute_names(df, "a", most=1)
    assert attribute_names(df, "a") == ["m", "n"]
    assert pivot_blocks(df.limit(0), ["e"], "a", "v", ["n"], "o").collect() == []


FEED = "k bigint, v string, time bigint, diff int, _k string"


def _state(rows):
    per = {}
    for k, v, t, d, _ in rows:
        if d:
            per.setdefault(k, []).append((t if t is not None else float("-inf"), d > 0, v))
    out = {}
    for k, c in per.items():
        t = max(x[0] for x in c)
        images = [v for u, ins, v in c if u == t and ins]
        if images:
            out[k] = max(images, key=lambda v: (v is not None, v or ""))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_changes_in_any_order(spark, batches):
    rng = random.Random(batches)
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice(["a", "b", None]), rng.choice([2, 4, 6, 8, 10, None]), rng.choice([1, -1, 0, None]), "x") for _ in range(60)]
    rows += rows[:20]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, FEED)
    got = {r["k"]: r["v"] for r in apply_changes(df, ["k"], ["v"], "time", "diff", batches=batches).collect()}
    assert got == _state(rows)


def test_changes_on_base(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (None, "old")], "k bigint, v string")
    df = spark.createDataFrame([(1, "new", 5, 1, "x"), (2, None, 7, -1, "x"), (2, "late", 3, 1, "x")], FEED)
    got = {r["k"]: r["v"] for r in apply_changes(df, ["k"], ["v"], "time", "diff", base).collect()}
    assert got == {1: "new", 3: "old", None: "old"}
    assert apply_changes(df.limit(0), ["k"], ["v"], "time", "diff", base).count() == 4
    assert apply_changes(df.limit(0), ["k"], ["v"], "time", "diff").count() == 0


def flags(spark, series, kind="upward", **kw):
    rows = [("s", 1_000 * i, v, i) for i, v in enumerate(series)]
    df = spark.createDataFrame(rows, "source string, t bigint, v double, reasons bigint")
    out = flag_readings(df, ["source"], "t", "v", F.lit(kind), "reasons", **kw).orderBy("time").collect()
    return [",".join(r["reasons"]) for r in out]


def noisy(n, level=100.0, seed=3):
    rng = random.Random(seed)
    return [level * (1 + rng.uniform(-0.1, 0.1)) for _ in range(n)]


def test_spikes_limits_and_stuck(spark):
    s = noisy(80)
    s[20], s[21], s[40], s[60] = 900.0, 4000.0, -3.0, float("inf")
    s[65:78] = [104.0] * 13
    f = flags(spark, s)
    assert f[20] == f[21] == "spike" and f[40] == f[60] == "limit" and set(f[65:78]) == {"stuck"}
    assert sum(x != "" for x in f) == 4 + 13


def test_lasting_levels_ramps_and_constants_are_sound(spark):
    assert set(flags(spark, noisy(40) + noisy(40, 900.0))) == {""}
    assert set(flags(spark, noisy(30) + noisy(15, 450.0) + noisy(30))) == {""}
    assert set(flags(spark, [100.0 + 10 * i for i in range(60)])) == {""}
    constant = [7.0] * 50
    constant[10] = -1.0
    assert [i for i, x in enumerate(flags(spark, constant)) if x] == [10]


def test_downwards_only_for_levels(spark):
    s = noisy(60)
    s[30] = 10.0
    assert set(flags(spark, s)) == {""}
    assert flags(spark, s, "level")[30] == "spike"


def test_totals(spark):
    s = [float(10 * i) for i in range(60)]
    s[30] = 40.0
    s[45] = 5_000.0  # jumps out and comes back: what follows is not below a plausible one
    f = flags(spark, s, "total")
    assert f[30] == "backwards" and set(f[46:]) == {""}
    jump = [float(10 * i) + (900 if i > 20 else 0) for i in range(40)]
    assert set(flags(spark, jump, "total")) == {""}


@pytest.mark.parametrize("kind", ["upward", "total"])
def test_shards_do_not_show(spark, kind):
    """Cut into time shards, the same readings are flagged."""
    s = noisy(300) if kind == "upward" else [float(i) for i in range(300)]
    for i in (50, 101, 199, 200, 250):
        s[i] = 2_000.0 if kind == "upward" else 3.0
    s[95:112] = [s[95]] * 17 if kind == "upward" else s[95:112]
    whole = flags(spark, s, kind)
    assert flags(spark, s, kind, shard=100_000, halo=30_000) == whole and sum(x != "" for x in whole) > 4


@pytest.mark.parametrize(("at", "halo"), [(20, 30_000), (98, 30_000), (98, 0), (97, 1_000), (99, 0)])
def test_a_jutting_total_is_no_mark_for_later_shards(spark, at, halo):
    """One wrong high total, far from a border or right before it, leaves the later shards alone."""
    s = [float(i) for i in range(300)]
    s[at], s[260] = 50_000.0, 3.0
    whole = flags(spark, s, "total")
    assert [i for i, x in enumerate(whole) if x] == [260] and flags(spark, s, "total", shard=100_000, halo=halo) == whole


def test_a_resent_total_is_no_mark_for_later_shards(spark):
    """A high total that was sent again with another value does not count, neither here nor later."""
    rows = [("s", 1_000 * i, float(i), 1) for i in range(300)] + [("s", 50_000, 9_000.0, 0)]
    df = spark.createDataFrame(rows, "source string, t bigint, v double, o bigint")
    out = flag_readings(df, ["source"], "t", "v", F.lit("total"), "o", shard=100_000, halo=30_000)
    assert out.where("size(reasons) > 0").count() == 0 and out.count() == 300


def test_a_source_that_moved_days_before_is_stuck(spark):
    """Stuck over a border and for whole shards: flagged as if uncut. A source constant but for wrong readings is sound in all shards."""
    s = noisy(150) + [104.0] * 350
    whole = flags(spark, s)
    assert set(whole[150:]) == {"stuck"} and flags(spark, s, shard=100_000, halo=30_000) == whole
    constant = [7.0] * 400
    constant[50], constant[250] = 900.0, -1.0
    assert [x for x in flags(spark, constant, shard=100_000, halo=30_000) if x] == ["spike", "limit"]


def test_a_run_over_many_shards_counts_as_one(spark):
    """Runs of too few readings in each shard are stuck together; a long stretch of shards in one value keeps its length to both sides."""
    s = noisy(43) + [104.0] * 14 + noisy(43, seed=4)
    whole = flags(spark, s)
    assert [i for i, x in enumerate(whole) if x] == list(range(43, 57)) and flags(spark, s, shard=10_000, halo=2_000) == whole


def test_changes_with_a_clock_far_off(spark):
    """One change far from all others doesn't put the rest into one batch, nor change the table."""
    rows = [(i % 7, f"v{i}", 10 * i, 1) for i in range(70)] + [(99, "late", 10**15, 1)]
    df = spark.createDataFrame(rows, "k int, v string, time bigint, diff int")
    got = {(r["k"], r["v"]) for r in apply_changes(df, ["k"], ["v"], "time", "diff").collect()}
    assert got == {(i % 7, f"v{i}") for i in range(63, 70)} | {(99, "late")}


def test_the_forest_decides(spark):
    """Of readings that the explicit checks let through, the cutoffs made from implausible readings keep some and drop others."""
    s = noisy(120)
    s[60] = 2_000.0
    s[100:104] = [101.0] * 4
    assert [i for i, x in enumerate(flags(spark, s)) if x] == [60]
    none = Rules(spike_score=-9.0, stuck_score=-9.0)
    assert [i for i, x in enumerate(flags(spark, s, rules=none)) if x] == [60, 100, 101, 102, 103]


def test_flags_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, 1, 5.0, 1), (None, 1, -5.0, 2), (None, None, 5.0, 1), ("a", 1, None, 1)], "source string, t bigint, v double, o bigint")
    out = flag_readings(df, ["source"], "t", "v", F.lit(None).cast("string"), "o").collect()
    assert [(r["source"], r["value"], r["reasons"]) for r in out] == [(None, -5.0, ["limit"])]
    assert flag_readings(df.limit(0), ["source"], "t", "v", F.lit("total"), "o").collect() == []


def test_outliers_score_higher():
    rng = np.random.default_rng(0)
    v = rng.normal(100, 5, 400)
    v[[50, 300]] = 900
    score, _ = judge(np.zeros(400, int), np.array([7], np.uint64), np.arange(400) * 1000, v, np.full(400, 2), np.full(400, np.nan), Rules())
    assert sorted(np.argsort(score)[-2:]) == [50, 300] and 0.2 < np.median(score) < 0.5
