"""Edge cases of the reference operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillstone.functions import expr as E
from rillstone.functions import jsons as J
from rillstone.functions import text as S
from rillstone.functions import times as D
from rillstone.operators import index as X
from rillstone.operators import iterate as G
from rillstone.operators import joins, reducers, table
from rillstone.operators import temporal as W
from rillstone.operators import udfs as U
from rillstone.session import table as table_of
from rillstone.sources import files as IO
from rillstone.streaming import changes as C
from rillstone.text import split as P


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_floored_division(spark):
    for a in (-7, -1, 0, 7):
        for b in (-2, 2, 3):
            assert one(spark, E.floor_div(F.lit(a), b)) == a // b and one(spark, E.floor_mod(F.lit(a), b)) == a % b
    assert one(spark, E.floor_div(F.lit(1), 0)) is None and one(spark, E.true_div(F.lit(1), 0)) is None


def test_text_like_python(spark):
    t = "Hello wörld, hello"
    c = F.lit(t)
    assert one(spark, S.swapcase(c)) == t.swapcase() and one(spark, S.title(c)) == t.title()
    assert one(spark, S.replace(c, "l", "L", 2)) == t.replace("l", "L", 2) and one(spark, S.replace(c, "l", "L")) == t.replace("l", "L")
    assert one(spark, S.find(c, "l", 4)) == t.find("l", 4) and one(spark, S.find(c, "z")) == -1 and one(spark, S.rfind(c, "hello")) == t.rfind("hello")
    assert one(spark, S.slice_(c, -5, None)) == t[-5:] and one(spark, S.slice_(c, 2, -3)) == t[2:-3] and one(spark, S.count(c, "l", 0, 8)) == t.count("l", 0, 8)
    assert one(spark, S.removesuffix(c, "llo")) == t.removesuffix("llo") and one(spark, S.parse_bool(F.lit("Yes"))) is True and one(spark, S.parse_int(F.lit("x"), True)) is None


def test_times(spark):
    t = F.lit(dt.datetime(2024, 3, 31, 1, 30)).cast("timestamp_ntz")
    assert one(spark, D.add_duration_in_timezone(t, 3_600_000_000, "Europe/Berlin")) == dt.datetime(2024, 3, 31, 3, 30)
    assert one(spark, D.hours(F.lit(-5_400_000_000))) == -1 and one(spark, D.weekday(t)) == 6
    assert one(spark, D.strptime(F.lit("2024-01-02 03:04:05.5"), "%Y-%m-%d %H:%M:%S.5")) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, D.round_to(t, 3_600_000_000).cast("timestamp_ntz")) == dt.datetime(2024, 3, 31, 2, 0)


def test_json(spark):
    v = J.parse(F.lit('{"a": {"b": [1, 2.5]}, "s": "x", "t": true}'))
    assert one(spark, J.as_int(v, "a", "b", 0)) == 1 and one(spark, J.as_float(v, "a", "b", 1)) == 2.5 and one(spark, J.as_bool(v, "t")) is True
    assert one(spark, J.as_str(v, "no", default="d")) == "d" and one(spark, J.parse(F.lit("{"))) is None


def test_matrix(spark):
    a = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    assert one(spark, E.matmul(a, a)) == [[7.0, 10.0], [15.0, 22.0]] and one(spark, E.matvec(a, a[0])) == [5.0, 11.0]


def test_row_keys_tell_values_apart(spark):
    k = [E.row_key(F.lit("a"), F.lit(None).cast("string")), E.row_key(F.lit(None).cast("string"), F.lit("a")), E.row_key(F.lit("a")), E.row_key(F.lit(1)), E.row_key(F.lit("1"))]
    assert len({one(spark, c) for c in k}) == 5


def test_lookup_misses(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, p string")
    b = spark.createDataFrame([("x", 9)], "id string, w int")
    assert {(r["n"], r["w"]) for r in table.lookup(a, F.col("p"), b, optional=True).collect()} == {(1, 9), (2, None)}
    with pytest.raises(Exception, match="no row with this id"):
        table.lookup(a, F.col("p"), b).collect()


def test_null_reducers(spark):
    df = spark.createDataFrame([(1, None), (1, 3), (1, 1)], "g int, v int")
    r = df.groupBy("g").agg(reducers.min_("v").alias("m"), reducers.count().alias("n"), reducers.count_distinct("v").alias("d"), reducers.sorted_tuple("v").alias("s"), reducers.sorted_tuple("v", True).alias("t")).first()
    assert (r["m"], r["n"], r["d"], r["s"], r["t"]) == (None, 3, 3, [None, 1, 3], [1, 3])
    with pytest.raises(Exception, match="more than one distinct"):
        df.groupBy("g").agg(reducers.unique("v")).collect()
    assert joins.join(df, df, ["v"]).count() == 3


def test_stateful_many(spark):
    df = spark.createDataFrame([(1, 2, 10), (1, 3, 10), (1, 5, 20)], "g int, v int, t int")
    out = reducers.stateful_many(df, ["g"], ["v"], lambda s, rows: (s or 0) * 10 + sum(r[0] * c for r, c in rows), "int", "x", "t")
    assert out.first()["x"] == 55


def test_window_edges(spark):
    df = spark.createDataFrame([(0,), (10,), (None,), (-1,), (19,)], "t bigint")
    w = {(r["window_start"], r["window_end"], r["n"]) for r in W.windowby(df, "t", W.tumbling(10), {"n": F.count(F.lit(1))}).collect()}
    assert w == {(0, 10, 1), (10, 20, 2), (-10, 0, 1)}
    assert {r["window_start"] for r in W.assign_windows(df, "t", W.tumbling(10, origin=5)).collect()} == {5, 15}
    # a hop wider than the window leaves rows in no window
    assert {r["t"] for r in W.assign_windows(df, "t", W.sliding(10, 2)).collect()} == {0, 10}
    # sessions: a gap of exactly max_gap is a new session
    s = {(r["window_start"], r["window_end"]) for r in W.windowby(df, "t", W.Session(max_gap=10), {"n": F.count(F.lit(1))}).collect()}
    assert s == {(-1, 0), (10, 19)}


def test_interval_join_by_brute_force(spark):
    a = [(i, (i * 7) % 13 - 3, i % 2) for i in range(30)] + [(99, None, 0), (98, 1, None)]
    b = [(i, (i * 5) % 17 - 4, i % 2) for i in range(30)] + [(97, 1, None), (96, None, 1)]
    l, r = spark.createDataFrame(a, "i int, t bigint, k int"), spark.createDataFrame(b, "j int, u bigint, k int")
    for lo, hi in ((-2, 3), (0, 0), (1, 4)):
        pairs = {(i, j) for i, t, k in a for j, u, m in b if t is not None and u is not None and k == m and lo <= u - t <= hi}
        for how in ("inner", "left", "right", "full"):
            want = set(pairs)
            if how in ("left", "full"):
                want |= {(i, None) for i, _, _ in a if i not in {p for p, _ in pairs}}
            if how in ("right", "full"):
                want |= {(None, j) for j, _, _ in b if j not in {q for _, q in pairs}}
            got = [(x["i"], x["j"]) for x in W.interval_join_rows(l, r, "t", "u", lo, hi, {"i": "i"}, {"j": "j"}, ["k"], how).collect()]
            assert len(got) == len(set(got)) and set(got) == want, (lo, hi, how)


def test_asof_defaults_and_shards(spark):
    l = spark.createDataFrame([(1, 5, None), (2, 50, None), (3, 500, "a")], "i int, t bigint, k string")
    r = spark.createDataFrame([(7, 5, None), (8, 6, None)], "j int, u bigint, k string")
    for shard in (None, 10):
        got = {x["i"]: x["j"] for x in W.asof_join(l, r, "t", "u", {"i": "i"}, {"j": "j"}, ["k"], defaults={"j": -1}, shard=shard).collect()}
        assert got == {1: 7, 2: 8, 3: -1}


def test_streams(spark):
    ch = spark.createDataFrame([("x", 1, 2, 1), ("x", 1, 4, -1), ("y", 2, 2, 1), ("y", 2, 4, -1), ("y", 3, 4, 1)], "id string, v int, _time int, _diff int")
    assert {(r["id"], r["v"]) for r in C.current(ch).collect()} == {("y", 3)}
    assert {(r["id"], r["_time"], r["is_upsert"]) for r in C.to_stream(ch).collect()} == {("x", 2, True), ("x", 4, False), ("y", 2, True), ("y", 4, True)}
    assert {(r["_time"], r["id"]) for r in C.snapshots(ch).collect()} == {(2, "x"), (2, "y"), (4, "y")}
    with pytest.raises(Exception, match="taken back"):
        C.assert_append_only(ch).collect()


def test_iterate_stops(spark):
    df = spark.createDataFrame([(1,), (100,)], "n bigint")
    halve = lambda n: n.select(F.greatest(F.floor(F.col("n") / 2), F.lit(1)).alias("n"))
    assert [r["n"] for r in G.iterate(halve, n=df).collect()] == [1, 1] and {r["n"] for r in G.iterate(halve, 2, n=df).collect()} == {1, 25}


def test_pagerank_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")], "u string, v string")
    assert G.pagerank(e, 20).count() == 3


def test_louvain_finds_cliques(spark):
    cliques = [(a + i, a + j, 1.0) for a in (0, 10, 20) for i in range(5) for j in range(5) if i != j] + [(0, 10, 1.0), (10, 0, 1.0), (10, 20, 1.0), (20, 10, 1.0)]
    e = spark.createDataFrame(cliques, "u bigint, v bigint, weight double")
    c = {r["v"]: r["c"] for r in G.louvain(e, 1, 12).collect()}
    assert all(len({c[a + i] for i in range(5)}) == 1 for a in (0, 10, 20)) and len({c[0], c[10], c[20]}) == 3


def test_filters_and_globs(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 3}, "path": "x/y/z.md", "tags": ["p"]}'), (2, '{"a": {"b": 1}}'), (3, None)], "i int, m string")
    ask = lambda e: {r["i"] for r in df.where(X.metadata_filter(e, F.col("m"))).collect()}
    assert ask("a.b > `2`") == {1} and ask("globmatch('x/**/*.md', path)") == {1} and ask("!(a.b == `1`)") == {1, 3} and ask("contains(tags, 'p') || a.b == `1`") == {1, 2}
    with pytest.raises(ValueError):
        X.metadata_filter("a $ b", F.col("m"))


def test_knn_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "i int, v array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "q int, v array<double>")
    assert [(r["data_id"], r["rank"]) for r in X.knn(d, "i", "v", q, "q", "v", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert X.knn(d, "i", "v", q.limit(0), "q", "v", 2).count() == 0


def test_retries_and_failures(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x

    assert U.with_retries(flaky, U.FixedDelay(3, 1))(5) == 5 and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        U.with_retries(lambda x: x / 0, U.NoRetry())(1)
    cache = U.InMemoryCache(2)
    f = U.with_cache(lambda x: calls.append(x) or x, cache)
    assert f(1) == f(1) == 1 and calls.count(1) == 1


def test_markdown_and_envelopes(spark):
    t = IO.table_from_markdown(spark, "  | a | b\n1 | 2 | x\n2 | None | y")
    assert t.dtypes == [("id", "bigint"), ("a", "bigint"), ("b", "string")] and t.count() == 2
    raw = spark.createDataFrame([('{"payload": {"op": "u", "before": {"k": 1}, "after": {"k": 2}}}',), ('{"op": "c", "after": {"k": 3}}',)], "value string")
    assert {(r["k"], r["_diff"]) for r in IO.read_change_envelopes(raw, "k: bigint").collect()} == {(1, -1), (2, 1), (3, 1)}


def test_chunks():
    t = "One two three. Four five six seven.\n\nEight nine " + "x" * 400
    assert "".join(P.token_chunks(t, 2, 5)) == t and all(len(c) <= 50 for c in P.recursive_chunks(t, 50))
    assert P.token_chunks("", 1, 5) == []


def _brute_pairs(left, right, within):
    """Scores of all pairs that share a feature held by fewer than 100 rows."""
    from collections import Counter
    from math import ceil, log2

    a, b = {i: Counter(t) for i, t in left.items()}, {i: Counter(t) for i, t in right.items()}
    held = Counter(f for x in (a, *([] if within else [b])) for c in x.values() for f in c)
    score = {}
    for i, x in a.items():
        for j, y in b.items():
            both = x.keys() & y.keys()
            if not (within and i == j) and any(held[f] < 100 for f in both):
                score[i, j] = round(sum(x[f] * y[f] / ceil(log2(held[f] + 1)) for f in both), 9)
    return score


def test_fuzzy_matches_of_many_rows_by_brute_force(spark):
    """Letters that 100 rows or more hold add to the weight of pairs, in both kinds of match, and partners are sought both ways."""
    import random

    from rillstone.operators import fuzzy as Z

    rng = random.Random(5)
    texts = {i: "".join(rng.choices("etaoin", k=6) + rng.choices("bcdfghjklmpq", k=2)) for i in range(130)}
    other = {i: "".join(rng.choices("etaoin", k=6) + rng.choices("bcdfghjklmpq", k=2)) for i in range(120)}
    df = lambda t: spark.createDataFrame(list(t.items()), "i bigint, t string")
    got = lambda d: {(r["left_id"], r["right_id"]): round(r["weight"], 6) for r in d.collect()}

    def best(score, rank):
        first = {}
        for p in score:
            first[p[0]] = max(first.get(p[0], p), p, key=rank)
        second = {}
        for p in first.values():
            second[p[1]] = max(second.get(p[1], p), p, key=rank)
        return {p: round(score[p], 6) for p in second.values()}

    s = _brute_pairs(texts, texts, True)
    want = {p: w for p, w in best(s, lambda p: (s[p], -min(p), -max(p))).items() if p[0] < p[1]}
    assert got(Z.fuzzy_self_match(df(texts), "i", "t", features=Z.letters)) == want and len(want) > 5
    m = _brute_pairs(texts, other, False)
    assert got(Z.fuzzy_match(df(texts), df(other), "i", "t", "i", "t", features=Z.letters)) == best(m, lambda p: (m[p], -p[1], -p[0]))


def test_fuzzy_matches_send_no_features_through_the_driver(spark, sf):
    """Small files hold many features: no join of them is a broadcast, as planned from the files and as run."""
    from rillstone.operators import fuzzy as Z

    c = table_of(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("t"))
    for out, count in ((Z.fuzzy_match(c, c, "i", "t", "i", "t"), c.count()), (Z.fuzzy_self_match(c, "i", "t"), None)):
        plan = out._jdf.queryExecution().executedPlan()
        assert "Broadcast" not in plan.toString()
        rows = out.collect()
        assert "Broadcast" not in plan.toString()
        if count:
            assert sorted((r["left_id"], r["right_id"]) for r in rows) == [(i, i) for i in range(count)]


def test_deduplicate_keeps_null_keys_apart(spark):
    """A null instance is one of its own, whatever texts others have."""
    from rillstone.streaming.changes import deduplicate

    df = spark.createDataFrame([(None, 1, 1), ("∅", 5, 2), (None, 4, 3), ("∅", 2, 4), ("None", 3, 5)], "k string, v int, t int")
    got = deduplicate(df, ["k"], "v", ["t"], lambda new, old: new > old).collect()
    assert sorted((str(r["k"]) + "!" * (r["k"] is None), r["v"]) for r in got) == [("None", 3), ("None!", 4), ("∅", 5)]


def _most_rows(df) -> int:
    """The most rows that any step of the plan put out when df was collected."""

    def steps(p):
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []
        children = p.children()
        for x in [*inner, *(children.apply(i) for i in range(children.size()))]:
            yield from steps(x)
        m = p.metrics().get("numOutputRows")
        if m.isDefined():
            yield m.get().value()

    return max(steps(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("instance", [[], ["i"]])
def test_buffered_rows_by_brute_force(spark, instance):
    """Rows come out as if every batch were looked at, null instances, times and batches and repeated rows included, without meeting the batches one by one."""
    import random

    rng = random.Random(3)
    rows = [(n, rng.choice([None, 1, 2]), rng.choice([None, *range(0, 60000, 7)]), rng.choice([None, *range(400)])) for n in range(3000)]
    rows = [(n, i, t if t is None or b is None else t // 4 + 100 * b, b) for n, i, t, b in rows]
    rows += rows[:20]
    group = lambda i: i if instance else 0
    top, now = {}, {}
    for _, i, t, b in rows:
        if t is not None:
            top[group(i), -1 if b is None else b] = max(t, top.get((group(i), -1 if b is None else b), t))
    for g in {g for g, _ in top}:
        m = None
        for b in range(-1, 400):
            m = max((x for x in (m, top.get((g, b))) if x is not None), default=None)
            now[g, b] = m
    held = {(group(i), b) for _, i, _, b in rows}

    def first(i, t, b):
        ok = lambda c: (group(i), c) in held and now[group(i), c] is not None and now[group(i), c] >= t + 900
        return None if t is None or b is None else next((c for c in range(b, 400) if ok(c)), None)

    known = lambda x: -1 if x is None else x
    want = sorted((n, known(first(i, t, b))) for n, i, t, b in rows)
    df = spark.createDataFrame(rows, "n int, i int, t bigint, _time int")
    out = C.buffered(df, F.col("t") + 900, "t", instance)
    got = sorted((r["n"], known(r["_out"])) for r in out.collect())
    assert got == want and len({b for _, b in want}) > 100
    assert _most_rows(out) <= 4 * len(rows)
