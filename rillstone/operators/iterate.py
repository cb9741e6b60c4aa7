"""Fixpoints and graph algorithms. Each round is written to the shared folder, so plans stay flat and lost executors cost one round."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def iterate(step: Callable[..., DataFrame | Mapping[str, DataFrame]], limit: int | None = None, key: Sequence[str] | None = None, **tables: DataFrame):
    """step(**tables) again and again until nothing changes, or limit rounds.

    What step returns replaces the tables of those names. The end is seen by one
    row: whether any row differs between a round and the one before.
    """
    now = dict(tables)
    single = None
    done = 0
    while limit is None or done < limit:
        got = step(**now)
        if single is None:
            single = not isinstance(got, Mapping)
        got = {next(iter(tables)): got} if single else dict(got)
        got = {k: written(v) for k, v in got.items()}
        changed = any(_differ(now[k], v) for k, v in got.items())
        now |= got
        done += 1
        if not changed:
            break
    return now[next(iter(tables))] if single else now


def _differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables differ as bags, by counting rows on both sides in one aggregation."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    return not both.groupBy(*cols).agg(F.sum("_d").alias("_d")).where("_d <> 0").limit(1).isEmpty()


def pagerank(edges: DataFrame, steps: int = 5, u: str = "u", v: str = "v") -> DataFrame:
    """``v``, ``rank``: integer ranks, 1000 plus a sixth of what comes in five sixths of each rank, starting from 6000."""
    e = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")))
    deg = e.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    vertices = written(e.select("u").union(e.select(F.col("v"))).distinct().join(deg, "u", "left").select(F.col("u").alias("v"), F.coalesce("deg", F.lit(0)).alias("deg")))
    ranks = vertices.select("v", F.lit(6000).cast("bigint").alias("rank"))
    for _ in range(steps):
        flow = ranks.join(vertices, "v").select(F.col("v").alias("u"), F.when(F.col("deg") == 0, F.lit(0)).otherwise(F.expr("(rank * 5) div (deg * 6)")).alias("flow"))
        got = e.join(flow, "u").groupBy("v").agg(F.sum("flow").alias("in"))
        ranks = written(vertices.select("v").join(got, "v", "left").select("v", (F.coalesce("in", F.lit(0)) + 1000).cast("bigint").alias("rank")))
    return ranks


def bellman_ford(vertices: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``v``, ``dist`` from the vertices with ``is_source``; infinity where there is no way. edges: u, v, dist."""
    inf = F.lit(float("inf"))
    start = written(vertices.select("v", F.when(F.col("is_source"), F.lit(0.0)).otherwise(inf).alias("dist")))
    e = written(edges.select("u", "v", F.col("dist").cast("double").alias("w")))

    def relax(state: DataFrame) -> DataFrame:
        near = state.where(F.col("dist") < inf).select(F.col("v").alias("u"), "dist")
        found = e.join(near, "u").groupBy("v").agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        return state.join(found, "v", "left").select("v", F.least("dist", F.coalesce("new", inf)).alias("dist"))

    return iterate(relax, limit, state=start)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``v``, ``component`` (its least vertex): the least label of the neighbours is taken over, and labels jump to their label's label."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    e = written(e.union(e.select("v", "u")).where("u is not null and v is not null").distinct())
    labels = written(e.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("component")))

    def step(state: DataFrame) -> DataFrame:
        near = e.join(state.select(F.col("v").alias("u"), "component"), "u").groupBy("v").agg(F.min("component").alias("near"))
        low = state.join(near, "v").select("v", F.least("component", "near").alias("c"))
        up = low.select(F.col("v").alias("c"), F.col("c").alias("up"))
        return low.join(up, "c", "left").select("v", F.least("c", F.coalesce("up", "c")).alias("component"))

    return iterate(step, state=labels)


def contract(edges: DataFrame, clusters: DataFrame, weight: str = "weight") -> DataFrame:
    """The graph of clusters: ``u``, ``v`` (clusters), summed weight. clusters: v, c; a vertex without one stands for itself."""
    a = clusters.select(F.col("v").alias("u"), F.col("c").alias("cu"))
    b = clusters.select("v", F.col("c").alias("cv"))
    j = edges.join(a, "u", "left").join(b, "v", "left")
    j = j.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), weight)
    return j.groupBy("u", "v").agg(F.sum(weight).alias(weight))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def modularity(edges: DataFrame, clusters: DataFrame, digits: int = 16) -> DataFrame:
    """``modularity`` of a clustering: the sum over clusters of (internal m - degree squared) / m squared. Edges go both ways."""
    g = contract(edges, clusters)
    total = g.agg(F.sum("weight").alias("m"))
    deg = g.groupBy(F.col("u").alias("c")).agg(F.sum("weight").alias("deg"), F.sum(F.when(F.col("u") == F.col("v"), F.col("weight")).otherwise(0)).alias("inner"))
    one = deg.crossJoin(F.broadcast(total))
    return one.agg(F.round(F.sum((F.col("inner") * F.col("m") - F.col("deg") * F.col("deg")) / (F.col("m") * F.col("m"))), digits).alias("modularity"))


def louvain_level(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``v``, ``c``: one level of moves that raise modularity, starting from single vertices.

    edges: u, v, weight, both ways. In a round every vertex finds its best
    cluster; moves are then made independent: of all moves that touch a cluster
    only the one of the highest priority (a hash of vertex and round) is made.
    """
    e = written(edges.groupBy("u", "v").agg(F.sum("weight").cast("double").alias("w")))
    deg = written(e.groupBy(F.col("u").alias("v")).agg(F.sum("w").alias("deg")))
    m = deg.agg(F.sum("deg")).first()[0] or 1.0
    own = written(deg.select("v", F.col("v").alias("c")))
    for i in range(rounds):
        size = own.join(deg, "v").groupBy("c").agg(F.sum("deg").alias("cdeg"))
        to = e.where("u <> v").join(own.select("v", "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        cand = to.unionByName(own.select(F.col("v").alias("u"), "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        x = cand.join(deg.select(F.col("v").alias("u"), "deg"), "u").join(size, "c").join(own.select(F.col("v").alias("u"), F.col("c").alias("now")), "u")
        rest = F.when(F.col("c") == F.col("now"), F.col("cdeg") - F.col("deg")).otherwise(F.col("cdeg"))
        x = x.withColumn("gain", 2 * F.col("w") - F.col("deg") * (2 * rest + F.col("deg")) / F.lit(m))
        best = x.groupBy("u", "now").agg(F.max(F.struct("gain", (F.col("c") == F.col("now")).alias("stay"), F.col("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stays"))
        moves = best.where("b.c <> now and b.gain > stays + 1e-12").select("u", "now", F.col("b.c").alias("c"), F.xxhash64("u", F.lit(i)).alias("p"))
        moves = written(moves)
        if moves.isEmpty():
            break
        touched = moves.select(F.col("now").alias("k"), "p", "u").union(moves.select("c", "p", "u")).groupBy("k").agg(F.max(F.struct("p", "u")).alias("top"))
        won = moves.join(touched.select(F.col("k").alias("now"), F.col("top.u").alias("t1")), "now").join(touched.select(F.col("k").alias("c"), F.col("top.u").alias("t2")), "c").where("u = t1 and u = t2")
        own = written(own.join(won.select(F.col("u").alias("v"), F.col("c").alias("new")), "v", "left").select("v", F.coalesce("new", "c").alias("c")))
    return own


def louvain(edges: DataFrame, levels: int = 2, rounds: int = 10) -> DataFrame:
    """``v``, ``c``: clusters after several levels, each on the contracted graph of the one before. edges: u, v, weight, both ways."""
    own = louvain_level(edges, rounds)
    graph = edges.select("u", "v", "weight")
    for _ in range(levels - 1):
        graph = written(contract(edges, own))
        up = louvain_level(graph, rounds).select(F.col("v").alias("c"), F.col("c").alias("top"))
        own = written(own.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c")))
    return own


def reachable(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """``v``: vertices on a way from start (column v), itself among them; only the newest ones are followed in each round."""
    e = written(edges.select("u", "v").distinct())
    seen = new = written(start.select("v").distinct())
    n = 0
    while limit is None or n < limit:
        new = written(e.join(new.select(F.col("v").alias("u")), "u").select("v").distinct().join(seen, "v", "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        n += 1
    return seen


def along_pointers(df: DataFrame, id_col: str, pointer: str, value: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """A recursive attribute: value combined with those of all rows that the pointers lead to, by doubling the stride each round.

    df with ``total``; pointers end in null. combine must be associative.
    """
    state = written(df.select(F.col(id_col).alias("i"), F.col(pointer).alias("p"), value.alias("x")))
    while not state.where("p is not null").limit(1).isEmpty():
        ahead = state.select(F.col("i").alias("p"), F.col("p").alias("pp"), F.col("x").alias("xx"), F.lit(True).alias("hit"))
        j = state.join(ahead, "p", "left")
        state = written(j.select("i", F.col("pp").alias("p"), F.when(F.col("hit"), combine(F.col("x"), F.col("xx"))).otherwise(F.col("x")).alias("x")))
    return df.join(state.select(F.col("i").alias(id_col), F.col("x").alias("total")), id_col)


def viterbi_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], observed: str, states: Sequence[str], start: Sequence[str], moves: Mapping[tuple[str, str], float], emit: Callable[[str, object], float], beam: int | None = None, keep: int | None = None) -> DataFrame:
    """``path`` array<string> per group: the likeliest states of a hidden Markov model, by log scores.

    moves: log probability of a state after another; emit(state, observed): log
    probability. beam: states kept per step. keep: last states that are told.
    A group is folded in one task, its rows in order.
    """
    number = {s: i for i, s in enumerate(states)}
    into: dict[int, list[tuple[int, float]]] = {}
    for (a, b), w in moves.items():
        into.setdefault(number[b], []).append((number[a], w))

    @F.pandas_udf("array<string>")
    def decode(*columns: pd.Series) -> object:
        rows = pd.concat(list(columns), axis=1, ignore_index=True)
        rows = rows.sort_values(list(range(1, rows.shape[1])), kind="stable") if rows.shape[1] > 1 else rows
        score: dict[int, float] = {}
        back: list[dict[int, int]] = []
        for n, o in enumerate(rows[0]):
            if n == 0:
                score = {number[s]: emit(s, o) for s in start}
                back.append({})
            else:
                new, via = {}, {}
                for b, froms in into.items():
                    best = max(((score[a] + w, a) for a, w in froms if a in score), default=None)
                    if best is not None:
                        new[b], via[b] = best[0] + emit(states[b], o), best[1]
                score = new
                back.append(via)
            if beam and len(score) > beam:
                score = dict(sorted(score.items(), key=lambda x: (x[1], x[0]), reverse=True)[:beam])
        if not score:
            return []
        at = max(score.items(), key=lambda x: (x[1], x[0]))[0]
        path = [at]
        for via in reversed(back[1:]):
            at = via[at]
            path.append(at)
        path = path[::-1]
        return [states[i] for i in (path[-keep:] if keep else path)]

    return df.groupBy(*group).agg(decode(F.col(observed), *[F.col(o) for o in order]).alias("path"))


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
