"""Implausible readings: an isolation forest per source, with physical limits and level checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL, LEVEL, UPWARD = 0, 1, 2
#: Readings that are looked at ahead of a total; two below it make it no mark.
AHEAD = 3
#: reasons, as bits
LIMIT, BACKWARDS, SPIKE, STUCK = 1, 2, 4, 8
REASONS = ("limit", "backwards", "spike", "stuck")


@dataclass(frozen=True)
class Rules:
    """factor: how far a spike leaves the level around it. reach: readings on each side that make the level.
    longest: readings that a spike may last. stuck: identical consecutive readings that count as stuck.
    trees, sample: of each forest. near: share of the way (in logarithms) to ``factor`` or ``stuck`` from which on a reading is put
    to the forest. spike_score, stuck_score: where between a source's usual score and that of readings made implausible on
    purpose its cutoff lies. season: ms of the cycle of the seasonal feature, cut into phases."""

    factor: float = 4.0
    reach: int = 8
    longest: int = 6
    stuck: int = 12
    trees: int = 24
    sample: int = 256
    near: float = 0.35
    spike_score: float = 0.75
    stuck_score: float = 0.9
    season: int = 600_000
    phases: int = 10
    seed: int = 17


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of public splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = n.astype(float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(seg: np.ndarray, seeds: np.ndarray, x: np.ndarray, train: np.ndarray, always: np.ndarray, rules: Rules) -> np.ndarray:
    """Isolation scores in (0, 1) of all rows, one forest per segment, the forests of all segments grown at once.

    seg: segment number of each row; seeds: a number per segment; x: features, one row per feature; train: rows
    that trees are grown from, a random sample of about rules.sample of them per segment for each tree; always: rows that
    every tree is grown from besides.
    """
    n, nseg = len(seg), len(seeds)
    share = np.minimum(1.0, rules.sample / np.maximum(np.bincount(seg[train], minlength=nseg), 1))
    usual = np.bincount(seg[train], minlength=nseg) * share + np.bincount(seg[always], minlength=nseg)
    depth = int(np.ceil(np.log2(max(2.0, usual.max(initial=2)))))
    rows, total = np.arange(n), np.zeros(n)
    flat = np.ascontiguousarray(x).ravel()
    all_of_them = bool((share >= 1).all())
    for t in range(rules.trees):
        own = train
        if not all_of_them:
            lot = _mix(seeds[seg[train]] ^ _mix(train.astype(np.uint64) + np.uint64(t << 40)))
            own = train[(lot >> np.uint64(11)).astype(float) / 2.0**53 < share[seg[train]]]
        own = np.concatenate([own, always])
        node = seg.astype(np.int64)
        length = np.zeros(n)
        for d in range(depth):
            many = nseg << d
            ids = np.arange(many, dtype=np.uint64)
            h = _mix(np.repeat(seeds, 1 << d) + _mix(ids % np.uint64(1 << d) + np.uint64((1 << d) + (t << 20) + rules.seed * 1_000_003)))
            feature = ((h >> np.uint64(40)) % np.uint64(len(x))).astype(np.int64)
            frac = (h & np.uint64((1 << 32) - 1)).astype(float) / 2.0**32
            v = flat[feature[node] * n + rows]
            lo, hi = np.full(many, np.inf), np.full(many, -np.inf)
            np.minimum.at(lo, node[own], v[own])
            np.maximum.at(hi, node[own], v[own])
            splits = hi > lo
            with np.errstate(invalid="ignore"):
                at = np.where(splits, lo + frac * (hi - lo), np.inf)
            length += splits[node]
            node = node * 2 + (v > at[node])
        total += length + _usual_path(np.bincount(node[own], minlength=nseg << depth))[node]
    return np.exp2(-total / rules.trees / np.maximum(_usual_path(usual), 1.0)[seg])


def _around(v: np.ndarray, seg: np.ndarray, reach: int) -> np.ndarray:
    """Median of the readings within reach on both sides, of the same segment; NaN readings don't count."""
    n = len(v)
    pad = np.concatenate([np.full(reach, np.nan), v, np.full(reach, np.nan)])
    pseg = np.concatenate([np.full(reach, -1), seg, np.full(reach, -1)])
    w = np.lib.stride_tricks.sliding_window_view(pad, 2 * reach + 1).copy()
    w[np.lib.stride_tricks.sliding_window_view(pseg, 2 * reach + 1) != seg[:, None]] = np.nan
    w.sort(axis=1)
    k = (~np.isnan(w)).sum(axis=1)
    r = np.arange(n)
    mid = (w[r, np.maximum(k - 1, 0) // 2] + w[r, np.minimum(k // 2, 2 * reach)]) / 2
    return np.where(k > 0, mid, np.nan)


def _runs(change: np.ndarray) -> np.ndarray:
    """Length of the run that each row is in; change is true where a run starts."""
    run = np.cumsum(change) - 1
    return np.bincount(run)[run]


def _marks(seg: np.ndarray, ok: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Readings that later totals are held against, else -inf: a reading that the next ones fall below is none.

    after: AHEAD readings that follow each segment, or NaN.
    """
    n = len(ok)
    end = np.searchsorted(seg, seg, side="right")
    ahead = np.full((AHEAD, n), np.nan)
    for j in range(AHEAD):
        at = np.arange(n) + j + 1
        beyond = np.nan if after is None else after[seg, np.clip(at - end, 0, AHEAD - 1)]
        ahead[j] = np.where(at < end, ok[np.minimum(at, n - 1)], beyond)
    with np.errstate(invalid="ignore"):
        jutting = (ahead < ok).sum(axis=0) >= 2
    return np.where(np.isnan(ok) | jutting, -np.inf, ok)


def _span(seg: np.ndarray, v: np.ndarray, good: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest good reading of each segment; inf and -inf if there is none."""
    lo, hi = np.full(many, np.inf), np.full(many, -np.inf)
    np.minimum.at(lo, seg[good], v[good])
    np.maximum.at(hi, seg[good], v[good])
    return lo, hi


def _checked(seg: np.ndarray, v: np.ndarray, kind: np.ndarray, before: np.ndarray, rules: Rules, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(limit, backwards, spike, ratio to the level around) of each reading; see judge."""
    n = len(v)
    start = np.r_[True, seg[1:] != seg[:-1]]
    limit = (v < 0) | np.isinf(v)
    ok = np.where(limit, np.nan, v)
    mark = np.fmax(_marks(seg, ok, after), np.where(np.isnan(before), -np.inf, before))
    # running maximum within segments: ranks make the segments' values comparable
    rank = np.argsort(np.argsort(mark, kind="stable"), kind="stable").astype(np.int64)
    top = np.maximum.accumulate(rank + seg * n) - seg * n
    by_rank = np.sort(mark, kind="stable")
    high = by_rank[top]
    backwards = (kind == TOTAL) & ~limit & (ok < high)
    # level
    level = _around(np.where(backwards, np.nan, ok), seg, rules.reach)
    ratio = np.log((np.where(limit, np.nan, np.maximum(ok, 1.0))) / np.maximum(level, 1.0))
    ratio = np.where(np.isnan(ratio), 0.0, ratio)
    far = np.log(rules.factor) - 1e-9
    off = ((kind == LEVEL) & (np.abs(ratio) >= far)) | ((kind == UPWARD) & (ratio >= far))
    off &= ~limit
    length = _runs(start | np.r_[True, off[1:] != off[:-1]])
    return limit, backwards, off & (length <= rules.longest), ratio


def _implausible(rules: Rules) -> np.ndarray:
    """Features of readings that are implausible by the least measure, one column each: spikes that last and spikes of one
    reading, up and down, and a stuck reading."""
    far, long = np.log(rules.factor), np.log(rules.stuck)
    return np.round([[far, 0, far, 0], [far, far, far, 0], [-far, 0, -far, 0], [-far, -far, -far, 0], [0, 0, 0, long]], 9).T


def _features(seg: np.ndarray, t: np.ndarray, ok: np.ndarray, limit: np.ndarray, ratio: np.ndarray, same: np.ndarray, many: int, rules: Rules) -> np.ndarray:
    """Level, difference, seasonal residual (in logarithms) and run length of each reading, one row each.

    All of them end where a reading counts as implausible, so that one wild reading doesn't hide
    others. The difference is that to both neighbours, so a reading beside a spike has none.
    """
    far = np.log(rules.factor)
    lv = np.log(np.maximum(ok, 1.0))
    start, n = np.r_[True, seg[1:] != seg[:-1]], len(seg)
    end = np.r_[start[1:], True]
    back, ahead = np.full(n, np.nan), np.full(n, np.nan)
    back[1:], ahead[:-1] = lv[1:] - lv[:-1], lv[:-1] - lv[1:]
    back[start], ahead[end] = np.nan, np.nan
    with np.errstate(invalid="ignore"):
        both = np.where(back * ahead > 0, np.sign(back) * np.minimum(np.abs(back), np.abs(ahead)), 0.0)
    phase = seg * rules.phases + (t % rules.season) * rules.phases // rules.season
    have, m = ~np.isnan(lv), many * rules.phases
    mean = np.bincount(phase[have], lv[have], m) / np.maximum(np.bincount(phase[have], minlength=m), 1)
    seasonal = np.where(have, lv - mean[phase], 0.0)
    x = np.vstack([np.where(limit, -far, ratio), both, seasonal, np.log(same.astype(float))])
    x[:3] = np.clip(x[:3], -far, far)
    x[3] = np.minimum(x[3], np.log(rules.stuck))
    return np.round(x, 9)  # equal readings stay equal, whatever their mean is rounded to


def judge(
    seg: np.ndarray, seeds: np.ndarray, t: np.ndarray, v: np.ndarray, kind: np.ndarray, before: np.ndarray, rules: Rules,
    after: np.ndarray | None = None, moves: np.ndarray | None = None, same: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(score, reasons) of each reading. Rows are by segment and time; before: greatest plausible total of earlier
    shards, or NaN; after: see _marks; moves: of each segment, whether its source has different plausible values in
    all its shards (default: in this segment); same: identical consecutive readings around each (default: in this segment)."""
    n, many = len(v), len(seeds)
    start = np.r_[True, seg[1:] != seg[:-1]]
    limit, backwards, spike, ratio = _checked(seg, v, kind, before, rules, after)
    ok = np.where(limit, np.nan, v)
    # identical values; a series that is constant, but for what is wrong in it, is not stuck
    changes = start | np.r_[True, v[1:] != v[:-1]]
    same = _runs(changes) if same is None else same
    good = ~(limit | spike | backwards)
    if moves is None:
        lo, hi = _span(seg, v, good, many)
        moves = lo < hi
    # the forest: grown from a reading of each run (a long run would hide itself) and readings made implausible on purpose
    wrong = _implausible(rules)
    each = wrong.shape[1]
    x = np.hstack([_features(seg, t, ok, limit, ratio, same, many, rules), np.repeat(wrong, many, axis=1)])
    score = isolation_scores(np.r_[seg, np.tile(np.arange(many), each)], seeds, x, np.flatnonzero(changes), n + np.arange(many * each), rules)
    made, score = score[n:].reshape(each, many), score[:n]
    runs, by = np.bincount(seg[changes], minlength=many), np.lexsort((score[changes], seg[changes]))
    usual = score[changes][by][np.cumsum(runs) - runs + runs // 2]  # a long run counts once here as well
    cut = lambda least, share: (usual + share * (least - usual))[seg] - 1e-9
    # what is put to the forest: readings off their level for a while, and runs of identical ones
    with np.errstate(invalid="ignore"):
        near = ~limit & (kind != TOTAL) & (np.where(kind == LEVEL, np.abs(ratio), ratio) >= rules.near * np.log(rules.factor))
    near &= _runs(start | np.r_[True, near[1:] != near[:-1]]) <= rules.longest
    above, below = made[:2].min(axis=0), made[2:4].min(axis=0)
    spike = near & (score >= np.where(ratio > 0, cut(above, rules.spike_score), cut(below, rules.spike_score)))
    stuck = ~limit & ~spike & (kind != TOTAL) & moves[seg] & (np.log(same) >= rules.near * np.log(rules.stuck)) & (score >= cut(made[4], rules.stuck_score))
    reasons = LIMIT * limit + BACKWARDS * backwards + SPIKE * spike + STUCK * stuck
    return score, reasons.astype(np.int32)


def flag_readings(
    df: DataFrame,
    source: Sequence[str],
    time: str,
    value: str,
    kind: Column,
    order: str | None = None,
    rules: Rules | None = None,
    shard: int = 86_400_000,
    halo: int = 3_600_000,
) -> DataFrame:
    """Every reading with its isolation score and the reasons why it is implausible.

    Result: the source columns, ``time``, ``value``, ``score`` double and
    ``reasons`` array<string> (empty: plausible). ``limit`` (negative or
    infinite) and ``backwards`` (a total below an earlier plausible one) are
    explicit rules. ``spike`` (for at most ``rules.longest`` readings far off the
    level around it) and ``stuck`` (many identical consecutive readings of a
    source that otherwise moves) are what the forest says. ``kind`` says what a
    source is: ``total`` (never falls), ``level`` (spikes in either direction),
    ``upward`` (spikes upwards only).

    A forest is grown per source and time shard, every tree from its own random
    sample of about ``rules.sample`` readings and from a few that are made
    implausible on purpose: at ``rules.factor`` times the level, and in a run of
    ``rules.stuck``. It scores all readings. The cutoff of a source lies between
    its usual score and that of the made ones; readings on the way to either
    measure (``rules.near``) are flagged when they reach it.

    Readings are shuffled once, by source and time shard; those within ``halo``
    of a shard's border also go to the neighbour. What a shard has to know of the
    others is carried over: the greatest mark among the totals of earlier shards,
    as judged with the readings that follow in later ones; the length of the run
    of identical readings at each border; and whether the source otherwise
    moves. So a source that holds a third of all rows spreads over many tasks
    and sees no cut. Python holds about a hundred thousand readings at a time.

    Defined cases: rows with a null time or a null or NaN value are no
    readings; rows of one source and time count once, the greatest ``order``
    holding (ties: the greatest value); null source columns are values like
    others; a null kind is ``upward``; an empty table gives an empty table;
    other columns are dropped and may have any name.
    """
    rules = rules or Rules()
    src = list(source)
    shard_of = lambda t: f"{t} - pmod({t}, {shard}L)"
    r = df.select(
        F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(src)]).alias("_k"),
        F.col(time).cast("bigint").alias("_t"),
        F.col(value).cast("double").alias("_v"),
        (F.col(order) if order else F.lit(0)).alias("_o"),
        F.when(kind == "total", TOTAL).when(kind == "level", LEVEL).otherwise(UPWARD).alias("_kind"),
    ).where("_t is not null and _v is not null and not isnan(_v)")
    s = r.withColumn("_s", F.explode(F.expr(f"array_distinct(array({shard_of('_t')}, {shard_of(f'(_t - {halo}L)')}, {shard_of(f'(_t + {halo}L)')}))")))
    s = s.repartition("_k", "_s").groupBy("_k", "_s", "_t").agg(F.max(F.struct("_o", "_v", "_kind")).alias("_x"))
    s = s.select("_k", "_s", "_t", "_x._v", "_x._kind")
    s = s.select("*", F.xxhash64("_k", "_s").alias("_h"), F.hash("_k", "_s").alias("_h2"))
    k = "_k " + s.schema["_k"].dataType.simpleString()
    sums = s.sortWithinPartitions("_h", "_h2", "_t").mapInArrow(_by_segment(_summed(rules, shard)), f"{k}, _s bigint, _top double, _head array<double>, _tail array<double>, _lo double, _hi double, _n bigint, _first double, _first_run bigint, _last double, _last_run bigint")
    # a row per source and shard: what one shard has to know of the others
    order_s = Window.partitionBy("_k").orderBy("_s")
    sums = sums.withColumn("_next", F.slice(F.flatten(F.collect_list("_head").over(order_s.rowsBetween(1, AHEAD))), 1, AHEAD))
    sound = f"filter(_tail, (x, i) -> x >= 0 and x < double('infinity') and size(filter(slice(concat(_tail, _next), i + 2, {AHEAD}), y -> y >= 0 and y < x)) < 2)"
    sums = sums.withColumn("_top", F.greatest("_top", F.array_max(F.expr(sound))))
    whole = order_s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumn("_moves", F.coalesce(F.min("_lo").over(whole) < F.max("_hi").over(whole), F.lit(False)))
    sums = _with_runs(sums, "_k", "_s")
    sums = sums.select("_k", "_s", "_next", "_moves", "_left", "_right", F.max("_top").over(order_s.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    s = s.join(sums, ["_k", "_s"], "left").sortWithinPartitions("_h", "_h2", "_t")
    out = s.mapInArrow(_by_segment(_judged(rules, shard)), f"{k}, _t bigint, _v double, _score double, _r int")
    bits = [F.when(F.col("_r").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(REASONS)]
    return out.select(
        *[F.col("_k").getField(f"f{i}").alias(c) for i, c in enumerate(src)],
        F.col("_t").alias("time"),
        F.col("_v").alias("value"),
        F.col("_score").alias("score"),
        F.filter(F.array(*bits), lambda x: x.isNotNull()).alias("reasons"),
    )


def _with_runs(sums: DataFrame, source: str, shard: str) -> DataFrame:
    """sums with ``_left`` and ``_right``: identical consecutive readings that lead up to a shard's first and go on after its last reading."""
    for near, near_run, far, far_run, way, out in (("_first", "_first_run", "_last", "_last_run", F.asc, "_left"), ("_last", "_last_run", "_first", "_first_run", F.desc, "_right")):
        w = Window.partitionBy(source).orderBy(way(shard))
        # shards of one value that go on with the run before them belong to one group
        joins = F.coalesce(F.col(near) == F.lag(far).over(w), F.lit(False))
        sums = sums.withColumn("_joins", joins).withColumn("_group", F.sum((~(F.col("_joins") & (F.col(near_run) == F.col("_n")))).cast("int")).over(w))
        sums = sums.withColumn("_so_far", F.sum(far_run).over(Window.partitionBy(source, "_group").orderBy(way(shard))))
        sums = sums.withColumn(out, F.when(F.col("_joins"), F.lag("_so_far").over(w)).otherwise(0)).drop("_joins", "_group", "_so_far")
    return sums


def _by_segment(told: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], hold: int = 100_000):
    """told(rows, first row of each segment, segment of each row) over whole segments, about hold rows at a time."""

    # a segment longer than hold is held whole: its length is bounded by the span of a shard
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            h, h2 = t["_h"].to_numpy(), t["_h2"].to_numpy()
            border = np.flatnonzero((h[1:] != h[:-1]) | (h2[1:] != h2[:-1])) + 1
            end = len(h) if last else (border[-1] if len(border) else 0)
            if end:
                first = np.r_[0, border[border < end]].astype(np.int64)
                seg = np.repeat(np.arange(len(first)), np.diff(np.r_[first, end]))
                yield from told(t.slice(0, end), first, seg).to_batches()
            held, rows = t.slice(end).to_batches(), len(h) - end

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= hold:
                yield from ready(False)
        if rows:
            yield from ready(True)

    return over


def _own(t: pa.Table, shard: int) -> np.ndarray:
    """Readings of the shard itself, not of its halo."""
    when = t["_t"].to_numpy()
    return when - when % shard == t["_s"].to_numpy()


def _summed(rules: Rules, shard: int):
    """A row per segment with readings of its own: of totals the greatest mark but for the last AHEAD readings, the first and
    the last ones, of other sources the least and greatest plausible reading; of all, the runs of identical readings at its ends."""

    def told(t: pa.Table, first: np.ndarray, seg: np.ndarray) -> pa.Table:
        own, v, kind = _own(t, shard), t["_v"].to_numpy(), t["_kind"].to_numpy()
        limit, _, spike, _ = _checked(seg, v, kind, np.full(len(v), np.nan), rules, None)
        lo, hi = _span(seg, v, own & (kind != TOTAL) & ~(limit | spike), len(first))
        seg, v, total = seg[own], v[own], kind[own] == TOTAL
        kept, start, count = np.unique(seg, return_index=True, return_counts=True)
        end = start + count
        mark = _marks(seg, np.where(total & (v >= 0) & np.isfinite(v), v, np.nan))
        mark[np.arange(len(v)) >= np.repeat(end - AHEAD, count)] = -np.inf
        top = np.maximum.reduceat(mark, start) if len(start) else mark
        run = _runs(np.r_[True, (v[1:] != v[:-1]) | (seg[1:] != seg[:-1])]) if len(v) else seg
        ends = {"_n": count, "_first": v[start], "_first_run": run[start], "_last": v[end - 1], "_last_run": run[end - 1]}
        v = np.where(total, v, np.nan)
        few = lambda at, to: pa.array([v[a:b] if total[a] else [] for a, b in zip(at, to, strict=True)], pa.list_(pa.float64()))
        row = pa.array(first[kept])
        return pa.table({
            "_k": t["_k"].take(row), "_s": t["_s"].take(row), "_top": pa.array(top, pa.float64(), mask=np.isinf(top)),
            "_head": few(start, np.minimum(start + AHEAD, end)), "_tail": few(np.maximum(start, end - AHEAD), end),
            "_lo": pa.array(lo[kept], pa.float64(), mask=np.isinf(lo[kept])), "_hi": pa.array(hi[kept], pa.float64(), mask=np.isinf(hi[kept])), **ends,
        })

    return told


def _judged(rules: Rules, shard: int):
    def told(t: pa.Table, first: np.ndarray, seg: np.ndarray) -> pa.Table:
        own = _own(t, shard)
        seeds = _mix(t["_h"].to_numpy()[first].astype(np.uint64))
        when, v = t["_t"].to_numpy(), t["_v"].to_numpy()
        # the halo before a shard comes before what is carried into the shard; that behind it is part of what follows
        before = np.where(when >= t["_s"].to_numpy(), t["_before"].to_numpy().astype(float), np.nan)
        behind = np.bincount(seg, when >= t["_s"].to_numpy() + shard, len(first)).astype(int)
        after = np.full((len(first), AHEAD), np.nan)
        for i, (c, x) in enumerate(zip(behind, t["_next"].take(pa.array(first)).to_pylist(), strict=True)):
            x = (x or [])[c:]
            after[i, : len(x)] = x
        after[(after < 0) | np.isinf(after)] = np.nan
        # a segment whose source has a row in no shard of its own is all halo and told nothing
        moves = np.array(t["_moves"].take(pa.array(first)).fill_null(False).to_pylist(), bool)
        run = np.cumsum(np.r_[True, (v[1:] != v[:-1]) | (seg[1:] != seg[:-1])]) - 1
        length, at = np.bincount(run), np.flatnonzero(own)
        if len(at):  # of the runs at a shard's borders, what lies beyond the halo counts as well
            begin = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1]
            new = np.r_[True, seg[at][1:] != seg[at][:-1]]
            a, b = at[new], at[np.r_[new[1:], True]]
            more = lambda i, c: t[c].take(pa.array(i)).fill_null(0).to_numpy()
            np.add.at(length, run[a], np.maximum(0, more(a, "_left") - (a - begin[run[a]])))
            np.add.at(length, run[b], np.maximum(0, more(b, "_right") - (begin[run[b]] + np.bincount(run)[run[b]] - 1 - b)))
        score, reasons = judge(seg, seeds, when, v, t["_kind"].to_numpy(), before, rules, after, moves, length[run])
        done = pa.table({"_k": t["_k"], "_t": t["_t"], "_v": t["_v"], "_score": score, "_r": pa.array(reasons, pa.int32())})
        return done.filter(pa.array(own))

    return told
