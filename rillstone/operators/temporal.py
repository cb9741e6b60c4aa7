"""Windows over event time, and joins by time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows of times start from Monday, 1 January 1973, if no origin is given; windows of numbers from 0.
MONDAY_1973 = 94_694_400_000_000
START, END = "window_start", "window_end"


@dataclass(frozen=True)
class Sliding:
    """Windows [origin + k hop, origin + k hop + duration). Times count in microseconds."""

    hop: float
    duration: float
    origin: float | None = None


def sliding(hop: float, duration: float | None = None, ratio: int | None = None, origin: float | None = None) -> Sliding:
    return Sliding(hop, duration if duration is not None else hop * (ratio or 1), origin)


def tumbling(duration: float, origin: float | None = None) -> Sliding:
    return Sliding(duration, duration, origin)


@dataclass(frozen=True)
class Session:
    """Rows of one instance whose neighbours are nearer than max_gap, or satisfy predicate(time, next time)."""

    max_gap: float | None = None
    predicate: object = None


@dataclass(frozen=True)
class IntervalsOver:
    """For every value of ``at``, the rows within [at + lower, at + upper]."""

    at: DataFrame
    at_col: str
    lower: float
    upper: float
    outer: bool = True


@dataclass(frozen=True)
class Behavior:
    """delay: results wait until the clock passes window start + delay. cutoff: rows come too late when it has
    passed window end + cutoff. keep_results: whether results of windows that have passed stay."""

    delay: float | None = None
    cutoff: float | None = None
    keep_results: bool = True


def exactly_once(window: Sliding, shift: float = 0) -> Behavior:
    """One result per window, when the clock passes its end + shift."""
    return Behavior(window.duration + shift, shift, True)


def _number(df: DataFrame, time: str) -> tuple[Column, bool]:
    kind = df.schema[time].dataType
    is_time = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    return (F.unix_micros(F.col(time).cast("timestamp")) if is_time else F.col(time)), is_time


def _back(df: DataFrame, time: str, c: Column) -> Column:
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(c.cast("bigint")).cast(kind)
    return c


def assign_windows(df: DataFrame, time: str, window: Sliding | Session, instance: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """A row per row and window that it is in, with ``window_start`` and ``window_end``; rows with a null time are in none."""
    t, is_time = _number(df, time)
    rows = df.where(F.col(time).isNotNull())
    if isinstance(window, Session):
        return _sessions(rows, time, window, instance, tie)
    o = window.origin if window.origin is not None else (MONDAY_1973 if is_time else 0)
    x = t - F.lit(o)
    whole = all(float(v).is_integer() for v in (window.hop, window.duration, o)) and not isinstance(df.schema[time].dataType, (T.DoubleType, T.FloatType))
    hop, dur = (int(window.hop), int(window.duration)) if whole else (float(window.hop), float(window.duration))
    floor = (lambda v: ((v - F.pmod(v, F.lit(hop))) / hop).cast("bigint")) if whole else (lambda v: F.floor(v / hop))
    hi, lo = floor(x), floor(x - dur) + 1
    if window.origin is not None:
        lo = F.greatest(lo, F.lit(0).cast("bigint"))
    k = F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))
    if window.hop == window.duration:
        out = rows.withColumn("_k", hi) if window.origin is None else rows.withColumn("_k", hi).where(F.col("_k") >= 0)
    else:
        out = rows.select("*", k.alias("_k"))
    start = F.col("_k") * F.lit(hop) + F.lit(int(o) if whole else float(o))
    return out.withColumns({START: _back(df, time, start), END: _back(df, time, start + F.lit(dur))}).drop("_k")


def _sessions(df: DataFrame, time: str, window: Session, instance: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Gaps and islands; a gap of max_gap or more starts a new session. A session ends at its last row's time."""
    w = Window.partitionBy(*instance).orderBy(F.col(time), *[F.col(c) for c in tie])
    t, _ = _number(df, time)
    before = F.lag(t).over(w)
    if window.predicate is not None:
        same = window.predicate(F.lag(F.col(time)).over(w), F.col(time))
    else:
        same = (t - before) < F.lit(window.max_gap)
    marked = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    # rows of equal time belong together, in whatever order they come
    numbered = marked.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*instance, "_n")
    return numbered.withColumns({START: F.min(time).over(s), END: F.max(time).over(s)}).drop("_new", "_n")


def windowby(df: DataFrame, time: str, window: Sliding | Session | IntervalsOver, aggs: Mapping[str, Column], instance: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Aggregates per instance and window."""
    if isinstance(window, IntervalsOver):
        return _intervals_over(df, time, window, aggs, instance)
    if isinstance(window, Session):
        t, _ = _number(df, time)
        w = Window.partitionBy(*instance).orderBy(F.col(time), *[F.col(c) for c in tie])
        same = window.predicate(F.lag(F.col(time)).over(w), F.col(time)) if window.predicate is not None else (t - F.lag(t).over(w)) < F.lit(window.max_gap)
        m = df.where(F.col(time).isNotNull()).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
        m = m.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        own = {START: F.min(time), END: F.max(time)}
        return m.groupBy(*instance, "_n").agg(*[c.alias(n) for n, c in {**own, **aggs}.items()]).drop("_n")
    return assign_windows(df, time, window, instance).groupBy(*instance, START, END).agg(*[c.alias(n) for n, c in aggs.items()])


def _intervals_over(df: DataFrame, time: str, window: IntervalsOver, aggs: Mapping[str, Column], instance: Sequence[str]) -> DataFrame:
    at = window.at.select(*instance, F.col(window.at_col).alias("_at")).distinct()
    j = interval_join(at, df, "_at", time, window.lower, window.upper, on=list(instance), how="left" if window.outer else "inner")
    cols = [F.col(f"l.{c}").alias(c) for c in instance] + [F.col("l._at").alias("at")] + [F.col(f"r.{c}").alias(c) for c in df.columns if c not in instance]
    return j.select(*cols).groupBy(*instance, "at").agg(*[c.alias(n) for n, c in aggs.items()])


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: float, upper: float, on: Mapping[str, str] | Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs with left time + lower <= right time <= left time + upper and equal keys (null equal to null), as ``l.x`` and ``r.y``.

    Time is cut into buckets as wide as the interval; a right row goes into the
    two buckets from which it can be reached, so the range becomes an equality
    and the shuffle is by key and bucket: a key that holds a third of all rows
    is spread by time.
    """
    keys = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    width = upper - lower
    lt, _ = _number(left, left_time)
    rt, _ = _number(right, right_time)
    w = width if width > 0 else 1
    floor = lambda c: F.floor(c / F.lit(float(w))) if not float(w).is_integer() else F.floor(c / F.lit(int(w)))
    lk = [F.struct(F.col(l)).alias(f"_k{i}") for i, l in enumerate(keys)]
    rk = [F.struct(F.col(r).alias(l)).alias(f"_k{i}") for i, (l, r) in enumerate(keys.items())]
    l, r = left.withColumn("_t", lt), right.withColumn("_t", rt)
    lb = l.select("*", *lk, floor(F.col("_t")).alias("_b")).where("_t is not null")
    first = floor(F.col("_t") - F.lit(upper))
    rb = r.select("*", *rk, F.explode(F.array_distinct(F.array(first, floor(F.col("_t") - F.lit(lower))))).alias("_b")).where("_t is not null")
    on_cols = [f"_k{i}" for i in range(len(keys))] + ["_b"]
    cond = None
    for c in on_cols:
        e = F.col(f"l.{c}") == F.col(f"r.{c}")
        cond = e if cond is None else cond & e
    d = F.col("r._t") - F.col("l._t")
    cond = cond & (d >= F.lit(lower)) & (d <= F.lit(upper))
    if how not in ("inner", "left"):
        raise ValueError("interval_join is inner or left; interval_join_rows has all kinds")
    return lb.alias("l").join(rb.alias("r"), cond, how)


def interval_join_rows(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: float, upper: float, left_cols: Mapping[str, str], right_cols: Mapping[str, str], on: Mapping[str, str] | Sequence[str] = (), how: str = "inner") -> DataFrame:
    """interval_join of any kind, projected: left_cols and right_cols map result names to columns."""
    keys = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    pick = [F.col(f"l.{c}").alias(n) for n, c in left_cols.items()] + [F.col(f"r.{c}").alias(n) for n, c in right_cols.items()]
    # rows whose time or bucket is null are in no bucket; on an outer side they must stay
    if how in ("inner", "left"):
        out = interval_join(left, right, left_time, right_time, lower, upper, keys, how).select(*pick)
        if how == "left":
            lost = left.where(F.col(left_time).isNull()).select(*[F.col(c).alias(n) for n, c in left_cols.items()], *[F.lit(None).cast(right.schema[c].dataType).alias(n) for n, c in right_cols.items()])
            out = out.unionByName(lost)
        return out
    back = {v: k for k, v in keys.items()}
    if how == "right":
        return interval_join_rows(right, left, right_time, left_time, -upper, -lower, right_cols, left_cols, back, "left").select(*left_cols, *right_cols)
    full = interval_join_rows(left, right, left_time, right_time, lower, upper, left_cols, right_cols, keys, "left")
    right_only = interval_join_rows(right, left.withColumn("_hit", F.lit(1)), right_time, left_time, -upper, -lower, right_cols, {**left_cols, "_hit": "_hit"}, back, "left")
    return full.unionByName(right_only.where("_hit is null").select(*left_cols, *right_cols))


def window_join_rows(left: DataFrame, right: DataFrame, left_time: str, right_time: str, window: Sliding | Session, left_cols: Mapping[str, str], right_cols: Mapping[str, str], on: Mapping[str, str] | Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs of rows in the same window with equal keys; ``window_start`` and ``window_end`` are kept.

    Sessions are those of both sides' rows together.
    """
    keys = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    kn = [f"_k{i}" for i in range(len(keys))]
    l = left.select(F.col(left_time).alias("_t"), *[F.col(a).alias(k) for k, a in zip(kn, keys, strict=True)], F.struct(*[F.col(c).alias(n) for n, c in left_cols.items()]).alias("_l"))
    r = right.select(F.col(right_time).alias("_t"), *[F.col(b).alias(k) for k, b in zip(kn, keys.values(), strict=True)], F.struct(*[F.col(c).alias(n) for n, c in right_cols.items()]).alias("_r"))
    if isinstance(window, Session):
        both = l.withColumn("_side", F.lit(0)).unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        both = assign_windows(both, "_t", window, kn, ["_side"])
        l, r = both.where("_side = 0").drop("_r"), both.where("_side = 1").drop("_l")
    else:
        l, r = assign_windows(l, "_t", window), assign_windows(r, "_t", window)
    cond = (F.col("a." + START) == F.col("b." + START)) & (F.col("a." + END) == F.col("b." + END))
    for k in kn:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = l.alias("a").join(r.alias("b"), cond, how)
    return j.select(
        F.coalesce(F.col("a." + START), F.col("b." + START)).alias(START),
        F.coalesce(F.col("a." + END), F.col("b." + END)).alias(END),
        *[F.col(f"a._l.{n}").alias(n) for n in left_cols],
        *[F.col(f"b._r.{n}").alias(n) for n in right_cols],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    left_cols: Mapping[str, str],
    right_cols: Mapping[str, str],
    on: Mapping[str, str] | Sequence[str] = (),
    direction: str = "backward",
    how: str = "left",
    left_tie: Sequence[str] = (),
    right_tie: Sequence[str] = (),
    defaults: Mapping[str, object] | None = None,
    shard: int | None = None,
) -> DataFrame:
    """Each row with the nearest row of the other side by time, among rows of equal keys.

    direction: backward (the last one not later), forward (the first one not
    earlier) or nearest (of two as near, the later). how: left, right (the right
    rows look for left ones) or outer (every row of both sides once). Equal
    times match for a left join backward, a right join forward and nearest;
    else a row sees only what is strictly before (after) it.

    Both sides are put together and sorted once by key and time; the last
    (first) row of the other side so far is what a window function carries. No
    pair is ever built. With ``shard`` (in units of time) a key is cut into time
    shards, for keys that hold much of the data; each shard gets the last
    (first) row of every other side from the shards before (after) it.
    """
    keys = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    kn = [f"_k{i}" for i in range(len(keys))]
    lt, _ = _number(left, left_time)
    rt, _ = _number(right, right_time)
    l = left.select(*[F.col(a).alias(k) for k, a in zip(kn, keys, strict=True)], lt.alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in left_tie]).alias("_lt") if left_tie else F.lit(None).cast("struct<x:int>").alias("_lt"), F.struct(*[F.col(c).alias(n) for n, c in left_cols.items()], lt.alias("_t")).alias("_l"))
    r = right.select(*[F.col(b).alias(k) for k, b in zip(kn, keys.values(), strict=True)], rt.alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in right_tie]).alias("_rt") if right_tie else F.lit(None).cast("struct<x:int>").alias("_rt"), F.struct(*[F.col(c).alias(n) for n, c in right_cols.items()], rt.alias("_t")).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True).where("_t is not null")
    parts = [F.col(k) for k in kn]
    if shard:
        both = both.withColumn("_s", F.floor(F.col("_t") / shard))
        parts = [*parts, F.col("_s")]
    # which side stands first among equal times
    right_first = (direction == "backward" and how != "right") or (direction == "forward" and how == "right")
    rank = (1 - F.col("_side")) if right_first else F.col("_side")
    if direction == "nearest":
        rank = F.col("_side")
    order = [F.col("_t"), rank, F.col("_lt"), F.col("_rt")]
    past, future = _before(parts, order), _after(parts, order)
    seen = {
        "_lb": F.last("_l", ignorenulls=True).over(past), "_rb": F.last("_r", ignorenulls=True).over(past),
        "_lf": F.last("_l", ignorenulls=True).over(future), "_rf": F.last("_r", ignorenulls=True).over(future),
    }
    need = {"backward": ("_lb", "_rb"), "forward": ("_lf", "_rf"), "nearest": tuple(seen)}[direction]
    x = both.withColumns({k: seen[k] for k in need})
    if shard:
        x = _carried(both, x, kn, need, order)
    if direction == "nearest":

        def nearer(b: str, f: str) -> Column:
            db, df_ = F.col("_t") - F.col(f"{b}._t"), F.col(f"{f}._t") - F.col("_t")
            return F.when(F.col(b).isNull() | (df_ <= db), F.coalesce(F.col(f), F.col(b))).otherwise(F.col(b))

        other_l, other_r = nearer("_lb", "_lf"), nearer("_rb", "_rf")
    else:
        other_l, other_r = F.col(need[0]), F.col(need[1])
    keep = {"left": F.col("_side") == 0, "right": F.col("_side") == 1, "outer": F.lit(True)}[how]
    x = x.where(keep).withColumns({"_ml": F.when(F.col("_side") == 0, F.col("_l")).otherwise(other_l), "_mr": F.when(F.col("_side") == 1, F.col("_r")).otherwise(other_r)})
    d = dict(defaults or {})
    fill = lambda c, n: F.coalesce(c, F.lit(d[n])) if n in d else c
    return x.select(*[fill(F.col(f"_ml.{n}"), n).alias(n) for n in left_cols], *[fill(F.col(f"_mr.{n}"), n).alias(n) for n in right_cols])


def _before(parts: Sequence, order: Sequence[Column]):
    """The rows before, in order."""
    return Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _after(parts: Sequence, order: Sequence[Column]):
    """The rows after, nearest one last: the order turned round, since a frame to the end is read anew for every row."""
    return Window.partitionBy(*parts).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def _carried(both: DataFrame, x: DataFrame, kn: Sequence[str], need: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key and shard the last (first) row of each side of the shards before (after), put where a shard saw none."""
    at = F.struct(*order)
    ends = both.groupBy(*kn, "_s").agg(
        F.max_by("_l", F.when(F.col("_l").isNotNull(), at)).alias("el"), F.max_by("_r", F.when(F.col("_r").isNotNull(), at)).alias("er"),
        F.min_by("_l", F.when(F.col("_l").isNotNull(), at)).alias("bl"), F.min_by("_r", F.when(F.col("_r").isNotNull(), at)).alias("br"),
    )
    past, future = _before(kn, [F.col("_s")]), _after(kn, [F.col("_s")])
    far = ends.select(
        *[F.col(k).alias(f"_f{k}") for k in kn], F.col("_s").alias("_fs"),
        F.last("el", True).over(past).alias("f_lb"), F.last("er", True).over(past).alias("f_rb"),
        F.last("bl", True).over(future).alias("f_lf"), F.last("br", True).over(future).alias("f_rf"),
    )
    cond = F.col("_s") == F.col("_fs")
    for k in kn:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_f{k}"))
    j = x.join(far, cond, "left")
    return j.withColumns({n: F.coalesce(F.col(n), F.col(f"f{n}")) for n in need})


def diff(df: DataFrame, time: str, values: Sequence[str], instance: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """``diff_x``: each value minus the one of the row before by time; null for the first row of an instance."""
    w = Window.partitionBy(*instance).orderBy(F.col(time), *[F.col(c) for c in tie])
    return df.withColumns({f"diff_{v}": F.col(v) - F.lag(v).over(w) for v in values})


def interpolate(df: DataFrame, time: str, values: Sequence[str], instance: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Null values filled on the line between the known ones before and after; at the ends by the nearest."""
    t, _ = _number(df, time)
    order = [F.col(time), *[F.col(c) for c in tie]]
    past, future = _before(instance, order), _after(instance, order)
    out = {}
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.struct(t.alias("t"), F.col(v).cast("double").alias("v")))
        a, b = F.last(known, True).over(past), F.last(known, True).over(future)
        line = a["v"] + F.try_divide((t - a["t"]) * (b["v"] - a["v"]), b["t"] - a["t"])
        out[v] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(F.coalesce(line, a["v"]))
    return df.withColumns(out)
