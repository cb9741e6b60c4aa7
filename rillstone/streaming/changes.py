"""Tables as streams of changes: columns ``_time`` (batch) and ``_diff`` (+1, -1)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import END, START, Behavior, Sliding, assign_windows, interval_join_rows

TIME, DIFF = "_time", "_diff"


def _data(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (TIME, DIFF)]


def consolidate(changes: DataFrame, per_time: bool = False) -> DataFrame:
    """Equal rows with their changes added up, those of sum 0 dropped; per_time: within each batch."""
    cols = _data(changes) + ([TIME] if per_time else [])
    return changes.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(f"{DIFF} <> 0")


def current(changes: DataFrame) -> DataFrame:
    """The table after all changes: a row as often as its changes add up to."""
    times = F.array_repeat(F.lit(1), F.greatest(F.col(DIFF), F.lit(0)).cast("int"))
    return consolidate(changes).withColumn("_n", F.explode(times)).drop("_n", DIFF)


def remove_retractions(changes: DataFrame) -> DataFrame:
    return changes.where(f"{DIFF} > 0")


def assert_append_only(changes: DataFrame) -> DataFrame:
    """The changes, or an error if one of them takes a row back."""
    ok = F.when(F.col(DIFF) > 0, F.col(DIFF)).otherwise(F.raise_error(F.lit("a row is taken back")).cast("int"))
    return changes.withColumn(DIFF, ok)


def to_stream(changes: DataFrame, name: str = "is_upsert") -> DataFrame:
    """Changes as events: of an id's changes in one batch, the insertion if there is one, or else the deletion."""
    w = Window.partitionBy("id", TIME).orderBy(F.desc(DIFF), *[F.col(c) for c in _data(changes) if c != "id"])
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*_data(changes), TIME, (F.col(DIFF) > 0).alias(name))


def stream_to_table(events: DataFrame, key: Sequence[str], is_upsert: str, order: Sequence[str]) -> DataFrame:
    """State after the last event of each key; keys whose last event is a deletion are absent.

    The last event is found by aggregation, so a key with very many events costs one row a task.
    """
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.where(F.col(f"_l.{is_upsert}")).select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest if c != is_upsert])


def from_streams(upserts: DataFrame, deletions: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State from a stream of new rows and one of deleted keys; a deletion at the same order comes first."""
    cols = [c for c in upserts.columns if c not in key and c not in order]
    a = upserts.select(*key, *order, *cols, F.lit(True).alias("_up"))
    b = deletions.select(*key, *order, *[F.lit(None).cast(upserts.schema[c].dataType).alias(c) for c in cols], F.lit(False).alias("_up"))
    return stream_to_table(a.unionByName(b), key, "_up", [*order, "_up"])


def snapshots(changes: DataFrame) -> DataFrame:
    """The whole table at every time at which it changed: rows with ``_time``."""
    times = changes.select(F.col(TIME).alias("at")).distinct()
    cols = _data(changes)
    # a row stands from the time its count becomes positive to the next change of it
    per = changes.groupBy(*cols, TIME).agg(F.sum(DIFF).alias(DIFF))
    w = Window.partitionBy(*cols).orderBy(TIME)
    runs = per.withColumn("_n", F.sum(DIFF).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_until", F.lead(TIME).over(w)).where("_n > 0")
    j = runs.join(times, (F.col("at") >= F.col(TIME)) & (F.col("at") < F.coalesce(F.col("_until"), F.lit(2**62))))
    return j.select(*cols, F.col("at").alias(TIME))


def _with_clock(df: DataFrame, time: str, instance: Sequence[str]) -> DataFrame:
    """df with ``_now``: the greatest event time of earlier batches of the instance; null in its first batch.

    The clock is one row per instance and batch, found before any window, and joined back.
    """
    keys = [*instance, TIME]
    clock = df.groupBy(*keys).agg(F.max(time).alias("_m"))
    w = Window.partitionBy(*instance).orderBy(TIME).rowsBetween(Window.unboundedPreceding, -1)
    clock = clock.select(F.struct(*keys).alias("_ck"), F.max("_m").over(w).alias("_now"))
    return df.withColumn("_ck", F.struct(*keys)).join(clock, "_ck").drop("_ck")


def ignore_late(df: DataFrame, threshold: Column, time: str, instance: Sequence[str] = ()) -> DataFrame:
    """Rows that are not late: the clock (of earlier batches) has not reached their threshold."""
    return _with_clock(df, time, instance).where(F.col("_now").isNull() | (F.col("_now") < threshold)).drop("_now")


#: A threshold is looked up within one of so many cells of about equal size.
_CELLS = 1024


def _cell(value: str, bounds: str) -> Column:
    """How many of the _CELLS - 1 ascending bounds are below value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_CELLS.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.element_at(bounds, n + s) < F.col(value), n + s).otherwise(n))


def buffered(df: DataFrame, threshold: Column, time: str, instance: Sequence[str] = ()) -> DataFrame:
    """Each row with ``_out``, the batch in which the clock reaches its threshold; at the end of input what is left comes out with null.

    No row meets the batches one by one. The clock never falls, so a row comes
    out in its own batch or, if that is later, in the first one whose clock
    reaches the threshold. That one is looked up once per threshold: thresholds
    and clocks are cut into cells by quantiles and sorted within, and each cell
    gets the first batch of the cells above it.
    """
    clock = df.groupBy(*instance, TIME).agg(F.max(time).alias("_m"))
    w = Window.partitionBy(*instance).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    clock = clock.withColumn("_m", F.max("_m").over(w)).where(F.col(TIME).isNotNull() & F.col("_m").isNotNull())
    d = df.withColumn("_v", threshold)
    wanted = d.select(*instance, "_v", F.lit(None).cast(df.schema[TIME].dataType).alias("_ct")).where("_v is not null")
    points = wanted.unionByName(clock.select(*instance, F.col("_m").alias("_v"), F.col(TIME).alias("_ct")))
    points = points.groupBy(*instance, "_v").agg(F.min("_ct").alias("_ct"))
    bounds = wanted.agg(F.percentile_approx("_v", [k / _CELLS for k in range(1, _CELLS)]).alias("_b"))
    cells = points.crossJoin(F.broadcast(bounds)).withColumn("_ck", F.struct(*instance, _cell("_v", "_b").alias("_cell"))).drop("_b")
    above = Window.partitionBy(*[f"_ck.{c}" for c in instance]).orderBy(F.desc("_ck._cell")).rowsBetween(Window.unboundedPreceding, -1)
    later = cells.groupBy("_ck").agg(F.min("_ct").alias("_l")).select("_ck", F.min("_l").over(above).alias("_later"))
    inside = Window.partitionBy("_ck").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = cells.join(later, "_ck").select(*[F.col(c).alias(f"_i_{c}") for c in instance], F.col("_v").alias("_fv"), F.coalesce(F.min("_ct").over(inside), "_later").alias("_first"))
    cond = F.col("_v").cast(points.schema["_v"].dataType) == F.col("_fv")
    for c in instance:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_i_{c}"))
    out = F.when(F.col(TIME).isNotNull() & F.col("_first").isNotNull(), F.greatest(TIME, "_first"))
    return d.join(found, cond, "left").select(*df.columns, out.alias("_out"))


def forgotten(df: DataFrame, threshold: Column, time: str, instance: Sequence[str] = ()) -> DataFrame:
    """Rows that are left at the end: the clock after the last batch has not reached their threshold."""
    if instance:
        clock = df.groupBy(F.struct(*instance).alias("_ck")).agg(F.max(time).alias("_now"))
        j = df.withColumn("_ck", F.struct(*instance)).join(clock, "_ck").drop("_ck")
    else:
        j = df.crossJoin(F.broadcast(df.agg(F.max(time).alias("_now"))))
    return j.where(F.col("_now") < threshold).drop("_now")


def deduplicate(df: DataFrame, instance: Sequence[str], value: str, order: Sequence[str], acceptor: Callable[[object, object], bool] | None = None) -> DataFrame:
    """The last accepted row of each instance, by order: the first one is accepted, a later one if acceptor(new, accepted) says so.

    Without an acceptor every change of value is accepted, which needs no
    Python. With one, an instance is folded in order by one task, a batch of
    rows in memory at a time.
    """
    cols = df.columns
    if acceptor is None:
        w = Window.partitionBy(*instance).orderBy(*order)
        ok = df.withColumn("_p", F.lag(value).over(w)).withColumn("_r", F.row_number().over(w))
        ok = ok.where((F.col("_r") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
        return ok.groupBy(*instance).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select("x.*")
    rows = df.select(*cols, F.xxhash64(*instance).alias("_h")).repartition(*instance).sortWithinPartitions("_h", *instance, *order)

    def fold(frames):
        key, best = None, None
        for f in frames:
            for r in f.itertuples(index=False):
                k = tuple(None if pd.isna(x := getattr(r, c)) else x for c in instance)
                if k != key:
                    if best is not None:
                        yield pd.DataFrame([best])[cols]
                    key, best = k, r
                else:
                    new, old = getattr(r, value), getattr(best, value)
                    if pd.isna(old) or acceptor(new, old):
                        best = r
        if best is not None:
            yield pd.DataFrame([best])[cols]

    return rows.withColumnRenamed("_h", "h_").mapInPandas(fold, df.schema)


def inactivity(df: DataFrame, time: str, allowed_us: int, instance: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(``inactive_t``, ``resumed_t``): the last event before each silence longer than allowed, and the first after it."""
    w = Window.partitionBy(*instance).orderBy(time)
    x = df.select(*instance, time).withColumn("_n", F.lead(time).over(w)).withColumn("_p", F.lag(time).over(w))
    gap = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp")) > allowed_us
    return x.where(gap("_n", time)).select(*instance, F.col(time).alias("inactive_t")), x.where(gap(time, "_p")).select(*instance, F.col(time).alias("resumed_t"))


def asof_now_join(queries: DataFrame, changes: DataFrame, on: Sequence[str], query_cols: Sequence[str], state_cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Queries (with ``_time``) joined with the table as it stood when they arrived, changes of their own batch included."""
    cols = [c for c in changes.columns if c not in (TIME, DIFF)]
    per = changes.groupBy(*cols, TIME).agg(F.sum(DIFF).alias(DIFF))
    w = Window.partitionBy(*cols).orderBy(TIME)
    runs = per.withColumn("_n", F.sum(DIFF).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_until", F.lead(TIME).over(w)).where("_n > 0")
    cond = (F.col(f"q.{TIME}") >= F.col(f"s.{TIME}")) & (F.col(f"q.{TIME}") < F.coalesce(F.col("s._until"), F.lit(2**62)))
    for c in on:
        cond = cond & F.col(f"q.{c}").eqNullSafe(F.col(f"s.{c}"))
    j = queries.alias("q").join(runs.alias("s"), cond, how)
    return j.select(*[F.col(f"q.{c}").alias(c) for c in [*query_cols]], *[F.col(f"s.{c}").alias(c) for c in state_cols])


def windowby_behaved(df: DataFrame, time: str, window: Sliding, aggs: Mapping[str, Column], behavior: Behavior, instance: Sequence[str] = ()) -> DataFrame:
    """Windows of rows that come in batches (``_time``), under a behaviour: the result after the last batch.

    A row is ignored in a window whose end + cutoff the clock (the greatest event
    time of earlier batches, per instance) has reached. Results come out when
    the clock reaches the window's start + delay, or at the end of input;
    ``_out`` is that batch. Without keep_results, windows that the clock has
    passed in the end are gone.
    """
    rows = assign_windows(df, time, window)
    if behavior.cutoff is not None:
        rows = ignore_late(rows, _plus(END, behavior.cutoff), time, instance)
    extra = {}
    if behavior.delay is not None:
        rows = buffered(rows, _plus(START, behavior.delay), time, instance)
        extra = {"_out": F.min("_out")}
    out = rows.groupBy(*instance, START, END).agg(*[c.alias(n) for n, c in {**aggs, **extra}.items()])
    if behavior.cutoff is not None and not behavior.keep_results:
        clock = df.groupBy(*instance).agg(F.max(time).alias("_now")) if instance else df.agg(F.max(time).alias("_now"))
        j = out.join(clock, list(instance)) if instance else out.crossJoin(F.broadcast(clock))
        out = j.where(F.col("_now") < _plus(END, behavior.cutoff)).drop("_now")
    return out


def _plus(col: str, by: float) -> Column:
    return F.col(col) + F.lit(int(by) if float(by).is_integer() else by)


def interval_join_behaved(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: float, upper: float, cutoff: float, left_cols: Mapping[str, str], right_cols: Mapping[str, str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """interval_join_rows without the rows that come too late: their side's clock has reached their time + cutoff."""
    l = ignore_late(left, _plus(left_time, cutoff), left_time)
    r = ignore_late(right, _plus(right_time, cutoff), right_time)
    return interval_join_rows(l, r, left_time, right_time, lower, upper, left_cols, right_cols, on, how)
