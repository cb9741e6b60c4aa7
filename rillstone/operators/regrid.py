"""Irregular readings onto a regular grid, gaps filled by a shape-preserving cubic or marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 4096


def _slope(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Slope at (x1, y1): weighted harmonic mean of the secants (0 at a turning point), one-sided at an end."""
    h0, h1 = x1 - x0, x2 - x1
    d0, d1 = (y1 - y0) / h0, (y2 - y1) / h1
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    both = F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))
    return F.when(y0.isNull(), d1).when(y2.isNull(), d0).otherwise(both)


def regular_grid(
    df: DataFrame,
    source: Sequence[str],
    time: str,
    value: str,
    order: str | None = None,
    step: int = 30_000,
    max_fill: int = 4,
    shard_periods: int = 2_880,
) -> DataFrame:
    """One row per source and period between its first and last reading.

    Result: the source columns, ``period_start`` (a multiple of ``step``),
    ``value``, ``n_readings`` and ``status``: ``observed`` (``value`` is the mean
    of the period's readings), ``filled`` (a gap of at most ``max_fill`` periods,
    by monotone cubic interpolation through the period means) or ``missing``
    (a longer gap, ``value`` null).

    Each source is cut into time shards of ``shard_periods`` periods, so a source
    that holds a third of all rows is spread over many tasks. The readings are
    shuffled once, by source and shard; then each shard receives the two period
    means before and after it (its halo), found among at most four rows per
    shard, so the interpolation does not see the cut.

    Defined cases: rows with a null time or a null or NaN value are no readings;
    an infinite value is a reading, but counts in no mean (a period of infinite
    values alone is ``observed`` with a null value, and no gap beside it is
    filled); null source columns form a source of their own; repeated rows of
    one source and time count once, the greatest ``order`` holding (ties: the
    greatest value); an empty table gives an empty table; other columns are
    dropped and may have any name.
    """
    src = list(source)
    span = step * shard_periods
    r = df.select(
        F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(src)]).alias("_k"),
        F.col(time).cast("bigint").alias("_t"),
        F.col(value).cast("double").alias("_v"),
        (F.col(order) if order else F.lit(0)).alias("_o"),
    ).where("_t is not null and _v is not null and not isnan(_v)")
    r = r.withColumn("_p", F.expr(f"_t - pmod(_t, {step}L)")).withColumn("_s", F.expr(f"_t - pmod(_t, {span}L)"))
    r = r.repartition("_k", "_s")
    once = r.groupBy("_k", "_s", "_p", "_t").agg(F.max(F.struct("_o", "_v")).getField("_v").alias("_v"))
    knots = once.groupBy("_k", "_s", "_p").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.abs("_v") != float("inf"), F.col("_v"))).alias("_y"),
    )
    # halo: of each shard's first and last two knots, those of the neighbouring shards
    up, down = Window.partitionBy("_k", "_s").orderBy("_p"), Window.partitionBy("_k", "_s").orderBy(F.desc("_p"))
    edges = knots.select("_k", "_s", "_p", "_y", F.row_number().over(up).alias("_a"), F.row_number().over(down).alias("_b")).where("_a <= 2 or _b <= 2")
    along = Window.partitionBy("_k").orderBy("_p")
    xy = F.struct("_p", "_y")
    halo = (
        edges.select(
            "_k",
            "_s",
            F.when(F.col("_a") == 1, F.lag(xy, 1).over(along)).alias("l1"),
            F.when(F.col("_b") == 1, F.lead(xy, 1).over(along)).alias("r1"),
            F.when(F.col("_b") == 1, F.lead(xy, 2).over(along)).alias("r2"),
        )
        .groupBy("_k", "_s")
        .agg(*[F.max(c).alias(c) for c in ("l1", "r1", "r2")])
        .where("l1 is not null or r1 is not null")
    )
    g = knots.join(halo, ["_k", "_s"], "left").select(
        "_k",
        "_p",
        "_n",
        "_y",
        F.coalesce(F.lag(xy, 1).over(up), F.col("l1")).alias("b"),
        F.coalesce(F.lead(xy, 1).over(up), F.col("r1")).alias("d"),
        F.coalesce(F.lead(xy, 2).over(up), F.when(F.lead(xy, 1).over(up).isNull(), F.col("r2")).otherwise(F.col("r1"))).alias("e"),
    )
    # x in periods, relative to the knot on the left of the gap
    rel = lambda c: (c - F.col("_p")) / float(step)
    xb, xd, xe = rel(F.col("b._p")), rel(F.col("d._p")), rel(F.col("e._p"))
    zero = F.lit(0.0)
    g = g.withColumns(
        {
            "_m": F.coalesce(((F.col("d._p") - F.col("_p")) / step).cast("bigint") - 1, F.lit(0).cast("bigint")),
            "_h": xd,
            "_g0": _slope(xb, F.col("b._y"), zero, F.col("_y"), xd, F.col("d._y")),
            "_g1": _slope(zero, F.col("_y"), xd, F.col("d._y"), xe, F.col("e._y")),
            "_y1": F.col("d._y"),
        }
    ).select("_k", "_p", "_n", "_y", "_m", "_h", "_g0", "_g1", "_y1")
    # a long gap is written in two steps, so that no row holds all its periods
    g = g.withColumn("_j", F.explode(F.expr(f"sequence(0L, _m div {_BLOCK})")))
    g = g.withColumn("_i", F.explode(F.expr(f"sequence(_j * {_BLOCK}, least(_m, (_j + 1) * {_BLOCK} - 1))")))
    u = F.col("_i") / F.col("_h")
    cubic = (
        (1 + 2 * u) * (1 - u) * (1 - u) * F.col("_y")
        + u * (1 - u) * (1 - u) * F.col("_h") * F.col("_g0")
        + u * u * (3 - 2 * u) * F.col("_y1")
        + u * u * (u - 1) * F.col("_h") * F.col("_g1")
    )
    seen = F.col("_i") == 0
    fill = (F.col("_m") <= max_fill) & F.col("_y").isNotNull() & F.col("_y1").isNotNull()
    return g.select(
        *[F.col("_k").getField(f"f{i}").alias(c) for i, c in enumerate(src)],
        (F.col("_p") + F.col("_i") * step).alias("period_start"),
        F.when(seen, F.col("_y")).when(fill, cubic).alias("value"),
        F.when(seen, F.col("_n")).otherwise(F.lit(0).cast("bigint")).alias("n_readings"),
        F.when(seen, "observed").when(fill, "filled").otherwise("missing").alias("status"),
    )
