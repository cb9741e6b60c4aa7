"""Items that appear together: stripes of neighbour counts, merged by item, with their significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a basket in one cell; a larger basket is cut into chunks that meet pairwise.
CHUNK = 512
#: A stripe is cut into so many pieces by neighbour, so that the stripe of a very common item is no single row.
PIECES = 16
_CODES = 4_000_000


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs summed, sorted by (a, b)."""
    if not len(a):
        return a, b, c
    at = np.lexsort((b, a))
    a, b, c = a[at], b[at], c[at]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new], np.add.reduceat(c, new)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, larger) of every pair of every cell, a bounded number at a time."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        lo, hi = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(), right.values.to_numpy()
        n, m = np.diff(lo), np.diff(hi)
        inner = m == 0
        for size in np.unique(n[inner]):  # baskets of one chunk, all of a size at once
            if size < 2:
                continue
            rows = np.flatnonzero(inner & (n == size))
            i, j = np.triu_indices(size, 1)
            for some in np.array_split(rows, max(1, len(rows) * len(i) // _CODES + 1)):
                items = np.sort(lv[lo[some][:, None] + np.arange(size)], axis=1)
                yield items[:, i].ravel(), items[:, j].ravel()
        for k in np.flatnonzero(~inner):  # two chunks of a large basket
            x = np.repeat(lv[lo[k] : lo[k + 1]], m[k])
            y = np.tile(rv[hi[k] : hi[k + 1]], n[k])
            yield np.minimum(x, y), np.maximum(x, y)


def _stripes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    piece = b % PIECES
    at = np.lexsort((b, piece, a))
    a, b, c, piece = a[at], b[at], c[at], piece[at]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])])
    ends = np.r_[new, len(a)].astype(np.int32)
    for s in range(0, len(new), 20_000):
        o = ends[s : s + 20_001]
        own = slice(o[0], o[-1])
        of = pa.array(o - o[0], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[o[:-1]]), pa.array(piece[o[:-1]].astype(np.int32)), pa.ListArray.from_arrays(of, pa.array(b[own])), pa.ListArray.from_arrays(of, pa.array(c[own]))],
            names=["item", "piece", "neighbours", "counts"],
        )


def _to_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of cells to stripes, combined within the task; written out when they fill memory."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, floor = 0, 0
    for a, b in _cells(batches):
        held.append((a, b, np.ones(len(a), np.int64)))
        size += len(a)
        if size - floor > _CODES:
            held = [_counted(*map(np.concatenate, zip(*held, strict=True)))]
            size = floor = len(held[0][0])
            if size > _CODES:
                yield from _stripes(*held[0])
                held, size, floor = [], 0, 0
    if held:
        yield from _stripes(*_counted(*map(np.concatenate, zip(*held, strict=True))))


def _merged(least: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes come sorted by item and piece; equal ones are added up as they pass."""
        none = np.empty(0, np.int64)
        a = b = c = none

        def out(a, b, c):
            keep = c >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, c)], names=["a", "b", "n_ab"])

        for batch in batches:
            nb, ct = batch.column("neighbours"), batch.column("counts")
            o = nb.offsets.to_numpy()
            items = np.repeat(batch.column("item").to_numpy(), np.diff(o))
            a, b, c = np.r_[a, items], np.r_[b, nb.values.to_numpy()[o[0] : o[-1]]], np.r_[c, ct.values.to_numpy()[o[0] : o[-1]]]
            if len(a) > 500_000:
                a, b, c = _counted(a, b, c)
                last = (a == items[-1]) if len(items) else np.zeros(len(a), bool)
                yield out(a[~last], b[~last], c[~last])
                a, b, c = a[last], b[last], c[last]
        yield out(*_counted(a, b, c))

    return over


def pairs_together(df: DataFrame, basket: str, item: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, items): the number of baskets that hold both items of each pair, and each single item.

    pairs: ``a`` < ``b`` bigint, ``n_ab``; pairs in fewer than ``least`` baskets
    are left out. items: ``item``, ``n``. Counts are of distinct baskets.

    By stripes: a task turns its baskets into an associative array of
    neighbour counts per item (the larger ones of each pair), combines them in
    memory before anything is shuffled, and sends each stripe in pieces by
    neighbour; stripes of one item and piece are then added up in a single pass
    over sorted input. No pair of a basket is ever a row. A basket of more than
    ``CHUNK`` items is cut into chunks by item hash that meet pairwise, so
    a basket that holds a third of all rows becomes many small cells.

    Defined cases: rows with a null basket or item are ignored; repeated rows
    count once; a basket of one item has no pairs; an empty table gives empty
    tables; items are integers; other columns are dropped and may have any name.
    """
    once = df.select(F.col(basket).alias("u"), F.col(item).cast("bigint").alias("i")).where("u is not null and i is not null").distinct()
    large = once.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("u", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    cut = once.join(large, "u", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("i"), "chunks").cast("int")))
    parts = cut.groupBy("u", "chunk").agg(F.collect_list("i").alias("left"), F.first("chunks").alias("chunks"))
    whole = parts.select("left", F.array().cast("array<bigint>").alias("right"))
    l, r = parts.where("chunks is not null").alias("l"), parts.where("chunks is not null").alias("r")
    across = l.join(r, (F.col("l.u") == F.col("r.u")) & (F.col("l.chunk") < F.col("r.chunk"))).select("l.left", F.col("r.left").alias("right"), F.hash("l.u", "l.chunk", "r.chunk").alias("cell"))
    # the cells of one busy basket are counted in as many tasks as there are
    across = across.repartition("cell").drop("cell")
    stripes = whole.unionByName(across).mapInArrow(_to_stripes, "item bigint, piece int, neighbours array<bigint>, counts array<bigint>")
    met = stripes.repartition("item", "piece").sortWithinPartitions("item", "piece")
    pairs = met.mapInArrow(_merged(least), "a bigint, b bigint, n_ab bigint")
    return pairs, once.groupBy(F.col("i").alias("item")).agg(F.count(F.lit(1)).alias("n"))


def with_counts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with ``n_a`` and ``n_b``."""
    a = items.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
    b = items.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, "b")


def log_likelihood_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of a 2 x 2 table against independence: about chi-squared of one degree, if independent."""

    def part(k: Column, row: Column, col: Column) -> Column:
        k, row, col = k.cast("double"), row.cast("double"), col.cast("double")
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)

    return F.lit(2.0) * (part(both, a, b) + part(a - both, a, n - b) + part(b - both, n - a, b) + part(n - a - b + both, n - a, n - b))
