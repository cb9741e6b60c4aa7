"""Entity-attribute-value rows into one wide row per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_names(df: DataFrame, attribute: str, most: int = 10_000) -> list[str]:
    """The attribute names, sorted. They become columns, so more than ``most`` is an error, not a cut."""
    rows = df.select(F.col(attribute).alias("a")).where("a is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes; a table can't have so many columns")
    return sorted(r["a"] for r in rows)


def pivot_blocks(
    df: DataFrame,
    entity: Sequence[str],
    attribute: str,
    value: str,
    attributes: Sequence[str],
    order: str | None = None,
    types: Mapping[str, str] | None = None,
    names: Mapping[str, str] | None = None,
    block: int = 64,
) -> DataFrame:
    """One row per entity with a column per attribute, by column-block pivoting.

    The rows are hashed by entity, once: one scan and one exchange whatever the
    number of attributes. The attributes are cut into blocks of ``block``. On that
    hashing every cell gets its reading, every block of an entity is pivoted into
    an array of its cells, and the blocks of an entity are put side by side, none
    of which moves a row again; so thousands of attributes never make one
    aggregation of thousands of buffers, but one of ``block`` and one of as many
    as there are blocks.

    Result: the entity columns, then a column per attribute (``names`` gives
    its name, ``types`` its type, double otherwise) and ``unfit``
    map<string,double>: the values that their column's type can't hold (their
    cell is null), or null.

    Defined cases: a null or NaN value is no value, but its row makes the
    entity exist; of several values of a cell the one of the greatest ``order``
    holds (ties: the greatest value); null entity columns are values like
    others; rows whose attribute is null or not listed only make the entity
    exist; an empty table gives an empty table; other columns are dropped and
    may have any name.
    """
    ent, atts = list(entity), list(dict.fromkeys(attributes))
    types, names = dict(types or {}), dict(names or {})
    out_names = ent + [names.get(a, a) for a in atts] + ["unfit"]
    if len({c.lower() for c in out_names}) != len(out_names):
        raise ValueError("result columns would share a name; give names for the attributes")
    spark = df.sparkSession
    usable = F.col("_v").isNotNull() & ~F.isnan("_v")
    base = df.select(
        F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(ent)]).alias("_e"),
        F.col(attribute).alias("_a"),
        F.col(value).cast("double").alias("_v"),
        (F.col(order) if order else F.lit(0)).alias("_o"),
    )
    # attributes become columns, so their number is bounded
    index = spark.createDataFrame(list(zip(atts, range(len(atts)))), "_a string, _i int")
    base = base.join(F.broadcast(index), "_a", "left").repartition("_e")
    best = base.groupBy("_e", "_i").agg(F.max(F.when(usable, F.struct("_o", "_v"))).getField("_v").alias("_v"))
    width, blocks = min(block, len(atts)), -(-len(atts) // block)
    own = [F.max(F.when(F.col("_i") % block == j, F.col("_v"))).alias(f"p{j}") for j in range(width)]
    if blocks > 1:
        parts = best.groupBy("_e", F.floor(F.col("_i") / block).alias("_b")).agg(*own)
        parts = parts.select("_e", "_b", F.array(*[f"p{j}" for j in range(width)]).alias("_p"))
        wide = parts.groupBy("_e").agg(*[F.first(F.when(F.col("_b") == b, F.col("_p")), ignorenulls=True).alias(f"b{b}") for b in range(blocks)])
        wide = wide.select("_e", *[F.col(f"b{i // block}")[i % block].alias(f"c{i}") for i in range(len(atts))])
    else:
        wide = best.groupBy("_e").agg(*(own or [F.count(F.lit(1)).alias("_none")])).withColumnsRenamed({f"p{j}": f"c{j}" for j in range(width)})
    cells, unfit = [], []
    for i, a in enumerate(atts):
        c, t = F.col(f"c{i}"), types.get(a, "double")
        if t == "double":
            cells.append(c.alias(names.get(a, a)))
        else:
            whole = c if t not in ("bigint", "int", "smallint", "tinyint") else F.when(c == F.floor(c.cast("double")).cast("double"), c)
            fit = F.when(F.abs(c) < 9.2e18, whole).try_cast(t)
            cells.append(fit.alias(names.get(a, a)))
            unfit.append(F.when(c.isNotNull() & fit.isNull(), F.struct(F.lit(names.get(a, a)).alias("a"), c.alias("v"))))
    lost = F.filter(F.array(*unfit), lambda x: x.isNotNull()) if unfit else None
    lost = F.when(F.size(lost) > 0, F.map_from_entries(lost)) if lost is not None else F.lit(None).cast("map<string,double>")
    return wide.select(*[F.col("_e").getField(f"f{i}").alias(c) for i, c in enumerate(ent)], *cells, lost.alias("unfit"))
