"""Tables with row identity: projections, key sets, keyed updates, lookups, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import row_key

ID = "id"


def with_id(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn(ID, key)


def with_id_from(df: DataFrame, *cols: str, instance: str | None = None) -> DataFrame:
    """Rows keyed by a hash of columns; equal values give equal ids."""
    return df.withColumn(ID, row_key(*[F.col(c) for c in cols], instance=None if instance is None else F.col(instance)))


def rename(df: DataFrame, names: Mapping[str, str] | None = None, **new_from_old: str) -> DataFrame:
    """By a mapping old to new, or as new=old."""
    return df.withColumnsRenamed({**(names or {}), **{o: n for n, o in new_from_old.items()}})


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c != ID})


def with_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c != ID})


def without(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def empty(spark: SparkSession, **kinds: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def split(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where cond is true, and all others, null among them."""
    yes = F.coalesce(cond, F.lit(False))
    return df.where(yes), df.where(~yes)


def _semi(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    k = b.select(F.col(ID).alias("_id"))
    return a.join(k, F.col(ID).eqNullSafe(F.col("_id")), how)


def restrict(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose id the other table has."""
    return _semi(df, other, "left_semi")


having = restrict


def intersect(df: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(restrict, others, df)


def difference(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose id the other table lacks."""
    return _semi(df, other, "left_anti")


def concat(*tables: DataFrame) -> DataFrame:
    """Union of tables whose ids are disjoint."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def concat_reindex(*tables: DataFrame) -> DataFrame:
    """Union of any tables; each row's id is made from its table's place and its old id."""
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn(ID, row_key(F.lit(i), F.col(ID))) for i, t in enumerate(tables)])


def update_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of other, and those of df that other has no row for."""
    return difference(df, other).unionByName(other.select(*df.columns))


def update_cells(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the columns of other put over its own, for the ids that other has."""
    cols = [c for c in other.columns if c != ID]
    o = other.select(F.col(ID).alias("_id"), *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = df.join(o, F.col(ID).eqNullSafe(F.col("_id")), "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two tables with the same ids side by side."""
    return df.join(other, ID)


def lookup(df: DataFrame, pointer: Column, other: DataFrame, optional: bool = False, allow_misses: bool = False, prefix: str = "") -> DataFrame:
    """df with the columns of the row of other that pointer names.

    A pointer without a row is an error; a null pointer too, unless optional;
    with allow_misses both give nulls.
    """
    cols = [c for c in other.columns if c != ID]
    o = other.select(F.col(ID).alias("_id"), *[F.col(c).alias(prefix + c) for c in cols], F.lit(True).alias("_hit"))
    j = df.withColumn("_p", pointer).join(o, F.col("_p") == F.col("_id"), "left")
    if not allow_misses:
        bad = F.col("_hit").isNull() & (F.col("_p").isNotNull() if optional else F.lit(True))
        j = j.withColumn("_hit", F.when(bad, F.raise_error(F.lit("no row with this id")).cast("boolean")).otherwise(F.col("_hit"))).where("_hit or _hit is null")
    return j.drop("_p", "_id", "_hit")


def lookup_by_values(df: DataFrame, other: DataFrame, on: Mapping[str, str], allow_misses: bool = False, prefix: str = "") -> DataFrame:
    """lookup by key values: on maps columns of df to the key columns of other."""
    p = row_key(*[F.col(c) for c in on])
    keyed = with_id_from(other, *on.values())
    return lookup(df, p, keyed, allow_misses=allow_misses, prefix=prefix)


def lookup_single(df: DataFrame, single: DataFrame, prefix: str = "") -> DataFrame:
    """df with the columns of a table of one row; more rows are an error."""
    one = single.limit(2).agg(*[F.first(c).alias(prefix + c) for c in single.columns if c != ID], F.count(F.lit(1)).alias("_n"))
    one = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row")).cast("bigint")).otherwise(F.col("_n")))
    return df.join(F.broadcast(one), how="cross").where("_n is not null").drop("_n")


def flatten(df: DataFrame, col: str, origin: str | None = None) -> DataFrame:
    """A row per element of an array or character of a text; origin names a column for the old id. Null and empty give none."""
    kind = df.schema[col].dataType
    each = F.split(F.col(col), "") if isinstance(kind, T.StringType) else F.col(col)
    out = df.withColumn("_at", F.lit(0)).select(*[F.col(c) for c in df.columns if c != col], F.posexplode(each).alias("_i", col))
    if ID in df.columns:
        if origin:
            out = out.withColumn(origin, F.col(ID))
        out = out.withColumn(ID, row_key(F.col(ID), F.col("_i")))
    return out.drop("_i")


def neighbours(df: DataFrame, key: Column | str, instance: Sequence[str] = (), id_col: str = ID) -> DataFrame:
    """df with ``prev`` and ``next``: ids of the rows before and after in the order of key (ties by id), within each instance."""
    k = F.col(key) if isinstance(key, str) else key
    w = Window.partitionBy(*instance).orderBy(k, F.col(id_col))
    return df.withColumns({"prev": F.lag(id_col).over(w), "next": F.lead(id_col).over(w)})


def majority(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("majority"))


def extreme_rows(df: DataFrame, group: Sequence[str], what: str, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The full row with the greatest (least) value per group; of ties the first by the tie columns."""
    order = [F.col(what).desc() if largest else F.col(what).asc(), *[F.col(c) for c in tie]]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def unpack_struct(df: DataFrame, col: str, *names: str) -> DataFrame:
    """Fields of a struct as columns, renamed in order."""
    fields = df.schema[col].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[f].alias(n) for f, n in zip(fields, names or fields, strict=False)])


def unpack_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Fields of a Json object as typed columns."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_j")).select(*keep, "_j.*")


def check_same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that only one of two tables has; empty if they agree."""
    return difference(a.select(ID), b).unionByName(difference(b.select(ID), a))


def check_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that both tables have; empty if they are disjoint."""
    return restrict(a.select(ID), b)


def assert_schema(df: DataFrame, schema: T.StructType, allow_superset: bool = True) -> DataFrame:
    """df, if it has the columns of schema with their types; otherwise an error."""
    own = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if own.get(f.name) != f.dataType]
    more = [] if allow_superset else [c for c in own if c not in schema.fieldNames()]
    if wrong or more:
        raise TypeError(f"schema does not match: {wrong or more}")
    return df


def tried(df: DataFrame, **exprs: Column) -> tuple[DataFrame, DataFrame]:
    """(df with the columns of the try_ expressions, rows where one gave null), the second being the error table."""
    out = df.withColumns(exprs)
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in exprs])
    return out, out.where(bad)


def remove_errors(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols) or None)
