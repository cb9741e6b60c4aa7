"""SQL over named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sql(query: str, **tables: DataFrame) -> DataFrame:
    """The result of a query over the given tables, whose names are those of the arguments; nothing is left registered under them."""
    return next(iter(tables.values())).sparkSession.sql(query, **tables) if all("{" + t + "}" in query for t in tables) else _with_views(query, tables)


def _with_views(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
