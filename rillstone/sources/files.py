"""Files: csv, Json lines, plain text, binary, parquet, SQLite; change envelopes; test tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _with_metadata(df: DataFrame, wanted: bool) -> DataFrame:
    """The file's path, size and time of change in a column ``_metadata``."""
    return df.select(*df.columns, F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at")).alias("_metadata")) if wanted else df


def _reader(spark: SparkSession, pattern: str, options: Mapping):
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").options(**options)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, delimiter: str = ",", quote: str = '"', escape: str | None = None, comment: str | None = None, header: bool = True, pattern: str = "*", with_metadata: bool = False, defaults: Mapping | None = None) -> DataFrame:
    """Columns are found by the names in the header. Without a schema types are inferred."""
    opt = {"sep": delimiter, "quote": quote, "escape": escape or '"', "header": str(header).lower(), "multiLine": "false"}
    if comment:
        opt["comment"] = comment
    r = _reader(spark, pattern, opt)
    df = r.option("enforceSchema", "false").schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)
    df = _with_metadata(df, with_metadata)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}) if defaults else df


def write_csv(df: DataFrame, path: str, **options: str) -> None:
    df.write.mode("overwrite").options(header="true", **options).csv(path)


def read_jsonlines(spark: SparkSession, path: str, schema: str | None = None, *, field_paths: Mapping[str, str] | None = None, pattern: str = "*", with_metadata: bool = False) -> DataFrame:
    """One Json object a line. field_paths gives columns by pointers such as /a/b/0; the schema has their types."""
    if not field_paths:
        r = _reader(spark, pattern, {})
        return _with_metadata((r.schema(schema) if schema else r).json(path), with_metadata)
    raw = _with_metadata(_reader(spark, pattern, {}).text(path), with_metadata)
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    v = F.try_parse_json("value")
    cols = []
    for c, t in kinds.items():
        pointer = field_paths.get(c, "/" + c)
        at = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in pointer.strip("/").split("/"))
        cols.append(F.try_variant_get(v, at, t).alias(c))
    return raw.select(*cols, *([F.col("_metadata")] if with_metadata else []))


def write_jsonlines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_plaintext(spark: SparkSession, path: str, *, pattern: str = "*", whole: bool = False, with_metadata: bool = False) -> DataFrame:
    """``data``: a row a line, or a row a file."""
    df = _reader(spark, pattern, {"wholetext": str(whole).lower()}).text(path)
    return _with_metadata(df, with_metadata).withColumnRenamed("value", "data")


def read_binary(spark: SparkSession, path: str, *, pattern: str = "*", with_metadata: bool = False) -> DataFrame:
    """``data``: the bytes of each file."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    meta = [F.struct("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).alias("_metadata")] if with_metadata else []
    return df.select(F.col("content").alias("data"), *meta)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    d = df.sortWithinPartitions(*sort_by) if sort_by else df
    d.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_null(df: DataFrame) -> None:
    """All rows are made, none is kept."""
    df.write.format("noop").mode("overwrite").save()


class SqliteSource(DataSource):
    """format("rillstone_sqlite"): options path, table, and partitions (by rowid)."""

    @classmethod
    def name(cls) -> str:
        return "rillstone_sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary", "BOOLEAN": "boolean"}
        with sqlite3.connect(self.options["path"]) as db:
            cols = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SqliteWriter(self.options, schema, overwrite)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: Mapping, schema):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[_Range]:
        import sqlite3

        with sqlite3.connect(self.options["path"]) as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if lo is None:
            return [_Range(0, 0)]
        n = int(self.options.get("partitions", "4"))
        step = -(-(hi - lo + 1) // n)
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        import sqlite3

        cols = ", ".join(f'"{c}"' for c in self.names)
        with sqlite3.connect(self.options["path"]) as db:
            yield from db.execute(f'SELECT {cols} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', (part.lo, part.hi))


class _Done(WriterCommitMessage):
    pass


class _SqliteWriter(DataSourceWriter):
    def __init__(self, options: Mapping, schema, overwrite: bool):
        import sqlite3

        self.options, self.schema = dict(options), schema
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}
        cols = ", ".join(f'"{f.name}" {kinds.get(f.dataType.simpleString(), "TEXT")}' for f in schema)
        with sqlite3.connect(self.options["path"]) as db:
            if overwrite:
                db.execute(f'DROP TABLE IF EXISTS "{self.options["table"]}"')
            db.execute(f'CREATE TABLE IF NOT EXISTS "{self.options["table"]}" ({cols})')

    def write(self, rows: Iterator) -> _Done:
        import sqlite3

        marks = ", ".join("?" * len(self.schema))
        with sqlite3.connect(self.options["path"], timeout=120) as db:
            db.executemany(f'INSERT INTO "{self.options["table"]}" VALUES ({marks})', (tuple(r) for r in rows))
        return _Done()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("rillstone_sqlite").options(path=path, table=table, partitions=str(partitions)).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("rillstone_sqlite").options(path=path, table=table).mode("overwrite").save()


def read_change_envelopes(raw: DataFrame, schema: str, value: str = "value", nested_text: bool = False) -> DataFrame:
    """Change events with before and after images as rows with ``_diff``: an update is a deletion and an insertion.

    nested_text: the images are texts that hold Json, and an update has no before image (it replaces by key).
    """
    image = "string" if nested_text else f"struct<{schema}>"
    kind = f"op string, before {image}, after {image}"
    payload = F.get_json_object(value, "$.payload")
    x = raw.select(F.from_json(F.coalesce(payload, F.col(value)), kind).alias("e"))
    read = (lambda c: F.from_json(c, f"struct<{schema}>")) if nested_text else (lambda c: c)
    sides = F.array(F.struct(read(F.col("e.before")).alias("r"), F.lit(-1).alias("_diff")), F.struct(read(F.col("e.after")).alias("r"), F.lit(1).alias("_diff")))
    return x.select(F.explode(sides).alias("s")).where("s.r is not null").select("s.r.*", "s._diff")


def table_from_markdown(spark: SparkSession, text: str, schema: str | None = None) -> DataFrame:
    """A small table drawn with bars or blanks; a leading column without a name is the id, and None, whole and decimal numbers and truth values are read as such."""
    lines = [line.strip() for line in text.strip().splitlines() if line.strip() and not re.fullmatch(r"[\s|:+-]+", line.strip())]
    bars = "|" in lines[0]
    cut = (lambda s: [c.strip() for c in s.split("|")]) if bars else (lambda s: s.split())
    head, rows = cut(lines[0]), [cut(line) for line in lines[1:]]
    if bars and head and not head[-1]:
        head, rows = head[:-1], [r[:-1] for r in rows]
    if not head[0]:
        head = ["id", *head[1:]]
    elif not bars and rows and len(rows[0]) == len(head) + 1:
        head = ["id", *head]

    def read(c: str):
        if c in ("None", ""):
            return None
        if c in ("True", "False"):
            return c == "True"
        for kind in (int, float):
            try:
                return kind(c)
            except ValueError:
                pass
        return c.strip("'\"")

    data = [tuple(read(c) for c in r) for r in rows]
    if schema:
        return spark.createDataFrame(data, schema)
    cols = list(zip(*data, strict=True)) if data else [()] * len(head)
    kinds = []
    for i, c in enumerate(cols):
        known = {type(x) for x in c if x is not None}
        kinds.append("boolean" if known == {bool} else "bigint" if known == {int} else "double" if known and known <= {int, float} else "string")
        if kinds[-1] == "double":
            cols[i] = tuple(None if x is None else float(x) for x in c)
        if kinds[-1] == "string":
            cols[i] = tuple(None if x is None else str(x) for x in c)
    return spark.createDataFrame(list(zip(*cols, strict=True)) if data else [], ", ".join(f"`{h}` {k}" for h, k in zip(head, kinds, strict=True)))


def list_files(path: str, pattern: str = "*") -> list[str]:
    return sorted(str(p) for p in Path(path).rglob(pattern) if p.is_file())
