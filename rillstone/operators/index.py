"""Nearest neighbours, full text, hybrid retrieval, metadata filters, classification by neighbours."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import cosine_distance, squared_distance
from ..session import spread


def _query_blocks(queries: DataFrame, query_id: str, vector: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of at most ``block``, by hash, each small enough to be sent to all tasks."""
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null and v is not null")
    n = q.count()
    parts = max(1, -(-n // block) * 2) if n > block else 1
    for p in range(parts):
        rows = (q.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p) if parts > 1 else q).collect()
        if rows:
            yield [r["q"] for r in rows], np.array([r["v"] for r in rows], float)


def knn(data: DataFrame, data_id: str, data_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 3, metric: str = "l2sq", block: int = 2_000) -> DataFrame:
    """``query_id``, ``data_id``, ``distance``, ``rank``: the k nearest rows of every query, exactly.

    The query set is held against all rows in blocks of ``block`` queries: a
    task multiplies its rows with the block as matrices and keeps k candidates
    per query, so what is shuffled is k rows per query and task, not pairs.
    Ties go to the smaller id. Null vectors are skipped; metric is l2sq or cos.
    """
    kinds = {"q": queries.schema[query_id].dataType.simpleString(), "d": data.schema[data_id].dataType.simpleString()}
    d = spread(data.select(F.col(data_id).alias("d"), F.col(data_vector).cast("array<double>").alias("v")).where("d is not null and v is not null"), data)
    found: DataFrame | None = None
    for ids, m in _query_blocks(queries, query_id, query_vector, block):
        part = d.mapInArrow(_nearest(ids, m, k, metric, to_arrow_type(queries.schema[query_id].dataType)), f"q {kinds['q']}, d {kinds['d']}, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return data.sparkSession.createDataFrame([], f"query_id {kinds['q']}, data_id {kinds['d']}, distance double, rank int")
    w = Window.partitionBy("q").orderBy("distance", "d")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), F.col("d").alias("data_id"), "distance", "rank")


def _distances(m: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    dots = m @ x.T
    if metric == "cos":
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nan_to_num(1 - dots / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]), nan=1.0)
    return np.maximum((m**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * dots, 0)


def _nearest(ids: list, m: np.ndarray, k: int, metric: str, kind: pa.DataType):
    arrow_ids = pa.array(ids, kind)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("v").to_pylist(), float)
            dist = _distances(m, x, metric)
            n = min(k, dist.shape[1])
            # ties at the edge must all stay, or the smaller id could be lost
            edge = np.partition(dist, n - 1, axis=1)[:, n - 1]
            q, r = np.nonzero(dist <= edge[:, None])
            t = pa.table({"q": arrow_ids.take(pa.array(q)), "d": b.column("d").take(pa.array(r)), "distance": dist[q, r]})
            keep = t if keep is None else pa.concat_tables([keep, t])
            if keep.num_rows > 50 * k * len(ids):
                keep = _trim(keep, k)
        if keep is not None:
            yield from _trim(keep, k).to_batches()

    return over


def _trim(t: pa.Table, k: int, by: str = "q") -> pa.Table:
    """The k rows of least distance of every query, the smaller id of ties."""
    t = t.sort_by([(by, "ascending"), ("distance", "ascending"), ("d", "ascending")])
    q = t[by].to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return t.filter(pa.array(place < k))


def lsh_buckets(df: DataFrame, vector: str, dim: int, ands: int, bands: int, width: float = 1.0, metric: str = "l2sq", seed: int = 0) -> DataFrame:
    """A row per row and band, with ``band`` and ``bucket``: random projections cut into steps of width, or signs for cosine."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((bands * ands, dim))
    if metric != "cos":
        lines /= np.linalg.norm(lines, axis=1, keepdims=True)
    shift = rng.random(bands * ands) * width

    @F.pandas_udf("array<bigint>")
    def project(v):
        x = np.array(v.tolist(), float)
        y = (x @ lines.T > 0).astype(np.int64) if metric == "cos" else np.floor((x @ lines.T + shift) / width).astype(np.int64)
        import pandas as pd

        return pd.Series(list(y))

    h = df.where(F.col(vector).isNotNull()).withColumn("_h", project(F.col(vector)))
    band = F.posexplode(F.array(*[F.xxhash64(F.slice("_h", 1 + i * ands, ands)) for i in range(bands)]))
    return h.select(*df.columns, band.alias("band", "bucket"))


def knn_lsh(data: DataFrame, data_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, dim: int, k: int = 3, ands: int = 4, bands: int = 20, width: float = 1.0, metric: str = "l2sq", seed: int = 0) -> DataFrame:
    """Like knn among the rows that share a bucket with the query; distances are exact."""
    a = lsh_buckets(data.select(F.col(data_id).alias("data_id"), F.col(vector).alias("dv")), "dv", dim, ands, bands, width, metric, seed)
    b = lsh_buckets(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")), "qv", dim, ands, bands, width, metric, seed)
    pairs = b.select("query_id", "band", "bucket").join(a.select("data_id", "band", "bucket"), ["band", "bucket"]).select("query_id", "data_id").distinct()
    full = pairs.join(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")), "query_id").join(data.select(F.col(data_id).alias("data_id"), F.col(vector).alias("dv")), "data_id")
    dist = (cosine_distance if metric == "cos" else squared_distance)(F.col("qv"), F.col("dv"))
    w = Window.partitionBy("query_id").orderBy("distance", "data_id")
    return full.select("query_id", "data_id", dist.alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def classify(neighbours: DataFrame, labels: DataFrame, data_id: str, label: str) -> DataFrame:
    """``query_id``, ``predicted``: the most frequent label among the neighbours, the smallest of ties."""
    n = neighbours.join(labels.select(F.col(data_id).alias("data_id"), F.col(label).alias("_l")), "data_id").groupBy("query_id", "_l").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("query_id").agg(F.min_by("_l", F.struct(-F.col("n"), F.col("_l"))).alias("predicted"))


def accuracy(predicted: DataFrame, exact: DataFrame, key: str, p: str, e: str) -> DataFrame:
    """``cnt`` of rows by ``value``: whether predicted and exact labels agree."""
    return predicted.select(key, F.col(p).alias("_p")).join(exact.select(key, F.col(e).alias("_e")), key).groupBy((F.col("_p") == F.col("_e")).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def cluster_by_buckets(df: DataFrame, row_id: str, vector: str, dim: int, clusters: int = 3, seed: int = 0, most: int = 100_000, **lsh) -> DataFrame:
    """``row_id``, ``cluster``: weighted k-means on the means of LSH buckets, rows taking the majority of their buckets.

    The buckets' means go to the driver, at most ``most`` of them; more are an error.
    """
    b = lsh_buckets(df.select(F.col(row_id).alias("i"), F.col(vector).alias("v")), "v", dim, **({"ands": 4, "bands": 4} | lsh), seed=seed)
    e = b.select("band", "bucket", "i", F.posexplode("v").alias("j", "x")).groupBy("band", "bucket", "j").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    means = e.groupBy("band", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n"))
    rows = means.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} buckets; use fewer or wider ones")
    x, w = np.array([r["mean"] for r in rows], float), np.array([r["n"] for r in rows], float)
    own = _kmeans(x, w, clusters, seed)
    told = df.sparkSession.createDataFrame([(r["band"], r["bucket"], int(c)) for r, c in zip(rows, own, strict=True)], "band int, bucket bigint, c int")
    votes = b.select("i", "band", "bucket").join(told, ["band", "bucket"]).groupBy("i", "c").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("i").alias("row_id")).agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("cluster"))


def _kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < min(k, len(x)):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0) * w
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[len(centres)])
    c = np.array(centres)
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == own).all() and _:
            break
        own = new
        for i in range(len(c)):
            if (own == i).any():
                c[i] = np.average(x[own == i], axis=0, weights=w[own == i])
    return own


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int = 3, k1: float = 1.2, b: float = 0.75, block: int = 500) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the k best documents of every query by BM25. Ties go to the smaller id.

    The query set is held against all documents in blocks of ``block`` queries.
    One pass counts in how many documents the block's words occur (only those
    words are shuffled), a second one scores: a task adds up each document's
    words over the queries that have them and keeps k candidates per query, so
    what is shuffled is k rows per query and task, not a row per query, document
    and shared word.
    """
    kinds = {"q": queries.schema[query_id].dataType, "d": docs.schema[doc_id].dataType}
    names = {x: t.simpleString() for x, t in kinds.items()}
    d = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null"), docs).select("d", words(F.col("t")).alias("w"))
    q = queries.select(F.col(query_id).alias("q"), F.array_distinct(words(F.col(query))).alias("w")).where("q is not null and size(w) > 0")
    n = q.count()
    parts = 1 if n <= block else 2 * -(-n // block)
    count, mean = d.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    found: DataFrame | None = None
    for p in range(parts if count else 0):
        own = q if parts == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        rows = own.collect()
        if not rows:
            continue
        terms = docs.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rows for t in r["w"]})], "t string")
        each = d.select(F.explode(F.array_distinct("w")).alias("t"))
        held = {r["t"]: r["n"] for r in each.join(F.broadcast(terms), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        at: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for t in r["w"]:
                if t in held:
                    at.setdefault(t, []).append(i)
        posting = {t: (np.array(i), float(np.log(1 + (count - held[t] + 0.5) / (held[t] + 0.5)))) for t, i in at.items()}
        ids = pa.array([r["q"] for r in rows], to_arrow_type(kinds["q"]))
        part = d.mapInArrow(_scored(ids, posting, float(mean), k, k1, b), f"q {names['q']}, d {names['d']}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"query_id {names['q']}, doc_id {names['d']}, score double, rank int")
    w = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "d")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), "score", "rank")


def _scored(ids: pa.Array, posting: dict[str, tuple[np.ndarray, float]], mean: float, k: int, k1: float, b: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: pa.Table | None = None
        for batch in batches:
            total = np.zeros((batch.num_rows, len(ids)))
            for i, ws in enumerate(batch.column("w").to_pylist()):
                tf: dict[str, int] = {}
                for t in ws:
                    if t in posting:
                        tf[t] = tf.get(t, 0) + 1
                norm = k1 * (1 - b + b * len(ws) / mean)
                row = total[i]
                for t, n in tf.items():
                    at, idf = posting[t]
                    row[at] += idf * n * (k1 + 1) / (n + norm)
            far = -np.round(total.T, 9)
            n = min(k, batch.num_rows)
            if not n:
                continue
            # ties at the edge must all stay, or the smaller id could be lost
            edge = np.partition(far, n - 1, axis=1)[:, n - 1]
            q, r = np.nonzero((far <= edge[:, None]) & (far < 0))
            t = pa.table({"q": ids.take(pa.array(q)), "d": batch.column("d").take(pa.array(r)), "score": total[r, q], "distance": far[q, r], "n": q})
            keep = _trim(t if keep is None else pa.concat_tables([keep, t]), k, "n")
        if keep is not None:
            yield from keep.select(["q", "d", "score"]).to_batches()

    return over


def rank_fusion(*ranked: DataFrame, k: int = 3, constant: float = 60) -> DataFrame:
    """``query_id``, ``data_id``, ``score``, ``rank`` from several rankings: the sum of 1 / (constant + rank)."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), [r.select("query_id", "data_id", "rank") for r in ranked])
    s = every.groupBy("query_id", "data_id").agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "data_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collapse(matches: DataFrame, data: DataFrame, data_id: str, cols: Sequence[str]) -> DataFrame:
    """One row per query: arrays of the matches' columns in the order of rank."""
    j = matches.join(data.select(F.col(data_id).alias("data_id"), *cols), "data_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "data_id", *cols)))
    return j.groupBy("query_id").agg(*[F.transform(rows, lambda r, c=c: r[c]).alias(c) for c in ["data_id", *cols]])


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: * and ? within a part, ** over parts."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            e = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : e].replace("!", "^", 1) + "]", e + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


_TOKEN = re.compile(r"\s*(&&|\|\||[!=<>]=|[<>()!,]|`[^`]*`|'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|[A-Za-z_][\w.]*)")


def metadata_filter(expression: str, metadata: Column) -> Column:
    """A filter language over Json text as a condition: comparisons of fields and literals, && || !, contains, starts_with, ends_with, globmatch."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"can't read the filter at {expression[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0
    v = F.try_parse_json(metadata)

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def take() -> str:
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def field(name: str) -> str:
        return "$" + "".join(f"[{json.dumps(p)}]" for p in name.split("."))

    def literal(t: str) -> object:
        return json.loads(t[1:-1]) if t[0] == "`" and t[1:-1] else t[1:-1] if t[0] in "'\"" else float(t) if "." in t else int(t)

    def is_literal(t: str) -> bool:
        return t[0] in "`'\"-" or t[0].isdigit()

    def value():
        t = take()
        if is_literal(t):
            return "literal", literal(t)
        if peek() == "(":
            take()
            args = [value()]
            while peek() == ",":
                take()
                args.append(value())
            take()
            return "call", (t, args)
        return "field", t

    def as_(x, like=None) -> Column:
        kind, y = x
        if kind == "literal":
            return F.lit(y)
        k = "double" if isinstance(like, (int, float)) and not isinstance(like, bool) else "boolean" if isinstance(like, bool) else "string"
        return F.try_variant_get(v, field(y), k)

    def call(name: str, args) -> Column:
        a, b = args[0], args[1] if len(args) > 1 else None
        if name == "globmatch":
            return as_(b).rlike(glob_pattern(a[1]))
        if name == "starts_with":
            return F.startswith(as_(a), as_(b))
        if name == "ends_with":
            return F.endswith(as_(a), as_(b))
        if name == "contains":
            if a[0] == "literal" and isinstance(a[1], list):
                return as_(b).isin(a[1])
            items = F.try_variant_get(v, field(a[1]), "array<string>")
            return F.coalesce(F.array_contains(items, as_(b).cast("string")), F.contains(as_(a), as_(b).cast("string")))
        raise ValueError(f"no function {name}")

    def atom() -> Column:
        if peek() == "!":
            take()
            return ~atom()
        if peek() == "(":
            take()
            c = either()
            take()
            return c
        a = value()
        if a[0] == "call":
            return F.coalesce(call(*a[1]), F.lit(False))
        op = peek()
        if op in ("==", "!=", "<", "<=", ">", ">="):
            take()
            b = value()
            x, y = as_(a, b[1] if b[0] == "literal" else None), as_(b, a[1] if a[0] == "literal" else None)
            if op == "==":
                return x.eqNullSafe(y)
            if op == "!=":
                return ~x.eqNullSafe(y)
            return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))
        return F.coalesce(as_(a, True), as_(a).isNotNull())

    def both() -> Column:
        c = atom()
        while peek() == "&&":
            take()
            c = c & atom()
        return c

    def either() -> Column:
        c = both()
        while peek() == "||":
            take()
            c = c | both()
        return c

    out = either()
    if pos != len(tokens):
        raise ValueError(f"can't read the filter at {tokens[pos]!r}")
    return out
