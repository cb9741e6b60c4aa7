"""Queries p1, p2, p4, p8, p9 and p10, with their SQL where SQL can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .defects import defects, main_defect
from .leaks import leaked
from .percentiles import RANK_ERROR, answer_percentiles, merge_percentiles, partial_percentiles
from .sentences import sentence_units, trained
from .together import log_likelihood_ratio, pairs_together, with_counts
from .tokens import decode_ids, encode_texts, read_ranks

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
GROUP = ["name", "operator_id"]


def p1_partials(spark: SparkSession, d: str) -> DataFrame:
    """One sketch per group and day (UTC), kept to be combined."""
    day = F.to_date(F.timestamp_millis("timestamp"))
    return partial_percentiles(table(spark, d, "metrics"), GROUP, "value", day)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return answer_percentiles(merge_percentiles(p1_partials(spark, d), GROUP), GROUP, PS)


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Each answer held against the exact ranks: is it within the stated rank error?"""
    q = p1_percentiles(spark, d)
    told = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{100 * p:g}").alias("q")) for p in PS])
    q = q.select(F.struct(*GROUP).alias("g"), told.alias("told"))
    m = table(spark, d, "metrics").where("value is not null and not isnan(value)").select(F.struct(*GROUP).alias("g"), "value")
    below = [F.avg((F.col("value") < F.col("told")[i]["q"]).cast("int")).alias(f"lo{i}") for i in range(len(PS))]
    upto = [F.avg((F.col("value") <= F.col("told")[i]["q"]).cast("int")).alias(f"hi{i}") for i in range(len(PS))]
    r = m.join(q, "g").groupBy("g").agg(*below, *upto)
    good = F.array(*[F.struct(F.lit(p).alias("p"), ((F.col(f"lo{i}") - RANK_ERROR <= p) & (F.col(f"hi{i}") + RANK_ERROR >= p)).alias("within")) for i, p in enumerate(PS)])
    return r.select("g", F.explode(good).alias("x")).select("g.name", "g.operator_id", "x.p", "x.within")


def p1_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """The answers for groups that a sketch holds whole, which are exact."""
    m = table(spark, d, "metrics").where("value is not null and not isnan(value)")
    small = m.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= 1_000).select(F.struct(*GROUP).alias("g"))
    return p1_percentiles(spark, d).withColumn("g", F.struct(*GROUP)).join(small, "g", "left_semi").drop("g")


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    rated = table(spark, d, "ratings")
    users = rated.where("userId is not null and movieId is not null").agg(F.count_distinct("userId").alias("n"))
    pairs, titles = pairs_together(rated, "userId", "movieId", least)
    return with_counts(pairs, titles).crossJoin(F.broadcast(users))  # of one row


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that anyone rated, how many times more often than chance, and the significance of that."""
    p = _pairs(spark, d, 1)
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    llr = log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"))
    return p.select(F.col("a").alias("movie_a"), F.col("b").alias("movie_b"), "n_ab", F.round(lift, 6).alias("lift"), F.round(llr, 6).alias("llr"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of counts are beyond a bigint from a billion users
    p = _pairs(spark, d, 10).where(wide("n_ab") * wide("n") >= 6 * (wide("n_a") * wide("n_b")))
    return p.select(F.col("a").alias("movie_a"), F.col("b").alias("movie_b"))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every pair, with its posterior."""
    return defects(table(spark, d, "qa_pairs"), "pair_id", "user_input", "reference", "reference_contexts")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_defect(p4_labels(spark, d))


def _ranks(name: str = "byte_bpe_50k") -> dict[bytes, int]:
    return read_ranks(f"{TOKENIZERS}/{name}.tiktoken")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text", _ranks())


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, put together from their ids."""
    return decode_ids(p8_ids(spark, d), "doc_id", "ids", _ranks())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentence_units(docs, "doc_id", "text", trained(docs, "text"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_partials, p1_within_bound, p1_small_groups, p2_found, p2_pairs, p4_found, p4_labels, p8_ids, p8_text, p9_found, p10_found)}

_COUNTS = """
WITH r AS (SELECT DISTINCT userId AS u, movieId AS i FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL),
t AS (SELECT i, count(*) AS n FROM r GROUP BY i),
c AS (SELECT count(DISTINCT u) AS n FROM r),
p AS (SELECT a.i AS movie_a, b.i AS movie_b, count(*) AS n_ab FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2),
x AS (SELECT p.*, ta.n AS n_a, tb.n AS n_b, c.n AS n FROM p JOIN t ta ON ta.i = movie_a JOIN t tb ON tb.i = movie_b CROSS JOIN c)
"""
_PART = "CASE WHEN {k} > 0 THEN ({k}) * ln(({k})::DOUBLE * n / (({row})::DOUBLE * ({col}))) ELSE 0 END"
_LLR = "2 * (" + " + ".join(_PART.format(k=k, row=r, col=c) for k, r, c in (("n_ab", "n_a", "n_b"), ("n_a - n_ab", "n_a", "n - n_b"), ("n_b - n_ab", "n - n_a", "n_b"), ("n - n_a - n_b + n_ab", "n - n_a", "n - n_b"))) + ")"

ORACLES = {
    "p1_within_bound": f"""
SELECT g.name, g.operator_id, p.p, true AS within
FROM (SELECT DISTINCT name, operator_id FROM metrics WHERE value IS NOT NULL AND NOT isnan(value)) g
CROSS JOIN (SELECT unnest({list(PS)})::DOUBLE AS p) p""",
    "p1_small_groups": "SELECT name, operator_id, count(*) AS n, "
    + ", ".join(f"quantile_disc(value, {p}) AS p{100 * p:g}" for p in PS)
    + " FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY name, operator_id HAVING count(*) <= 1000",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": _COUNTS + "SELECT movie_a, movie_b FROM x WHERE n_ab >= 10 AND n_ab * n >= 6 * n_a * n_b",
    "p2_pairs": _COUNTS + f"SELECT movie_a, movie_b, n_ab, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift, round({_LLR}, 6) AS llr FROM x",
}
