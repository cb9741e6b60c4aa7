"""Queries of graphs, nearest neighbours, retrieval, matching, Python functions, documents and connectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuzzy as Z
from ..operators import index as X
from ..operators import iterate as G
from ..operators import udfs as U
from ..session import shared_dir
from ..session import table as T
from ..sources import files as IO
from ..text import split as P
from ..text.store import DocumentStore

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Which nation's customers order from which nation's suppliers: u, v, weight."""
    l = T(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = T(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = T(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


_TRADE = """t AS (SELECT c_nationkey AS u, s_nationkey AS v, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(_TRADE.join(["WITH RECURSIVE ", """, d AS (SELECT u, count(*) AS deg FROM t GROUP BY u), n AS (SELECT u AS v FROM t UNION SELECT v FROM t),
r0 AS (SELECT v, 6000::BIGINT AS rank FROM n),"""]) + ",".join(f"""
r{i} AS (SELECT n.v, (1000 + coalesce(sum(r.rank * 5 // (d.deg * 6)), 0))::BIGINT AS rank FROM n LEFT JOIN t ON t.v = n.v LEFT JOIN r{i - 1} r ON r.v = t.u LEFT JOIN d ON d.u = t.u GROUP BY n.v)""" for i in range(1, 6)) + " SELECT v, rank FROM r5")
def pagerank(spark, d):
    return G.pagerank(trade(spark, d).select("u", "v"))


def ring(spark, d):
    """Every order linked to the next one of its customer: a graph of many paths. u, v, dist."""
    o = T(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("u"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("u")
    return o.withColumn("v", F.lead("u").over(w)).where("v is not null").select("u", "v", ((F.col("u") % 7) + 1).cast("double").alias("dist"))


_RING = "e AS (SELECT o_custkey, o_orderkey AS u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v, ((o_orderkey % 7) + 1)::DOUBLE AS dist FROM orders)"


@query(f"WITH RECURSIVE {_RING}, x AS (SELECT o_custkey, u, sum(coalesce(dist, 0)) OVER (PARTITION BY o_custkey ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e) SELECT u AS v, coalesce(s, 0.0) AS dist FROM x")
def bellman_ford(spark, d):
    o = T(spark, d, "orders")
    v = o.select(F.col("o_orderkey").alias("v"), "o_custkey").join(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")), "o_custkey")
    return G.bellman_ford(v.select("v", (F.col("v") == F.col("first")).alias("is_source")), ring(spark, d))


@query(f"WITH {_RING} SELECT u AS v, min(u) OVER (PARTITION BY o_custkey) AS component FROM e QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def connected_components(spark, d):
    return G.connected_components(ring(spark, d))


@query(f"WITH {_RING}, f AS (SELECT min(u) AS s FROM e) SELECT u AS v FROM e WHERE o_custkey = (SELECT o_custkey FROM e, f WHERE u = s)")
def reachable_vertices(spark, d):
    e = ring(spark, d)
    return G.reachable(e, e.agg(F.min("u").alias("v")))


@query(f"WITH {_RING} SELECT u AS o_orderkey, sum(dist) OVER (PARTITION BY o_custkey ORDER BY u DESC) AS total FROM e")
def along_pointers(spark, d):
    """Every order with the sum of its own number and those of all orders it points to."""
    from pyspark.sql import Window

    o = T(spark, d, "orders").select("o_custkey", "o_orderkey")
    o = o.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return G.along_pointers(o, "o_orderkey", "next", ((F.col("o_orderkey") % 7) + 1).cast("double"), lambda a, b: a + b).select("o_orderkey", "total")


@query(f"WITH {_TRADE}, b AS (SELECT u, v, weight FROM t UNION ALL SELECT v, u, weight FROM t), c AS (SELECT n_nationkey AS v, n_regionkey AS c FROM nation), "
       "g AS (SELECT x.c AS u, y.c AS v, sum(weight) AS w FROM b JOIN c x ON b.u = x.v JOIN c y ON b.v = y.v GROUP BY 1, 2), m AS (SELECT sum(w) AS m FROM g), "
       "k AS (SELECT u, sum(w) AS deg, sum(CASE WHEN u = v THEN w ELSE 0 END) AS inner_w FROM g GROUP BY u) SELECT round(sum((inner_w * m - deg * deg) / (m::DOUBLE * m)), 6) AS modularity FROM k, m")
def modularity(spark, d):
    t = trade(spark, d)
    both = t.unionByName(t.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    return G.modularity(both.withColumn("weight", F.col("weight").cast("double")), T(spark, d, "nation").select(F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("c")), 6)


@query()
def louvain_clusters(spark, d):
    """Clusters of products bought together by the same customers of a nation."""
    t = trade(spark, d)
    both = t.unionByName(t.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    return G.louvain(both, 2, 6)


@query(f"WITH {_TRADE}, c AS (SELECT n_nationkey AS v, n_regionkey AS c FROM nation) SELECT x.c AS u, y.c AS v, sum(weight)::BIGINT AS weight FROM t JOIN c x ON t.u = x.v JOIN c y ON t.v = y.v WHERE x.c <> y.c GROUP BY 1, 2")
def contracted_graph(spark, d):
    c = T(spark, d, "nation").select(F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("c"))
    return G.without_self_loops(G.contract(trade(spark, d), c))


_L2 = "list_sum([(x - y) * (x - y) FOR x, y IN list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[])])"


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS data_id, list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 2 * list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, data_id, round(dist, 5) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, data_id) <= 3""")
def knn_exact(spark, d):
    e = T(spark, d, "embeddings")
    n = X.knn(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 4).where("query_id <> data_id")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("distance", "data_id")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 3").select("query_id", "data_id", F.round("distance", 5).alias("distance"))


@query("SELECT true AS enough")
def knn_lsh_recall(spark, d):
    """Share of the true neighbours that the LSH index finds: at least nine in ten."""
    e = T(spark, d, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    q = e.where("vec_id % 20 = 0")
    exact = X.knn(e, "vec_id", "embedding", q, "vec_id", "embedding", 5).select("query_id", "data_id")
    near = X.knn_lsh(e, "vec_id", "embedding", q, "vec_id", "embedding", dim, 5, ands=3, bands=40, width=1.2).select("query_id", "data_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "data_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, q.label AS exact, e.label AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 2 * list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS r
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 <> 0), v AS (SELECT query_id, exact, l, count(*) AS n FROM s WHERE r <= 5 GROUP BY 1, 2, 3),
p AS (SELECT query_id, exact, l, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, l) AS r FROM v) SELECT l = exact AS value, count(*) AS cnt FROM p WHERE r = 1 GROUP BY 1""")
def knn_classifier(spark, d):
    e = T(spark, d, "embeddings")
    train, test = e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0")
    got = X.classify(X.knn(train, "vec_id", "embedding", test, "vec_id", "embedding", 5), train, "vec_id", "label")
    return X.accuracy(got, test.select(F.col("vec_id").alias("query_id"), "label"), "query_id", "predicted", "label")


@query()
def lsh_clusters(spark, d):
    e = T(spark, d, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    return X.cluster_by_buckets(e, "vec_id", "embedding", dim, 3, width=1.0)


_BM25 = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS len FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS docs, avg(len) AS mean FROM n), tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark),
s AS (SELECT query_id, tf.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
FROM q JOIN tf USING (word) JOIN df USING (word) JOIN n ON n.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1, 2)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 3")
def bm25_search(spark, d):
    return X.bm25(T(spark, d, "documents"), "doc_id", "text", T(spark, d, "benchmark"), "item_id", "text", 3).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, count(*) AS n FROM q JOIN tf USING (word) GROUP BY 1, 2)),
u AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM r WHERE rank <= 5 UNION ALL SELECT * FROM l WHERE rank <= 5) GROUP BY 1, 2)
SELECT query_id, doc_id AS data_id, round(score, 8) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) <= 3""")
def hybrid_search(spark, d):
    """BM25 and the plain number of shared words, their ranks fused."""
    from pyspark.sql import Window

    docs, items = T(spark, d, "documents"), T(spark, d, "benchmark")
    a = X.bm25(docs, "doc_id", "text", items, "item_id", "text", 5).select("query_id", F.col("doc_id").alias("data_id"), "rank")
    tf = docs.select(F.col("doc_id").alias("data_id"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("w"))
    q = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("w"))
    n = q.join(tf, "w").groupBy("query_id", "data_id").agg(F.count(F.lit(1)).alias("n"))
    b = n.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "data_id"))).where("rank <= 5").select("query_id", "data_id", "rank")
    return X.rank_fusion(a, b, k=3).select("query_id", "data_id", F.round("score", 8).alias("score"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(path, '^/[^/]*-guide/[^/]*[.]html$') AND n_chars > 300 AND (lang = 'en' OR lang = 'de')")
def filtered_documents(spark, d):
    docs = T(spark, d, "documents").withColumn("metadata", F.to_json(F.struct("path", "n_chars", "lang")))
    store = DocumentStore(docs)
    return store.inputs("n_chars > `300` && (lang == 'en' || lang == 'de') && globmatch('/*-guide/*.html', path)").select("doc_id")


@query("SELECT count(*) AS file_count, max(epoch_us(modified_at) // 1000000)::BIGINT AS last_modified FROM documents")
def document_statistics(spark, d):
    docs = T(spark, d, "documents").withColumn("metadata", F.to_json(F.struct("path", F.unix_seconds("modified_at").alias("modified_at"))))
    return DocumentStore(docs).statistics()


@query()
def document_retrieval(spark, d):
    docs = T(spark, d, "documents").withColumn("metadata", F.to_json(F.struct("path", "lang")))
    store = DocumentStore(docs, lambda t: P.token_chunks(t, 20, 60))
    q = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return store.retrieve(q, 3).select("query_id", "rank", F.round("score", 6).alias("score"), "chunk")


@query("SELECT doc_id, true AS whole FROM documents WHERE length(trim(text)) > 0")
def split_tokens(spark, d):
    """Every text in chunks of at most 60 tokens; put together they are the text again."""
    c = P.split_texts(T(spark, d, "documents").where("length(trim(text)) > 0").select("doc_id", "text"), "text", lambda t: P.token_chunks(t, 20, 60))
    return c.groupBy("doc_id", "text").agg((F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "") == F.col("text")).alias("whole")).drop("text")


@query("SELECT doc_id, true AS fit FROM documents WHERE regexp_matches(text, '\\S')")
def split_recursive(spark, d):
    """Every text in chunks of at most 300 characters."""
    c = P.split_texts(T(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", "text"), "text", lambda t: P.recursive_chunks(t, 300))
    return c.groupBy("doc_id").agg((F.max(F.length("chunk")) <= 300).alias("fit"))


@query("SELECT n_nationkey AS left_id, n_nationkey AS right_id FROM nation")
def fuzzy_match(spark, d):
    """Nations against their own names written otherwise: every one finds itself."""
    n = T(spark, d, "nation").select("n_nationkey", F.concat_ws(" ", F.lower("n_name"), F.col("n_nationkey").cast("string")).alias("t"))
    m = T(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws("  ", F.lit("the nation of"), F.upper("n_name"), F.col("n_nationkey").cast("string")).alias("t"))
    return Z.fuzzy_match(n, m, "n_nationkey", "t", "k", "t").select("left_id", "right_id")


@query()
def fuzzy_self_match(spark, d):
    return Z.fuzzy_self_match(T(spark, d, "nation"), "n_nationkey", "n_name", features=Z.letters)


@query("SELECT c_custkey AS left_id, c_custkey AS right_id FROM customer")
def fuzzy_match_customers(spark, d):
    """Customers against their own names written otherwise, the segment being a frequent word on both sides."""
    c = T(spark, d, "customer").select("c_custkey", F.concat_ws(" ", F.lower("c_name"), "c_mktsegment").alias("t"))
    m = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws("  ", F.lit("the"), "c_mktsegment", F.upper("c_name")).alias("t"))
    return Z.fuzzy_match(c, m, "c_custkey", "t", "k", "t").select("left_id", "right_id")


@query()
def fuzzy_self_match_customers(spark, d):
    """Customers of about the same balance, the closer if segment and nation are the same as well."""
    balance = F.concat(F.lit("b"), F.floor("c_acctbal"))
    c = T(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("n"), "c_nationkey"), balance).alias("t"))
    return Z.fuzzy_self_match(c, "c_custkey", "t")


@query()
def viterbi_paths(spark, d):
    """Busy and calm phases of users, from how many events follow each other."""
    e = T(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    stay = {("calm", "calm"): -0.2, ("calm", "busy"): -1.7, ("busy", "busy"): -0.3, ("busy", "calm"): -1.4}
    emit = lambda s, o: -0.4 if (o in ("click", "purchase")) == (s == "busy") else -1.2
    p = G.viterbi_groups(e, ["user_id"], ["ts", "event_id"], "event_type", ["calm", "busy"], ["calm", "busy"], stay, emit, keep=10)
    return p.select("user_id", F.array_join("path", ",").alias("path"))


@query("SELECT event_id, round(value * 2, 4) AS twice FROM events")
def python_function(spark, d):
    twice = U.udf(lambda x: x * 2, "double", propagate_none=True)
    return T(spark, d, "events").select("event_id", F.round(twice("value"), 4).alias("twice"))


@query("SELECT event_id, event_type || '!' AS loud FROM events")
def async_function(spark, d):
    async def shout(s):
        return s + "!"

    f = U.udf(shout, "string", propagate_none=True, capacity=64, retries=U.FixedDelay(2, 1), cache=U.InMemoryCache())
    return T(spark, d, "events").select("event_id", f("event_type").alias("loud"))


class _Parity(U.AsyncTransformer):
    async def invoke(self, event_id, user_id):
        if user_id % 10 == 0:
            raise ValueError("not this one")
        return {"even": 1 - event_id % 2}


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN user_id % 10 <> 0 THEN 1 - event_id % 2 END AS even FROM events")
def async_transformer(spark, d):
    return _Parity(T(spark, d, "events").select("event_id", "user_id"), "even bigint").finished.select("event_id", "status", "even")


@query("SELECT n_nationkey, n_nationkey - (SELECT avg(n_nationkey) FROM nation) AS off FROM nation")
def apply_all_rows(spark, d):
    n = T(spark, d, "nation").select("n_nationkey")
    return U.apply_all_rows(n, lambda f: f.assign(off=f.n_nationkey - f.n_nationkey.mean()), "n_nationkey int, off double")


def _folder(spark) -> str:
    return f"{shared_dir(spark).removeprefix('file://')}/io-{uuid.uuid4().hex}"


@query("SELECT * FROM nation")
def csv_round_trip(spark, d):
    p = _folder(spark)
    IO.write_csv(T(spark, d, "nation"), "file://" + p)
    return IO.read_csv(spark, "file://" + p, "n_nationkey int, n_name string, n_regionkey int", pattern="*.csv")


@query("SELECT * FROM customer")
def jsonlines_round_trip(spark, d):
    p = _folder(spark)
    IO.write_jsonlines(T(spark, d, "customer"), "file://" + p)
    return IO.read_jsonlines(spark, "file://" + p, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", pattern="*.json")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def jsonlines_field_paths(spark, d):
    p = _folder(spark)
    IO.write_jsonlines(T(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props")), "file://" + p)
    return IO.read_jsonlines(spark, "file://" + p, "event_id bigint, k bigint", field_paths={"k": "/props/k"}, pattern="*.json")


@query("SELECT r_name AS data FROM region")
def plaintext_round_trip(spark, d):
    p = _folder(spark)
    T(spark, d, "region").select("r_name").write.text("file://" + p)
    return IO.read_plaintext(spark, "file://" + p, pattern="*.txt")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sqlite_round_trip(spark, d):
    import os

    p = _folder(spark)
    os.makedirs(p)
    IO.write_sqlite(T(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{p}/t.db", "t")
    return IO.read_sqlite(spark, f"{p}/t.db", "t")


@query("SELECT k, count(*) AS n, sum(d)::BIGINT AS s FROM (SELECT seq, k, 1 AS d FROM change_feed WHERE diff = 1 UNION ALL SELECT seq, k, -1 FROM change_feed WHERE diff = -1) GROUP BY k")
def change_envelopes(spark, d):
    """The feed as change envelopes, read back as rows with _diff."""
    f = T(spark, d, "change_feed")
    image = F.struct("k", "v")
    env = F.to_json(F.struct(F.struct(F.when(F.col("diff") > 0, "c").otherwise("d").alias("op"), F.when(F.col("diff") < 0, image).alias("before"), F.when(F.col("diff") > 0, image).alias("after")).alias("payload")))
    rows = IO.read_change_envelopes(f.select(env.alias("value")), "k: bigint, v: string")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("_diff").alias("s"))
