"""Queries of the relational operators: projections, functions, reducers, joins, key sets, SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import jsons as J
from ..functions import text as S
from ..functions import times as D
from ..operators import joins, reducers, table
from ..session import table as T
from .sql import sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        T(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
        )
    )


@query("SELECT c_custkey AS key, c_name AS label, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def select_filter_rename(spark, d):
    c = T(spark, d, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").withColumn("twice", F.col("c_acctbal") * 2)
    return table.rename(table.without(c, "c_nationkey", "c_acctbal", "c_mktsegment"), {"c_custkey": "key"}, label="c_name")


@query("SELECT 'yes' AS side, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'no', count(*), round(sum(o_totalprice), 2) FROM orders WHERE NOT coalesce(o_totalprice > 200000, false)")
def split_sides(spark, d):
    yes, no = table.split(T(spark, d, "orders"), F.col("o_totalprice") > 200000)
    agg = lambda x, n: x.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return agg(yes, "yes").unionByName(agg(no, "no"))


@query("SELECT p_partkey, p_size::VARCHAR AS p_size, floor(p_retailprice)::BIGINT AS price FROM part")
def cast_to_types(spark, d):
    return E.cast_types(T(spark, d, "part").select("p_partkey", "p_size", F.floor("p_retailprice").alias("price")), p_size="string", price="bigint")


@query("SELECT n_nationkey AS a_n_nationkey, n_name AS a_n_name FROM nation")
def with_prefix(spark, d):
    return table.with_prefix(T(spark, d, "nation").select("n_nationkey", "n_name"), "a_")


@query("SELECT r_regionkey AS r_regionkey_x, r_name AS r_name_x FROM region")
def with_suffix(spark, d):
    return table.with_suffix(T(spark, d, "region").select("r_regionkey", "r_name"), "_x")


@query("""SELECT o_orderkey, (floor((o_orderkey - 500) / 7.0))::BIGINT AS q, ((((o_orderkey - 500) % 7) + 7) % 7)::BIGINT AS m,
(o_orderkey - 500) / 8.0::DOUBLE AS t, (o_orderkey & 12)::BIGINT AS a, (o_orderkey | 3)::BIGINT AS o, xor(o_orderkey, 5)::BIGINT AS x, abs(o_orderkey - 500)::BIGINT AS ab,
((o_orderkey % 10) ** 2)::BIGINT AS p FROM orders""")
def arithmetic(spark, d):
    k = F.col("o_orderkey")
    return T(spark, d, "orders").select(
        "o_orderkey", E.floor_div(k - 500, 7).alias("q"), E.floor_mod(k - 500, 7).alias("m"), E.true_div(k - 500, 8).alias("t"), E.bit_and(k, 12).alias("a"),
        E.bit_or(k, 3).alias("o"), E.bit_xor(k, 5).alias("x"), F.abs(k - 500).alias("ab"), E.power(k % 10, 2, True).alias("p"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS f_price,
coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, -1.0) AS filled, round_even(o_totalprice, 0) AS rounded FROM orders""")
def null_handling(spark, d):
    f = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return T(spark, d, "orders").select(
        "o_orderkey", E.if_else(F.col("o_totalprice") > 200000, "big", "small").alias("size"), E.require(F.col("o_totalprice"), f).alias("f_price"),
        E.fill_na(f, -1.0).alias("filled"), E.round_even(F.col("o_totalprice")).alias("rounded"),
    )


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, reverse(p_name) AS rev, length(p_name) AS len, replace(p_name, 'a', '_') AS rep,
starts_with(p_name, 'p') AS sw, ends_with(p_type, 'L') AS ew, (length(p_type) - length(replace(p_type, 'E', '')))::BIGINT AS cnt, (strpos(p_type, 'E') - 1)::BIGINT AS fnd,
CASE WHEN strpos(reverse(p_type), 'E') = 0 THEN -1 ELSE length(p_type) - strpos(reverse(p_type), 'E') END::BIGINT AS rfnd, p_type[1:3] AS sl, trim(' ' || p_name || ' ') AS st,
CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS rp, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS pi FROM part""")
def text_functions(spark, d):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return T(spark, d, "part").select(
        "p_partkey", S.upper(n).alias("up"), S.lower(b).alias("lo"), S.reversed_(n).alias("rev"), S.length(n).alias("len"), S.replace(n, "a", "_").alias("rep"), S.startswith(n, "p").alias("sw"),
        S.endswith(t, "L").alias("ew"), S.count(t, "E").alias("cnt"), S.find(t, "E").alias("fnd"), S.rfind(t, "E").alias("rfnd"), S.slice_(t, 0, 3).alias("sl"),
        S.strip(F.concat(F.lit(" "), n, F.lit(" "))).alias("st"), S.removeprefix(b, "Brand").alias("rp"), S.parse_int(F.substring(b, 7, 10), optional=True).alias("pi"),
    )


@query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS da, hour(ts) AS h, minute(ts) AS mi, second(ts)::BIGINT AS s, (epoch_us(ts) % 1000000)::BIGINT AS us,
(isodow(ts) - 1)::BIGINT AS wd, strftime(ts, '%Y/%m/%d %H:%M:%S') AS txt, make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000) AS quarter_hour,
make_timestamp(epoch_us(ts) + 3600000000) AS later, epoch_us(ts) / 1000000.0::DOUBLE AS unix FROM events""")
def time_functions(spark, d):
    t = F.col("ts")
    naive = lambda c: c.cast("timestamp_ntz")
    return T(spark, d, "events").select(
        "event_id", D.year(t).alias("y"), D.month(t).alias("mo"), D.day(t).alias("da"), D.hour(t).alias("h"), D.minute(t).alias("mi"), D.second(t).alias("s"), D.microsecond(t).alias("us"),
        D.weekday(t).alias("wd"), D.strftime(t, "%Y/%m/%d %H:%M:%S").alias("txt"), naive(D.floor_to(t, 900_000_000)).alias("quarter_hour"), naive(D.add_duration(t, 3_600_000_000)).alias("later"),
        D.timestamp(t, "s").alias("unix"),
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.missing')::BIGINT, -1) AS m FROM events")
def json_functions(spark, d):
    v = J.parse(F.col("props"))
    return T(spark, d, "events").select("event_id", J.as_int(v, "k").alias("k"), J.as_int(v, "missing", default=-1).alias("m"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def unpack_json_columns(spark, d):
    return table.unpack_json(T(spark, d, "events").select("event_id", "props"), "props", "k bigint")


@query("""SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings""")
def array_products(spark, d):
    e = F.col("embedding")
    return T(spark, d, "embeddings").select("vec_id", F.round(E.dot(e, e), 4).alias("dot"), F.round(E.norm(e), 4).alias("norm"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most,
min_by(event_id, (value, event_id)) AS arg_least, min_by(event_id, (-value, event_id)) AS arg_most, min_by(event_type, (ts, event_id)) AS first_type, max_by(event_type, (ts, event_id)) AS last_type
FROM events GROUP BY user_id""")
def group_reducers(spark, d):
    return T(spark, d, "events").groupBy("user_id").agg(
        reducers.count().alias("n"), reducers.count_distinct("event_type").alias("kinds"), F.round(reducers.sum_("value"), 4).alias("total"), F.round(reducers.avg("value"), 6).alias("mean"),
        reducers.min_("value").alias("least"), reducers.max_("value").alias("most"), reducers.argmin("value", "event_id").alias("arg_least"), reducers.argmax("value", "event_id").alias("arg_most"),
        reducers.earliest("event_type", "ts", "event_id").alias("first_type"), reducers.latest("event_type", "ts", "event_id").alias("last_type"),
    )


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id""")
def tuple_reducers(spark, d):
    return T(spark, d, "events").groupBy("user_id").agg(
        F.array_join(reducers.sorted_tuple("event_type"), ",").alias("types"), F.array_join(reducers.tuple_(F.col("event_id").cast("string"), ["ts", "event_id"]), ",").alias("ids")
    )


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS only_status FROM orders GROUP BY o_custkey")
def unique_reducer(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(reducers.unique_or_null("o_orderstatus").alias("only_status"))


@query("SELECT l_returnflag, abs(1) = 1 AS near FROM lineitem GROUP BY l_returnflag")
def count_distinct_approximate(spark, d):
    n = T(spark, d, "lineitem").groupBy("l_returnflag").agg(reducers.count_distinct_approximate("l_orderkey").alias("a"), reducers.count_distinct("l_orderkey").alias("e"))
    return n.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e") + 1).alias("near"))


@query("SELECT label, i - 1 AS i, round(sum(embedding[i]::DOUBLE), 3) AS s FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i")
def array_sum_reducer(spark, d):
    s = reducers.array_sum(T(spark, d, "embeddings"), ["label"], "embedding")
    return s.select("label", F.posexplode("sum").alias("i", "s")).select("label", F.col("i").cast("bigint").alias("i"), F.round("s", 3).alias("s"))


@query("SELECT user_id, round(sum(value * value), 3) AS squares FROM events GROUP BY user_id")
def custom_accumulator(spark, d):
    return reducers.accumulate(T(spark, d, "events"), ["user_id"], ["value"], _Squares(), "double", "squares").withColumn("squares", F.round("squares", 3))


class _Squares(reducers.Accumulator):
    def from_row(self, row):
        return row[0] * row[0]

    def update(self, state, other):
        return state + other


@query("SELECT user_id, string_agg(event_type[1], '' ORDER BY ts, event_id) AS walk FROM events GROUP BY user_id")
def stateful_reducer(spark, d):
    return reducers.stateful_single(T(spark, d, "events"), ["user_id"], ["event_type"], lambda s, r: (s or "") + r[0][0], "string", "walk", ["ts", "event_id"])


@query("""SELECT user_id, event_type AS majority FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def majority(spark, d):
    return table.majority(T(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT * EXCLUDE r FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def argmax_rows(spark, d):
    return table.extreme_rows(T(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "value", ["event_id"])


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def star_join(spark, d):
    j = joins.join(T(spark, d, "orders").select("o_custkey", "o_totalprice"), T(spark, d, "customer").select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"}).select("o_totalprice", "c_nationkey")
    j = joins.join(j, T(spark, d, "nation"), {"c_nationkey": "n_nationkey"})
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _by_customer(spark, d):
    """Finished orders and accounts in credit per customer; what isn't either is counted under null."""
    a = T(spark, d, "orders").groupBy(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = T(spark, d, "customer").groupBy(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("k2")).agg(F.count(F.lit(1)).alias("n2"))
    return a, b


_BY_CUSTOMER = "WITH a AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS k2, count(*) AS n2 FROM customer GROUP BY 1) "


@query(_BY_CUSTOMER + "SELECT k, k2, n, n2 FROM a LEFT JOIN b ON k IS NOT DISTINCT FROM k2")
def join_left_null_safe(spark, d):
    a, b = _by_customer(spark, d)
    return joins.join_left(a, b, {"k": "k2"}).select("k", "k2", "n", "n2")


@query(_BY_CUSTOMER + "SELECT k, k2, n, n2 FROM a RIGHT JOIN b ON k IS NOT DISTINCT FROM k2")
def join_right_null_safe(spark, d):
    a, b = _by_customer(spark, d)
    return joins.join_right(a, b, {"k": "k2"}).select("k", "k2", "n", "n2")


@query(_BY_CUSTOMER + "SELECT k, k2, n, n2 FROM a FULL JOIN b ON k IS NOT DISTINCT FROM k2")
def join_outer_null_safe(spark, d):
    a, b = _by_customer(spark, d)
    return joins.join_outer(a, b, {"k": "k2"}).select("k", "k2", "n", "n2")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(spark, d):
    return joins.join(T(spark, d, "nation"), T(spark, d, "region")).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, d):
    return joins.semi(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return joins.anti(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT event_type, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1")
def salted_join(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return joins.salted(T(spark, d, "events"), c, ["user_id"], 8).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey > n_nationkey AND s_acctbal > 0")
def theta_join(spark, d):
    return joins.join(T(spark, d, "supplier"), T(spark, d, "nation")).where("s_nationkey > n_nationkey and s_acctbal > 0").select("s_suppkey", "n_name")


@query("""
SELECT v, 2.0::DOUBLE AS least, 2.0::DOUBLE AS greatest, 0.0::DOUBLE AS share, count(*) AS n FROM orders, (SELECT 2.0::DOUBLE AS v) GROUP BY v UNION ALL
SELECT v, 2.0, 12.0, 0.3, count(*) FROM orders, (SELECT 5.0::DOUBLE AS v) GROUP BY v UNION ALL
SELECT v, 12.0, 12.0, 1.0, count(*) FROM orders, (SELECT 12.0::DOUBLE AS v) GROUP BY v""")
def gradual_broadcast(spark, d):
    """Between 2 and 12: all rows see the lower bound at 2, a share of three tenths the upper one at 5, all at 12."""
    o = T(spark, d, "orders").select("o_orderkey")
    seen = [joins.gradual_broadcast(o, spark.createDataFrame([(2.0, v, 12.0)], "lo double, v double, hi double"), "lo", "v", "hi").withColumn("v", F.lit(v)) for v in (2.0, 5.0, 12.0)]
    share = F.round(F.avg((F.col("apx_value") == 12.0).cast("double")), 1)
    return reduce(DataFrame.unionByName, seen).groupBy("v").agg(F.min("apx_value").alias("least"), F.max("apx_value").alias("greatest"), share.alias("share"), F.count(F.lit(1)).alias("n"))


def _keyed(spark, d):
    """Customers in credit, and those of one segment with their balance set to 0."""
    c = T(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    a = table.with_id_from(c.where("c_acctbal > 0"), "c_custkey")
    b = table.with_id_from(c.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")
    return a, b


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def intersect_ids(spark, d):
    a, b = _keyed(spark, d)
    return table.intersect(a, b).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def difference_ids(spark, d):
    a, b = _keyed(spark, d)
    return table.difference(a, b).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def restrict_ids(spark, d):
    a, b = _keyed(spark, d)
    return table.restrict(a, b).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'")
def update_rows(spark, d):
    a, b = _keyed(spark, d)
    return table.update_rows(a, b).drop("id")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def update_cells(spark, d):
    a, b = _keyed(spark, d)
    return table.update_cells(a, table.restrict(b, a).select("id", "c_acctbal")).drop("id")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def lookup_rows(spark, d):
    c = table.with_id_from(T(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey")
    return table.lookup(T(spark, d, "orders").select("o_orderkey", "o_custkey"), E.row_key(F.col("o_custkey").alias("c0")), c, allow_misses=True).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_by_values(spark, d):
    o = joins.semi(T(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), T(spark, d, "customer").select("c_custkey"), ["c_custkey"]).withColumnRenamed("c_custkey", "k")
    return table.lookup_by_values(o, T(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"k": "c_custkey"}).select("o_orderkey", "c_mktsegment")


@query("SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
def lookup_single_row(spark, d):
    return table.lookup_single(T(spark, d, "nation").select("n_name"), T(spark, d, "region").agg(F.count(F.lit(1)).alias("regions")))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def concat_reindexed(spark, d):
    n = table.with_id_from(T(spark, d, "nation").select(F.col("n_name").alias("name")), "name")
    r = table.with_id_from(T(spark, d, "region").select(F.col("r_name").alias("name")), "name")
    return table.concat_reindex(n, r).select("name")


@query("SELECT vec_id, (i - 1)::BIGINT AS i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)")
def flatten_arrays(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("e"))
    return table.flatten(e, "e").select("vec_id", F.col("e.i").cast("bigint").alias("i"), F.col("e.x").cast("double").alias("x"))


@query("SELECT n_nationkey, unnest(string_split(n_name, '')) AS n_name FROM nation")
def flatten_texts(spark, d):
    return table.flatten(T(spark, d, "nation").select("n_nationkey", "n_name"), "n_name")


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sort_neighbours(spark, d):
    return table.neighbours(T(spark, d, "events").select("event_id", "user_id", "ts"), "ts", ["user_id"], "event_id").select("event_id", "prev", "next")


@query("SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders")
def sql_union(spark, d):
    return sql("SELECT c_mktsegment FROM c UNION SELECT o_orderpriority FROM o", c=T(spark, d, "customer"), o=T(spark, d, "orders"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def sql_intersect(spark, d):
    return sql("SELECT c_custkey AS k FROM c INTERSECT SELECT o_custkey FROM o", c=T(spark, d, "customer"), o=T(spark, d, "orders"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def sql_except(spark, d):
    return sql("SELECT c_custkey AS k FROM c EXCEPT SELECT o_custkey FROM o", c=T(spark, d, "customer"), o=T(spark, d, "orders"))


_HAVING = """WITH t AS (SELECT c_nationkey AS n, count(*) AS customers, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey HAVING count(*) > 2)
SELECT n_name, customers, top, CASE WHEN top BETWEEN 0 AND 9000 THEN 'mid' WHEN top IS NULL THEN 'none' ELSE 'high' END AS band
FROM t JOIN nation ON n = n_nationkey WHERE top > (SELECT avg(c_acctbal) FROM customer) AND NOT n_name = 'CHINA'"""


@query(_HAVING)
def sql_having_subquery(spark, d):
    return sql(_HAVING, customer=T(spark, d, "customer"), nation=T(spark, d, "nation"))


_JOINS = "SELECT r_name, count(*) AS suppliers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY r_name"


@query(_JOINS)
def sql_outer_joins(spark, d):
    return sql(_JOINS, region=T(spark, d, "region"), nation=T(spark, d, "nation"), supplier=T(spark, d, "supplier"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def top_k(spark, d):
    from ..operators.iterate import top_rows

    return top_rows(T(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return T(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(w) AS word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1")
def word_count(spark, d):
    w = T(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("count"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate""")
def shipping_priority(spark, d):
    c = T(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = T(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-03-15 00:00:00'").select("o_orderkey", "o_custkey", "o_orderdate")
    l = T(spark, d, "lineitem").where("l_shipdate > timestamp_ntz'1998-03-15 00:00:00'")
    j = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(spark, d):
    l = T(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01 00:00:00' and l_shipdate < timestamp_ntz'1998-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return l.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
