"""Queries of the temporal and streaming operators, over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as W
from ..session import shared_dir
from ..session import table as T
from ..streaming import changes as C
from ..streaming import run as R

QUERIES, ORACLES = {}, {}
H = 3_600_000_000


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def events(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events")


@query("""SELECT user_id, make_timestamp(k * 3600000000) AS window_start, make_timestamp((k + 1) * 3600000000) AS window_end, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, epoch_us(ts) // 3600000000 AS k FROM events) GROUP BY user_id, k""")
def window_tumbling(spark, d):
    return W.windowby(events(spark, d), "ts", W.tumbling(H), {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}, ["user_id"])


@query("""SELECT make_timestamp(k * 1800000000) AS window_start, make_timestamp(k * 1800000000 + 7200000000) AS window_end, count(*) AS n
FROM (SELECT unnest(range((epoch_us(ts) - 7200000000) // 1800000000 + 1, epoch_us(ts) // 1800000000 + 1)) AS k FROM events) GROUP BY k""")
def window_sliding(spark, d):
    return W.windowby(events(spark, d), "ts", W.sliding(H // 2, ratio=4), {"n": F.count(F.lit(1))})


@query("SELECT k * 10.0 AS window_start, k * 10.0 + 10.0 AS window_end, count(*) AS n FROM (SELECT floor(value / 10)::BIGINT AS k FROM events WHERE value IS NOT NULL) GROUP BY k")
def window_of_numbers(spark, d):
    return W.windowby(events(spark, d), "value", W.tumbling(10.0), {"n": F.count(F.lit(1))})


_SESSIONS = """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n FROM b GROUP BY user_id, s"""


@query(_SESSIONS)
def window_session(spark, d):
    return W.windowby(events(spark, d), "ts", W.Session(max_gap=2 * H), {"n": F.count(F.lit(1))}, ["user_id"], ["event_id"])


@query(_SESSIONS)
def window_session_predicate(spark, d):
    near = lambda a, b: F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")) < 2 * H
    return W.windowby(events(spark, d), "ts", W.Session(predicate=near), {"n": F.count(F.lit(1))}, ["user_id"], ["event_id"])


@query("""SELECT a.user_id, a.ts AS at, count(e.event_id) AS n, round(sum(e.value), 4) AS total
FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') a LEFT JOIN events e ON e.user_id = a.user_id AND epoch_us(e.ts) - epoch_us(a.ts) BETWEEN -3600000000 AND 1800000000 GROUP BY 1, 2""")
def window_intervals_over(spark, d):
    e = events(spark, d)
    at = e.where("event_type = 'signup'").select("user_id", "ts")
    return W.windowby(e, "ts", W.IntervalsOver(at, "ts", -H, H // 2), {"n": F.count("event_id"), "total": F.round(F.sum("value"), 4)}, ["user_id"])


def _clicks_and_views(spark, d):
    both = events(spark, d)
    pick = lambda t, p: both.where(F.col("event_type") == t).select(F.col("event_id").alias(p + "id"), F.col("user_id").alias(p + "user"), F.col("ts").alias(p + "ts"))
    return pick("click", "c_"), pick("view", "v_")


_CV = "WITH c AS (SELECT event_id AS c_id, user_id AS c_user, ts AS c_ts FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS v_id, user_id AS v_user, ts AS v_ts FROM events WHERE event_type = 'view') "
_NEAR = "c_user = v_user AND epoch_us(v_ts) - epoch_us(c_ts) BETWEEN -3600000000 AND 7200000000"


def _interval(how: str, sql_how: str):
    @query(_CV + f"SELECT c_id, v_id FROM c {sql_how} JOIN v ON {_NEAR}")
    def run(spark, d):
        c, v = _clicks_and_views(spark, d)
        return W.interval_join_rows(c, v, "c_ts", "v_ts", -H, 2 * H, {"c_id": "c_id"}, {"v_id": "v_id"}, {"c_user": "v_user"}, how)

    QUERIES[f"interval_join_{how}"] = QUERIES.pop("run")
    ORACLES[f"interval_join_{how}"] = ORACLES.pop("run")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _interval(_how, _sql)


def _windows(how: str, sql_how: str):
    @query(_CV + f"SELECT c_id, v_id FROM c {sql_how} JOIN v ON c_user = v_user AND epoch_us(c_ts) // 14400000000 = epoch_us(v_ts) // 14400000000")
    def run(spark, d):
        c, v = _clicks_and_views(spark, d)
        return W.window_join_rows(c, v, "c_ts", "v_ts", W.tumbling(4 * H), {"c_id": "c_id"}, {"v_id": "v_id"}, {"c_user": "v_user"}, how).select("c_id", "v_id")

    QUERIES[f"window_join_{how}"] = QUERIES.pop("run")
    ORACLES[f"window_join_{how}"] = ORACLES.pop("run")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _windows(_how, _sql)


_ASOF = {
    ("backward", "left"): "SELECT c_id, (SELECT max_by(v_id, (v_ts, v_id)) FROM v WHERE v_user = c_user AND v_ts <= c_ts) AS v_id FROM c",
    ("forward", "left"): "SELECT c_id, (SELECT min_by(v_id, (v_ts, v_id)) FROM v WHERE v_user = c_user AND v_ts > c_ts) AS v_id FROM c",
    ("backward", "right"): "SELECT (SELECT max_by(c_id, (c_ts, c_id)) FROM c WHERE c_user = v_user AND c_ts < v_ts) AS c_id, v_id FROM v",
    ("forward", "right"): "SELECT (SELECT min_by(c_id, (c_ts, c_id)) FROM c WHERE c_user = v_user AND c_ts >= v_ts) AS c_id, v_id FROM v",
    ("nearest", "left"): "SELECT c_id, (SELECT min_by(v_id, (abs(epoch_us(v_ts) - epoch_us(c_ts)), v_ts < c_ts, v_id)) FROM v WHERE v_user = c_user) AS v_id FROM c",
    ("backward", "outer"): "SELECT c_id, (SELECT max_by(v_id, (v_ts, v_id)) FROM v WHERE v_user = c_user AND v_ts <= c_ts) AS v_id FROM c UNION ALL SELECT (SELECT max_by(c_id, (c_ts, c_id)) FROM c WHERE c_user = v_user AND c_ts < v_ts) AS c_id, v_id FROM v",
}


def _asof(direction: str, how: str, oracle: str, shard: int | None = None):
    @query(_CV + oracle)
    def run(spark, d):
        c, v = _clicks_and_views(spark, d)
        return W.asof_join(c, v, "c_ts", "v_ts", {"c_id": "c_id"}, {"v_id": "v_id"}, {"c_user": "v_user"}, direction, how, ["c_id"], ["v_id"], shard=shard)

    name = f"asof_join_{direction}_{how}" + ("_sharded" if shard else "")
    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for (_d, _h), _o in _ASOF.items():
    _asof(_d, _h, _o)
_asof("backward", "left", _ASOF["backward", "left"], 24 * H)
_asof("nearest", "left", _ASOF["nearest", "left"], 24 * H)


@query("SELECT event_id, user_id, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff_value FROM events")
def ordered_diff(spark, d):
    return W.diff(events(spark, d), "ts", ["value"], ["user_id"], ["event_id"]).select("event_id", "user_id", "value", F.round("diff_value", 6).alias("diff_value"))


@query("""WITH x AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1 FROM x
WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) * (v1 - v0) / (t1 - t0) END, 6) AS v FROM y""")
def interpolate(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return W.interpolate(e, "ts", ["v"], ["user_id"], ["event_id"]).select("event_id", F.round("v", 6).alias("v"))


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type GROUP BY user_id""")
def deduplicate_changes(spark, d):
    return C.deduplicate(events(spark, d), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_id")


@query("""SELECT user_id, min_by(event_id, (-value, ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def deduplicate_acceptor(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ts", "value")
    return C.deduplicate(e, ["user_id"], "value", ["ts", "event_id"], lambda new, old: new > old).select("user_id", "event_id")


@query("SELECT user_id, ts AS inactive_t FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE epoch_us(n) - epoch_us(ts) > 86400000000")
def inactivity(spark, d):
    return C.inactivity(events(spark, d), "ts", 24 * H, ["user_id"])[0]


def _feed(spark, d):
    return T(spark, d, "change_feed").select("k", "v", F.col("time").alias("_time"), F.col("diff").alias("_diff")).distinct()


_FEED = "WITH f AS (SELECT DISTINCT k, v, time, diff FROM change_feed) "


@query(_FEED + "SELECT k, v, sum(diff)::BIGINT AS _diff FROM f GROUP BY k, v HAVING sum(diff) <> 0")
def consolidate_changes(spark, d):
    return C.consolidate(_feed(spark, d))


@query(_FEED + "SELECT k, v, time AS _time FROM f WHERE diff > 0")
def remove_retractions(spark, d):
    return C.remove_retractions(_feed(spark, d)).drop("_diff")


@query("SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY time DESC, diff DESC, seq DESC) AS r FROM change_feed) WHERE r = 1 AND diff > 0")
def stream_to_table(spark, d):
    f = T(spark, d, "change_feed").withColumn("up", F.col("diff") > 0)
    return C.stream_to_table(f, ["k"], "up", ["time", "diff", "seq"]).select("k", "v")


@query("SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY time DESC, seq DESC, diff DESC) AS r FROM change_feed) WHERE r = 1 AND diff > 0")
def from_two_streams(spark, d):
    f = T(spark, d, "change_feed")
    return C.from_streams(f.where("diff > 0").select("k", "v", "time", "seq"), f.where("diff < 0").select("k", "time", "seq"), ["k"], ["time", "seq"]).select("k", "v")


@query("""SELECT e.event_id, count(c.c_custkey) AS n FROM events e JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 100 <= epoch_us(e.ts) // 86400000000 - 19723 GROUP BY 1""")
def asof_now_join(spark, d):
    """Customers arrive a hundredth a day; an event sees those that are there."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (24 * H)) - 19723
    q = events(spark, d).select("event_id", "user_id", day.alias("_time"))
    s = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_custkey", (F.col("c_custkey") % 100).alias("_time"), F.lit(1).alias("_diff"))
    return C.asof_now_join(q, s, ["user_id"], ["event_id"], ["c_custkey"]).groupBy("event_id").agg(F.count("c_custkey").alias("n"))


@query("""WITH b AS (SELECT event_id, epoch_us(ts) AS t, event_id // 500 AS batch FROM events), m AS (SELECT batch, max(t) AS m FROM b GROUP BY batch),
c AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM m)
SELECT event_id FROM b JOIN c USING (batch) WHERE now IS NULL OR now < t + 60000000""")
def ignore_late_rows(spark, d):
    e = events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("event_id") / 500).alias("_time"))
    return C.ignore_late(e, F.col("t") + 60_000_000, "t").select("event_id")


@query("""WITH b AS (SELECT event_id, epoch_us(ts) AS t, event_id // 500 AS batch FROM events), m AS (SELECT batch, max(t) AS m FROM b GROUP BY batch),
c AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS now FROM m)
SELECT event_id, (SELECT min(c.batch) FROM c WHERE c.batch >= b.batch AND c.now >= b.t + 86400000000) AS out_batch FROM b""")
def buffer_rows(spark, d):
    e = events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("event_id") / 500).alias("_time"))
    return C.buffered(e, F.col("t") + 24 * H, "t").select("event_id", F.col("_out").alias("out_batch"))


@query("SELECT event_id FROM events WHERE epoch_us(ts) + 86400000000 > (SELECT max(epoch_us(ts)) FROM events)")
def forget_rows(spark, d):
    e = events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return C.forgotten(e, F.col("t") + 24 * H, "t").select("event_id")


@query("WITH x AS (SELECT event_id, user_id, (event_id % 5)::BIGINT AS t FROM events) SELECT t.t AS _time, count(*) AS n FROM x JOIN (SELECT DISTINCT t FROM x) t ON t.t >= x.t GROUP BY t.t")
def snapshots(spark, d):
    c = events(spark, d).select("event_id", "user_id", (F.col("event_id") % 5).alias("_time"), F.lit(1).alias("_diff"))
    return C.snapshots(c).groupBy("_time").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark, d):
    kinds = ", ".join(f"{c} {t}" for c, t in T(spark, d, "events").dtypes)
    return R.read_files(spark, d, kinds, "parquet", "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT make_timestamp(k * 3600000000) AS window_start, make_timestamp((k + 1) * 3600000000) AS window_end, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 AS k FROM events) GROUP BY k")
def stream_windows(spark, d):
    """The stream of the events' files through watermarked windows; what it gives in the end."""
    s = _stream(spark, d)
    out = R.to_memory(R.windowed(s, "ts", "1 hour", {"n": F.count(F.lit(1))}), f"w_{uuid.uuid4().hex}", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_upserts(spark, d):
    """The stream of the events' files into a keyed target."""
    s = _stream(spark, d)
    path = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    R.upsert_into(s.select("user_id", "ts", "event_id", "event_type"), path + "/t", ["user_id"], path + "/c", ["ts", "event_id"]).awaitTermination()
    return R.latest_version(spark, path + "/t").select("user_id", "event_type")


@query("SELECT user_id FROM events GROUP BY user_id")
def stream_deduplicated(spark, d):
    s = _stream(spark, d)
    return R.to_memory(R.deduplicated(s.select("user_id"), ["user_id"]), f"d_{uuid.uuid4().hex}")


_BATCHED = """WITH b AS (SELECT event_id, epoch_us(ts) AS t, event_id // 500 AS batch FROM events), m AS (SELECT batch, max(t) AS m FROM b GROUP BY batch),
c AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM m), k AS (SELECT *, t // 3600000000 * 3600000000 AS w FROM b JOIN c USING (batch)) """


def _batched(spark, d):
    return events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("event_id") / 500).alias("_time"))


@query(_BATCHED + "SELECT w AS window_start, w + 3600000000 AS window_end, count(*) AS n FROM k WHERE now IS NULL OR now < w + 3600000000 + 600000000 GROUP BY w")
def window_cutoff(spark, d):
    return C.windowby_behaved(_batched(spark, d), "t", W.tumbling(H), {"n": F.count(F.lit(1))}, W.Behavior(cutoff=600_000_000))


@query(_BATCHED + "SELECT w AS window_start, w + 3600000000 AS window_end, count(*) AS n FROM k WHERE (now IS NULL OR now < w + 3600000000 + 86400000000) AND (SELECT max(t) FROM b) < w + 3600000000 + 86400000000 GROUP BY w")
def window_forgetting(spark, d):
    return C.windowby_behaved(_batched(spark, d), "t", W.tumbling(H), {"n": F.count(F.lit(1))}, W.Behavior(cutoff=24 * H, keep_results=False))


@query(_BATCHED + """, o AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS clock FROM m)
SELECT w AS window_start, w + 3600000000 AS window_end, count(*) AS n, min((SELECT min(o.batch) FROM o WHERE o.batch >= k.batch AND o.clock >= k.w + 3600000000)) AS out_batch FROM k WHERE now IS NULL OR now < w + 3600000000 GROUP BY w""")
def window_exactly_once(spark, d):
    w = W.tumbling(H)
    return C.windowby_behaved(_batched(spark, d), "t", w, {"n": F.count(F.lit(1))}, W.exactly_once(w)).withColumnRenamed("_out", "out_batch")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_replayed_batches(spark, d):
    """The events of four batches replayed one by one."""
    from ..streaming.demo import replay_batches

    e = events(spark, d).select("event_type", F.floor(F.pmod(F.col("event_id"), F.lit(4))).alias("_time"))
    return R.to_memory(replay_batches(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"b_{uuid.uuid4().hex}", "complete")
