"""Queries over streams and stores: events that arrive in parts, some late, with a restart after each; events as the log of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyvalue import KeyValue, with_defaults
from ..sources.shared import scratch
from ..streaming import running as R
from .queries import add, table

PARTS = 4
# When an event arrives, in both dialects: in its quarter of the time, one in ten a part late, one in fifty two parts.
ARRIVAL = f"least({PARTS - 1}, cast(floor(event_id * {PARTS} / n) AS int) + CASE WHEN event_id % 10 = 3 THEN 1 WHEN event_id % 50 = 7 THEN 2 ELSE 0 END)"


def arrivals(s: SparkSession, d: str) -> list[DataFrame]:
    events = table(s, d, "events")
    dealt = events.crossJoin(F.broadcast(events.agg((F.max("event_id") + 1).alias("n")))).withColumn("part", F.expr(ARRIVAL))
    rows = dealt.select("part", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return [rows.filter(f"part = {k}").drop("part") for k in range(PARTS)]


def arrived(late: str) -> str:
    """SQL: events with their arrival, the mark (in micros) that the earlier arrivals left, and that of all."""
    return f"""a AS (SELECT *, epoch_us(ts) AS us, {ARRIVAL.replace("int)", "INTEGER)")} AS part FROM events, (SELECT max(event_id) + 1 AS n FROM events)),
        m AS (SELECT part, max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {late} AS mark FROM a GROUP BY part),
        k AS (SELECT a.*, m.mark, (SELECT max(us) // 1000 * 1000 - {late} FROM a) AS final FROM a JOIN m USING (part))"""


QUIET_MS, DELAY_DAYS = 3_600_000, 2
DELAY = f"{DELAY_DAYS * 86_400_000_000}::BIGINT"


def stream_saves(s: SparkSession, d: str) -> DataFrame:
    flow = lambda stream: R.saves(stream, "user_id", quiet_ms=QUIET_MS, late=f"{DELAY_DAYS} days")
    return R.arrive(s, arrivals(s, d), scratch(s, "saves"), flow).select("user_id", F.unix_micros("opened").alias("opened"), F.unix_micros("saved_at").alias("saved_at"), "n", "payload")


add("stream_saves", stream_saves, f"""WITH {arrived(DELAY)}, t AS (SELECT * FROM k WHERE mark IS NULL OR us > mark),
    f AS (SELECT *, coalesce(us >= lag(us) OVER (PARTITION BY user_id ORDER BY us) + {QUIET_MS}000, true) AS fresh FROM t), g AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM f)
    SELECT user_id, min(us) AS opened, max(us) + {QUIET_MS}000 AS saved_at, count(*) AS n, arg_max(event_type, (us, event_id)) AS payload FROM g GROUP BY user_id, b HAVING max(us) + {QUIET_MS}000 <= any_value(final)""")


def stream_flushes(s: SparkSession, d: str) -> DataFrame:
    flow = lambda stream: R.flushes(stream, "payload", every="1 day", late=f"{DELAY_DAYS} days")
    return R.arrive(s, arrivals(s, d), scratch(s, "flushes"), flow).select("payload", F.unix_micros("flushed_at").alias("flushed_at"), "n")


add("stream_flushes", stream_flushes, f"""WITH {arrived(DELAY)}, w AS (SELECT *, (us // 86400000000 + 1) * 86400000000 AS stop FROM k)
    SELECT event_type AS payload, stop AS flushed_at, count(*) AS n FROM w WHERE mark IS NULL OR stop > mark GROUP BY 1, 2 HAVING stop <= any_value(final)""")


def stream_store(s: SparkSession, d: str) -> DataFrame:
    store = KeyValue(s, scratch(s, "latest"))
    parts = arrivals(s, d)
    R.arrive(s, parts, scratch(s, "store"), None, R.latest(parts[0], "user_id", store))
    return store.state().select(F.col("key").cast("bigint").alias("user_id"), F.col("value").alias("payload"))


add("stream_store", stream_store, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS payload FROM events GROUP BY user_id")

# Events as changes of a store: one in nine deletes its key, one in 4001 clears all.
OP = "CASE WHEN event_id % 4001 = 4000 THEN 'clear' WHEN event_id % 9 = 4 THEN 'delete' ELSE 'put' END"
KEYS = "concat(event_type, '/', event_id * 7919 % 1009)"


def _changes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.expr(OP).alias("op"), F.expr(KEYS).alias("key"), F.concat("props", F.lit(" "), F.col("event_id").cast("string")).alias("value"))


def filled(s: SparkSession, d: str) -> KeyValue:
    """A store after all events, in four logs of their order, compacted after the second and the third."""
    store, changes = KeyValue(s, scratch(s, "values")), _changes(s, d)
    n = changes.agg(F.max("seq")).first()[0]
    edges = [-1, *(n * k // 4 for k in (1, 2, 3)), n]
    for k in range(4):
        store.append(changes.filter((F.col("seq") > edges[k]) & (F.col("seq") <= edges[k + 1])))
        if k in (1, 2):
            store.compact()
    return store


LAST = f"""l AS (SELECT {KEYS} AS key, arg_max({OP}, event_id) AS op, arg_max(props || ' ' || event_id, event_id) AS value, max(event_id) AS seq FROM events WHERE {OP} <> 'clear' GROUP BY 1),
    st AS (SELECT key, value FROM l WHERE op = 'put' AND seq > coalesce((SELECT max(event_id) FROM events WHERE {OP} = 'clear'), -1))"""
add("key_value_state", lambda s, d: filled(s, d).state().select("key", "value"), f"WITH {LAST} SELECT key, value FROM st")
add("preferences", lambda s, d: with_defaults(filled(s, d).state(), table(s, d, "customer").select(F.expr("concat('view/', c_custkey)").alias("key"), F.col("c_name").alias("value"))),
    f"WITH {LAST}, d AS (SELECT 'view/' || c_custkey AS key, c_name AS value FROM customer) SELECT coalesce(st.key, d.key) AS key, CASE WHEN st.key IS NULL THEN d.value ELSE st.value END AS value, st.key IS NOT NULL AS own FROM st FULL JOIN d ON d.key = st.key")
