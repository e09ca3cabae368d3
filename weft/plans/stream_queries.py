"""Queries over the events as streams with state: they arrive in slices of time, a micro-batch each."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.stored import folder
from weft.streaming import event_stream, lifecycle

from . import views
from .registry import query

SLICES = 4
#: What each of the table's events stands for in a session's life.
KINDS = """CASE WHEN event_type = 'view' THEN 'send_message' WHEN event_type = 'purchase' THEN 'execution_complete' WHEN event_type = 'signup' THEN 'reply_user'
  WHEN event_type = 'click' THEN CASE event_id % 4 WHEN 0 THEN 'interrupt' WHEN 1 THEN 'ask_user' WHEN 2 THEN 'timeout' ELSE 'resume_session' END ELSE 'error' END"""


def lived(pace: int) -> str:
    """The events as steps of sessions, ``pace`` times as fast, up to the moment when the stream has passed them all."""
    return f"""e AS (SELECT user_id, event_id AS seq, epoch_us(ts) // {pace} AS moment, {KINDS} AS event FROM events),
  upto AS (SELECT (max(moment) // 1000 + 1) * 1000 AS until FROM e)"""


def _steps(spark, sf_dir, pace):
    e = views.table(spark, sf_dir, "events")
    at = F.expr(f"unix_micros(cast(ts as timestamp)) div {pace}")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.expr(KINDS).alias("event"), F.timestamp_micros(at).alias("ts"))


def _arriving(spark, rows):
    """The rows as a stream of slices of time, then a tick past the last; how late a row may come; and how many there are.

    Files of a slice come in any order, so a row is late by a slice at most.
    """
    first, last, count = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
    first, last = first or 0, last or 0
    width, path = (last - first) // SLICES + 1, folder(spark, "slices")
    late = width // lifecycle.SECOND + 2
    tick = spark.range(1).select(F.timestamp_micros(F.lit((last // 1000 + 1) * 1000 + late * lifecycle.SECOND)).alias("ts"))
    for i in range(SLICES):
        rows.where(F.floor((F.unix_micros("ts") - first) / width) == i).write.mode("append").parquet(path)
    n = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    lifecycle.ticks(tick).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, n // SLICES)).parquet(path)
    return stream, f"{late} seconds", count


def _buckets(rows: int) -> int:
    """Groups of sessions for a stream of some ``rows``: a few thousand rows each, and enough for all stores."""
    return 32 + rows // 10_000


def drained(spark, stream, rows: int = 0):
    """The rows that a stream with state gives until its input of some ``rows`` ends; a store for each hundred thousand."""
    path = folder(spark, "lived")
    with lifecycle.state_store(spark, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 + rows // 100_000)):
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


MACHINE = f"""WITH RECURSIVE {lived(30)}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, seq) AS n FROM e),
  run(user_id, n, seq, moment, event, status, since, accepted, code) AS (
    SELECT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', 'expired', CAST(0 AS BIGINT), false, '' FROM (SELECT DISTINCT user_id FROM o)
    UNION ALL
    SELECT user_id, n, seq, moment, event, CASE code WHEN '' THEN goes ELSE was END, CASE code WHEN '' THEN moment ELSE since END, code = '', code FROM (
      SELECT *, CASE event WHEN 'send_message' THEN 'running' WHEN 'resume_session' THEN 'resuming' WHEN 'reply_user' THEN 'resuming' WHEN 'execution_complete' THEN 'completed'
          WHEN 'error' THEN 'idle' WHEN 'ask_user' THEN 'awaiting_user' ELSE 'paused' END AS goes,
        CASE WHEN event = 'send_message' THEN CASE WHEN was = 'running' THEN 'SESSION_BUSY' ELSE '' END
          WHEN event = 'resume_session' THEN CASE WHEN was IN ('paused', 'awaiting_user') THEN '' ELSE 'SESSION_NOT_PAUSED' END
          WHEN event = 'reply_user' THEN CASE WHEN was = 'awaiting_user' THEN '' ELSE 'SESSION_NOT_PAUSED' END
          WHEN was IN ('running', 'resuming') THEN '' ELSE 'INVALID_REQUEST' END AS code
      FROM (SELECT o.user_id, o.n, o.seq, o.moment, o.event, CASE WHEN fresh THEN 'idle' ELSE r.status END AS was, CASE WHEN fresh THEN o.moment ELSE r.since END AS since
        FROM (SELECT *, CASE WHEN n = 0 THEN 0 WHEN status IN ('paused', 'awaiting_user') THEN since + 3600000000 ELSE moment + 1800000000 END AS due FROM run) r
        JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1, LATERAL (SELECT r.n = 0 OR r.due < o.moment AS fresh)))),
  done AS (SELECT *, CASE WHEN status IN ('paused', 'awaiting_user') THEN since + 3600000000 ELSE moment + 1800000000 END AS due, lead(moment) OVER (PARTITION BY user_id ORDER BY n) AS next FROM run WHERE n > 0)"""


@query(f"{MACHINE} SELECT seq AS event_id, status, accepted, code FROM done")
def ss04_status_machine(spark, sf_dir):
    stream, late, n = _arriving(spark, _steps(spark, sf_dir, 30))
    got = drained(spark, lifecycle.lifecycle(stream, late=late, buckets=_buckets(n)), n)
    return got.where("event != 'expire'").select(F.col("seq").alias("event_id"), "status", "accepted", "code")


@query(f"{MACHINE} SELECT user_id, seq AS last_event, due AS expired_at FROM done, upto WHERE due < coalesce(next, until + 1)")
def ss05_status_expiry(spark, sf_dir):
    stream, late, n = _arriving(spark, _steps(spark, sf_dir, 30))
    got = drained(spark, lifecycle.lifecycle(stream, late=late, buckets=_buckets(n)), n)
    return got.where("event = 'expire'").select(F.col("session_id").cast("bigint").alias("user_id"), F.col("seq").alias("last_event"), F.col("at").alias("expired_at"))


@query(f"""WITH {lived(1440)}, o AS (SELECT *, lead(moment) OVER (PARTITION BY user_id ORDER BY moment, seq) AS next FROM e),
  gaps AS (SELECT user_id, moment, CAST((coalesce(next, until + 1) - moment - 1) // 15000000 AS BIGINT) AS beats FROM o, upto WHERE event NOT IN ('execution_complete', 'error'))
  SELECT user_id, moment AS after, n, moment + n * 15000000 AS moment FROM (SELECT *, unnest(range(1, beats + 1)) AS n FROM gaps)""")
def ss06_heartbeats(spark, sf_dir):
    stream, late, n = _arriving(spark, _steps(spark, sf_dir, 1440))
    return drained(spark, lifecycle.heartbeats(stream, 15, late, _buckets(n)), n).select(F.col("session_id").cast("bigint").alias("user_id"), "after", "n", F.col("at").alias("moment"))


@query(f"""WITH {lived(30)}, g AS (SELECT *, event IN ('send_message', 'resume_session', 'reply_user') AS starts,
    count(*) FILTER (event IN ('execution_complete', 'error', 'ask_user', 'interrupt', 'timeout')) OVER (PARTITION BY user_id ORDER BY moment, seq ROWS UNBOUNDED PRECEDING) AS ended FROM e)
  SELECT seq AS event_id, row_number() OVER (PARTITION BY user_id, ended ORDER BY moment, seq) = 1 AS dispatched FROM g WHERE starts""")
def ss10_running_turns(spark, sf_dir):
    stream, late, n = _arriving(spark, _steps(spark, sf_dir, 30))
    return drained(spark, lifecycle.running_turns(stream, late, _buckets(n)), n).select(F.col("seq").alias("event_id"), "dispatched")


@query(f"""WITH {lived(30)}, o AS (SELECT *, lag(event) OVER w AS before, lag(moment) OVER w AS before_moment, lead(event) OVER w AS next, lead(moment) OVER w AS next_moment, lead(seq) OVER w AS next_seq
    FROM e WHERE event IN ('send_message', 'execution_complete') WINDOW w AS (PARTITION BY user_id ORDER BY moment, seq))
  SELECT CAST(seq AS VARCHAR) AS asked, CASE WHEN next = 'execution_complete' AND next_moment <= moment + 3600000000 THEN CAST(next_seq AS VARCHAR) END AS answered,
    CASE WHEN next_moment <= moment + 3600000000 THEN next_moment ELSE moment + 3600000000 END AS moment, CASE WHEN next_moment <= moment + 3600000000 THEN CASE next WHEN 'send_message' THEN 'replaced' ELSE 'answered' END ELSE 'expired' END AS outcome
  FROM o, upto WHERE event = 'send_message' AND (next_moment <= moment + 3600000000 OR moment + 3600000000 <= until)
  UNION ALL SELECT NULL, CAST(seq AS VARCHAR), moment, 'rejected' FROM o WHERE event = 'execution_complete' AND NOT coalesce(before = 'send_message' AND moment <= before_moment + 3600000000, false)""")
def ss11_questions(spark, sf_dir):
    """Views ask, purchases answer."""
    stream, late, n = _arriving(spark, _steps(spark, sf_dir, 30))
    asks, answers = stream.where(F.col("event").isin("send_message", lifecycle.TICK)), stream.where("event = 'execution_complete'")
    return drained(spark, lifecycle.questions(asks, answers, late=late, buckets=_buckets(n)), n).select(F.col("asked").cast("string").alias("asked"), F.col("answered").cast("string").alias("answered"), F.col("at").alias("moment"), "outcome")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS event, replace(props, ',', chr(10)) AS data FROM events")
def io26_event_stream(spark, sf_dir):
    """Events written as event-stream text by micro-batches, and read back by others."""
    event_stream.register(spark)
    path, text = folder(spark, "sent"), folder(spark, "event-stream")
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.replace("props", F.lit(","), F.lit("\n")).alias("data"))
    e.write.parquet(path)
    n = len(spark.read.schema(e.schema).parquet(path).inputFiles())
    sent = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", max(1, n // SLICES)).parquet(path).writeStream.format("weft_events")
    sent.option("path", text).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return drained(spark, spark.readStream.format("weft_events").option("path", text).load())
