"""Streaming jobs run to completion over the given tables; each has the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions.states import moves_sql
from voxtable.plans.catalog import PREV
from voxtable.plans.registry import query
from voxtable.plans.views import view, view_of
from voxtable.schemas import TABLES
from voxtable.session import fresh_path
from voxtable.streaming import jobs as sj
from voxtable.streaming import ordered as so


def stream_of(spark, sf, name):
    return sj.file_stream(spark, sf, TABLES[name], f"{name}.parquet")


@query("event_tail_stream", "SELECT event_id, episode_id, ts_ms, state, message FROM job_event WHERE event_id > 250")
def event_tail_stream(spark, sf):
    tail = view_of(stream_of(spark, sf, "events"), "job_event").where("event_id > 250")
    return sj.run_once(tail, "event-tail").select("event_id", "episode_id", "ts_ms", "state", "message")


def fed(spark, name, df, key, time, job, parts=(2, 0, 1)):
    """Write ``df`` in parts, in the given order, and run the job after each; the end marker comes last. All rows that came out."""
    folder, target = fresh_path(spark, name), fresh_path(spark, f"{name}-out")
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    numbered = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(len(parts))))
    pieces = [numbered.where(F.col("__part") == p).drop("__part") for p in parts]
    pieces += [sj.end_marker(spark, schema, key, time)] if time else []
    out = None
    for piece in pieces:
        piece.write.mode("append").parquet(folder)
        fresh = sj.resume(job(sj.file_stream(spark, folder, schema, "*.parquet")), target, stateful=time is not None)
        out = fresh if out is None else out.unionByName(fresh)
    return out


@query("event_tail_resumed", "SELECT event_id, episode_id, ts_ms, state, message FROM job_event WHERE event_id > 250")
def event_tail_resumed(spark, sf):
    """Three calls, each behind new files: every row comes out of one of them."""
    events = view(spark, sf, "job_event").select("event_id", "episode_id", "ts_ms", "state", "message")
    return fed(spark, "tail", events, "episode_id", None, lambda stream: stream.where("event_id > 250"))


YEAR_MS = 366 * 86_400_000


@query("transition_monitor_stream", "WITH " + PREV.replace("lead(ts_ms) OVER (PARTITION BY episode_id ORDER BY ts_ms, event_id) AS nx", "lag(ts_ms) OVER (PARTITION BY episode_id ORDER BY ts_ms, event_id) AS pt")
       + f" SELECT episode_id, event_id, from_state, state, (from_state, state) IN (SELECT (old, new) FROM {moves_sql()}) AS legal, ts_ms - pt AS previous_ms FROM p WHERE from_state IS NOT NULL")
def transition_monitor_stream(spark, sf):
    """The files hold each episode's events in no order; what comes out is in order."""
    events = view(spark, sf, "job_event").select("episode_id", "event_id", "ts_ms", "state")
    out = fed(spark, "moves", events, "episode_id", "ts_ms", lambda stream: so.monitored_moves(stream, reorder_ms=YEAR_MS))
    return out.where("NOT late").drop("late")


@query("upload_assembly_stream", "WITH RECURSIVE " + """ch AS (SELECT upload_id, seq, length, CAST(90 AS BIGINT) AS total, row_number() OVER (PARTITION BY upload_id ORDER BY seq) AS n, skewed + (seq//1000000000-1)*20 AS "offset" FROM upload_chunk),
 st AS (SELECT upload_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reject, CAST(0 AS BIGINT) AS done FROM (SELECT DISTINCT upload_id FROM ch)
  UNION ALL SELECT c.upload_id, c.n, c.seq, CASE WHEN done=total THEN 'ALREADY_COMPLETE' WHEN "offset"<>done THEN 'OFFSET_MISMATCH' WHEN "offset"+length > total THEN 'EXCEEDS_TOTAL' END,
   CASE WHEN done<>total AND "offset"=done AND "offset"+length <= total THEN done+length ELSE done END FROM st JOIN ch c ON c.upload_id=st.upload_id AND c.n=st.n+1)
SELECT upload_id, seq, reject, done AS committed_bytes, done=90 AS complete FROM st WHERE n > 0""")
def upload_assembly_stream(spark, sf):
    """The chunks of an upload come in the wrong order over several triggers."""
    chunks = view(spark, sf, "upload_chunk").selectExpr(
        "upload_id", "seq", "skewed + (seq DIV 1000000000 - 1)*20 AS offset", "length", "90L AS total_bytes")
    return fed(spark, "uploads", chunks, "upload_id", "seq", lambda stream: so.assembled_uploads(stream, reorder_ms=YEAR_MS))


SESSIONS = """WITH w AS (SELECT *, sum(opens) OVER (PARTITION BY episode_id ORDER BY s, pos) AS g FROM (
   SELECT *, CASE WHEN pe IS NULL OR s - pe >= 3600000 THEN 1 ELSE 0 END AS opens FROM (
     SELECT *, max(e) OVER (PARTITION BY episode_id ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM live_word)))
SELECT episode_id, min(s) AS first_ms, count(*) AS n_words FROM w GROUP BY episode_id, g"""


@query("ordered_word_sessions_stream", SESSIONS)
def ordered_word_sessions_stream(spark, sf):
    """Sessions of a keyed processor: the end of the input closes those that are open."""
    words = view(spark, sf, "live_word").selectExpr("episode_id", "s AS at_ms", "pos", "e - s AS length_ms")
    out = fed(spark, "sessions", words, "episode_id", "at_ms", lambda stream: so.word_sessions(stream, gap_ms=3_600_000, reorder_ms=YEAR_MS))
    return out.where("late_ms IS NULL").drop("late_ms")


@query("live_word_sessions_stream", SESSIONS + """
 HAVING max(e) + 3600000 - 1 <= (SELECT max(s) FROM live_word) - 3600000""")
def live_word_sessions_stream(spark, sf):
    words = stream_of(spark, sf, "events").selectExpr(
        "user_id AS episode_id", "date_trunc('MILLISECOND', CAST(ts AS TIMESTAMP)) AS at", "CAST(floor(value*1000) AS BIGINT) + 1 AS length_ms")
    # Append mode: a session comes out, and leaves the state, once the watermark has passed its end.
    out = sj.run_once(sj.silence_sessions(words, gap_ms=3_600_000), "sessions")
    first = F.expr("timestampdiff(MILLISECOND, CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' AS TIMESTAMP), first_at)")
    return out.select("episode_id", first.alias("first_ms"), "n_words")
