"""Catalog, queue, state and table-update queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voxtable.functions.states import moves_sql
from voxtable.operators import catalog as ct
from voxtable.operators import rules as rl
from voxtable.operators import scan
from voxtable.plans.registry import query
from voxtable.plans.views import table, view
from voxtable.session import fresh_path, staged
from voxtable.sources.versions import Tables

EP = ["episode_id"]
QUEUE = "q AS (SELECT e.episode_id, s.priority, s.created_at AS sc, s.series_id, e.ordinal FROM episode e JOIN series s USING (series_id) WHERE e.status='QUEUED' AND e.queue_requested)"
DAY = 86_400_000


@query("next_episode", "WITH " + QUEUE + " SELECT episode_id FROM q ORDER BY priority, sc, series_id, ordinal, episode_id LIMIT 1")
def next_episode(spark, sf):
    return ct.next_episode(view(spark, sf, "episode"), view(spark, sf, "series")).select("episode_id")


@query("queue_order", "WITH " + QUEUE + " SELECT episode_id, row_number() OVER (ORDER BY priority, sc, series_id, ordinal, episode_id) AS queue_rank FROM q")
def queue_order(spark, sf):
    return ct.queue_order(view(spark, sf, "episode"), view(spark, sf, "series")).select("episode_id", "queue_rank")


@query("series_detail", """WITH o AS (SELECT episode_id, series_id FROM episode)
SELECT series_id, '0_series' AS kind, series_id AS position, '{"series_id":' || series_id || ',"title":"' || title || '","priority":' || priority || '}' AS doc FROM series
UNION ALL SELECT series_id, '1_glossary', updated_at, '{"zh":"' || replace(zh, chr(10), '\\n') || '","vi":"' || replace(vi, chr(10), '\\n') || '","locked":' || locked || '}' FROM glossary
UNION ALL SELECT series_id, '2_episode', ordinal, '{"episode_id":' || episode_id || ',"ordinal":' || ordinal || ',"filename":"' || filename || '","status":"' || status || '"}' FROM episode
UNION ALL SELECT series_id, '3_issue', issue_id, '{"episode_id":' || i.episode_id || ',"issue_id":' || issue_id || ',"code":"' || code || '","severity":"' || severity || '","resolved":' || resolved || '}' FROM issue i JOIN o USING (episode_id)
UNION ALL SELECT series_id, '4_artifact', artifact_id, '{"episode_id":' || a.episode_id || ',"kind":"' || kind || '","bytes":' || bytes || '}' FROM artifact a JOIN o USING (episode_id)""")
def series_detail(spark, sf):
    return ct.detail_rows(*[view(spark, sf, n) for n in ("series", "episode", "glossary", "issue", "artifact")])


@query("ordered_listing", "SELECT episode_id, ord, segment_id, start_ms, end_ms FROM segment ORDER BY episode_id, start_ms, end_ms, segment_id")
def ordered_listing(spark, sf):
    return view(spark, sf, "segment").select("episode_id", "ord", "segment_id", "start_ms", "end_ms").orderBy("episode_id", "start_ms", "end_ms", "segment_id")


@query("latest_artifact", """SELECT episode_id, kind, artifact_id, bytes, created_at FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY created_at DESC, artifact_id DESC) AS r FROM artifact
  WHERE kind IN ('final_video','preview_video')) WHERE r=1""")
def latest_artifact(spark, sf):
    return ct.latest_artifact(view(spark, sf, "artifact"), ["final_video", "preview_video"])


@query("replace_latest_artifact", """SELECT episode_id, kind, artifact_id, bytes, created_at FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, kind ORDER BY created_at DESC, artifact_id DESC) AS r FROM artifact) WHERE r=1""")
def replace_latest_artifact(spark, sf):
    return ct.replace_latest(view(spark, sf, "artifact"))


@query("event_page", "SELECT event_id, episode_id, state FROM job_event WHERE event_id > 250 ORDER BY event_id LIMIT 100")
def event_page(spark, sf):
    return ct.event_page(view(spark, sf, "job_event"), 250).select("event_id", "episode_id", "state")


@query("quota_admission", """WITH RECURSIVE r AS (SELECT series_id%25 AS workspace, episode_id, total_bytes, row_number() OVER (PARTITION BY series_id%25 ORDER BY episode_id) AS n FROM episode),
 st AS (SELECT workspace, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS episode_id, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS reserved_bytes, false AS admitted FROM (SELECT DISTINCT workspace FROM r)
  UNION ALL SELECT r.workspace, r.n, r.episode_id, CASE WHEN used + total_bytes <= 20000000 THEN used + total_bytes ELSE used END, used, used + total_bytes <= 20000000 FROM st JOIN r ON r.workspace=st.workspace AND r.n=st.n+1)
SELECT workspace, episode_id, reserved_bytes, admitted FROM st WHERE n > 0""")
def quota_admission(spark, sf):
    req = view(spark, sf, "episode").selectExpr("series_id % 25 AS workspace", "episode_id", "total_bytes")
    return ct.quota_admission(req, ["workspace"], 20_000_000, order="episode_id").select("workspace", "episode_id", "reserved_bytes", "admitted")


@query("issue_summary", "SELECT code, severity, count(*) AS n FROM issue WHERE NOT resolved GROUP BY ROLLUP(code, severity)")
def issue_summary(spark, sf):
    return ct.issue_summary(view(spark, sf, "issue"))


@query("review_gate", """SELECT episode_id FROM episode e WHERE status='NEEDS_REVIEW' AND NOT EXISTS (SELECT 1 FROM issue i WHERE i.episode_id=e.episode_id AND NOT resolved
   AND code IN ('ROI_REQUIRED','DURATION_REWRITE_REQUIRED','ALIGNMENT_REVIEW_REQUIRED','TRANSCRIPT_REVIEW_REQUIRED','MISSING_TTS_CLIP')) AND NOT EXISTS (SELECT 1 FROM segment s WHERE s.episode_id=e.episode_id AND (needs_review OR action='NEEDS_REVIEW'))""")
def review_gate(spark, sf):
    return ct.review_gate(view(spark, sf, "episode"), view(spark, sf, "issue"), view(spark, sf, "segment")).select("episode_id")


@query("review_flags", """SELECT d.doc_id, coalesce(quality=0, false) AS needs_review, CASE WHEN toxic=1 THEN 'KEEP' ELSE 'DUB' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_flags(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_review"), F.when(F.col("toxic") == 1, "KEEP").otherwise("DUB").alias("action"))


@query("checkpoint_mismatches", """WITH r AS (SELECT doc_id, source AS stage, sha256(text) AS want FROM documents WHERE doc_id%17<>3), c AS (SELECT doc_id, sha256(CASE WHEN doc_id%13=0 THEN text || 'x' ELSE text END) AS have FROM documents WHERE doc_id%19<>5)
SELECT doc_id, stage, CASE WHEN want IS NULL THEN 'NOT_INDEXED' WHEN have IS NULL THEN 'MISSING' ELSE 'CHECKSUM_MISMATCH' END AS reason FROM r FULL JOIN c USING (doc_id) WHERE want IS NULL OR have IS NULL OR want <> have""")
def checkpoint_mismatches(spark, sf):
    docs = table(spark, sf, "documents")
    recorded = docs.where("doc_id%17 <> 3").select("doc_id", F.col("source").alias("stage"), F.sha2("text", 256).alias("sha256"))
    current = docs.where("doc_id%19 <> 5").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id%13=0 THEN concat(text, 'x') ELSE text END"), 256).alias("sha256"))
    return ct.checkpoint_mismatches(recorded, current, ["doc_id"])


@query("roi_fallback", """SELECT episode_id, CASE WHEN episode_id%6=0 THEN 0.1::DOUBLE WHEN series_id%3=0 AND 1+series_id%9+1+series_id%8 <= 10 THEN 0::DOUBLE END AS x,
  CASE WHEN episode_id%6<>0 AND NOT (series_id%3=0 AND 1+series_id%9+1+series_id%8 <= 10) THEN 'ROI_REQUIRED' END AS issue FROM episode""")
def roi_fallback(spark, sf):
    out = ct.resolved_roi(view(spark, sf, "episode"), view(spark, sf, "series"))
    return out.select("episode_id", F.col("roi.x").alias("x"), "issue")


GLOSS = """cur AS (SELECT series_id, zh, any_value(vi) AS vi, bool_or(locked) AS locked, CAST(0 AS BIGINT) AS updated_at FROM (SELECT series_id, zh, 'old' AS vi, locked FROM glossary) GROUP BY series_id, zh),
 req AS (SELECT c_custkey AS request_id, c_custkey%7 AS series_id, p_name AS zh, p_brand AS vi, c_custkey%2=0 AS locked, c_custkey AS updated_at FROM customer JOIN part ON p_partkey%300=c_custkey
   UNION ALL SELECT updated_at+1000000, series_id, zh, 'new', updated_at%2=0, updated_at+1000000 FROM glossary),
 rq AS (SELECT series_id, request_id, count(*) > count(DISTINCT zh) AS dup, list(zh) FILTER (NOT locked) AS free, list(zh) FILTER (locked) AS fixed FROM req GROUP BY series_id, request_id),
 o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY request_id) AS n FROM rq WHERE NOT dup),
 w AS (SELECT s.series_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, coalesce((SELECT list(zh) FROM cur WHERE cur.series_id=s.series_id AND locked), []) AS held, true AS ok FROM (SELECT DISTINCT series_id FROM o) s
   UNION ALL SELECT w.series_id, o.n, o.request_id, CASE WHEN list_has_any(coalesce(free, []), held) THEN held ELSE list_concat(held, coalesce(fixed, [])) END, NOT list_has_any(coalesce(free, []), held)
     FROM w JOIN o ON o.series_id=w.series_id AND o.n=w.n+1),
 rej AS (SELECT request_id, 'DUPLICATE_TERM' AS code FROM rq WHERE dup UNION ALL SELECT request_id, 'LOCKED_TERM' FROM w WHERE NOT ok),
 good AS (SELECT * FROM req WHERE request_id NOT IN (SELECT request_id FROM rej)),
 newg AS (SELECT series_id, zh, arg_max(vi, age) AS vi, arg_max(locked, age) AS locked FROM (SELECT series_id, zh, vi, locked, -1 AS age FROM cur UNION ALL SELECT series_id, zh, vi, locked, request_id FROM good) GROUP BY series_id, zh)"""


def _glossary_inputs(spark, sf):
    g = view(spark, sf, "glossary")
    current = g.groupBy("series_id", "zh").agg(F.lit("old").alias("vi"), F.bool_or("locked").alias("locked"), F.lit(0).cast("long").alias("updated_at"))
    cust, part = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "part")
    req = part.withColumn("c_custkey", F.expr("p_partkey%300")).join(cust, "c_custkey").selectExpr(
        "c_custkey AS request_id", "c_custkey%7 AS series_id", "p_name AS zh", "p_brand AS vi", "c_custkey%2=0 AS locked", "c_custkey AS updated_at")
    more = g.selectExpr("updated_at+1000000 AS request_id", "series_id", "zh", "'new' AS vi", "updated_at%2=0 AS locked", "updated_at+1000000 AS updated_at")
    return current, req.unionByName(more), view(spark, sf, "series")


@query("glossary_upsert", "WITH RECURSIVE " + GLOSS + " SELECT series_id, zh, vi, locked FROM newg")
def glossary_upsert(spark, sf):
    return ct.glossary_upsert(*_glossary_inputs(spark, sf))[0].select("series_id", "zh", "vi", "locked")


@query("glossary_upsert_rejects", "WITH RECURSIVE " + GLOSS + " SELECT request_id, code FROM rej")
def glossary_upsert_rejects(spark, sf):
    return ct.glossary_upsert(*_glossary_inputs(spark, sf))[2]


@query("glossary_versions", "WITH RECURSIVE " + GLOSS + """ SELECT s.series_id, s.glossary_version + coalesce(n, 0) AS glossary_version FROM series s LEFT JOIN (SELECT series_id, count(DISTINCT request_id) AS n FROM good GROUP BY series_id) USING (series_id)""")
def glossary_versions(spark, sf):
    return ct.glossary_upsert(*_glossary_inputs(spark, sf))[1].select("series_id", "glossary_version")


PREV = "p AS (SELECT *, lag(state) OVER (PARTITION BY episode_id ORDER BY ts_ms, event_id) AS from_state, lead(ts_ms) OVER (PARTITION BY episode_id ORDER BY ts_ms, event_id) AS nx FROM job_event)"


@query("illegal_transitions", "WITH " + PREV + f" SELECT event_id, episode_id, from_state, state FROM p WHERE from_state IS NOT NULL AND (from_state, state) NOT IN (SELECT (old, new) FROM {moves_sql()})")
def illegal_transitions(spark, sf):
    out = ct.judged_moves(view(spark, sf, "job_event"), EP, ["ts_ms", "event_id"])
    return out.where("NOT legal").select("event_id", "episode_id", "from_state", "state")


@query("time_in_state", "WITH " + PREV + " SELECT event_id, episode_id, state, nx - ts_ms AS in_state_ms FROM p")
def time_in_state(spark, sf):
    out = ct.time_in_state(view(spark, sf, "job_event"), EP, ["ts_ms", "event_id"])
    return out.select("event_id", "episode_id", "state", "in_state_ms")


REQ = f"""mv AS (SELECT old, new FROM {moves_sql()}),
 r1 AS (SELECT o_orderkey + CASE WHEN o_orderkey%101=7 THEN 100000000 ELSE 0 END AS episode_id, CASE o_orderkey%4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'PREPARING' ELSE 'COMPLETED' END AS ns FROM orders WHERE o_orderpriority<>'5-LOW'),
 r2 AS (SELECT o_orderkey AS episode_id, CASE o_orderkey%2 WHEN 0 THEN 'QUEUED' ELSE 'FAILED' END AS ns FROM orders WHERE o_orderkey%3=0),
 j1 AS (SELECT r1.episode_id, e.status, ns, (status, ns) IN (SELECT (old, new) FROM mv) AS ok FROM r1 LEFT JOIN episode e USING (episode_id)),
 s1 AS (SELECT e.episode_id, CASE WHEN ok THEN ns ELSE e.status END AS status FROM episode e LEFT JOIN j1 USING (episode_id)),
 j2 AS (SELECT r2.episode_id, s1.status, ns, (status, ns) IN (SELECT (old, new) FROM mv) AS ok FROM r2 LEFT JOIN s1 USING (episode_id)),
 j AS (SELECT * FROM j1 UNION ALL SELECT * FROM j2)"""


def _transition_inputs(spark, sf):
    """Up to two requests for one episode; the second is judged on what the first left."""
    orders = table(spark, sf, "orders")
    first = orders.where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey + CASE WHEN o_orderkey%101=7 THEN 100000000 ELSE 0 END AS episode_id",
        "CASE o_orderkey%4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'PREPARING' ELSE 'COMPLETED' END AS status", "'m' AS message", "0L AS ts_ms")
    second = orders.where("o_orderkey%3 = 0").selectExpr(
        "o_orderkey AS episode_id", "CASE o_orderkey%2 WHEN 0 THEN 'QUEUED' ELSE 'FAILED' END AS status", "'m' AS message", "1L AS ts_ms")
    return view(spark, sf, "episode"), first.unionByName(second)


@query("status_transitions", "WITH " + REQ + " SELECT s1.episode_id, CASE WHEN ok THEN ns ELSE s1.status END AS status FROM s1 LEFT JOIN j2 USING (episode_id)")
def status_transitions(spark, sf):
    return ct.apply_transitions(*_transition_inputs(spark, sf))[0].select("episode_id", "status")


@query("transition_events", "WITH " + REQ + " SELECT episode_id, ns AS state FROM j WHERE ok")
def transition_events(spark, sf):
    return ct.apply_transitions(*_transition_inputs(spark, sf))[1].select("episode_id", "state")


@query("transition_rejects", "WITH " + REQ + " SELECT episode_id, status AS from_state, ns AS to_state, CASE WHEN status IS NULL THEN 'EPISODE_NOT_FOUND' ELSE 'INVALID_TRANSITION' END AS code FROM j WHERE ok IS NOT TRUE")
def transition_rejects(spark, sf):
    return ct.apply_transitions(*_transition_inputs(spark, sf))[2]


@query("upload_first_rejected", """WITH c AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY upload_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM upload_chunk),
 o AS (SELECT *, expected + skewed AS "offset", 90 AS total FROM c)
SELECT upload_id, seq, "offset", expected FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY seq) AS r FROM o WHERE "offset" <> expected OR "offset" + length > total) WHERE r=1""")
def upload_first_rejected(spark, sf):
    base = view(spark, sf, "upload_chunk")
    sized = scan.prefix(base, ["upload_id"], ["seq"], {"so_far": ("sum", F.col("length"))})
    chunks = sized.withColumn("offset", F.col("so_far") + F.col("skewed")).drop("so_far")
    totals = base.select("upload_id").distinct().withColumn("total_bytes", F.lit(90).cast("long"))
    return ct.first_rejected_chunk(chunks, ["upload_id"], totals)


@query("recovery_plan", """WITH a AS (SELECT *, episode_id%9<>4 AS source_ok, CASE WHEN status<>'PREPARING' OR episode_id%2=0 THEN CASE episode_id%3 WHEN 0 THEN 'TTS' WHEN 1 THEN 'ASR' END END AS st,
   CASE WHEN status<>'PREPARING' OR episode_id%2=0 THEN episode_id%7<>2 END AS valid FROM episode WHERE status IN ('V1_RUNNING','PREPARING','ASR')),
 d AS (SELECT *, (NOT source_ok OR (status<>'V1_RUNNING' AND NOT (status='PREPARING' AND valid IS NULL) AND NOT coalesce(valid, true))) AS bad FROM a)
SELECT episode_id, status, CASE WHEN bad THEN 'FAILED' WHEN queue_requested THEN 'QUEUED' ELSE 'CHECKPOINTED' END AS decision,
 CASE WHEN NOT bad THEN CASE WHEN status='V1_RUNNING' THEN 'V1_RUNNING' WHEN status='PREPARING' AND valid IS NULL THEN 'PREPARING' ELSE coalesce(st, 'SEPARATING') END END AS next_stage, CASE WHEN bad THEN 'CHECKPOINT_INVALID' END AS code FROM d""")
def recovery_plan(spark, sf):
    eps = view(spark, sf, "episode")
    marks = eps.where("status <> 'PREPARING' OR episode_id%2 = 0").selectExpr(
        "episode_id", "CASE episode_id%3 WHEN 0 THEN 'TTS' WHEN 1 THEN 'ASR' END AS checkpoint_stage", "episode_id%7 <> 2 AS valid")
    return ct.recovery_plan(eps, marks, eps.selectExpr("episode_id", "episode_id%9 <> 4 AS source_ok"))


STG = "CASE l_linenumber WHEN 1 THEN 'SEPARATING' WHEN 2 THEN 'ASR' WHEN 3 THEN 'ALIGNING' WHEN 4 THEN 'TRANSLATING' WHEN 5 THEN 'TTS' WHEN 6 THEN 'TIMING' ELSE 'QC' END"


@query("cascade_invalidation", f"""WITH r AS (SELECT DISTINCT l_orderkey AS episode_id, l_linenumber AS no, {STG} AS stage FROM lineitem), d AS (SELECT l_orderkey AS episode_id, min(l_linenumber) AS first FROM lineitem WHERE l_returnflag='R' AND l_partkey%3=0 GROUP BY 1)
SELECT r.episode_id, stage FROM r LEFT JOIN d USING (episode_id) WHERE first IS NULL OR no < first""")
def cascade_invalidation(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS episode_id", f"{STG} AS stage", "l_returnflag", "l_partkey")
    damaged = rows.where("l_returnflag = 'R' AND l_partkey%3 = 0").select("episode_id", "stage")
    return ct.invalidate_from(rows.select("episode_id", "stage").distinct(), damaged, EP)


@query("stages_to_run", f"""WITH w AS (SELECT DISTINCT l_orderkey AS episode_id, l_linenumber AS no, {STG} AS stage FROM lineitem), m AS (SELECT episode_id, min(no) AS first FROM w WHERE NOT (episode_id%5<>0 AND (episode_id+no)%6<>0) GROUP BY 1)
SELECT w.episode_id, stage FROM w JOIN m USING (episode_id) WHERE no >= first""")
def stages_to_run(spark, sf):
    want = table(spark, sf, "lineitem").selectExpr("l_orderkey AS episode_id", "l_linenumber AS no", f"{STG} AS stage", "sha2(CAST(l_linenumber AS STRING), 256) AS input_hash").distinct()
    done = want.where("episode_id%5 <> 0").withColumn("input_hash", F.expr("CASE WHEN (episode_id+no)%6=0 THEN 'other' ELSE input_hash END"))
    return ct.stages_to_run(want.drop("no"), done.drop("no"), EP).select("episode_id", "stage")


@query("resolved_issues", """SELECT issue_id, i.episode_id, code, (resolved OR (e.status='NEEDS_REVIEW' AND code IN ('DURATION_REWRITE_REQUIRED','ALIGNMENT_REVIEW_REQUIRED','TRANSCRIPT_REVIEW_REQUIRED','MISSING_TTS_CLIP','AUDIO_QC_FAILED'))
  OR e.status='FAILED') AS resolved FROM issue i JOIN episode e USING (episode_id)""")
def resolved_issues(spark, sf):
    eps, issues = view(spark, sf, "episode"), view(spark, sf, "issue")
    reviewed = ct.resolve_issues(issues, eps.where("status = 'NEEDS_REVIEW'"), ct.RESOLVED_BY_EDIT)
    retried = ct.resolve_issues(reviewed, eps.where("status = 'FAILED'"))
    return retried.select("issue_id", "episode_id", "code", "resolved")


@query("cascade_delete", """WITH del AS (SELECT series_id FROM series s WHERE priority=3 AND NOT EXISTS (SELECT 1 FROM episode e WHERE e.series_id=s.series_id AND e.status IN ('V1_RUNNING','PREPARING','ASR'))),
 de AS (SELECT episode_id FROM episode WHERE series_id IN (SELECT series_id FROM del))
SELECT 'series' AS table_name, count(*) AS n FROM series WHERE series_id NOT IN (SELECT series_id FROM del) UNION ALL SELECT 'episode', count(*) FROM episode WHERE episode_id NOT IN (SELECT episode_id FROM de)
UNION ALL SELECT 'issue', count(*) FROM issue WHERE episode_id NOT IN (SELECT episode_id FROM de) UNION ALL SELECT 'artifact', count(*) FROM artifact WHERE episode_id NOT IN (SELECT episode_id FROM de)""")
def cascade_delete(spark, sf):
    series, eps = view(spark, sf, "series"), view(spark, sf, "episode")
    gone = ct.deletable(series.where("priority = 3"), eps, "series_id")
    gone_eps = eps.join(gone.select("series_id"), "series_id", "left_semi")
    kept = {"series": ct.without_deleted(series, gone, ["series_id"]), "episode": ct.without_deleted(eps, gone_eps, EP),
            "issue": ct.without_deleted(view(spark, sf, "issue"), gone_eps, EP), "artifact": ct.without_deleted(view(spark, sf, "artifact"), gone_eps, EP)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("series_deleted_in_one_commit", """WITH del AS (SELECT series_id FROM series s WHERE priority=3 AND NOT EXISTS (SELECT 1 FROM episode e WHERE e.series_id=s.series_id AND e.status IN ('V1_RUNNING','PREPARING','ASR'))),
 de AS (SELECT episode_id FROM episode WHERE series_id IN (SELECT series_id FROM del)), iss AS (SELECT *, resolved OR (code = 'ROI_REQUIRED' AND episode_id IN (SELECT episode_id FROM episode)) AS r2 FROM issue WHERE episode_id NOT IN (SELECT episode_id FROM de))
SELECT CAST(0 AS BIGINT) AS version, 'series' AS table_name, count(*) AS n FROM series UNION ALL SELECT 0, 'episode', count(*) FROM episode UNION ALL SELECT 0, 'issue', count(*) FROM issue WHERE NOT resolved UNION ALL SELECT 0, 'artifact', count(*) FROM artifact
UNION ALL SELECT 2, 'series', count(*) FROM series WHERE series_id NOT IN (SELECT series_id FROM del) UNION ALL SELECT 2, 'episode', count(*) FROM episode WHERE episode_id NOT IN (SELECT episode_id FROM de)
UNION ALL SELECT 2, 'issue', count(*) FROM iss WHERE NOT r2 UNION ALL SELECT 2, 'artifact', count(*) FROM artifact WHERE episode_id NOT IN (SELECT episode_id FROM de)""")
def series_deleted_in_one_commit(spark, sf):
    """Three commits: the tables, a cascade over all four of them, resolved issues; rows (open issues) before and after."""
    tables = Tables(spark, fresh_path(spark, "tables"))
    tables.commit({n: view(spark, sf, n) for n in ("series", "episode", "issue", "artifact")}, -1)
    ct.delete_series(tables, tables.read("series").where("priority = 3"))
    ct.change_tables(tables, {"issue": lambda issues: ct.resolve_issues(issues, tables.read("episode", 0), ["ROI_REQUIRED"])})
    parts = []
    for version in (0, tables.version()):
        for name in tables.names(version):
            df = tables.read(name, version)
            parts.append((df.where("NOT resolved") if name == "issue" else df).agg(F.lit(version).cast("long").alias("version"), F.lit(name).alias("table_name"), F.count("*").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("manifest_set_mismatch", """WITH a AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents), b AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id%21=4 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id%33<>5)
(SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def manifest_set_mismatch(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    listed = docs.select("path", F.sha2("text", 256).alias("sha256"))
    found = docs.where("doc_id%33 <> 5").select("path", F.sha2(F.expr("CASE WHEN doc_id%21=4 THEN concat(text, '!') ELSE text END"), 256).alias("sha256"))
    return rl.bag_mismatch(listed, found)


@query("replaced_segments", """SELECT episode_id, ord, CASE WHEN episode_id%3=0 THEN 'edited' ELSE action END AS action FROM segment WHERE NOT (episode_id%3=0 AND ord%2=1)""")
def replaced_segments(spark, sf):
    """Segments of some episodes are overwritten; the other partitions stay."""
    path = fresh_path(spark, "segments")
    seg = view(spark, sf, "segment").select("ord", "action", F.col("episode_id"), (F.col("episode_id") % 16).alias("shard"))
    ct.replace_partitions(seg, path, "shard")
    stored = spark.read.schema("ord bigint, action string, episode_id bigint, shard bigint").parquet(path)
    hit = stored.where("episode_id%3 = 0 AND ord%2 = 0").withColumn("action", F.lit("edited"))
    # A partition holds several episodes, so the untouched ones are written back with it.
    ct.replace_partitions(staged(hit.unionByName(stored.where("episode_id%3 <> 0"))), path, "shard")
    return spark.read.schema("ord bigint, action string, episode_id bigint, shard bigint").parquet(path).select("episode_id", "ord", "action")


@query("frozen_run_changes", """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey%5=0 THEN 'CONFIG_CHANGED' WHEN o_orderkey%7=0 THEN 'SOURCE_CHANGED' ELSE 'CODE_CHANGED' END AS reason FROM orders WHERE o_orderkey%5=0 OR o_orderkey%7=0 OR o_orderkey%11=0""")
def frozen_run_changes(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.selectExpr("o_orderkey AS run_id", "sha2(o_orderpriority, 256) AS config_sha256", "sha2(o_orderstatus, 256) AS input_sha256", "'c' AS code_sha256")
    now = o.selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey%5=0 THEN 'x' ELSE sha2(o_orderpriority, 256) END AS config_sha256",
                       "CASE WHEN o_orderkey%7=0 THEN 'x' ELSE sha2(o_orderstatus, 256) END AS input_sha256", "CASE WHEN o_orderkey%11=0 THEN 'x' ELSE 'c' END AS code_sha256")
    return ct.frozen_run_changes(runs, now)


EXPORT = "e AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST(json_object({', '.join(f"'{c}', {c}" for c in columns)}) AS VARCHAR) AS doc FROM {source}"
    for name, columns, source in [
        (n, ct.EXPORT_COLUMNS[n], n if n != "workspace" else "(SELECT r_regionkey AS id, 1 AS schema_version, CAST(r_regionkey*1000 AS BIGINT) AS created_at FROM region)") for n in ct.EXPORT_COLUMNS]) + ")"


def _exported(spark, sf):
    made = table(spark, sf, "region").selectExpr("r_regionkey AS id", "1 AS schema_version", "CAST(r_regionkey*1000 AS BIGINT) AS created_at")
    return ct.export_rows({n: made if n == "workspace" else view(spark, sf, n) for n in ct.EXPORT_COLUMNS})


@query("workspace_export", "WITH " + EXPORT + " SELECT table_name, doc FROM e")
def workspace_export(spark, sf):
    return _exported(spark, sf)


@query("workspace_export_manifest", "WITH " + EXPORT + """, p AS (SELECT table_name, doc, (row_number() OVER (PARTITION BY table_name ORDER BY doc) - 1)//64 AS leaf, row_number() OVER (PARTITION BY table_name ORDER BY doc) AS i FROM e),
 l AS (SELECT table_name, leaf, sha256(string_agg(sha256(doc), '' ORDER BY i)) AS h, count(*) AS n, sum(strlen(doc)) AS b FROM p GROUP BY ALL)
SELECT table_name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS leaves, sha256(string_agg(h, '' ORDER BY leaf)) AS root FROM l GROUP BY table_name""")
def workspace_export_manifest(spark, sf):
    return ct.export_manifest(_exported(spark, sf), leaf_rows=64)
