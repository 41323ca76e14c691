"""Run, stage, cost and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators import reports as rp
from voxtable.plans.registry import query
from voxtable.plans.views import table, view


def rounded_sql(v: str, digits: int) -> str:
    """SQL of the exact half-even rounding of a double column."""
    k, c = "134217729::DOUBLE", 10.0**digits
    ch = c * 134217729.0 - (c * 134217729.0 - c)
    cl = c - ch
    p = f"({v}*{c:.0f}::DOUBLE)"
    vh = f"({v}*{k}-({v}*{k}-{v}))"
    err = f"((({vh}*{ch:.0f}::DOUBLE-{p})+{vh}*{cl:.0f}::DOUBLE+({v}-{vh})*{ch:.0f}::DOUBLE)+({v}-{vh})*{cl:.0f}::DOUBLE)"
    near = f"round_even({p}, 0)"
    return (f"(CASE WHEN {p}-{near}=0.5 AND {err}>0 THEN {near}+1 WHEN {p}-{near}=-0.5 AND {err}<0 THEN {near}-1 ELSE {near} END/{c:.0f}::DOUBLE)")


def stage_runs(spark, sf):
    # The recording order of the stages of a run.
    return view(spark, sf, "stage_run").withColumn("seq", F.expr("attempt*100000L + worker"))


SR = "sr AS (SELECT *, attempt*100000 + worker AS seq FROM stage_run)"
TOT = SR + """, tot AS (SELECT run_id, CAST(sum(wall_ms) AS BIGINT) AS total_ms, count(*) AS stages, arg_max(stage, (wall_ms, -seq)) AS bottleneck FROM sr GROUP BY run_id)"""


@query("run_report", "WITH " + TOT + """ SELECT t.run_id, total_ms, stages, bottleneck, total_ms/CAST(source_ms AS DOUBLE) AS rtf, total_ms/1000.0::DOUBLE*6000/3600 AS compute_cost, total_ms/1000.0::DOUBLE*6000/3600 + api_cost AS total_cost
 FROM tot t JOIN (SELECT o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT)+1 AS source_ms, CASE WHEN o_orderkey%4<>0 THEN CAST(o_custkey AS DOUBLE) END AS api_cost FROM orders) USING (run_id)""")
def run_report(spark, sf):
    runs = table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "CAST(floor(o_totalprice) AS BIGINT)+1 AS source_ms",
                                                 "CASE WHEN o_orderkey%4<>0 THEN CAST(o_custkey AS DOUBLE) END AS api_cost")
    out = rp.run_totals(stage_runs(spark, sf), runs)
    return out.select("run_id", "total_ms", "stages", "bottleneck", "rtf", "compute_cost", "total_cost")


@query("stage_fractions", "WITH " + TOT + " SELECT run_id, seq, stage, wall_ms/CAST(total_ms AS DOUBLE) AS fraction_of_wall_time FROM sr JOIN tot USING (run_id)")
def stage_fractions(spark, sf):
    rows = stage_runs(spark, sf)
    return rp.stage_fractions(rows, rp.run_totals(rows)).select("run_id", "seq", "stage", "fraction_of_wall_time")


@query("suite_rollup", """SELECT * EXCLUDE (c), """ + rounded_sql("c", 2) + """ AS cost FROM (SELECT worker, CAST(sum(wall_ms) AS BIGINT) AS elapsed_ms, CASE WHEN bool_or(status IN ('PENDING','RUNNING','TIMED_OUT','INTERRUPTED')) THEN 'INCOMPLETE' WHEN bool_or(status='FAILED') THEN 'FAILED' ELSE 'MEASURED' END AS status,
  count(*) AS jobs, CAST(sum(wall_ms) AS BIGINT)*6000.0::DOUBLE/3600000 AS c FROM stage_run GROUP BY worker)""")
def suite_rollup(spark, sf):
    return rp.suite_rollup(view(spark, sf, "stage_run"), ["worker"], F.lit(6000.0))


@query("run_suite_status", """SELECT run_id, CAST(sum(wall_ms) AS BIGINT) AS elapsed_ms, CASE WHEN bool_or(status IN ('PENDING','RUNNING','TIMED_OUT','INTERRUPTED')) THEN 'INCOMPLETE' WHEN bool_or(status='FAILED') THEN 'FAILED' ELSE 'MEASURED' END AS status,
  count(*) AS jobs, CAST(NULL AS DOUBLE) AS cost FROM stage_run GROUP BY run_id""")
def run_suite_status(spark, sf):
    return rp.suite_rollup(view(spark, sf, "stage_run"), ["run_id"], F.lit(None).cast("double"))


@query("realtime_factors", """SELECT run_id, seq, stage, CASE WHEN p > 0 THEN """ + rounded_sql("q", 6) + """ END AS realtime_factor, CASE WHEN p > 0 THEN p END AS basis_ms, CASE WHEN p > 0 THEN b END AS wall_basis FROM (
  SELECT *, attempt*100000 + worker AS seq, coalesce(processed_ms, source_ms) AS p, coalesce(inference_ms, adapter_ms, wall_ms) AS w,
   CASE WHEN inference_ms IS NOT NULL THEN 'adapter_inference_ms' WHEN adapter_ms IS NOT NULL THEN 'adapter_wall_ms' ELSE 'stage_wall_ms' END AS b,
   coalesce(inference_ms, adapter_ms, wall_ms)/CAST(coalesce(processed_ms, source_ms) AS DOUBLE) AS q FROM stage_run)""")
def realtime_factors(spark, sf):
    return rp.realtime_factors(stage_runs(spark, sf)).select("run_id", "seq", "stage", "realtime_factor", "basis_ms", "wall_basis")


@query("budget_projection", """SELECT run_id, total, """ + rounded_sql("total", 2) + """ AS projected, CASE WHEN total > 8000 THEN 'REQUIRE_CONTINUE' WHEN total > 6500 THEN 'NO_AUTO_PROPAINTER' WHEN total > 5000 THEN 'REDUCE_FALLBACK' ELSE 'NORMAL' END AS policy FROM (
  SELECT run_id, (sum(wall_ms)*40 + 1000000)*6000.0::DOUBLE/3600000 + 17.0::DOUBLE AS total FROM stage_run GROUP BY run_id)""")
def budget_projection(spark, sf):
    sums = view(spark, sf, "stage_run").groupBy("run_id").agg((F.sum("wall_ms") * 40).alias("elapsed_ms"))
    total = ft.projected_cost(F.col("elapsed_ms"), F.lit(1_000_000), F.lit(17.0))
    return sums.select("run_id", total.alias("total"), ft.rounded(total, 2).alias("projected"), ft.budget_policy(total).alias("policy"))


@query("evidence_rollup", """SELECT run_id, seq, array_to_string(CASE WHEN r IS NULL AND n IS NULL THEN ['quality_evidence'] WHEN r IS NULL THEN n WHEN n IS NULL THEN r ELSE list_concat(r, list_filter(n, lambda x: NOT list_contains(r, x))) END, ',') AS missing FROM (
  SELECT run_id, attempt*100000 + worker AS seq, CASE WHEN attempt%3<>0 THEN ['a', stage] END AS r, CASE WHEN worker%2=0 THEN [stage, 'z'] END AS n FROM stage_run)""")
def evidence_rollup(spark, sf):
    rows = stage_runs(spark, sf)
    r, n = F.expr("CASE WHEN attempt%3<>0 THEN array('a', stage) END"), F.expr("CASE WHEN worker%2=0 THEN array(stage, 'z') END")
    return rows.select("run_id", "seq", F.array_join(rp.merged_evidence(r, n), ",").alias("missing"))


@query("artifact_digest", """SELECT episode_id, sha256('[' || string_agg('{"bytes":' || bytes || ',"path":"' || path || '","sha256":"' || sha256(path) || '"}', ',' ORDER BY path) || ']') AS sha256, count(*) AS files
 FROM (SELECT episode_id, bytes, kind || '/' || artifact_id || '/' || bytes AS path FROM artifact) GROUP BY episode_id""")
def artifact_digest(spark, sf):
    files = view(spark, sf, "artifact").withColumn("path", F.concat_ws("/", "kind", F.col("artifact_id").cast("string"), F.col("bytes").cast("string")))
    return rp.digest(files.withColumn("sha256", F.sha2("path", 256)), ["episode_id"], "path", ["path", "sha256", "bytes"])


@query("model_identity", """SELECT episode_id, sha256('[' || string_agg('{"hash": "' || sha256(path) || '", "id": "' || path || '", "revision": ' || CASE WHEN bytes%2=0 THEN 'null' ELSE CAST(bytes AS VARCHAR) END || '}', ', ' ORDER BY path) || ']') AS sha256, count(*) AS files
 FROM (SELECT episode_id, bytes, kind || '/' || artifact_id || '/' || bytes AS path FROM artifact) GROUP BY episode_id""")
def model_identity(spark, sf):
    files = view(spark, sf, "artifact").withColumn("id", F.concat_ws("/", "kind", F.col("artifact_id").cast("string"), F.col("bytes").cast("string")))
    files = files.withColumn("hash", F.sha2("id", 256)).withColumn("revision", F.expr("CASE WHEN bytes%2=1 THEN bytes END"))
    return rp.digest(files, ["episode_id"], "id", ["id", "hash", "revision"], spaced=True)


PLAN = """cs AS (SELECT corpus, case_id, CASE WHEN case_id%4=0 THEN 'Clip ' || category || '!' ELSE category || '-' || CAST(case_id AS VARCHAR) END AS name, category, tts_text, has_roi, zh_reference FROM corpus_case),
 slug AS (SELECT *, CASE WHEN case_id%4=0 THEN 'clip-' || category ELSE name END AS sl FROM cs),
 js AS (SELECT *, unnest(['asr','align','tts','bandit','ocr','inpaint']) AS stage FROM slug),
 r AS (SELECT *, CASE WHEN stage='tts' AND tts_text IS NULL THEN 'missing_tts_text' WHEN stage IN ('ocr','inpaint') AND NOT has_roi THEN 'missing_roi' END AS reason FROM js)"""


def _plan_cases(spark, sf):
    return view(spark, sf, "corpus_case").withColumns({
        "case_no": F.col("case_id"),
        "case_id": F.expr("CASE WHEN case_id%4=0 THEN concat('Clip ', category, '!') ELSE concat(category, '-', CAST(case_id AS STRING)) END"),
        "roi": F.expr("CASE WHEN has_roi THEN named_struct('x', roi_x) END"), "words": F.expr("CASE WHEN case_id%2=0 THEN array(1) END")})


@query("benchmark_plan_skipped", "WITH " + PLAN + " SELECT corpus, name AS case_id, stage, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def benchmark_plan_skipped(spark, sf):
    return rp.plan_jobs(_plan_cases(spark, sf), ["corpus"])[1].groupBy("corpus", "case_id", "stage", "reason").agg(F.count("*").alias("n"))


@query("benchmark_plan_jobs", "WITH " + PLAN + """ SELECT corpus, name AS case_id, stage, sl || '_' || stage AS job_id, CASE stage WHEN 'align' THEN sl || '_asr' WHEN 'inpaint' THEN sl || '_ocr' END AS depends_on,
  CASE WHEN stage IN ('asr','align') THEN 'asr' WHEN stage IN ('ocr','inpaint') THEN 'vision' ELSE stage END AS profile,
  CASE stage WHEN 'asr' THEN CASE WHEN coalesce(zh_reference,'')='' THEN 'zh_reference' ELSE '' END WHEN 'align' THEN CASE WHEN case_id%2=0 THEN '' ELSE 'words' END WHEN 'tts' THEN 'pronunciation_human_rating'
   WHEN 'bandit' THEN 'sfx_preservation_reference' WHEN 'ocr' THEN 'subtitle_text_reference' ELSE 'residual_visual_review' END AS missing FROM r WHERE reason IS NULL""")
def benchmark_plan_jobs(spark, sf):
    jobs = rp.plan_jobs(_plan_cases(spark, sf), ["corpus"])[0]
    return jobs.select("corpus", "case_id", "stage", "job_id", "depends_on", "profile", F.array_join("missing_evidence", ",").alias("missing"))


@query("job_ids_with_collisions", """WITH c AS (SELECT source, lang, doc_id, 'Case ' || CASE WHEN doc_id%3=0 THEN lang ELSE lang || CAST(doc_id AS VARCHAR) END || CASE doc_id%2 WHEN 0 THEN '!' ELSE '?' END AS case_id FROM documents),
 s AS (SELECT DISTINCT source, case_id, 'case-' || lower(regexp_replace(regexp_replace(case_id, '^Case ', ''), '[!?]$', '')) AS slug FROM c),
 f AS (SELECT source, slug, arg_min(case_id, (no, case_id)) AS first FROM (SELECT c.source, c.case_id, slug, min(doc_id) AS no FROM c JOIN s ON c.source=s.source AND c.case_id=s.case_id GROUP BY ALL) GROUP BY source, slug)
SELECT s.source, s.case_id, CASE WHEN first=s.case_id THEN s.slug || '_asr' ELSE s.slug || '_' || substring(sha256(s.case_id), 1, 8) || '_asr' END AS job_id FROM s JOIN f ON f.source=s.source AND f.slug=s.slug""")
def job_ids_with_collisions(spark, sf):
    cases = table(spark, sf, "documents").selectExpr(
        "source", "doc_id", "concat('Case ', CASE WHEN doc_id%3=0 THEN lang ELSE concat(lang, CAST(doc_id AS STRING)) END, CASE doc_id%2 WHEN 0 THEN '!' ELSE '?' END) AS case_id")
    once = cases.groupBy("source", "case_id").agg(F.min("doc_id").alias("case_no")).withColumn("stage", F.lit("asr"))
    return rp.job_ids(once, ["source"]).select("source", "case_id", "job_id")


@query("corpus_report_join", """SELECT c.doc_id AS case_id, l.doc_id IS NULL AS mismatch FROM documents c LEFT JOIN labels l USING (doc_id)""")
def corpus_report_join(spark, sf):
    cases = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    return rp.unchecked_cases(cases, table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")), ["case_id"])


@query("run_report_lines", "WITH " + TOT + """ SELECT run_id, 0 AS part, CAST(n AS BIGINT) AS position, line FROM (SELECT run_id, unnest([0,1,2,3]) AS n, unnest(['# Run ' || run_id, printf('Total wall: %.3f s', total_ms/1000.0::DOUBLE), '| Stage | Status | Seconds |', '| --- | --- | ---: |']) AS line FROM tot)
UNION ALL SELECT run_id, 1, seq, printf('| %s | %s | %.3f |', stage, status, wall_ms/1000.0::DOUBLE) FROM sr
UNION ALL SELECT run_id, 2, 0, '## Issues (no automatic corrections)' FROM tot
UNION ALL SELECT run_id, 3, seq, '- ' || stage || ': NO_USABLE_ARTIFACT.' FROM sr WHERE status='FAILED'""")
def run_report_lines(spark, sf):
    rows = stage_runs(spark, sf)
    issues = rows.where("status = 'FAILED'").withColumn("code", F.lit("NO_USABLE_ARTIFACT"))
    return rp.report_lines(rows, rp.run_totals(rows), issues)


@query("check_summary", """SELECT worker, CASE WHEN bool_and(status='MEASURED') THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count_if(status='MEASURED') AS BIGINT) AS passed, CAST(count_if(status<>'MEASURED') AS BIGINT) AS failed FROM stage_run GROUP BY worker""")
def check_summary(spark, sf):
    return rp.check_summary(view(spark, sf, "stage_run").withColumn("passed", F.col("status") == "MEASURED").drop("status"), ["worker"])


@query("job_slugs", r"""SELECT page_id, CASE WHEN c='' THEN 'case' ELSE c END AS slug FROM (SELECT page_id, regexp_replace(substring(CASE WHEN s='' THEN 'case' ELSE s END, 1, 48), '[-._]+$', '') AS c FROM (
  SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')) AS s FROM pages))""")
def job_slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.job_slug(F.col("url")).alias("slug"))
