"""Validation, gates, sets and quality-control queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators import quality as ql
from voxtable.operators import rules as rl
from voxtable.operators import scan
from voxtable.plans.dialogue import TOK_SQL, segments_with_words
from voxtable.plans.registry import query
from voxtable.plans.views import table, view

EP = ["episode_id"]
CATS = "('speech_clear','music_loud','nonverbal','overlap','subtitle_static','subtitle_motion','dark')"


@query("segment_contract_violations", "WITH " + TOK_SQL + """, x AS (SELECT episode_id, ord, start_ms, CASE WHEN ord%6=5 THEN start_ms-10 ELSE end_ms END AS end_ms,
   CASE WHEN (episode_id+ord)%7=2 AND i=1 THEN start_ms-1 ELSE s END AS s, e FROM tok)
SELECT DISTINCT episode_id, ord, 'WORD_OUTSIDE_SEGMENT' AS code FROM x WHERE NOT (start_ms <= s AND s < e AND e <= end_ms)
UNION ALL SELECT DISTINCT episode_id, ord, 'EMPTY_SEGMENT' FROM x WHERE end_ms <= start_ms
UNION ALL SELECT episode_id, ord, 'CONFIDENCE_OUT_OF_RANGE' FROM segment WHERE episode_id%9=3 AND ord%2=0""")
def segment_contract_violations(spark, sf):
    seg = segments_with_words(spark, sf).withColumn("end_ms", F.expr("CASE WHEN ord%6=5 THEN start_ms-10 ELSE end_ms END"))
    seg = seg.withColumn("words", F.expr(
        "transform(words, (w, i) -> named_struct('t', w.t, 's', CASE WHEN (episode_id+ord)%7=2 AND i=1 THEN start_ms-1 ELSE w.s END, 'e', w.e))"))
    seg = seg.withColumn("confidence", F.expr(
        "map('asr', CASE WHEN episode_id%9=3 AND ord%2=0 THEN 1.5D ELSE 0.5D END, 'alignment', CAST(NULL AS DOUBLE))"))
    return rl.segment_contract(seg, ["episode_id", "ord"])


@query("roi_rules", """
WITH r AS (SELECT doc_id AS case_id, CAST(doc_id%10 AS DOUBLE)/10 AS x, 0.5::DOUBLE AS y, CAST(1+doc_id%7 AS DOUBLE)/10 + CASE WHEN doc_id%11=0 THEN 0.0000005::DOUBLE ELSE 0::DOUBLE END AS w, 0.5::DOUBLE AS h FROM documents)
SELECT case_id, 'ROI_CONTRACT' AS code FROM r WHERE NOT (x>=0 AND x<1 AND w>0 AND w<=1 AND x+w <= 1::DOUBLE+0.000001::DOUBLE AND y+h <= 1::DOUBLE+0.000001::DOUBLE)
UNION ALL SELECT case_id, 'ROI_CROP' FROM r WHERE NOT (x+w <= 1 AND y+h <= 1)""")
def roi_rules(spark, sf):
    r = table(spark, sf, "documents").selectExpr("doc_id AS case_id", """named_struct('x', CAST(doc_id%10 AS DOUBLE)/10, 'y', 0.5D,
        'w', CAST(1+doc_id%7 AS DOUBLE)/10 + CASE WHEN doc_id%11=0 THEN 0.0000005D ELSE 0D END, 'h', 0.5D) AS roi""")
    return rl.roi_contract(r, ["case_id"])


@query("roi_pixels_and_crop", """
WITH r AS (SELECT doc_id AS case_id, CAST(doc_id%10 AS DOUBLE)/10 AS x, CAST(doc_id%8 AS DOUBLE)/9 AS y, CAST(1+doc_id%7 AS DOUBLE)/10 AS w, CAST(1+doc_id%3 AS DOUBLE)/16 AS h, 1280 AS fw, 720 AS fh, 64 AS c FROM documents),
 p AS (SELECT *, greatest(0, least(fw, CAST(floor(x*fw) AS BIGINT))) AS pl, greatest(0, least(fw, CAST(ceil((x+w)*fw) AS BIGINT))) AS pr,
   CAST(trunc(x*fw) AS BIGINT) AS rl, CAST(trunc(y*fh) AS BIGINT) AS rt, CAST(trunc(w*fw) AS BIGINT) AS rw, CAST(trunc(h*fh) AS BIGINT) AS rh FROM r),
 a AS (SELECT *, greatest(0, rl-c) AS l0, least(fw, rl+rw+c) AS r0, greatest(0, rt-c) AS t0, least(fh, rt+rh+c) AS b0 FROM p),
 g AS (SELECT *, (r0-l0+7)//8*8 AS aw, (b0-t0+7)//8*8 AS ah FROM a),
 k AS (SELECT *, least(l0, aw-(r0-l0)) AS bx, least(t0, ah-(b0-t0)) AS byy FROM g),
 z AS (SELECT *, l0-bx AS lf, t0-byy AS tp, least(fw, r0+(aw-(r0-l0))-bx)-(l0-bx) AS cw, least(fh, b0+(ah-(b0-t0))-byy)-(t0-byy) AS ch FROM k)
SELECT case_id, CASE WHEN pr > pl THEN pl END AS px_left, CASE WHEN pr > pl THEN pr END AS px_right, lf AS crop_left, tp AS crop_top, cw AS crop_width, ch AS crop_height,
 CASE WHEN rw<=0 OR rh<=0 THEN 'ROI_BELOW_ONE_PIXEL' WHEN cw<>aw OR ch<>ah THEN 'UNALIGNED_AT_SOURCE_BOUNDS' WHEN cw=fw AND ch=fh THEN 'FULL_FRAME_PROHIBITED'
  WHEN cw>720 OR ch>480 OR cw*ch>345600 THEN 'CROP_LIMIT_EXCEEDED' END AS reason FROM z""")
def roi_pixels_and_crop(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id AS case_id", "CAST(doc_id%10 AS DOUBLE)/10 AS x", "CAST(doc_id%8 AS DOUBLE)/9 AS y",
                                                 "CAST(1+doc_id%7 AS DOUBLE)/10 AS w", "CAST(1+doc_id%3 AS DOUBLE)/16 AS h", "1280L AS fw", "720L AS fh", "64L AS c")
    args = [F.col(c) for c in ("x", "y", "w", "h", "fw", "fh")]
    px, crop = ft.roi_pixels(*args), ft.crop_geometry(*args, F.col("c"))
    return d.select("case_id", px["left"].alias("px_left"), px["right"].alias("px_right"), crop["left"].alias("crop_left"),
                    crop["top"].alias("crop_top"), crop["width"].alias("crop_width"), crop["height"].alias("crop_height"), crop["reason"].alias("reason"))


@query("roi_equality", """SELECT doc_id AS case_id, CASE doc_id%3 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.0000000005::DOUBLE ELSE 0.00000001::DOUBLE END <= 0.000000001::DOUBLE AS same FROM documents""")
def roi_equality(spark, sf):
    shift = "CASE doc_id%3 WHEN 0 THEN 0D WHEN 1 THEN 0.0000000005D ELSE 0.00000001D END"
    d = table(spark, sf, "documents").selectExpr("doc_id AS case_id", "named_struct('x', 0.25D, 'y', 0.5D, 'w', 0.5D, 'h', 0.25D) AS a",
                                                 f"named_struct('x', 0.25D + {shift}, 'y', 0.5D, 'w', 0.5D, 'h', 0.25D) AS b")
    return d.select("case_id", ft.roi_equal(F.col("a"), F.col("b")).alias("same"))


@query("polygon_bounds", """SELECT frame_no, least(box_left, box_left+3) AS l, greatest(box_right, box_left+3) AS r, least(box_top, box_top-2) AS t, greatest(box_bottom, box_top-2) AS b FROM ocr_line""")
def polygon_bounds(spark, sf):
    lines = view(spark, sf, "ocr_line").withColumn("box", F.expr(
        "array(array(box_left, box_top), array(box_right, box_top - 2), array(box_right, box_bottom), array(box_left + 3, box_bottom))"))
    box = ft.bounding_box(F.col("box"))
    return lines.select("frame_no", box["left"].alias("l"), box["right"].alias("r"), box["top"].alias("t"), box["bottom"].alias("b"))


@query("entity_violations", """
SELECT 'series' AS entity, series_id AS id, 'PRIORITY_RANGE' AS code FROM series WHERE NOT priority*1000 BETWEEN 0 AND 10000
UNION ALL SELECT 'episode', episode_id, 'FILENAME_NOT_BASENAME' FROM episode WHERE filename LIKE '%/%'
UNION ALL SELECT 'episode', episode_id, 'UNSUPPORTED_EXTENSION' FROM episode WHERE filename LIKE '%.txt'
UNION ALL SELECT 'episode', episode_id, 'FILE_TOO_LARGE' FROM episode WHERE total_bytes > 300000 OR total_bytes <= 0
UNION ALL SELECT 'glossary', updated_at, 'TARGET_LENGTH' FROM glossary WHERE NOT length(vi) BETWEEN 1 AND 300
UNION ALL SELECT 'glossary', updated_at, 'BLANK_TERM' FROM glossary WHERE trim(zh)='' OR trim(vi)=''""")
def entity_violations(spark, sf):
    series = view(spark, sf, "series").withColumn("priority", F.col("priority") * 1000)
    named = lambda df, kind, ident: df.select(F.lit(kind).alias("entity"), F.col(ident).alias("id"), "code")
    return rl.union_all([
        named(rl.series_rules(series, ["series_id"]), "series", "series_id"),
        named(rl.episode_rules(view(spark, sf, "episode"), ["episode_id"], max_bytes=300_000), "episode", "episode_id"),
        named(rl.glossary_rules(view(spark, sf, "glossary"), ["updated_at"]), "glossary", "updated_at")])


@query("path_containment", """
SELECT page_id, CASE page_id%6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE false END AS contained FROM pages""")
def path_containment(spark, sf):
    paths = table(spark, sf, "pages").selectExpr("page_id", """CASE page_id%6 WHEN 0 THEN concat('a/', page_id) WHEN 1 THEN concat('../', page_id)
        WHEN 2 THEN concat('a/../b/', page_id) WHEN 3 THEN 'a/..' WHEN 4 THEN concat('/', page_id) ELSE concat('a/../../b/', page_id) END AS path""")
    return paths.select("page_id", rl.contained_path(F.col("path")).alias("contained"))


CASE_SQL = """cs AS (SELECT c.*, CASE WHEN case_id%31=0 THEN 'zz' WHEN case_id%29=0 THEN sha256('other') WHEN case_id%2=0 THEN upper(sha256(text)) END AS source_sha256,
   case_id%23=0 AS gone, NOT source LIKE '../%' AS path_ok, (start_ms >= 0 AND end_ms > start_ms) AS bounds_ok FROM corpus_case c),
 j AS (SELECT *, (bounds_ok AND path_ok AND NOT gone) AS usable, (bounds_ok AND path_ok AND NOT gone AND end_ms <= source_duration_ms) AS in_time FROM cs),
 bad AS (SELECT corpus, case_id, unnest(list_filter([CASE WHEN category='other' THEN 'UNKNOWN_CATEGORY' END, CASE WHEN NOT bounds_ok THEN 'INVALID_BOUNDS' END,
   CASE WHEN bounds_ok AND NOT path_ok THEN 'SOURCE_OUTSIDE_FOLDER' END, CASE WHEN bounds_ok AND path_ok AND gone THEN 'SOURCE_NOT_FOUND' END,
   CASE WHEN usable AND source_sha256='zz' THEN 'MALFORMED_HASH' END, CASE WHEN usable AND case_id%31<>0 AND case_id%29=0 AND sha256('other')<>sha256(text) THEN 'HASH_MISMATCH' END,
   CASE WHEN usable AND end_ms > source_duration_ms THEN 'END_AFTER_SOURCE' END,
   CASE WHEN in_time AND case_id%10=7 THEN 'WORDS_OUT_OF_RANGE' END,
   CASE WHEN in_time AND has_roi AND NOT (roi_x + roi_w <= 1) THEN 'INVALID_ROI' END,
   CASE WHEN in_time AND case_id%13=0 THEN 'INVALID_TARGET_MS' END], lambda v: v IS NOT NULL)) AS code FROM j)"""


def corpus_cases(spark, sf):
    return view(spark, sf, "corpus_case").withColumns({
        "source_sha256": F.expr("CASE WHEN case_id%31=0 THEN 'zz' WHEN case_id%29=0 THEN sha2('other', 256) WHEN case_id%2=0 THEN upper(sha2(text, 256)) END"),
        "roi": F.expr("CASE WHEN has_roi THEN named_struct('x', roi_x, 'y', 0.0D, 'w', roi_w, 'h', 0.5D) END"),
        "words": F.expr("array(named_struct('t', 'a', 's', start_ms, 'e', CASE WHEN case_id%10=7 THEN end_ms + 1 ELSE end_ms END))"),
        "target_ms": F.expr("CASE WHEN case_id%13=0 THEN 0L ELSE 5L END")})


def corpus_inventory(spark, sf):
    return view(spark, sf, "corpus_case").where("case_id%23 <> 0").select(
        "source", F.sha2("text", 256).alias("sha256"), F.col("source_duration_ms").alias("duration_ms"))


@query("corpus_case_violations", "WITH " + CASE_SQL + " SELECT corpus, case_id, code FROM bad")
def corpus_case_violations(spark, sf):
    return rl.corpus_rules(corpus_cases(spark, sf), corpus_inventory(spark, sf), ["corpus", "case_id"], ["case_id"])


@query("corpus_coverage", "WITH " + CASE_SQL + f""", ok AS (SELECT * FROM j WHERE in_time),
 r AS (SELECT corpus, CAST(sum(end_ms-start_ms) AS BIGINT) AS total_case_duration_ms, count(*) AS case_count,
   coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category<>'other')), ','), '') AS covered, count(DISTINCT category) FILTER (WHERE category<>'other') AS k FROM ok GROUP BY corpus)
SELECT corpus, total_case_duration_ms, case_count, covered, CASE WHEN k < 7 OR total_case_duration_ms < 600000 OR corpus IN (SELECT corpus FROM bad) THEN 'INVALID'
  ELSE 'READY_FOR_REPRESENTATIVE_QUALITY_EVALUATION' END AS status FROM r""")
def corpus_coverage(spark, sf):
    cases = corpus_cases(spark, sf)
    errors = rl.corpus_rules(cases, corpus_inventory(spark, sf), ["corpus", "case_id"], ["case_id"])
    fatal = errors.where(F.col("code").isin("INVALID_BOUNDS", "SOURCE_OUTSIDE_FOLDER", "SOURCE_NOT_FOUND", "END_AFTER_SOURCE"))
    checked = cases.join(fatal.select("corpus", "case_id"), ["corpus", "case_id"], "left_anti")
    out = rl.corpus_coverage(checked, errors, ["corpus"])
    return out.select("corpus", "total_case_duration_ms", "case_count", F.array_join("covered", ",").alias("covered"), "status")


@query("category_difference", f"""SELECT corpus, array_to_string(list_sort(list_filter(['dark','music_loud','nonverbal','overlap','speech_clear','subtitle_motion','subtitle_static'],
   lambda c: NOT list_contains(list(DISTINCT category), c))), ',') AS missing FROM corpus_case GROUP BY corpus""")
def category_difference(spark, sf):
    wanted = F.array(*[F.lit(c) for c in sorted(rl.CATEGORIES)])
    return view(spark, sf, "corpus_case").groupBy("corpus").agg(
        F.array_join(F.array_except(wanted, F.collect_set("category")), ",").alias("missing"))


@query("public_settings", """SELECT run_id, worker, attempt, stage, 'model=m1' AS settings FROM stage_run""")
def public_settings(spark, sf):
    runs = view(spark, sf, "stage_run").withColumn("settings", F.expr(
        "map('model', 'm1', 'API_KEY', 'x', 'access_token', stage, 'Env', 'y', 'user_password', 'z')"))
    shown = F.array_join(F.transform(F.map_entries(rl.plan_map(rl.public_map(F.col("settings")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return runs.select("run_id", "worker", "attempt", "stage", shown.alias("settings"))


@query("measured_metrics", """SELECT run_id, worker, attempt, stage, concat_ws(',', CASE WHEN inference_ms IS NOT NULL THEN 'inference_ms' END, CASE WHEN attempt%4<>1 THEN 'load_ms' END) AS kept FROM stage_run""")
def measured_metrics(spark, sf):
    runs = view(spark, sf, "stage_run").withColumn("metrics", F.expr(
        "map('inference_ms', CAST(inference_ms AS DOUBLE), 'load_ms', CASE WHEN attempt%4=1 THEN CAST('NaN' AS DOUBLE) ELSE 3D END, 'peak_reserved_bytes', -1D, 'secret', 5D)"))
    return runs.select("run_id", "worker", "attempt", "stage",
                       F.array_join(F.array_sort(F.map_keys(rl.measured_metrics(F.col("metrics")))), ",").alias("kept"))


JOB = {"plan": "l_suppkey", "job_id": "concat(CASE WHEN l_partkey%41=0 THEN '-' ELSE 'job' END, CAST(l_orderkey%500 AS {S}), '_', CAST(l_linenumber AS {S}))",
       "stage": "CASE l_linenumber WHEN 1 THEN 'asr' WHEN 2 THEN 'align' WHEN 3 THEN 'tts' WHEN 4 THEN 'bandit' WHEN 5 THEN 'probe' WHEN 6 THEN 'ocr' ELSE 'mux' END",
       "input": "CASE WHEN l_orderkey%37=0 THEN '' ELSE 'in.wav' END", "config": "CASE WHEN l_orderkey%10<>0 THEN 'c.json' END",
       "timeout_s": "l_quantity*2000", "hourly_rate": "CASE WHEN l_partkey%3=0 THEN l_discount - 0.01 END"}


@query("plan_rule_violations", "WITH jb AS (SELECT " + ", ".join(f"{e.replace('{S}', 'VARCHAR')} AS {c}" for c, e in JOB.items()) + """ FROM lineitem)
SELECT plan, job_id, unnest(list_filter([CASE WHEN NOT regexp_full_match(job_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') THEN 'INVALID_ID' END, CASE WHEN stage='mux' THEN 'UNSUPPORTED_STAGE' END,
 CASE WHEN input='' THEN 'MISSING_INPUT' END, CASE WHEN config IS NULL AND stage<>'probe' THEN 'CONFIG_REQUIRED' END, CASE WHEN timeout_s <= 0 OR timeout_s > 86400 THEN 'INVALID_TIMEOUT' END,
 CASE WHEN hourly_rate < 0 THEN 'INVALID_RATE' END], lambda v: v IS NOT NULL)) AS code FROM jb
UNION ALL SELECT plan, job_id, 'DUPLICATE_ID' FROM jb GROUP BY plan, job_id HAVING count(*) > 1
UNION ALL SELECT plan, job_id, 'INPUT_NOT_FOUND' FROM jb WHERE input=''""")
def plan_rule_violations(spark, sf):
    jobs = table(spark, sf, "lineitem").selectExpr(*[f"{e.replace('{S}', 'STRING')} AS {c}" for c, e in JOB.items()])
    files = table(spark, sf, "region").selectExpr("'in.wav' AS source").distinct()
    return rl.plan_rules(jobs, ["plan"], files)


@query("subtitle_mode", """SELECT episode_id, CASE episode_id%4 WHEN 0 THEN 'burn' WHEN 2 THEN 'off' ELSE CASE episode_id%3 WHEN 0 THEN 'replace' ELSE 'burn' END END AS mode FROM episode""")
def subtitle_mode(spark, sf):
    return view(spark, sf, "episode").select("episode_id", rl.subtitle_mode(F.array("flag", "flag2"), "replace").alias("mode"))


@query("preview_audio_gate", """SELECT episode_id, CASE WHEN ch<>2 OR rate<>48000 THEN 'PREVIEW_AUDIO_FORMAT_MISMATCH' WHEN abs(drift) > 500 THEN 'PREVIEW_AUDIO_DURATION_MISMATCH' END AS failure,
  (ch=2 AND rate=48000 AND abs(drift) <= 250) AS technical_pass FROM (SELECT episode_id, 1+episode_id%5//2 AS ch, CASE WHEN episode_id%9=0 THEN 44100 ELSE 48000 END AS rate, total_bytes%1201-600 AS drift FROM episode)""")
def preview_audio_gate(spark, sf):
    e = view(spark, sf, "episode").selectExpr("episode_id", "1+(episode_id%5) DIV 2 AS ch", "CASE WHEN episode_id%9=0 THEN 44100 ELSE 48000 END AS rate", "total_bytes%1201-600 AS drift")
    args = [F.col(c) for c in ("rate", "ch", "drift")]
    return e.select("episode_id", rl.preview_audio_verdict(*args).alias("failure"), rl.preview_technical_pass(*args).alias("technical_pass"))


EDITS = """ed AS (SELECT episode_id, ord, speaker_id AS track_id, ord AS sent_no, start_ms - CASE WHEN (episode_id+ord)%13=5 THEN 40000 ELSE 0 END AS start_ms, end_ms,
   CASE WHEN (episode_id+ord)%17=3 THEN 'NEEDS_REVIEW' ELSE CASE WHEN action='NEEDS_REVIEW' THEN 'KEEP' ELSE action END END AS action,
   CASE WHEN (episode_id*3+ord)%19=4 THEN ' ' ELSE zh_text END AS dub_vi FROM segment WHERE NOT (episode_id%21=6 AND ord=1)
   UNION ALL SELECT episode_id, ord+1000, speaker_id, ord+1000, start_ms+9000000, end_ms+9000000, 'KEEP', zh_text FROM segment WHERE episode_id%21=8 AND ord=0)"""


def review_edits(spark, sf):
    seg = segments_with_words(spark, sf)
    same = seg.where("NOT (episode_id%21=6 AND ord=1)").selectExpr(
        "episode_id", "ord", "speaker_id AS track_id", "ord AS sent_no", "start_ms - CASE WHEN (episode_id+ord)%13=5 THEN 40000 ELSE 0 END AS start_ms", "end_ms",
        "CASE WHEN (episode_id+ord)%17=3 THEN 'NEEDS_REVIEW' ELSE CASE WHEN action='NEEDS_REVIEW' THEN 'KEEP' ELSE action END END AS action",
        "CASE WHEN (episode_id*3+ord)%19=4 THEN ' ' ELSE zh_text END AS dub_vi", "words", "false AS needs_review", "map('asr', 1.0D) AS confidence")
    extra = seg.where("episode_id%21=8 AND ord=0").selectExpr(
        "episode_id", "ord+1000 AS ord", "speaker_id AS track_id", "ord+1000 AS sent_no", "start_ms+9000000 AS start_ms", "end_ms+9000000 AS end_ms",
        "'KEEP' AS action", "zh_text AS dub_vi", "transform(words, w -> named_struct('t', w.t, 's', w.s+9000000, 'e', w.e+9000000)) AS words",
        "false AS needs_review", "map('asr', 1.0D) AS confidence")
    return same.unionByName(extra)


EDIT_BAD = EDITS + """, tl AS (SELECT episode_id, max(end_ms) AS dur FROM segment GROUP BY episode_id),
 o AS (SELECT ed.*, dur, lag(end_ms) OVER (PARTITION BY ed.episode_id, track_id ORDER BY sent_no) AS pe FROM ed JOIN tl USING (episode_id)),
 badrows AS (SELECT episode_id, ord, unnest(list_filter([CASE WHEN start_ms < pe THEN 'OUT_OF_ORDER' END, CASE WHEN end_ms > dur THEN 'OUTSIDE_TIMELINE' END,
  CASE WHEN action='NEEDS_REVIEW' THEN 'UNDECIDED' END, CASE WHEN action='DUB' AND trim(dub_vi)='' THEN 'DUB_INCOMPLETE' END], lambda v: v IS NOT NULL)) AS code FROM o
 UNION ALL SELECT coalesce(a.episode_id, b.episode_id), coalesce(a.ord, b.ord), 'SEGMENT_SET_CHANGED' FROM segment a FULL JOIN ed b ON a.episode_id=b.episode_id AND a.ord=b.ord WHERE a.ord IS NULL OR b.ord IS NULL
 UNION ALL SELECT DISTINCT episode_id, CAST(NULL AS BIGINT), 'EPISODE_NOT_IN_REVIEW' FROM ed WHERE episode_id%9=2)"""


def reviewed(stored):
    return stored.groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms")).withColumn(
        "status", F.expr("CASE WHEN episode_id%9=2 THEN 'V1_RUNNING' WHEN episode_id%2=0 THEN 'NEEDS_REVIEW' ELSE 'CHECKPOINTED' END"))


@query("review_edit_violations", "WITH " + EDIT_BAD + " SELECT episode_id, ord, code FROM badrows")
def review_edit_violations(spark, sf):
    stored = view(spark, sf, "segment")
    episodes = reviewed(stored)
    return rl.edit_violations(stored, review_edits(spark, sf), episodes, EP, "ord")


@query("review_edits_applied", "WITH " + EDIT_BAD + """ SELECT episode_id, ord, action, start_ms, CAST(NULL AS DOUBLE) AS asr_confidence FROM ed
  WHERE episode_id NOT IN (SELECT episode_id FROM badrows)""")
def review_edits_applied(spark, sf):
    stored = view(spark, sf, "segment").withColumn("confidence", F.expr("map('asr', CAST(NULL AS DOUBLE))"))
    episodes = reviewed(stored)
    edits = review_edits(spark, sf)
    bad = rl.edit_violations(stored, edits, episodes, EP, "ord")
    return rl.applied_edits(stored, edits, bad, EP, "ord").select("episode_id", "ord", "action", "start_ms", F.col("confidence")["asr"].alias("asr_confidence"))


@query("mix_input_violations", """
WITH s AS (SELECT episode_id, ord, CASE WHEN (episode_id+ord)%12=7 THEN start_ms-3000 ELSE start_ms END AS start_ms, end_ms, action, needs_review FROM segment),
 c AS (SELECT episode_id, ord FROM clip WHERE NOT missing)
SELECT episode_id, ord, 'NEEDS_REVIEW' AS code FROM s WHERE action='NEEDS_REVIEW' OR needs_review
UNION ALL SELECT episode_id, ord, 'EMPTY_SEGMENT' FROM s WHERE start_ms < 0 OR end_ms <= start_ms
UNION ALL SELECT episode_id, ord, 'SEGMENTS_OVERLAP' FROM (SELECT *, lag(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, ord) AS pe FROM s) WHERE pe > start_ms
UNION ALL SELECT episode_id, ord, 'CLIP_MISSING' FROM s WHERE action='DUB' AND (episode_id, ord) NOT IN (SELECT (episode_id, ord) FROM c)
UNION ALL SELECT episode_id, ord, 'CLIP_WITHOUT_SEGMENT' FROM c WHERE (episode_id, ord) NOT IN (SELECT (episode_id, ord) FROM s WHERE action='DUB')""")
def mix_input_violations(spark, sf):
    seg = segments_with_words(spark, sf).withColumn("start_ms", F.expr("CASE WHEN (episode_id+ord)%12=7 THEN start_ms-3000 ELSE start_ms END"))
    return rl.mix_input_violations(seg, view(spark, sf, "clip").where("NOT missing"), EP, "ord")


@query("id_set_mismatch", """
SELECT episode_id, ord, 'left' AS side FROM segment WHERE (episode_id, ord) NOT IN (SELECT (episode_id, ord) FROM clip WHERE NOT missing)
UNION ALL SELECT episode_id, ord, 'right' FROM clip WHERE NOT missing AND (episode_id, ord) NOT IN (SELECT (episode_id, ord) FROM segment)""")
def id_set_mismatch(spark, sf):
    return rl.set_mismatch(view(spark, sf, "segment"), view(spark, sf, "clip").where("NOT missing"), ["episode_id", "ord"])


@query("range_bag_mismatch", """
WITH want AS (SELECT episode_id, start_ms, end_ms FROM segment WHERE action='DUB'),
 got AS (SELECT episode_id, start_ms, CASE WHEN ord%4=2 THEN end_ms+1 ELSE end_ms END AS end_ms FROM segment WHERE action='DUB' AND ord<>6)
(SELECT *, 'left' AS side FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want))""")
def range_bag_mismatch(spark, sf):
    dubs = view(spark, sf, "segment").where("action = 'DUB'")
    want = dubs.select("episode_id", "start_ms", "end_ms")
    got = dubs.where("ord <> 6").selectExpr("episode_id", "start_ms", "CASE WHEN ord%4=2 THEN end_ms+1 ELSE end_ms END AS end_ms")
    return rl.bag_mismatch(want, got)


@query("distinct_spans", "SELECT DISTINCT episode_id, start_ms//60000*60000 AS start_ms, end_ms//3600000*3600000 AS end_ms FROM turn")
def distinct_spans(spark, sf):
    return view(spark, sf, "turn").selectExpr("episode_id", "start_ms DIV 60000 * 60000 AS start_ms", "end_ms DIV 3600000 * 3600000 AS end_ms").distinct()


@query("issue_union", """SELECT code, count(*) AS n FROM (SELECT 'SPAN' AS code FROM turn WHERE end_ms > duration_ms UNION ALL SELECT 'FILENAME_NOT_BASENAME' FROM episode WHERE filename LIKE '%/%'
  UNION ALL SELECT 'UNSUPPORTED_EXTENSION' FROM episode WHERE filename LIKE '%.txt') GROUP BY code""")
def issue_union(spark, sf):
    names = rl.episode_rules(view(spark, sf, "episode"), ["episode_id"], max_bytes=10**15).select("code", F.col("episode_id").alias("id"))
    spans = view(spark, sf, "turn").where("end_ms > duration_ms").select(F.lit("SPAN").alias("code"), F.col("turn_id").alias("id"))
    return rl.union_all([names, spans]).groupBy("code").agg(F.count("*").alias("n"))


FRAMES = """fr AS (SELECT episode_id, i - CASE WHEN episode_id%7=1 AND i>=5 THEN 0 ELSE 0 END + CASE WHEN episode_id%7=1 AND i>=5 THEN 1 ELSE 0 END AS frame_index,
  1000 + CAST(round_even(i*40.0::DOUBLE, 0) AS BIGINT) + CASE WHEN episode_id%7=2 AND i=4 THEN 90 ELSE 0 END AS at_ms, CAST(1000 AS BIGINT) AS start_ms,
  1000 + n*40 + CASE WHEN episode_id%7=3 THEN 500 ELSE 0 END AS end_ms, n FROM (SELECT doc_id AS episode_id, 3 + n_chars%50 AS n, unnest(range(0, 3 + n_chars%50)) AS i FROM documents))"""


@query("dense_timeline_violations", "WITH " + FRAMES + """, x AS (SELECT *, frame_index - coalesce(lag(frame_index) OVER w, -1) <> 1 AS gap, abs(at_ms - lag(at_ms) OVER w - 40.0) > 40.0 AS sparse,
   NOT (start_ms <= at_ms AND at_ms < end_ms) AS outside FROM fr WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
 r AS (SELECT episode_id, bool_or(gap) AS gap, bool_or(coalesce(sparse, false)) AS sparse, bool_or(outside) AS outside, count(*) AS n, min(at_ms) AS lo, max(at_ms) AS hi, any_value(start_ms) AS s, any_value(end_ms) AS e, arg_min(at_ms, frame_index) AS f FROM x GROUP BY episode_id),
 o AS (SELECT *, greatest(0, round_even(f/40.0::DOUBLE, 0)) AS off FROM r),
 d AS (SELECT fr.episode_id, bool_or(abs(at_ms - round_even((off+frame_index)*40.0::DOUBLE, 0)) > 40.0) AS drift FROM fr JOIN o USING (episode_id) GROUP BY fr.episode_id)
SELECT episode_id, unnest(list_filter([CASE WHEN gap THEN 'INDEX_NOT_CONTIGUOUS' END, CASE WHEN outside THEN 'TIME_OUTSIDE_INTERVAL' END, CASE WHEN sparse THEN 'NOT_DENSE' END,
  CASE WHEN lo - s > 80 OR e - hi > 80 THEN 'EDGES_UNCOVERED' END, CASE WHEN off + n > 70 THEN 'MORE_FRAMES_THAN_SOURCE' END, CASE WHEN drift THEN 'NOT_ON_SOURCE_FRAMES' END,
  CASE WHEN n > 48 THEN 'FRAME_CAP_EXCEEDED' END], lambda v: v IS NOT NULL)) AS code FROM o JOIN d USING (episode_id)""")
def dense_timeline_violations(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id AS episode_id", "3 + n_chars%50 AS n")
    frames = docs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).selectExpr(
        "episode_id", "i + CASE WHEN episode_id%7=1 AND i>=5 THEN 1 ELSE 0 END AS frame_index",
        "1000 + i*40 + CASE WHEN episode_id%7=2 AND i=4 THEN 90 ELSE 0 END AS at_ms", "1000L AS start_ms",
        "1000 + n*40 + CASE WHEN episode_id%7=3 THEN 500 ELSE 0 END AS end_ms", "25L AS fps_num", "1L AS fps_den", "0L AS source_start_ms", "70L AS source_frames")
    return rl.dense_timeline_rules(frames, EP, frame_cap=48)


@query("frame_rate_drift", "WITH " + FRAMES + " SELECT episode_id, frame_index, at_ms FROM fr WHERE abs(at_ms - 1000 - frame_index*40.0) > 2.0")
def frame_rate_drift(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id AS episode_id", "3 + n_chars%50 AS n")
    frames = docs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).selectExpr(
        "episode_id", "i + CASE WHEN episode_id%7=1 AND i>=5 THEN 1 ELSE 0 END AS frame_index",
        "i*40 + CASE WHEN episode_id%7=2 AND i=4 THEN 90 ELSE 0 END AS rel", "25L AS fps_num", "1L AS fps_den")
    out = rl.cfr_drift(frames, EP, at="rel")
    return out.select("episode_id", "frame_index", (F.col("rel") + 1000).alias("at_ms"))


@query("repeated_frame_times", "SELECT user_id AS episode_id, epoch_us(ts)//1000//60000 AS at_min, 'AMBIGUOUS_FRAME_TIME' AS code FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_frame_times(spark, sf):
    base = view(spark, sf, "turn").selectExpr("episode_id", "(start_ms + 1704067200000) DIV 60000 AS at_min")
    return rl.repeated_timestamps(base, EP, "at_min")


@query("subtitle_band", """
WITH c AS (SELECT *, (box_top+box_bottom)/2 AS ctr FROM ocr_line WHERE box_top >= 720*0.55::DOUBLE AND abs((box_left+box_right)/2 - 500) <= 1000*0.22::DOUBLE),
 m AS (SELECT episode_id, list_sort(list(ctr))[count(*)//2+1] AS mid FROM c GROUP BY episode_id HAVING count(*) >= 3),
 k AS (SELECT c.episode_id, count(*) AS support_count, min(box_top) AS t, max(box_bottom) AS b FROM c JOIN m USING (episode_id) WHERE abs(ctr-mid) < 720*0.06::DOUBLE GROUP BY c.episode_id HAVING count(*) >= 3)
SELECT episode_id, support_count, greatest(0, CAST(trunc(t-12) AS BIGINT))/720.0::DOUBLE AS y, (least(720, CAST(trunc(b+12) AS BIGINT)) - greatest(0, CAST(trunc(t-12) AS BIGINT)))/720.0::DOUBLE AS h FROM k""")
def subtitle_band(spark, sf):
    return ql.subtitle_bands(view(spark, sf, "ocr_line"), EP, width=F.lit(1000.0), height=F.lit(720.0))


@query("audio_quality", """
WITH b AS (SELECT label AS stem, list_transform(embedding, lambda v: greatest(-32768, least(32767, CAST(floor(CAST(v AS DOUBLE)*80000) AS BIGINT)))) AS s FROM embeddings),
 w AS (SELECT stem, unnest([s[1:16], s[17:32], s[33:48], s[49:64]]) AS p, s FROM b),
 q AS (SELECT stem, count(*) AS windows, CAST(sum(CASE WHEN sqrt(list_sum(list_transform(p, lambda x: x*x))/CAST(len(p) AS DOUBLE)) <= 8000 THEN 1 ELSE 0 END) AS BIGINT) AS silent FROM w GROUP BY stem),
 a AS (SELECT stem, CAST(sum(len(s)) AS BIGINT) AS samples, max(list_max(list_transform(s, lambda x: abs(x)))) AS peak, CAST(sum(len(list_filter(s, lambda x: abs(x) >= 32767))) AS BIGINT) AS clipped FROM b GROUP BY stem)
SELECT stem, samples, peak, clipped, windows, silent, round(20*log10(peak/32768.0::DOUBLE), 6) AS peak_dbfs, clipped/CAST(samples AS DOUBLE) AS clipped_sample_ratio, silent/CAST(windows AS DOUBLE) AS silence_window_ratio,
  CAST(round_even(samples*1000/160.0::DOUBLE, 0) AS BIGINT) AS duration_ms FROM a JOIN q USING (stem)""")
def audio_quality(spark, sf):
    out = ql.audio_quality(pcm_blocks(spark, sf), ["stem"], channels=1, rate=160, silence_dbfs=20 * math.log10(8000 / 32768))
    return out.withColumn("peak_dbfs", F.round("peak_dbfs", 6))


def pcm_blocks(spark, sf):
    samples = F.transform("embedding", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v.cast("double") * 80_000))).cast("long"))
    return table(spark, sf, "embeddings").select(F.col("label").alias("stem"), F.col("vec_id").alias("block_no"), samples.alias("samples"))


@query("mix_quality", """
WITH b AS (SELECT label AS stem, list_transform(embedding, lambda v: greatest(-32768, least(32767, CAST(floor(CAST(v AS DOUBLE)*80000) AS BIGINT)))) AS s FROM embeddings),
 a AS (SELECT stem, CAST(sum(len(s)) AS BIGINT) AS samples, CAST(sum(len(list_filter(s, lambda x: abs(x) >= 32767))) AS BIGINT) AS clipped FROM b GROUP BY stem),
 d AS (SELECT *, CAST(round_even(samples*1000/160.0::DOUBLE, 0) AS BIGINT) AS duration_ms FROM a)
SELECT stem, abs(duration_ms - (duration_ms//50*50)) AS duration_drift_ms, abs(duration_ms - (duration_ms//50*50)) <= 20 AS duration_pass, clipped/CAST(samples AS DOUBLE) <= 0.00001::DOUBLE AS clipping_pass,
 (abs(duration_ms - (duration_ms//50*50)) <= 20 AND clipped/CAST(samples AS DOUBLE) <= 0.00001::DOUBLE) AS technical_quality_pass FROM d""")
def mix_quality(spark, sf):
    measured = ql.audio_quality(pcm_blocks(spark, sf), ["stem"], channels=1, rate=160).withColumn("source_ms", F.expr("duration_ms DIV 50 * 50"))
    return ql.mix_quality(measured).select("stem", "duration_drift_ms", "duration_pass", "clipping_pass", "technical_quality_pass")


@query("ocr_counts", """SELECT episode_id, count(*) AS sampled_frames, CAST(sum(frame_no%4) AS BIGINT) AS text_instances, CAST(sum(CASE WHEN frame_no%5=0 THEN frame_no%4 ELSE 0 END) AS BIGINT) AS residual_text,
  bool_and(frame_no%97<>0) AS all_unmasked_equal FROM ocr_line GROUP BY episode_id""")
def ocr_counts(spark, sf):
    frames = view(spark, sf, "ocr_line").withColumn("texts", F.expr("array_repeat('x', CAST(frame_no%4 AS INT))"))
    return ql.ocr_counts(frames, EP, checked=F.expr("frame_no%5=0"), untouched=F.expr("frame_no%97<>0"))


@query("hostile_cue_text", """SELECT page_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM (SELECT page_id, i, replace(replace(replace(replace(replace(trim(regexp_replace(l0, '[\\x00-\\x1f\\x7f]', ' ', 'g')), '{', '｛'), '}', '｝'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS l
  FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), chr(10))) AS l0, generate_subscripts(string_split(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), chr(10)), 1) AS i FROM pages)) WHERE l <> '' GROUP BY page_id""")
def hostile_cue_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.cue_text(F.col("html")).alias("text"))


@query("cue_timestamps", """SELECT page_id, printf('%02d:%02d:%02d,%03d', ms//3600000, ms//60000%60, ms//1000%60, ms%1000) AS stamp FROM (SELECT page_id, page_id*777777 AS ms FROM pages)""")
def cue_timestamps(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.timestamp(F.col("page_id") * 777_777).alias("stamp"))
