"""Source, audio-block and adapter queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions import adapters as ad
from voxtable.operators import pcm
from voxtable.plans.registry import query
from voxtable.plans.views import table, view
from voxtable.session import fresh_path, spread
from voxtable.sources import audio as au
from voxtable.sources import documents as dc


@query("artifact_document_segments", "SELECT episode_id, ord//4 AS part, ord%4 AS pos, segment_id AS id, start_ms, end_ms, zh_text FROM segment")
def artifact_document_segments(spark, sf):
    """Written as one JSON file per document part, then scanned back."""
    seg = view(spark, sf, "segment").withColumn("part", F.expr("ord DIV 4"))
    listed = F.sort_array(F.collect_list(F.struct(
        "ord", F.struct(F.col("segment_id").alias("id"), "start_ms", "end_ms", "zh_text").alias("item"))))
    docs = seg.groupBy("episode_id", "part").agg(F.transform(listed, lambda r: r["item"]).alias("segments")).select(
        "episode_id", "part", F.to_json(F.struct(F.lit(1).alias("schema_version"), "segments")).alias("value"))
    path = fresh_path(spark, "stage-documents")
    docs.write.parquet(path)
    stored = spark.read.schema("episode_id bigint, part bigint, value string").parquet(path)
    keys = ["episode_id", "part"]
    return dc.document_segments(dc.stage_documents(stored, keys), keys).select(*keys, "pos", "id", "start_ms", "end_ms", "zh_text")


@query("stage_reports_tolerant", """SELECT run_id, seq, CASE WHEN k IN (1, 2) THEN NULL ELSE stage END AS stage, CASE WHEN k IN (1, 2) THEN NULL ELSE CAST(wall_ms AS DOUBLE) END AS wall, k NOT IN (1, 2) AS readable
 FROM (SELECT *, attempt*100000 + worker AS seq, attempt%7 AS k FROM stage_run)""")
def stage_reports_tolerant(spark, sf):
    runs = view(spark, sf, "stage_run").withColumn("seq", F.expr("attempt*100000L + worker"))
    doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), "stage", "status", F.create_map(F.lit("wall"), F.col("wall_ms").cast("double")).alias("metrics")))
    value = F.when(F.expr("attempt%7 = 1"), F.lit('{"stage": "asr", ')).when(F.expr("attempt%7 = 2"), F.lit("[1, 2]")).otherwise(doc)
    out = dc.stage_reports(runs.withColumn("value", value), ["run_id", "seq"])
    return out.select("run_id", "seq", F.col("report.stage").alias("stage"), F.col("report.metrics")["wall"].alias("wall"), F.col("report").isNotNull().alias("readable"))


@query("corpus_manifest_cases", """SELECT corpus, case_id//50 AS case_no, CAST(case_id AS VARCHAR) AS case_id, category, start_ms, end_ms FROM corpus_case""")
def corpus_manifest_cases(spark, sf):
    cases = view(spark, sf, "corpus_case").withColumn("part", F.expr("case_id DIV 50000"))
    item = F.struct(F.col("case_id").cast("string").alias("id"), "source", "start_ms", "end_ms", "category")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("case_id", item.alias("c")))), lambda r: r["c"])
    docs = cases.groupBy("corpus", "part").agg(listed.alias("cases")).select(
        "corpus", "part", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("representative").alias("kind"), "cases")).alias("value"))
    out = dc.corpus_cases(docs, ["corpus", "part"])
    return out.select("corpus", (F.col("case_no") + F.col("part") * 1000).alias("case_no"), "case_id", "category", "start_ms", "end_ms")


@query("probe_metadata", """SELECT episode_id, CASE WHEN error IS NULL THEN duration_ms END AS duration_ms, CASE WHEN error = 'MISSING_STREAM' THEN NULL ELSE 'h264' END AS video_codec, error FROM (
 SELECT *, CASE WHEN episode_id%7=2 THEN 'MISSING_STREAM' WHEN episode_id%5=1 THEN 'INVALID_DURATION' WHEN episode_id%11=3 THEN 'INVALID_DIMENSIONS' END AS error FROM episode)""")
def probe_metadata(spark, sf):
    eps = view(spark, sf, "episode")
    cover = F.struct(F.lit("video").alias("codec_type"), F.lit("png").alias("codec_name"), F.lit(9).alias("width"), F.lit(9).alias("height"),
                     F.struct(F.lit(1).alias("attached_pic")).alias("disposition"))
    movie = F.struct(F.expr("CASE WHEN episode_id%7=2 THEN 'data' ELSE 'video' END").alias("codec_type"), F.lit("h264").alias("codec_name"),
                     F.expr("CASE WHEN episode_id%11=3 THEN 0 ELSE 1280 END").alias("width"), F.lit(720).alias("height"),
                     F.struct(F.lit(0).alias("attached_pic")).alias("disposition"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("int").alias("width"),
                     F.lit(None).cast("int").alias("height"), F.lit(None).cast("struct<attached_pic:int>").alias("disposition"))
    length = F.expr("CASE WHEN episode_id%5=1 THEN 'N/A' ELSE CAST(CAST(duration_ms AS DECIMAL(20,3))/1000 AS STRING) END")
    doc = F.to_json(F.struct(F.array(cover, movie, sound).alias("streams"), F.struct(length.alias("duration")).alias("format")))
    return dc.probe_metadata(eps.select("episode_id", doc.alias("value")), ["episode_id"]).select("episode_id", "duration_ms", "video_codec", "error")


@query("file_inventory", "SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages")
def file_inventory(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return dc.inventory(rows, ["page_id"])


@query("zipped_ocr_lines", """SELECT frame_no, CASE WHEN frame_no%6=0 THEN 'UNEQUAL_LENGTHS' END AS issue, CASE WHEN frame_no%6<>0 THEN i END AS line_no, CASE WHEN frame_no%6<>0 THEN 't' || i END AS text
 FROM (SELECT frame_no, unnest(range(0, CASE WHEN frame_no%6=0 THEN 1 ELSE 2 END)) AS i FROM ocr_line)""")
def zipped_ocr_lines(spark, sf):
    frames = view(spark, sf, "ocr_line").selectExpr(
        "frame_no", "array(array(box_left), array(box_right)) AS boxes", "array('t0', 't1') AS texts", "CASE WHEN frame_no%6=0 THEN array(0.5D) ELSE array(0.5D, 0.9D) END AS scores")
    return dc.zipped_lines(frames, ["frame_no"]).select("frame_no", "issue", "line_no", "text")


@query("punctuated_lines", """SELECT episode_id, ord, CASE WHEN ord<>3 THEN zh_text END AS asr_text, CASE WHEN ord<>5 THEN zh_text || '.' END AS zh_text, CASE WHEN ord IN (3, 5) THEN 'POSITION_WITHOUT_PARTNER' END AS issue FROM segment""")
def punctuated_lines(spark, sf):
    seg = view(spark, sf, "segment")
    rows = seg.where("ord <> 5").select("episode_id", "ord", F.concat("zh_text", F.lit(".")).alias("punc_text"))
    return dc.punctuated(seg.where("ord <> 3"), rows, ["episode_id"], "ord")


@query("public_json", """SELECT run_id, seq, '{"a":{"keep":' || wall_ms || '},"list":[{"x":1}],"stage":"' || stage || '"}' AS doc FROM (SELECT *, attempt*100000 + worker AS seq FROM stage_run)""")
def public_json(spark, sf):
    doc = F.format_string('{"stage":"%s","API_KEY":"k","a":{"token":1,"keep":%d,"env":{"z":1}},"list":[{"x":1,"user_password":2}],"environment":3}', "stage", "wall_ms")
    rows = spread(view(spark, sf, "stage_run")).select("run_id", F.expr("attempt*100000L + worker AS seq"), doc.alias("doc"))
    return rows.select("run_id", "seq", dc.plan_json(dc.public_json("doc")).alias("doc"))


def stem_blocks(spark, sf):
    """Stems of 32-frame stereo blocks: one embedding row is one block of one episode."""
    level = lambda e: F.transform("embedding", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v.cast("double") * e))).cast("smallint"))
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id DIV 50 AS episode_id"), F.expr("vec_id % 50 AS block_no"), level(60_000).alias("speech"), level(3_000).alias("music"),
        F.transform("embedding", lambda v, i: i.cast("smallint")).alias("effects"))


MIX_SQL = """blk AS (SELECT vec_id//50 AS episode_id, vec_id%50 AS block_no, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1)-1 AS BIGINT) AS i FROM embeddings),
 smp AS (SELECT episode_id, block_no, i, block_no*32 + i//2 AS frame, greatest(-32768, least(32767, CAST(floor(CAST(v AS DOUBLE)*60000) AS BIGINT))) AS speech, CAST(floor(CAST(v AS DOUBLE)*3000) AS BIGINT) AS music FROM blk),
 mixed AS (SELECT s.*, CASE WHEN block_no%3=0 AND i//2 >= 5 AND i//2 < 20 THEN 0 ELSE speech END + music + i
   + CASE WHEN block_no%4=1 AND i//2 >= 20 THEN 400 + ((frame - (block_no*32+20))*2 + i%2) ELSE 0 END
   + CASE WHEN block_no%4=2 AND i//2 < 18 AND (episode_id, block_no-1) IN (SELECT (vec_id//50, vec_id%50) FROM embeddings) THEN 400 + ((frame - ((block_no-1)*32+20))*2 + i%2) ELSE 0 END AS m FROM smp s)"""


@query("three_stem_mix", "WITH " + MIX_SQL + """ SELECT episode_id, block_no, string_agg(CAST(greatest(-32768, least(32767, m)) AS VARCHAR), ',' ORDER BY i) AS samples,
  CAST(sum(CASE WHEN abs(m) > 32767 THEN 1 ELSE 0 END) AS BIGINT) AS clipped FROM mixed GROUP BY episode_id, block_no""")
def three_stem_mix(spark, sf):
    blocks = stem_blocks(spark, sf)
    # Times are in frames here (1000 per second), so word times are frame numbers.
    words = blocks.where("block_no%3 = 0").selectExpr("episode_id", "CAST((block_no*32+5)*1000/32.0 AS DOUBLE) AS s", "CAST((block_no*32+20)*1000/32.0 AS DOUBLE) AS e")
    clips = blocks.where("block_no%4 = 1").selectExpr("episode_id", "block_no*32+20 AS left", "block_no*32+50 AS right", "transform(sequence(0, 59), x -> CAST(400 + x AS SMALLINT)) AS samples")
    out = pcm.stem_mix(blocks, words, clips, ["episode_id"], rate=32)
    return out.select("episode_id", "block_no", F.array_join("samples", ",").alias("samples"), "clipped")


RAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({0} - {1} + 1)/4.0::DOUBLE, ({2} - {0})/4.0::DOUBLE))"
SUB_SQL = f"""blk AS (SELECT vec_id//50 AS episode_id, vec_id%50 AS block_no, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1)-1 AS BIGINT) AS i FROM embeddings),
 ids AS (SELECT DISTINCT episode_id, block_no FROM blk),
 bad AS (SELECT episode_id, count(*) AS uncovered FROM ids a WHERE block_no%3=0 AND NOT EXISTS (SELECT 1 FROM ids b WHERE b.episode_id=a.episode_id AND b.block_no=a.block_no+1) GROUP BY episode_id),
 smp AS (SELECT blk.*, i//2 AS r, coalesce(uncovered, 0) AS uncovered, (episode_id, block_no-1) IN (SELECT (episode_id, block_no) FROM ids WHERE block_no%3=0) AS tail,
   greatest(-32768, least(32767, CAST(floor(CAST(v AS DOUBLE)*60000) AS BIGINT))) AS speech, greatest(-32768, least(32767, CAST(floor(CAST(v AS DOUBLE)*3000) AS BIGINT))) AS music FROM blk LEFT JOIN bad USING (episode_id)),
 mixed AS (SELECT *, CASE WHEN uncovered > 0 THEN speech ELSE greatest(-32768, least(32767, CAST(round_even(speech
   + CASE WHEN block_no%4=1 AND r >= 2 THEN (100 + (r-2)*2 + i%2) * {RAMP.format("r", 2, 32)} ELSE 0 END
   - CASE WHEN block_no%3=0 AND r >= 5 THEN music * {RAMP.format("r", 5, 40)} ELSE 0 END
   - CASE WHEN tail AND r < 8 THEN music * {RAMP.format("(r+32)", 5, 40)} ELSE 0 END, 0) AS BIGINT))) END AS m FROM smp)"""


@query("dialogue_subtract_mix", "WITH " + SUB_SQL + """ SELECT episode_id, block_no, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS samples, CAST(sum(CASE WHEN abs(m) >= 32767 THEN 1 ELSE 0 END) AS BIGINT) AS clipped,
  max(uncovered) AS uncovered FROM mixed GROUP BY episode_id, block_no""")
def dialogue_subtract_mix(spark, sf):
    blocks = stem_blocks(spark, sf)
    words = blocks.where("block_no%3 = 0").selectExpr("episode_id", "CAST((block_no*32+5)*1000/32.0 AS DOUBLE) AS s", "CAST((block_no*32+40)*1000/32.0 AS DOUBLE) AS e")
    clips = blocks.where("block_no%4 = 1").selectExpr("episode_id", "block_no*32+2 AS left", "block_no*32+32 AS right", "transform(sequence(0, 59), x -> CAST(100 + x AS SMALLINT)) AS samples")
    windows = blocks.selectExpr("episode_id", "block_no*32 AS left", "block_no*32+32 AS right", "music AS samples")
    out = pcm.subtract_mix(blocks.withColumnRenamed("speech", "samples"), words, clips, windows, ["episode_id"], rate=32, ramp_ms=125)
    return out.select("episode_id", "block_no", F.array_join("samples", ",").alias("samples"), "clipped", "uncovered")


@query("passthrough_blocks", """SELECT vec_id//50 AS episode_id, vec_id%50 AS block_no, NOT (vec_id//50 IN (SELECT vec_id//50 FROM embeddings WHERE label%2=0 AND (vec_id//50)%3<>0)) AS copied FROM embeddings""")
def passthrough_blocks(spark, sf):
    base = table(spark, sf, "embeddings").selectExpr("vec_id DIV 50 AS episode_id", "vec_id % 50 AS block_no", "label")
    mix, copy = pcm.passthrough(base, base.where("label%2 = 0"), base.where("episode_id%3 <> 0"), ["episode_id"])
    return mix.withColumn("copied", F.lit(False)).unionByName(copy.withColumn("copied", F.lit(True))).select("episode_id", "block_no", "copied")


@F.pandas_udf(T.BinaryType())
def _as_wav(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: au.wav_bytes(np.floor(np.asarray(v, dtype="float64") * 30_000), 8, 2))


WAV_SQL = """SELECT vec_id, b AS block_no, 8 AS rate, list_sum(list_transform(embedding[b*16+1:b*16+16], lambda v: CAST(floor(CAST(v AS DOUBLE)*30000) AS BIGINT)))::BIGINT AS total, 8 AS frames
 FROM (SELECT *, unnest(range(0, 4)) AS b FROM embeddings)""".replace("8 AS rate", "CAST(8 AS BIGINT) AS rate").replace("8 AS frames", "CAST(8 AS BIGINT) AS frames")


@query("wav_blocks", WAV_SQL)
def wav_blocks(spark, sf):
    files = table(spark, sf, "embeddings").select("vec_id", _as_wav("embedding").alias("content"))
    out = au.wav_blocks(files, "vec_id")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return out.select("vec_id", "block_no", "rate", total.alias("total"), "frames")


@query("wav_range_blocks", WAV_SQL)
def wav_range_blocks(spark, sf):
    """The same sounds as files in the shared folder, each read in several ranges of bytes."""
    folder = fresh_path(spark, "wavs")
    au.write_wavs(spread(table(spark, sf, "embeddings")).select(F.col("vec_id").cast("string").alias("name"), _as_wav("embedding").alias("content")), folder)
    out = au.wav_ranges(au.wav_files(spark, folder), range_bytes=50)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    ident = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    return out.select(ident.alias("vec_id"), "block_no", "rate", total.alias("total"), "frames")


@query("adapter_stage_run", "SELECT run_id, stage, attempt, CASE WHEN stage NOT IN ('stage1', 'stage2', 'stage3', 'stage5') THEN 'UNSUPPORTED_STAGE' END AS problem FROM stage_run")
def adapter_stage_run(spark, sf):
    """Recorded runs of stages that no adapter serves."""
    out = ad.stage_support(view(spark, sf, "stage_run"), ["stage1", "stage2", "stage3", "stage5"])
    return out.select("run_id", "stage", "attempt", "problem")


@query("adapter_result_contract", """SELECT run_id, seq, CASE WHEN attempt%5=1 THEN 'MISSING_QUALITY_METRICS' WHEN attempt%5=2 THEN 'NON_FINITE_METRICS' WHEN attempt%5=3 THEN 'MISSING_MODEL_IDENTITY' END AS problem
 FROM (SELECT *, attempt*100000 + worker AS seq FROM stage_run)""")
def adapter_result_contract(spark, sf):
    runs = view(spark, sf, "stage_run").withColumn("seq", F.expr("attempt*100000L + worker"))
    metrics = F.expr("CASE WHEN attempt%5<>1 THEN map('cer', CASE WHEN attempt%5=2 THEN CAST('NaN' AS DOUBLE) ELSE 0.5D END) END")
    weights = F.expr("CASE WHEN attempt%5=3 THEN '' ELSE sha2(stage, 256) END")
    return runs.select("run_id", "seq", ad.result_problem(F.lit("r1"), weights, metrics).alias("problem"))


CALLS = "c AS (SELECT run_id AS request_id, stage, attempt, worker, CASE WHEN worker%9=0 THEN NULL WHEN worker%9<5 THEN 503 WHEN worker%9=5 THEN 429 WHEN worker%9=6 THEN 404 ELSE 200 END::BIGINT AS status FROM stage_run)"


@query("transport_retries", "WITH " + CALLS + """, n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stage, attempt, worker) AS k, count(*) OVER (PARTITION BY request_id) AS recorded, status IS NULL OR status=429 OR status BETWEEN 500 AND 599 AS again FROM c),
 f AS (SELECT request_id, coalesce(min(k) FILTER (NOT again AND k <= 3), max(k) FILTER (k <= 3)) AS attempts FROM n GROUP BY request_id)
SELECT request_id, attempts, status, CASE WHEN status IS NULL THEN 'TRANSPORT_FAILED' WHEN status BETWEEN 200 AND 299 THEN NULL WHEN again THEN 'TRANSIENT_HTTP_FAILURE' ELSE 'HTTP_FAILURE' END AS error, recorded - attempts AS surplus
FROM f JOIN n USING (request_id) WHERE n.k = f.attempts""")
def transport_retries(spark, sf):
    """How calls ended, judged on the recorded attempts."""
    calls = view(spark, sf, "stage_run").selectExpr("run_id AS request_id", "stage", "attempt", "worker",
        "CAST(CASE WHEN worker%9=0 THEN NULL WHEN worker%9<5 THEN 503 WHEN worker%9=5 THEN 429 WHEN worker%9=6 THEN 404 ELSE 200 END AS BIGINT) AS status")
    return ad.retry_outcomes(calls, ["request_id"], ["stage", "attempt", "worker"])
