"""Dubbing tables derived from the driver's tables, in Spark and in DuckDB SQL.

Each view is one projection (a source table plus column expressions that both engines read alike), so
the operators get realistic keys, times and text at any scale factor without synthetic data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxtable.schemas import TABLES

# Milliseconds since 2024-01-01, from a timestamp without time zone.
REL_MS = {
    "spark": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {0})",
    "duckdb": "((epoch_us({0}) - 1704067200000000) // 1000)",
}
DAY_MS = {
    "spark": "(datediff(CAST({0} AS DATE), DATE'1992-01-01') * 86400000L)",
    "duckdb": "(datediff('day', DATE '1992-01-01', CAST({0} AS DATE)) * CAST(86400000 AS BIGINT))",
}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "segment": ("conversations", {
        "episode_id": "conv_id",
        "series_id": "conv_id % 7",
        "ord": "turn",
        "segment_id": "concat('seg_', lpad(CAST(turn*17000 + (turn*137+conv_id*53)%900 AS VARCHAR(20)), 12, '0'), '_', lpad(CAST(turn AS VARCHAR(20)), 4, '0'))",
        "speaker_id": "role",
        "start_ms": "turn*17000 + (turn*137+conv_id*53)%900",
        "end_ms": "turn*17000 + (turn*137+conv_id*53)%900 + 300 + 8*length(text)",
        "zh_text": "text",
        "action": "CASE (conv_id*7+turn*3)%10 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'DUB' END",
        "needs_review": "(conv_id*7+turn*3)%10 = 1",
    }),
    "clip": ("conversations", {
        "episode_id": "conv_id",
        "ord": "turn",
        "actual_ms": "CAST(floor((300+8*length(text))*(70+(conv_id*31+turn*17)%70)/100) AS BIGINT)",
        "attempts": "turn%5",
        "missing": "(conv_id+turn)%11 = 0",
    }),
    "turn": ("events", {
        "episode_id": "user_id",
        "turn_id": "event_id",
        "start_ms": "REL_MS(ts)",
        "end_ms": "REL_MS(ts) + CAST(floor(value*60000) AS BIGINT) + 1",
        "speaker_id": "event_type",
        "duration_ms": "CAST(2500000000 AS BIGINT)",
    }),
    "live_word": ("events", {
        "episode_id": "user_id",
        "pos": "event_id",
        "s": "REL_MS(ts)",
        "e": "REL_MS(ts) + CAST(floor(value*1000) AS BIGINT) + 1",
    }),
    "job_event": ("events", {
        "event_id": "event_id",
        "episode_id": "user_id",
        "ts_ms": "REL_MS(ts)",
        "state": "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'signup' THEN 'PREPARING' WHEN 'click' THEN 'SEPARATING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END",
        "message": "props",
    }),
    "ocr_line": ("events", {
        "episode_id": "user_id",
        "frame_no": "event_id",
        "box_left": "CAST((event_id*13)%700 AS DOUBLE)",
        "box_right": "CAST((event_id*13)%700 + 100 + event_id%300 AS DOUBLE)",
        "box_top": "CAST(400+(event_id*7)%300 AS DOUBLE)",
        "box_bottom": "CAST(440+(event_id*7)%300 AS DOUBLE)",
    }),
    "media": ("documents", {
        "episode_id": "doc_id",
        "series_id": "source",
        "duration_ms": "n_chars*1000",
        "fps": "1 + doc_id%30",
    }),
    "corpus_case": ("documents", {
        "corpus": "doc_id%50",
        "case_id": "doc_id",
        "category": "CASE doc_id%8 WHEN 0 THEN 'speech_clear' WHEN 1 THEN 'music_loud' WHEN 2 THEN 'nonverbal' WHEN 3 THEN 'overlap' WHEN 4 THEN 'subtitle_static' WHEN 5 THEN 'subtitle_motion' WHEN 6 THEN 'dark' ELSE 'other' END",
        "start_ms": "(doc_id%17)*100",
        "end_ms": "(doc_id%17)*100 + (n_chars%4000)*10 - 50",
        "source_duration_ms": "n_chars*10",
        "source": "CASE WHEN doc_id%19=0 THEN concat('../', source, '/', CAST(doc_id AS VARCHAR(20)), '.mp4') ELSE concat(source, '/', CAST(doc_id AS VARCHAR(20)), '.mp4') END",
        "zh_reference": "CASE WHEN doc_id%5=0 THEN NULL ELSE text END",
        "tts_text": "CASE WHEN doc_id%3=0 THEN NULL ELSE lang END",
        "roi_x": "CAST(doc_id%10 AS DOUBLE)/10",
        "roi_w": "CAST(1+doc_id%7 AS DOUBLE)/10",
        "has_roi": "doc_id%4<>0",
        "text": "text",
    }),
    "series": ("customer", {
        "series_id": "c_custkey",
        "title": "c_name",
        "priority": "CAST(c_nationkey AS BIGINT)",
        "created_at": "(c_custkey*7919)%100000",
        "roi_json": "CASE WHEN c_custkey%3=0 THEN concat('{\"x\":0,\"y\":0.', CAST(1+c_custkey%9 AS VARCHAR(20)), ',\"w\":1,\"h\":0.', CAST(1+c_custkey%8 AS VARCHAR(20)), '}') END",
        "glossary_version": "c_custkey%4",
    }),
    "episode": ("orders", {
        "episode_id": "o_orderkey",
        "series_id": "o_custkey",
        "ordinal": "o_orderkey%1000 + 1",
        "filename": "concat(CASE WHEN o_orderkey%23=0 THEN 'a/b' ELSE 'ep' END, CAST(o_orderkey AS VARCHAR(20)), CASE o_orderkey%5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' WHEN 2 THEN '.mov' WHEN 3 THEN '.txt' ELSE '.webm' END)",
        "total_bytes": "CAST(floor(o_totalprice) AS BIGINT)",
        "duration_ms": "CAST(floor(o_totalprice*10) AS BIGINT)",
        "status": "CASE WHEN o_orderstatus='O' THEN CASE o_orderkey%4 WHEN 0 THEN 'V1_RUNNING' WHEN 1 THEN 'PREPARING' WHEN 2 THEN 'ASR' ELSE 'UPLOADING' END WHEN o_orderstatus='F' THEN CASE o_orderkey%3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END ELSE 'QUEUED' END",
        "queue_requested": "o_orderkey%3<>0",
        "created_at": "DAY_MS(o_orderdate)",
        "roi_json": "CASE o_orderkey%6 WHEN 0 THEN '{\"x\":0.1,\"y\":0.7,\"w\":0.8,\"h\":0.2}' WHEN 1 THEN '{\"x\":0.5,\"y\":0.7,\"w\":0.8,\"h\":0.2}' WHEN 2 THEN 'broken' END",
        "flag": "CASE o_orderkey%4 WHEN 0 THEN 'SUBTITLE_MODE=burn' WHEN 1 THEN 'SUBTITLE_MODE=bogus' WHEN 2 THEN 'SUBTITLE_MODE=off' ELSE 'OTHER' END",
        "flag2": "CASE o_orderkey%3 WHEN 0 THEN 'SUBTITLE_MODE=replace' ELSE 'SUBTITLE_MODE=burn' END",
    }),
    "stage_run": ("lineitem", {
        "run_id": "l_orderkey",
        "stage": "concat('stage', CAST(l_linenumber AS VARCHAR(20)))",
        "attempt": "l_partkey",
        "worker": "l_suppkey",
        "wall_ms": "CAST(floor(l_quantity*1000) AS BIGINT) + l_partkey%97",
        "status": "CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 'FAILED' WHEN l_returnflag='A' AND l_partkey%50=0 THEN 'TIMED_OUT' ELSE 'MEASURED' END",
        "inference_ms": "CASE WHEN l_partkey%3=0 THEN CAST(floor(l_extendedprice) AS BIGINT) END",
        "adapter_ms": "CASE WHEN l_partkey%5<>0 THEN CAST(floor(l_extendedprice) AS BIGINT) + 7 END",
        "processed_ms": "CASE WHEN l_suppkey%4<>0 THEN CAST(floor(l_quantity*100) AS BIGINT) END",
        "source_ms": "CAST(l_suppkey*1000 AS BIGINT)",
        "price_c": "CAST(round(l_extendedprice*100) AS BIGINT)",
    }),
    "artifact": ("lineitem", {
        "episode_id": "l_orderkey",
        "kind": "CASE l_linenumber WHEN 1 THEN 'final_video' WHEN 2 THEN 'preview_video' WHEN 3 THEN 'checkpoint' WHEN 4 THEN 'transcript' ELSE 'other' END",
        "artifact_id": "l_partkey*100000 + l_suppkey",
        "bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
        "created_at": "DAY_MS(l_shipdate)",
    }),
    "issue": ("lineitem", {
        "episode_id": "l_orderkey",
        "issue_id": "l_partkey*100000 + l_suppkey",
        "code": "CASE l_linenumber WHEN 1 THEN 'DURATION_REWRITE_REQUIRED' WHEN 2 THEN 'ALIGNMENT_REVIEW_REQUIRED' WHEN 3 THEN 'ROI_REQUIRED' WHEN 4 THEN 'TRANSCRIPT_REVIEW_REQUIRED' WHEN 5 THEN 'MISSING_TTS_CLIP' WHEN 6 THEN 'AUDIO_QC_FAILED' ELSE 'MIX_CLIPPING' END",
        "severity": "CASE WHEN l_returnflag='R' THEN 'error' ELSE 'warning' END",
        "resolved": "l_linestatus='F'",
    }),
    "upload_chunk": ("lineitem", {
        "upload_id": "l_orderkey",
        "seq": "CAST(l_linenumber AS BIGINT)*1000000000 + l_partkey*10000 + l_suppkey",
        "length": "CAST(floor(l_quantity) AS BIGINT)",
        "skewed": "CASE WHEN l_partkey%11=0 THEN 1 ELSE 0 END",
    }),
    "glossary": ("benchmark", {
        "series_id": "item_id%7",
        "zh": "substring(text, 1, strpos(text, ' ')-1)",
        "term": "text",
        "vi": "substring(text, strpos(text, ' ')+1)",
        "locked": "item_id%3<>0",
        "updated_at": "item_id",
    }),
}


def _engine(expr: str, engine: str) -> str:
    for name, forms in (("REL_MS", REL_MS), ("DAY_MS", DAY_MS)):
        expr = re.sub(rf"{name}\((\w+)\)", lambda m, f=forms[engine]: f.format(m.group(1)), expr)
    if engine == "spark":
        expr = expr.replace("AS VARCHAR(20)", "AS STRING").replace("strpos(", "instr(")
    return expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def view_of(base: DataFrame, name: str) -> DataFrame:
    """The projection of a view over its base table, batch or stream."""
    return base.selectExpr(*[f"{_engine(expr, 'spark')} AS {col}" for col, expr in VIEWS[name][1].items()])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view_of(table(spark, sf_dir, VIEWS[name][0]), name)


def view_sql(name: str) -> str:
    base, columns = VIEWS[name]
    body = ", ".join(f"{_engine(expr, 'duckdb')} AS {col}" for col, expr in columns.items())
    return f"{name} AS (SELECT {body} FROM {base})"


def with_views(sql: str) -> str:
    """Prepend the CTEs of the views that ``sql`` names."""
    used = [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql, re.I)]
    if not used:
        return sql
    heads = ", ".join(view_sql(n) for n in used)
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {heads}, " + re.sub(r"^with\s+recursive\s+", "", body, flags=re.I)
    if re.match(r"with\b", body, re.I):
        return f"WITH {heads}, " + re.sub(r"^with\s+", "", body, flags=re.I)
    return f"WITH {heads} {body}"
