"""JSON documents, media metadata and file inventories as tables.

Readers give ``path, value`` (or ``path, content``); the parsers below take such rows, so they work on
files, on a table column, or on a stream alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.operators.rules import ENV_KEYS, SECRET_KEY
from voxtable.schemas import ARTIFACT_DOC, CORPUS_DOC, PROBE_DOC, REPORT_DOC


def text_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row per file: ``path, value``."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: ``path, length, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def stage_documents(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return rows.select(*keys, F.from_json(value, ARTIFACT_DOC).alias("doc")).where("doc.schema_version IS NOT NULL")


def document_segments(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.posexplode("doc.segments").alias("pos", "s")).select(*keys, F.col("pos").cast("long").alias("pos"), "s.*")


def document_turns(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.explode("doc.turns").alias("t")).select(*keys, "t.*")


def document_ocr_lines(docs: DataFrame, keys: list[str]) -> DataFrame:
    frames = docs.select(*keys, F.posexplode("doc.frames").alias("frame_no", "f"))
    lines = frames.select(*keys, "frame_no", "f.at_ms", F.posexplode("f.lines").alias("line_no", "l"))
    return lines.select(*keys, F.col("frame_no").cast("long").alias("frame_no"), "at_ms", F.col("line_no").cast("long").alias("line_no"), "l.*")


def zipped_lines(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel ``boxes, texts, scores`` arrays to line rows; frames of unequal lengths give an issue."""
    same = (F.size("boxes") == F.size("texts")) & (F.size("texts") == F.size("scores"))
    lines = F.when(same, F.arrays_zip("boxes", "texts", "scores"))
    return frames.select(*keys, F.when(~same, "UNEQUAL_LENGTHS").alias("issue"), F.posexplode_outer(lines).alias("line_no", "l")).select(
        *keys, "issue", F.col("line_no").cast("long").alias("line_no"), F.col("l.texts").alias("text"), F.col("l.scores").alias("score"), F.col("l.boxes").alias("box"))


def punctuated(segments: DataFrame, rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Punctuated text by position; positions on one side only give an issue instead of a shift."""
    r = rows.select(*keys, index, "punc_text")
    s = segments.select(*keys, index, F.col("zh_text").alias("asr_text"))
    issue = F.when(F.col("asr_text").isNull() | F.col("punc_text").isNull(), "POSITION_WITHOUT_PARTNER")
    return s.join(r, [*keys, index], "full_outer").select(*keys, index, "asr_text", F.col("punc_text").alias("zh_text"), issue.alias("issue"))


def stage_reports(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Reports, one row per document; an unreadable or non-object document gives a null report."""
    return rows.select(*keys, F.when(is_object(F.col(value)), F.from_json(value, REPORT_DOC)).alias("report"))


def corpus_cases(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Corpus manifests to case rows with their index."""
    docs = rows.select(*keys, F.from_json(value, CORPUS_DOC).alias("doc")).where("doc.schema_version = 1")
    return docs.select(*keys, "doc.kind", F.posexplode("doc.cases").alias("case_no", "c")).select(
        *keys, "kind", F.col("case_no").cast("long").alias("case_no"), F.col("c.id").alias("case_id"), "c.source", "c.source_sha256",
        "c.start_ms", "c.end_ms", "c.category", "c.zh_reference", "c.words", "c.roi", "c.tts_text", "c.target_ms")


def probe_metadata(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Duration, first real video stream and first audio stream; ``error`` where one is missing."""
    p = F.from_json(value, PROBE_DOC)
    video = lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)
    doc = rows.select(*keys, p.alias("p")).select(
        *keys, F.get(F.filter("p.streams", video), 0).alias("v"),
        F.get(F.filter("p.streams", lambda s: s["codec_type"] == "audio"), 0).alias("a"),
        F.expr("try_cast(p.format.duration AS DECIMAL(30,9))").alias("seconds"))
    error = (
        F.when(F.col("v").isNull() | F.col("a").isNull(), "MISSING_STREAM")
        .when(F.col("seconds").isNull() | (F.col("seconds") <= 0), "INVALID_DURATION")
        .when(~F.coalesce((F.col("v.width") > 0) & (F.col("v.height") > 0), F.lit(False)), "INVALID_DIMENSIONS"))
    return doc.select(
        *keys, F.when(error.isNull(), F.floor(F.col("seconds") * 1000)).cast("long").alias("duration_ms"), F.col("v.codec_name").alias("video_codec"),
        F.col("v.width").cast("long").alias("width"), F.col("v.height").cast("long").alias("height"), F.col("a.codec_name").alias("audio_codec"),
        F.expr("try_cast(a.sample_rate AS BIGINT)").alias("sample_rate"), F.col("a.channels").cast("long").alias("channels"), error.alias("error"))


def inventory(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Bytes and checksum of each file."""
    return rows.select(*keys, F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


_SECRET = re.compile(SECRET_KEY)
_WRITTEN = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


@lru_cache(1 << 16)
def _public(key: str) -> bool:
    return _SECRET.search(key) is None


@lru_cache(1 << 16)
def _plan(key: str) -> bool:
    return key.casefold() not in ENV_KEYS


def _filtered(text: pd.Series, keep: Callable[[str], bool]) -> pd.Series:
    """Keys that are not kept are left out while a document is read, at any depth; a key is judged once, as documents share them."""
    read = json.JSONDecoder(object_pairs_hook=lambda pairs: {k: v for k, v in pairs if keep(k)}).decode

    def one(doc: str | None) -> str | None:
        try:
            return _WRITTEN(read(doc))
        except (TypeError, ValueError):
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def public_json(text: pd.Series) -> pd.Series:
    """JSON without credential-like keys at any depth; null when it cannot be read."""
    return _filtered(text, _public)


@F.pandas_udf(T.StringType())
def plan_json(text: pd.Series) -> pd.Series:
    """JSON without environment keys at any depth; null when it cannot be read."""
    return _filtered(text, _plan)
