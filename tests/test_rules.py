import json
from types import SimpleNamespace

import pandas as pd
import pytest
from listing import listed
from pyspark.sql import functions as F

from voxtable.operators import rules as rl
from voxtable.schemas import ROI, WORD
from voxtable.sources import documents as dc


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def codes(df):
    return sorted(r["code"] for r in df.collect())


def test_segment_contract(rows):
    df = rows(f"id bigint, start_ms bigint, end_ms bigint, words array<{WORD}>, confidence map<string,double>", [
        (1, 0, 10, [("a", 0, 10)], {"asr": None, "alignment": 1.0}), (2, 10, 10, [], {}), (3, 5, 10, [("a", 4, 6)], {}),
        (4, 0, 10, [("a", 3, 3)], {"asr": 1.01})])
    assert listed(rl.segment_contract(df, ["id"]), "id", "code") == [
        (2, "EMPTY_SEGMENT"), (3, "WORD_OUTSIDE_SEGMENT"), (4, "CONFIDENCE_OUT_OF_RANGE"), (4, "WORD_OUTSIDE_SEGMENT")]


@pytest.mark.parametrize("path, good", [("a/b.mp4", True), ("a/../b", True), ("..", False), ("a/..", False), ("/a", False), ("a/../../b", False), ("C:\\x", False), (".", False)])
def test_paths(spark, path, good):
    assert one(spark, rl.contained_path(F.lit(path))) is good


def test_upload_admission(rows):
    df = rows("episode_id bigint, ordinal bigint, filename string, total_bytes bigint", [
        (1, 1, "film.MP4", 5), (2, 0, "film.mp4", 11), (3, 1, "a/b.mkv", 5), (4, 1, "film.txt", 5), (5, 1, ".mp4", 5), (6, 1, "x" * 197 + ".mov", 0)])
    assert listed(rl.episode_rules(df, ["episode_id"], max_bytes=10), "episode_id", "code") == [
        (2, "FILE_TOO_LARGE"), (2, "ORDINAL_RANGE"), (3, "FILENAME_NOT_BASENAME"), (4, "UNSUPPORTED_EXTENSION"),
        (5, "UNSUPPORTED_EXTENSION"), (6, "FILENAME_LENGTH"), (6, "FILE_TOO_LARGE")]


CASE = f"corpus bigint, case_id string, source string, source_sha256 string, start_ms bigint, end_ms bigint, category string, words array<{WORD}>, roi {ROI}, target_ms bigint"


def corpus(rows, width):
    return [(1, c, f"{c}.mp4", None, 0, width, c, None, None, None) for c in rl.CATEGORIES]


@pytest.mark.parametrize("width, status", [(90_000, "READY_FOR_REPRESENTATIVE_QUALITY_EVALUATION"), (60_000, "INVALID")])
def test_corpus_coverage(rows, width, status):
    cases = rows(CASE, corpus(rows, width))
    files = rows("source string, sha256 string, duration_ms bigint", [(f"{c}.mp4", "a" * 64, 100_000) for c in rl.CATEGORIES])
    errors = rl.corpus_rules(cases, files, ["corpus", "case_id"], ["case_id"])
    assert errors.count() == 0
    row = rl.corpus_coverage(cases, errors, ["corpus"]).first()
    assert (row["status"], row["total_case_duration_ms"], row["missing"]) == (status, 7 * width, [])


def test_corpus_problems(rows):
    files = rows("source string, sha256 string, duration_ms bigint", [("f.mp4", "A" * 64, 1000)])
    good = ("f.mp4", "a" * 64, 0, 500, "dark")
    cases = rows(CASE, [
        (1, "dup", *good, None, None, None), (1, "dup", *good, None, None, None),
        (1, "hash", "f.mp4", "b" * 64, 0, 500, "dark", None, None, None), (1, "hex", "f.mp4", "zz", 0, 500, "dark", None, None, None),
        (1, "word", *good, [("a", 10, 20), ("b", 5, 8)], None, None), (1, "gone", "g.mp4", None, 0, 500, "dark", None, None, None),
        (1, "out", "../f.mp4", None, 0, 500, "odd", None, None, None), (1, "late", "f.mp4", None, 0, 1001, "dark", None, None, None),
        (1, "roi", *good, None, (0.5, 0.0, 0.6, 1.0), 0), (1, "empty", "f.mp4", None, 5, 5, "dark", None, None, None)])
    got = set(listed(rl.corpus_rules(cases, files, ["corpus", "case_id"], ["case_id"]), "case_id", "code"))
    assert got == {("dup", "DUPLICATE_ID"), ("hash", "HASH_MISMATCH"), ("hex", "MALFORMED_HASH"), ("word", "WORDS_OUT_OF_RANGE"), ("gone", "SOURCE_NOT_FOUND"),
                   ("out", "SOURCE_OUTSIDE_FOLDER"), ("out", "UNKNOWN_CATEGORY"), ("late", "END_AFTER_SOURCE"), ("roi", "INVALID_ROI"), ("roi", "INVALID_TARGET_MS"), ("empty", "INVALID_BOUNDS")}


EDIT = f"episode_id bigint, segment_id string, track_id string, sent_no bigint, start_ms bigint, end_ms bigint, action string, needs_review boolean, dub_vi string, words array<{WORD}>, confidence map<string,double>"


def edits(rows, changes):
    stored = rows("episode_id bigint, segment_id string, confidence map<string,double>", [(1, "a", {"asr": None}), (1, "b", {"asr": None})])
    base = {"a": dict(track="t", start=0, end=100, action="DUB", dub="xin chào", words=[("w", 0, 50), ("v", 50, 90)]),
            "b": dict(track="t", start=100, end=200, action="KEEP", dub="", words=[])}
    for ident, change in changes.items():
        base.setdefault(ident, dict(base["b"])).update(change)
    sent = rows(EDIT, [(1, i, e["track"], n, e["start"], e["end"], e["action"], False, e["dub"], e["words"], {"asr": 1.0}) for n, (i, e) in enumerate(base.items())])
    return stored, sent, rows("episode_id bigint, duration_ms bigint", [(1, 200)])


@pytest.mark.parametrize("changes, want", [
    ({}, []), ({"b": {"start": 99}}, ["OUT_OF_ORDER"]), ({"b": {"start": 99, "track": "other"}}, []), ({"b": {"end": 201}}, ["OUTSIDE_TIMELINE"]),
    ({"c": {"start": 200, "end": 200}}, ["SEGMENT_SET_CHANGED"]), ({"b": {"action": "NEEDS_REVIEW"}}, ["UNDECIDED"]),
    ({"a": {"dub": " "}}, ["DUB_INCOMPLETE"]), ({"a": {"words": [("w", 0, 50), ("v", 49, 90)]}}, ["BAD_WORDS"])])
def test_review_edits(rows, changes, want):
    stored, sent, episodes = edits(rows, changes)
    bad = rl.edit_violations(stored, sent, episodes, ["episode_id"], "segment_id")
    assert codes(bad) == want
    done = rl.applied_edits(stored, sent, bad, ["episode_id"], "segment_id").collect()
    assert len(done) == (0 if want else 2) and all(r["confidence"]["asr"] is None for r in done)


def test_subtitle_flags(spark):
    mode = lambda *f: one(spark, rl.subtitle_mode(F.array(*[F.lit(x) for x in f]), "replace"))
    assert mode("x", "SUBTITLE_MODE=bogus", "SUBTITLE_MODE=off", "SUBTITLE_MODE=burn") == "off" and mode("x") == "replace"


def test_preview_limits(spark):
    args = [F.lit(48_000), F.lit(2)]
    assert one(spark, rl.preview_audio_verdict(*args, F.lit(-500))) is None
    assert one(spark, rl.preview_audio_verdict(*args, F.lit(501))) == "PREVIEW_AUDIO_DURATION_MISMATCH"
    assert one(spark, rl.preview_technical_pass(*args, F.lit(250))) and not one(spark, rl.preview_technical_pass(*args, F.lit(251)))


FRAME = "episode_id bigint, frame_index bigint, at_ms bigint, start_ms bigint, end_ms bigint, fps_num bigint, fps_den bigint, source_start_ms bigint, source_frames bigint"


@pytest.mark.parametrize("times, want", [([0, 40, 80], []), ([0, 40, 160], ["NOT_DENSE", "NOT_ON_SOURCE_FRAMES"]), ([0], ["EDGES_UNCOVERED"])])
def test_dense_timeline(rows, times, want):
    df = rows(FRAME, [(1, i, t, 0, 120 if len(times) > 2 and times[2] == 80 else 200, 25, 1, 0, 3) for i, t in enumerate(times)])
    assert codes(rl.dense_timeline_rules(df, ["episode_id"], frame_cap=3)) == want


def test_json_filters_judge_a_key_once_and_keep_one_writer(monkeypatch):
    made, judged = [], []
    build, search = json.JSONEncoder.__init__, dc._SECRET.search
    monkeypatch.setattr(json.JSONEncoder, "__init__", lambda self, **options: made.append(1) or build(self, **options))
    monkeypatch.setattr(dc, "_SECRET", SimpleNamespace(search=lambda key: judged.append(key) or search(key)))
    docs = [f'{{"b_once":[{{"ENV":1,"token_once":2,"x_once":{i}.50}}],"a_once":"\\u00e9"}}' for i in range(50)]
    first = dc.public_json.func(pd.Series([*docs, None, "{", "7", '{"env":1,"env":2}']))
    got = list(dc.plan_json.func(first))
    assert got[3] == '{"a_once":"é","b_once":[{"x_once":3.5}]}' and got[50:] == [None, None, "7", "{}"]
    assert not made and len(judged) == len(set(judged))


def test_metrics_and_secrets(spark):
    kept = one(spark, rl.measured_metrics(F.expr("map('inference_ms', 0D, 'load_ms', double('inf'), 'other', 1D, 'peak_reserved_bytes', -1D)")))
    assert kept == {"inference_ms": 0.0}
    doc = '{"a":[{"Authorization":1,"b":2}],"env":{"x":1},"apiKey":3,"z":"é"}'
    assert one(spark, dc.public_json(F.lit(doc))) == '{"a":[{"b":2}],"env":{"x":1},"z":"é"}'
    assert one(spark, dc.plan_json(F.lit(doc))) == '{"a":[{"Authorization":1,"b":2}],"apiKey":3,"z":"é"}'
    assert one(spark, dc.public_json(F.lit("{"))) is None


def test_documents(rows, tmp_path, spark):
    (tmp_path / "a.json").write_text('{"schema_version":1,"stage":"asr","metrics":{"inference_ms":5}}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text('{"stage":')
    reports = dc.stage_reports(dc.text_files(spark, str(tmp_path)), ["path"])
    assert sorted((r["path"][-6:], r["report"].stage if r["report"] else None) for r in reports.collect()) == [("a.json", "asr"), ("b.json", None), ("c.json", None)]
    files = dc.inventory(dc.binary_files(spark, str(tmp_path)), ["path"])
    assert sorted(r["bytes"] for r in files.collect()) == [3, 9, 63]
    frames = rows("f bigint, boxes array<string>, texts array<string>, scores array<double>", [(1, ["p", "q"], ["a", "b"], [0.1, 0.2]), (2, ["p"], ["a", "b"], [0.1])])
    assert listed(dc.zipped_lines(frames, ["f"]), "f", "issue", "line_no", "text") == [(1, None, 0, "a"), (1, None, 1, "b"), (2, "UNEQUAL_LENGTHS", None, None)]
