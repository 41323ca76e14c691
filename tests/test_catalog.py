import pytest
from listing import listed
from pyspark.sql import functions as F

from voxtable.functions import adapters as ad
from voxtable.functions.states import legal_moves
from voxtable.operators import catalog as ct
from voxtable.operators import context as cx
from voxtable.operators import reports as rp


def test_moves():
    moves = set(legal_moves())
    assert ("QUEUED", "PREPARING") in moves and ("UPLOADING", "QUEUED") in moves and ("PREPARING", "V1_RUNNING") in moves
    assert ("PREVIEW_READY", "TEXT_REMOVAL") not in moves and ("COMPLETED", "QUEUED") not in moves and ("UPLOADING", "FAILED") not in moves
    assert ("SKIPPED", "FAILED") not in moves and ("PAUSED", "PAUSED") in moves


def test_queue(rows):
    series = rows("series_id string, priority bigint, created_at bigint", [("a", 10, 1), ("b", 0, 2)])
    eps = rows("episode_id bigint, series_id string, ordinal bigint, status string, queue_requested boolean",
               [(1, "a", 1, "QUEUED", True), (2, "b", 2, "QUEUED", True), (3, "b", 1, "QUEUED", True), (4, "b", 0, "QUEUED", False), (5, "b", 0, "FAILED", True)])
    assert ct.next_episode(eps, series).first()["episode_id"] == 3
    assert listed(ct.queue_order(eps, series), "queue_rank", "episode_id") == [(1, 3), (2, 2), (3, 1)]


def test_glossary_lock(rows):
    current = rows("series_id bigint, zh string, vi string, locked boolean, updated_at bigint", [(1, "甲", "old", True, 0), (1, "乙", "old", False, 0)])
    series = rows("series_id bigint, glossary_version bigint", [(1, 4)])
    req = rows("request_id bigint, series_id bigint, zh string, vi string, locked boolean, updated_at bigint", [
        (1, 1, "甲", "model", False, 1), (1, 1, "丙", "model", False, 1), (2, 1, "乙", "new", True, 2), (3, 1, "丁", "x", True, 3), (3, 1, "丁", "y", True, 3), (4, 1, "甲", "user", True, 4)])
    table, versions, rejects = ct.glossary_upsert(current, req, series)
    assert listed(table, "zh", "vi") == sorted([("甲", "user"), ("乙", "new")], key=repr)
    assert versions.first()["glossary_version"] == 6
    assert listed(rejects, "request_id", "code") == [(1, "LOCKED_TERM"), (3, "DUPLICATE_TERM")]


def test_invalidation_and_memo(rows):
    records = rows("episode_id bigint, stage string", [(1, "SEPARATING"), (1, "ASR"), (1, "TTS"), (2, "TTS")])
    damaged = rows("episode_id bigint, stage string", [(1, "ASR")])
    assert listed(ct.invalidate_from(records, damaged, ["episode_id"]), "episode_id", "stage") == [(1, "SEPARATING"), (2, "TTS")]
    want = rows("episode_id bigint, stage string, input_hash string", [(1, "SEPARATING", "a"), (1, "ASR", "b2"), (1, "TTS", "c")])
    done = rows("episode_id bigint, stage string, input_hash string", [(1, "SEPARATING", "a"), (1, "ASR", "b"), (1, "TTS", "c")])
    assert listed(ct.stages_to_run(want, done, ["episode_id"]), "stage") == [("ASR",), ("TTS",)]


def test_checkpoints_both_ways(rows):
    rec = rows("path string, stage string, sha256 string", [("a", "ASR", "1"), ("b", "ASR", "2"), ("c", "TTS", "3")])
    now = rows("path string, sha256 string", [("a", "1"), ("b", "x"), ("d", "4")])
    assert listed(ct.checkpoint_mismatches(rec, now, ["path"]), "path", "stage", "reason") == [
        ("b", "ASR", "CHECKSUM_MISMATCH"), ("c", "TTS", "MISSING"), ("d", None, "NOT_INDEXED")]


def test_partition_replacement(rows, spark, tmp_path):
    path = str(tmp_path / "segments")
    old = rows("episode_id bigint, line bigint", [(1, 1), (1, 2), (2, 1)])
    old.write.partitionBy("episode_id").parquet(path)
    ct.replace_partitions(rows("line bigint, episode_id bigint", [(9, 1)]), path)
    assert listed(spark.read.parquet(path), "episode_id", "line") == [(1, 9), (2, 1)]


def test_export_writes_checksummed_files(rows, tmp_path):
    series = rows("series_id bigint, title string, priority bigint, created_at bigint, glossary_version bigint, roi_json string, secret_path string", [(1, "t", 0, 0, 0, None, "/x")])
    files = ct.write_export({"series": series}, str(tmp_path / "export")).collect()
    text = "".join(p.read_text() for p in (tmp_path / "export").rglob("part-*.txt"))
    assert len(files) == 1 and len(files[0]["sha256"]) == 64 and '"title":"t"' in text and "/x" not in text


def test_recovery(rows):
    eps = rows("episode_id bigint, status string, queue_requested boolean", [(1, "V1_RUNNING", True), (2, "PREPARING", False), (3, "ASR", True), (4, "ASR", True), (5, "COMPLETED", True), (6, "TTS", False)])
    marks = rows("episode_id bigint, checkpoint_stage string, valid boolean", [(3, "ASR", True), (4, "ASR", False), (6, None, True)])
    hashes = rows("episode_id bigint, source_ok boolean", [(i, True) for i in range(1, 7)])
    assert listed(ct.recovery_plan(eps, marks, hashes), "episode_id", "decision", "next_stage") == [
        (1, "QUEUED", "V1_RUNNING"), (2, "CHECKPOINTED", "PREPARING"), (3, "QUEUED", "ASR"), (4, "FAILED", None), (6, "CHECKPOINTED", "SEPARATING")]


def test_large_glossary_gives_the_same_matches(rows):
    lines = rows("k bigint, id bigint, text string", [(1, 1, "the old night and day"), (1, 2, "gone"), (2, 3, "the old night"), (1, 4, "a b"), (1, 5, "")])
    terms = rows("k bigint, term string", [(1, "old night"), (1, "b"), (1, "go"), (2, "day"), (2, "the old night"), (1, "old nights")])
    want = [(1, "b"), (1, "old night")]
    many = rows("k bigint, term string", [(1, f"zz term {i}") for i in range(6000)])
    odd = rows("k bigint, term string", [(1, ""), (1, None), (2, "")])
    for all_terms in (terms, terms.unionAll(many), terms.unionAll(odd)):
        got = listed(cx.term_matches(lines, all_terms, ["k"], text="text", term="term"), "id", "term")
        assert got == sorted([(1, "old night"), (2, "go"), (3, "the old night"), (4, "b")], key=repr), want
    free = listed(cx.term_matches(lines.drop("k"), terms.drop("k"), [], text="text", term="term"), "id", "term")
    assert (2, "go") in free and (1, "day") in free


def test_term_matching_is_linear_in_the_text(rows):
    import time

    line = rows("id bigint, text string", [(1, "ab cd " * 17_000 + "needle in hay")])
    terms = rows("term string", [("needle in",), ("hay",), ("x",), ("nothing here",)])
    started = time.perf_counter()
    assert listed(cx.term_matches(line, terms, [], text="text", term="term"), "term") == [("hay",), ("needle in",)]
    assert time.perf_counter() - started < 20


def test_packing_takes_any_index(rows):
    for index in ([1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 6, 8, 10, 12, 14, 16], [3]):
        df = rows("k bigint, ord bigint, tokens bigint", [(1, i, 10) for i in index])
        got = listed(cx.packed_batches(df, ["k"], block_rows=4), "first_ord", "lines")
        assert got == sorted([(index[i], min(4, len(index) - i)) for i in range(0, len(index), 4)], key=repr)


def test_requests_of_one_batch_are_walked_in_order(rows):
    current = rows("series_id bigint, zh string, vi string, locked boolean, updated_at bigint", [])
    series = rows("series_id bigint, glossary_version bigint", [(1, 0)])
    req = rows("request_id bigint, series_id bigint, zh string, vi string, locked boolean, updated_at bigint", [
        (10, 1, "t", "user", True, 1), (11, 1, "t", "model", False, 2), (11, 1, "u", "model", True, 2), (12, 1, "u", "free", False, 3)])
    table, versions, rejects = ct.glossary_upsert(current, req, series)
    assert listed(table, "zh", "vi", "locked") == [("t", "user", True), ("u", "free", False)]
    assert listed(rejects, "request_id", "code") == [(11, "LOCKED_TERM")] and versions.first()["glossary_version"] == 2
    eps = rows("episode_id bigint, status string", [(1, "QUEUED"), (2, "QUEUED")])
    moves = rows("episode_id bigint, status string, message string, ts_ms bigint", [(1, "PREPARING", "", 1), (1, "FAILED", "", 2), (2, "COMPLETED", "", 1), (3, "FAILED", "", 1)])
    updated, done, bad = ct.apply_transitions(eps, moves)
    assert listed(updated, "episode_id", "status") == [(1, "FAILED"), (2, "QUEUED")]
    assert listed(done, "episode_id", "n", "state") == [(1, 1, "PREPARING"), (1, 2, "FAILED")]
    assert listed(bad, "episode_id", "code") == [(2, "INVALID_TRANSITION"), (3, "EPISODE_NOT_FOUND")]


def test_two_replies_reject_the_batch(rows):
    lines = rows(LINES, [(1, 0, "s1", "seg_a")])
    body = '{"segments":[{"id":"s1","subtitle_vi":"a","dub_vi":"b","emotion":"calm","punctuation":"."}]}'
    good, bad = cx.matched_translations(lines, rows("batch bigint, body string", [(1, body), (1, body)]), ["batch"])
    assert good.count() == 0 and listed(bad, "batch", "reason") == [(1, "DUPLICATE_RESPONSE")]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_packing_equals_greedy_loop(rows, block):
    import random

    rnd = random.Random(block)
    data = [(k, i, rnd.choice([10, 40, 60, 101])) for k in (1, 2) for i in range(60)]
    want = []
    for k in (1, 2):
        lines, i = [t for kk, _, t in data if kk == k], 0
        while i < len(lines):
            n = 1
            while i + n < len(lines) and n < 4 and sum(lines[i:i + n + 1]) <= 100:
                n += 1
            want.append((k, i, n, lines[i] > 100))
            i += n
    df = rows("k bigint, ord bigint, tokens bigint", data)
    assert listed(cx.packed_batches(df, ["k"], max_tokens=100, block_rows=max(block, 4)), "k", "first_ord", "lines", "too_long") == sorted(want, key=repr)


LINES = "batch bigint, pos bigint, alias string, segment_id string"


@pytest.mark.parametrize("body, reason", [
    ('{"segments":[%s,%s]}' % tuple('{"id":"%s","subtitle_vi":" Xin ","dub_vi":"Chào!","emotion":"calm","punctuation":"..."}' % i for i in ("s1", "seg_b")), None),
    ('{"segments":[]}', "IDS_DO_NOT_MATCH"), ('{"segments":[],"x":1}', "INVALID_SHAPE"), ("[]", "INVALID_SHAPE"), ("nope", "INVALID_SHAPE"),
    ('{"segments":[{"id":"s1","subtitle_vi":"a","dub_vi":"b","emotion":"c"}]}', "INVALID_SHAPE"),
    ('{"segments":[%s,%s]}' % (('{"id":"s1","subtitle_vi":"a","dub_vi":"b","emotion":"c","punctuation":""}',) * 2), "DUPLICATE_ID"),
    ('{"segments":[{"id":"s1","subtitle_vi":" ","dub_vi":"b","emotion":"c","punctuation":""}]}', "EMPTY_TEXT")])
def test_reply_is_all_or_nothing(rows, body, reason):
    lines = rows(LINES, [(1, 0, "s1", "seg_a"), (1, 1, "s2", "seg_b")])
    good, bad = cx.matched_translations(lines, rows("batch bigint, body string", [(1, body)]), ["batch"])
    assert [r["reason"] for r in bad.collect()] == ([reason] if reason else [])
    assert listed(good, "segment_id", "subtitle_vi", "dub_vi") == ([] if reason else [("seg_a", "Xin…", "Chào!"), ("seg_b", "Xin…", "Chào!")])


def test_unmapped_speaker_is_uncertain(rows):
    lines = rows("episode_id bigint, speaker_id string, addressee_id string", [(1, "speaker_0", "x"), (1, "speaker_1", "x")])
    out = cx.with_characters(lines, rows("episode_id bigint, speaker_id string, character_id string", [(1, "speaker_1", "An")]), ["episode_id"])
    assert listed(out, "speaker_id", "character_id", "uncertain") == [("speaker_0", None, True), ("speaker_1", "An", False)]


def test_unknown_cost_stays_null(rows):
    stages = rows("run_id bigint, stage string, wall_ms bigint, seq bigint", [(1, "a", 5000, 0), (1, "b", 5000, 1), (2, "a", 0, 0)])
    runs = rows("run_id bigint, source_ms bigint, api_cost double", [(1, 20_000, None), (2, 1, 5.0)])
    got = listed(rp.run_totals(stages, runs), "run_id", "bottleneck", "rtf", "total_cost")
    assert got == [(1, "a", 0.5, None), (2, None, 0.0, 5.0)]


def test_retries(rows):
    tried = rows("call string, n bigint, status bigint", [
        ("ok", 1, 200), ("later", 1, 503), ("later", 2, None), ("later", 3, 200), ("gone", 1, 404), ("gone", 2, 200), ("busy", 1, 429), ("busy", 2, 500),
        ("busy", 3, 503), ("busy", 4, 200), ("down", 1, None)])
    got = listed(ad.retry_outcomes(tried, ["call"], ["n"]), "call", "attempts", "status", "error", "surplus")
    assert got == sorted([("ok", 1, 200, None, 0), ("later", 3, 200, None, 0), ("gone", 1, 404, "HTTP_FAILURE", 1),
                          ("busy", 3, 503, "TRANSIENT_HTTP_FAILURE", 1), ("down", 1, None, "TRANSPORT_FAILED", 0)], key=repr)


def test_unsupported_stage(rows):
    runs = rows("run_id bigint, stage string", [(1, "TTS"), (2, "ASR"), (3, None)])
    assert listed(ad.stage_support(runs, ["TTS"]), "run_id", "problem") == [(1, None), (2, "UNSUPPORTED_STAGE"), (3, "UNSUPPORTED_STAGE")]


def test_edits_need_an_open_episode_and_unique_ids(rows):
    from voxtable.operators import rules as rl

    schema = "e bigint, ord bigint, track_id string, sent_no bigint, start_ms bigint, end_ms bigint, action string, needs_review boolean, dub_vi string, words array<struct<t:string,s:bigint,e:bigint>>"
    line = lambda e, i: (e, i, "a", i, i * 10, i * 10 + 5, "KEEP", False, "", [])
    stored = rows("e bigint, ord bigint", [(1, 1), (2, 1), (3, 1), (3, 1)])
    eps = rows("e bigint, duration_ms bigint, status string", [(1, 100, "NEEDS_REVIEW"), (2, 100, "V1_RUNNING"), (3, 100, "CHECKPOINTED")])
    out = rl.edit_violations(stored, rows(schema, [line(1, 1), line(2, 1), line(3, 1)]), eps, ["e"], "ord")
    assert listed(out, "e", "ord", "code") == sorted([(2, None, "EPISODE_NOT_IN_REVIEW"), (3, None, "DUPLICATE_STORED_ID")], key=repr)


def test_export_manifest_ignores_order(rows):
    a = rows("table_name string, doc string", [("t", "é"), ("t", "b"), ("u", "c")])
    one, two = (listed(ct.export_manifest(x), "table_name", "n", "bytes", "root") for x in (a, a.orderBy("doc").repartition(5)))
    assert one == two and one[0][:3] == ("t", 2, 3)


def test_history_cap(rows):
    old = rows("series_id bigint, at bigint", [(1, i) for i in range(5)])
    new = rows("series_id bigint, at bigint", [(1, 9)])
    assert listed(ct.capped_history(old, new, ["series_id"], ["at"], 3), "at") == [(3,), (4,), (9,)]


def test_quota_refusals_reserve_nothing(rows):
    import random

    rnd = random.Random(1)
    data = [(k, i, rnd.randrange(1, 60)) for k in (1, 2, 3) for i in range(80)] + [(4, 0, 100), (4, 1, 1), (5, 0, 101)]
    want, used = [], {}
    for k, i, size in data:
        held = used.get(k, 0)
        want.append((k, i, held, held + size <= 100))
        used[k] = held + size if held + size <= 100 else held
    req = rows("k bigint, seq bigint, total_bytes bigint", data)
    assert listed(ct.quota_admission(req, ["k"], 100), "k", "seq", "reserved_bytes", "admitted") == sorted(want, key=repr)


def test_character_names_in_ids(spark):
    from voxtable.functions import text as tx

    df = spark.createDataFrame([(" Ünï / Clip ",), ("...",), ("x" * 60,)], "c string").select(tx.job_slug(F.col("c")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["n-clip", "case", "x" * 48]
