"""Sample-exact mixes and streams against their batch twins."""

import numpy as np
import pytest
from listing import listed
from pyspark.sql import functions as F

from voxtable.operators import catalog as ct
from voxtable.operators import pcm, scan
from voxtable.sources import audio as au
from voxtable.streaming import jobs as sj
from voxtable.streaming import ordered as so

RATE = 200


def stereo(level, frames):
    return np.full((frames, 2), level, dtype="int16").ravel().tolist()


def blocks_of(rows, **stems):
    names = list(stems)
    data = [(1, b, *[stereo(v, RATE) for v in stems.values()]) for b in range(2)]
    return rows("episode_id bigint, block_no bigint, " + ", ".join(f"{n} array<smallint>" for n in names), data)


def whole(df):
    return np.concatenate([np.array(r["samples"]).reshape(-1, 2)[:, 0] for r in sorted(df.collect(), key=lambda r: r["block_no"])])


def test_only_the_lexical_span_is_replaced(rows):
    blocks = blocks_of(rows, speech=1000, music=100, effects=200)
    words = rows("episode_id bigint, s bigint, e bigint", [(1, 200, 600)])
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 40, 120, stereo(400, 80))])
    out = whole(pcm.stem_mix(blocks, words, clips, ["episode_id"], rate=RATE))
    assert (out[:40] == 1300).all() and (out[40:120] == 700).all() and (out[120:] == 1300).all()


def test_voice_crosses_blocks_and_clipping_is_counted(rows):
    blocks = blocks_of(rows, speech=0, music=20_000, effects=0)
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 190, 210, stereo(10_000, 20)), (1, 195, 205, stereo(5_000, 10))])
    mixed = pcm.stem_mix(blocks, rows("episode_id bigint, s bigint, e bigint", []), clips, ["episode_id"], rate=RATE)
    out = whole(mixed)
    assert (out[190:195] == 30_000).all() and (out[195:205] == 32_767).all() and (out[205:210] == 30_000).all()
    assert listed(mixed, "block_no", "clipped") == [(0, 10), (1, 10)]


def test_dialogue_is_subtracted_with_ramps(rows):
    source, ramp = 1000, 4
    blocks = blocks_of(rows, samples=source)
    words = rows("episode_id bigint, s bigint, e bigint", [(1, 900, 1100)])
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 100, 300, stereo(50, 198))])
    windows = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 0, 210, stereo(600, 210)), (1, 150, 400, stereo(300, 250))])
    got = whole(pcm.subtract_mix(blocks, words, clips, windows, ["episode_id"], rate=RATE, ramp_ms=20))
    want = np.full(400, float(source))
    edge = lambda f, a, b: max(0.0, min(1.0, (f - a + 1) / ramp, (b - f) / ramp))
    for f in range(100, 300):
        want[f] += 50 * edge(f, 100, 300)
    for f in range(180, 220):
        want[f] -= (600 if f < 210 else 300) * edge(f, 180, 220)
    assert (got == np.rint(want)).all()


def test_missing_dialogue_leaves_the_whole_episode(rows):
    blocks = blocks_of(rows, samples=1000)
    words = rows("episode_id bigint, s bigint, e bigint", [(1, 900, 1100)])
    windows = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 0, 205, stereo(600, 205))])
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 10, 60, stereo(50, 50))])
    out = pcm.subtract_mix(blocks, words, clips, windows, ["episode_id"], rate=RATE)
    assert listed(out, "block_no", "uncovered") == [(0, 1), (1, 1)]
    assert (whole(out) == 1000).all()


def test_overlapping_words_are_subtracted_once(rows):
    blocks = blocks_of(rows, samples=1000)
    windows = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(1, 0, 400, stereo(600, 400))])
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [])
    words = lambda *spans: rows("episode_id bigint, s bigint, e bigint", [(1, s, e) for s, e in spans])
    mixed = lambda w: whole(pcm.subtract_mix(blocks, w, clips, windows, ["episode_id"], rate=RATE)).tolist()
    assert mixed(words((200, 700), (500, 1100), (600, 650))) == mixed(words((200, 1100)))
    assert min(mixed(words((200, 700), (500, 1100)))) >= 400


def test_voice_and_dialogue_of_many_blocks_need_no_task_of_their_own(spark, rows):
    """Pieces of a block arrive in any order; no operator starts a Python group for each block."""
    clips = rows("episode_id bigint, left bigint, right bigint, samples array<smallint>", [(e, b * 2, b * 2 + 3, [1, 2, 3, 4, 5, 6]) for e in (None, 7) for b in range(9_000)])
    voice = pcm.clip_pieces(clips, ["episode_id"], rate=2)
    dialogue = pcm.dialogue_pieces(clips, ["episode_id"], rate=2)
    for df in (voice, dialogue):
        assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["episode_id"], r["block_no"]): r["samples"] for r in voice.collect()}
    assert len(got) == 2 * 9_001 and got[(None, 0)] == [1, 2, 3, 4] and got[(7, 5)] == [6, 8, 3, 4] and got[(7, 9_000)] == [5, 6, 0, 0]
    got = {(r["episode_id"], r["block_no"]): r["dialogue"] for r in dialogue.collect()}
    assert len(got) == 2 * 9_001 and got[(None, 0)] == [1, 2, 3, 4] and got[(7, 5)] == [5, 6, 3, 4] and got[(7, 9_000)] == [5, 6, 0, 0]


def test_passthrough(rows):
    blocks = rows("episode_id bigint", [(1,), (2,), (3,)])
    mix, copy = pcm.passthrough(blocks, rows("episode_id bigint", [(1,), (2,)]), rows("episode_id bigint", [(1,), (3,)]), ["episode_id"])
    assert listed(mix, "episode_id") == [(1,)] and listed(copy, "episode_id") == [(2,), (3,)]


MOVES = "episode_id bigint, event_id bigint, ts_ms bigint, state string"
CHUNKS = "upload_id bigint, seq bigint, offset bigint, length bigint, total_bytes bigint"
DAY = 86_400_000


def fed(spark, rows, folder, schema, batches, job, key, time):
    """One call for each batch of rows, the end marker last; what came out of each call."""
    out = []
    for data in [*batches, None]:
        piece = sj.end_marker(spark, schema, key, time) if data is None else rows(schema, data)
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = sj.resume(job(sj.file_stream(spark, f"{folder}/in", schema, "*.parquet")), f"{folder}/out", stateful=True)
        out.append(got.collect())
    return out


def test_monitor_takes_files_in_the_wrong_order(spark, rows, tmp_path):
    states = ["QUEUED", "PREPARING", "SEPARATING", "ASR", "FAILED", "QUEUED", "RETRYING"]
    parts = [[(e, part * 10 + i, DAY + part * 1000 + i // 2 * 7, states[(part * 3 + i * (e + 1)) % 7]) for e in range(4) for i in range(6)] for part in range(3)]
    out = fed(spark, rows, tmp_path, MOVES, [parts[2], parts[0], parts[1]], lambda s: so.monitored_moves(s, reorder_ms=DAY // 2), "episode_id", "ts_ms")
    got = [r for call in out for r in call]
    assert not any(out[:3])  # nothing is settled before the end
    batch = ct.judged_moves(rows(MOVES, sum(parts, [])), ["episode_id"], ["ts_ms", "event_id"]).where("from_state IS NOT NULL")
    cols = ("episode_id", "event_id", "from_state", "state", "legal")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == listed(batch, *cols) and not any(r["late"] for r in got)


def test_rows_come_out_at_the_watermark_and_late_ones_as_rejects(spark, rows, tmp_path):
    hour = DAY // 24
    batches = [
        [(1, 1, DAY, "QUEUED"), (1, 2, DAY + 1, "PREPARING"), (2, 3, DAY + 10 * hour, "QUEUED")],
        [(1, 4, DAY + 9 * hour, "FAILED"), (1, 5, DAY + 7 * hour + 1, "PREPARING"), (1, 6, DAY + 8 * hour + 5, "SEPARATING")],
        [(2, 8, DAY + 30 * hour, "FAILED")],
    ]
    out = fed(spark, rows, tmp_path, MOVES, batches, lambda s: so.monitored_moves(s, reorder_ms=2 * hour, grace_ms=hour), "episode_id", "ts_ms")
    seen = [[(r["event_id"], r["from_state"], r["late"]) for r in sorted(call, key=lambda r: r["event_id"])] for call in out]
    assert seen[0] == [(2, "QUEUED", False)]  # two hours behind the latest row all is settled
    assert (5, None, True) in seen[1]  # later than that, but within the grace
    assert seen[2] == [(4, "SEPARATING", False), (6, "PREPARING", False)]  # by time, not by arrival
    assert seen[3] == [(8, "QUEUED", False)]


def test_upload_resumes_at_the_committed_length(spark, rows, tmp_path):
    data = [(1, 1, 0, 4, 10), (1, 2, 5, 2, 10), (1, 3, 4, 7, 10), (1, 4, 4, 6, 10), (1, 5, 10, 1, 10)]
    out = fed(spark, rows, tmp_path, CHUNKS, [data[::-1]], lambda s: so.assembled_uploads(s, reorder_ms=DAY), "upload_id", "seq")
    assert sorted((r["seq"], r["reject"], r["committed_bytes"], r["complete"]) for r in out[1] if r["upload_id"] == 1) == [
        (1, None, 4, False), (2, "OFFSET_MISMATCH", 4, False), (3, "EXCEEDS_TOTAL", 4, False), (4, None, 10, True), (5, "ALREADY_COMPLETE", 10, True)]


def test_chunks_of_an_upload_over_triggers_in_the_wrong_order(spark, rows, tmp_path):
    parts = [[(u, part * 3 + i, (part * 3 + i) * 5 + (u == 2 and part == 2), 5, 60) for u in (1, 2, 3) for i in range(3)] for part in range(4)]
    out = fed(spark, rows, tmp_path, CHUNKS, [parts[3], parts[1], parts[0] + parts[2]], lambda s: so.assembled_uploads(s, reorder_ms=DAY), "upload_id", "seq")
    got = [r for call in out for r in call]
    assert len(got) == 36 and sorted(r["upload_id"] for r in got if r["complete"]) == [1, 3]
    assert {r["reject"] for r in got if r["upload_id"] == 2 and r["seq"] >= 6} == {"OFFSET_MISMATCH"}


def test_keyed_sessions_close_at_the_gap_and_at_the_end(spark, rows, tmp_path):
    schema = "episode_id bigint, at_ms bigint, pos bigint, length_ms bigint"
    words = [(1, DAY, 0, 100), (1, DAY + 499, 1, 101), (1, DAY + 1000, 2, 50), (2, DAY + 5, 3, 1), (1, DAY + 120, 4, 700)]
    out = fed(spark, rows, tmp_path, schema, [words[:4:3], words[1:3] + words[4:]], lambda s: so.word_sessions(s, gap_ms=400, reorder_ms=DAY // 2), "episode_id", "at_ms")
    assert not any(out[:2])
    assert sorted((r["episode_id"], r["first_ms"] - DAY, r["n_words"], r["late_ms"]) for r in out[2]) == [(1, 0, 4, None), (2, 5, 1, None)]


def test_a_tail_goes_on_where_it_stopped(spark, rows, tmp_path):
    """New files come once; a batch that was written but not committed comes again with the same number and replaces itself."""
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = lambda: sj.file_stream(spark, folder, "id bigint", "*.parquet", files_per_trigger=1)
    calls = []
    for ids in ([1, 2], [3], []):
        if ids:
            rows("id bigint", [(i,) for i in ids]).coalesce(1).write.mode("append").parquet(folder)
        calls.append(listed(sj.resume(stream(), target), "id"))
    assert calls == [[(1,), (2,)], [(3,)], []]
    for i in (4, 5, 6):
        rows("id bigint", [(i,)]).coalesce(1).write.mode("append").parquet(folder)

    def breaks(batch, number):
        batch.write.mode("overwrite").parquet(sj._version(target, number))
        if number == 3:
            raise RuntimeError("stopped behind the write")

    with pytest.raises(Exception, match="stopped behind the write"):
        stream().writeStream.option("checkpointLocation", f"{target}/log").trigger(availableNow=True).foreachBatch(breaks).start().awaitTermination()
    assert sj.versions(spark, target) == [0, 1, 2]
    assert listed(sj.read_versions(spark, target, stream().schema), "id") == [(i,) for i in (1, 2, 3, 4)]  # what is not committed is not seen
    assert listed(sj.resume(stream(), target), "id") == [(5,), (6,)]
    assert listed(sj.read_versions(spark, target, stream().schema), "id") == [(i,) for i in range(1, 7)]


def test_sessions_close_at_exactly_the_gap(spark, rows, tmp_path):
    rows("episode_id bigint, ms bigint, length_ms bigint", [(1, 0, 100), (1, 499, 101), (1, 1000, 50)]).selectExpr(
        "episode_id", "timestamp_millis(ms) AS at", "length_ms").coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = sj.file_stream(spark, str(tmp_path / "w"), "episode_id bigint, at timestamp, length_ms bigint", "*.parquet")
    assert listed(sj.run_once(sj.silence_sessions(stream, gap_ms=400), "test-sessions", mode="complete"), "n_words") == [(1,), (2,)]


def test_ranges_give_the_blocks_of_whole_files(spark, tmp_path):
    rnd = np.random.default_rng(1)
    made = {"mono": au.wav_bytes(rnd.integers(-9, 9, 1003), 100, 1), "stereo": au.wav_bytes(rnd.integers(-9, 9, 2 * 777), 50, 2), "short": au.wav_bytes(rnd.integers(-9, 9, 7), 100, 1), "none": au.wav_bytes(np.zeros(0), 100, 1)}
    made |= {"cut": made["mono"][:700], "head": made["mono"][:30], "empty": b"", "text": b"no sound at all", "bytes": made["mono"][:34] + b"\x08\0" + made["mono"][36:], "odd": made["stereo"][:-1]}
    long_chunk = b"LIST" + (5000).to_bytes(4, "little") + b"x" * 5000
    made["overrun"] = made["mono"][:36] + long_chunk + made["mono"][36:]
    made["chunks"] = made["mono"][:4] + (len(made["overrun"]) - 8).to_bytes(4, "little") + made["overrun"][8:]
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in made.items()], "name string, content binary")
    folder = f"file:{tmp_path}/wavs"
    assert au.write_wavs(files, folder) == len(made)
    plain = lambda df, key: sorted((r[key].rsplit("/", 1)[-1].removesuffix(".wav"), r["block_no"], r["rate"], r["channels"], r["frames"], r["samples"], r["error"]) for r in df.collect())
    want = plain(au.wav_blocks(files, "name"), "name")
    assert {e for *_, e in want} >= {None, "NO_SAMPLES", "UNREADABLE", "NOT_PCM16_MONO_OR_STEREO"}
    for range_bytes in (1, 64, 201, 1 << 20):
        empty = spark.createDataFrame([(f"{folder}/empty.wav", 0)], "path string, length bigint")  # Spark's listing passes over it
        few = au.wav_files(spark, folder).where("length > 0").unionByName(empty).where("length < 800" if range_bytes == 1 else "true")
        got = plain(au.wav_ranges(few, range_bytes=range_bytes), "path")
        assert got == (want if range_bytes > 1 else [w for w in want if len(made[w[0]]) < 800])


def test_tasks_follow_the_bytes_and_not_the_number_of_ranges(spark):
    files = spark.range(20_000).selectExpr("concat('file:/none/', id, '.wav') AS path", "200L AS length")
    assert au.wav_ranges(files, range_bytes=50).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * 4


def test_a_file_of_three_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    """A sparse file: nothing of it is ever in one cell."""
    head = au.wav_bytes(np.zeros(0), 48_000, 2)
    size = 3 << 30
    with open(tmp_path / "long.wav", "wb") as out:
        out.write(head[:4] + (size + 36).to_bytes(4, "little") + head[8:40] + size.to_bytes(4, "little"))
        out.truncate(44 + size)
    blocks = au.wav_ranges(au.wav_files(spark, str(tmp_path)), range_bytes=1 << 27).select("block_no", "frames", F.spark_partition_id().alias("task"))
    got = blocks.groupBy("task").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"), F.max("block_no").alias("last")).collect()
    assert len(got) > 8 and sum(r["frames"] for r in got) == size // 4
    assert sum(r["n"] for r in got) == max(r["last"] for r in got) + 1 == -(-(size // 4) // 48_000)
