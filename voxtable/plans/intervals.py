"""Interval, window and chunk queries (A1 scans feed all of them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.operators import intervals as iv
from voxtable.operators import scan
from voxtable.plans.registry import query
from voxtable.plans.views import view

EP = ["episode_id"]
DAY = 86_400_000

ISLANDS = """
 islands AS (SELECT *, sum(opens) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id) AS isl FROM (
   SELECT *, CASE WHEN reach IS NULL OR {cond} THEN 1 ELSE 0 END AS opens FROM (
     SELECT *, max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM src)))
"""


@query("coalesce_padded_spans", """
WITH src AS (SELECT episode_id, turn_id, greatest(0, start_ms-600000) AS start_ms, least(duration_ms, end_ms+600000) AS end_ms FROM turn),
""" + ISLANDS.format(cond="start_ms - reach > 1200000") + """
SELECT episode_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM islands GROUP BY episode_id, isl""")
def coalesce_padded_spans(spark, sf):
    spans = view(spark, sf, "turn")
    return iv.padded_windows(spans, EP, padding_ms=600_000, gap_ms=1_200_000)


@query("span_bounds_errors", """
SELECT episode_id, turn_id, start_ms, end_ms FROM turn WHERE NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= duration_ms)""")
def span_bounds_errors(spark, sf):
    return iv.span_errors(view(spark, sf, "turn")).select("episode_id", "turn_id", "start_ms", "end_ms")


@query("speech_window_union", """
WITH src AS (SELECT episode_id, turn_id, speaker_id, greatest(0, start_ms) AS start_ms, least(duration_ms, end_ms) AS end_ms FROM turn
   WHERE greatest(0, start_ms) < least(duration_ms, end_ms)),
""" + ISLANDS.format(cond="start_ms >= reach") + """,
 grp AS (SELECT episode_id, min(start_ms) AS s, max(end_ms) AS e, list_sort(list(DISTINCT speaker_id)) AS spk FROM islands GROUP BY episode_id, isl)
SELECT episode_id, st AS start_ms, least(e, st+3600000) AS end_ms, array_to_string(spk, ',') AS speaker_ids
FROM (SELECT *, unnest(range(s, e, 3600000)) AS st FROM grp)""")
def speech_window_union(spark, sf):
    out = iv.speech_windows(view(spark, sf, "turn"), EP, chunk_ms=3_600_000)
    return out.select("episode_id", "start_ms", "end_ms", F.array_join("speaker_ids", ",").alias("speaker_ids"))


@query("overlapping_chunks", """
WITH RECURSIVE c AS (
  SELECT episode_id, duration_ms, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start_ms, least(duration_ms, 240000) AS end_ms FROM media
  UNION ALL
  SELECT episode_id, duration_ms, chunk_no+1, end_ms-1000, least(duration_ms, end_ms-1000+240000) FROM c WHERE end_ms < duration_ms)
SELECT episode_id, chunk_no, start_ms, end_ms FROM c""")
def overlapping_chunks(spark, sf):
    whole = view(spark, sf, "media").withColumn("start_ms", F.lit(0).cast("long")).withColumn("end_ms", F.col("duration_ms"))
    return iv.split_overlapping(whole, 240_000, 1_000, index="chunk_no").select("episode_id", "chunk_no", "start_ms", "end_ms")


@query("separation_windows", """
WITH RECURSIVE used AS (SELECT * FROM turn),
 eps AS (SELECT DISTINCT episode_id, duration_ms FROM turn UNION ALL SELECT DISTINCT episode_id, duration_ms FROM media WHERE episode_id NOT IN (SELECT episode_id FROM turn)),
 src AS (SELECT episode_id, turn_id, greatest(0, start_ms-600) AS start_ms, least(duration_ms, end_ms+600) AS end_ms FROM used),
""" + ISLANDS.format(cond="start_ms - reach > 1200") + """,
 merged AS (SELECT episode_id, min(start_ms) AS s, max(end_ms) AS e FROM islands GROUP BY episode_id, isl
   UNION ALL SELECT episode_id, 0, least(duration_ms, 1800000) FROM eps WHERE episode_id NOT IN (SELECT episode_id FROM used)),
 pieces AS (SELECT episode_id, s AS cs, least(e, s+7200000) AS ce, e FROM merged
   UNION ALL SELECT episode_id, ce-240000, least(e, ce-240000+7200000), e FROM pieces WHERE ce < e),
 p1 AS (SELECT episode_id, cs, ce, CASE WHEN ce-cs < 1800000 THEN greatest(0, cs-(1800000-(ce-cs))//2) END AS f, duration_ms FROM pieces JOIN eps USING (episode_id)),
 p2 AS (SELECT DISTINCT episode_id, CASE WHEN f IS NULL THEN cs ELSE greatest(0, least(duration_ms, f+1800000)-1800000) END AS start_ms,
          CASE WHEN f IS NULL THEN ce ELSE least(duration_ms, f+1800000) END AS end_ms FROM p1)
SELECT * FROM p2 a WHERE NOT EXISTS (SELECT 1 FROM p2 b WHERE b.episode_id=a.episode_id AND b.start_ms<=a.start_ms AND a.end_ms<=b.end_ms
   AND (b.start_ms<>a.start_ms OR b.end_ms<>a.end_ms))""")
def separation_windows(spark, sf):
    turns = view(spark, sf, "turn")
    spoken = turns.groupBy("episode_id").agg(F.max("duration_ms").alias("duration_ms"))
    silent = view(spark, sf, "media").select("episode_id", "duration_ms").distinct().join(spoken, EP, "left_anti")
    episodes = spoken.unionByName(silent)
    spans = turns.select("episode_id", "start_ms", "end_ms")
    return iv.separation_windows(spans, episodes, EP, min_ms=1_800_000, max_ms=7_200_000, overlap_ms=240_000)


@query("silence_sessions", """
WITH w AS (SELECT *, sum(opens) OVER (PARTITION BY episode_id ORDER BY s, pos) AS g FROM (
   SELECT *, CASE WHEN pe IS NULL OR s - pe >= 7200000 THEN 1 ELSE 0 END AS opens FROM (
     SELECT *, lag(e) OVER (PARTITION BY episode_id ORDER BY s, pos) AS pe FROM live_word)))
SELECT episode_id, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n_words FROM w GROUP BY episode_id, g""")
def silence_sessions(spark, sf):
    return iv.silence_groups(view(spark, sf, "live_word"), EP, ["s", "pos"], gap_ms=7_200_000)


@query("speaker_overlap_pairs", """
SELECT a.episode_id, a.turn_id AS l_id, b.turn_id AS r_id, a.speaker_id AS l_speaker, b.speaker_id AS r_speaker,
  greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms
FROM turn a JOIN turn b ON a.episode_id=b.episode_id AND a.turn_id < b.turn_id AND a.speaker_id <> b.speaker_id
  AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms""")
def speaker_overlap_pairs(spark, sf):
    return iv.speaker_overlaps(view(spark, sf, "turn"), EP, leaf_ms=900_000)


@query("protected_collisions", """
SELECT episode_id, turn_id, start_ms, end_ms, EXISTS (SELECT 1 FROM turn p WHERE p.episode_id=v.episode_id AND p.speaker_id='error'
   AND p.start_ms < v.end_ms AND p.end_ms > v.start_ms) AS collides
FROM turn v WHERE speaker_id IN ('click','view','signup')""")
def protected_collisions(spark, sf):
    turns = view(spark, sf, "turn")
    voiced = turns.where(F.col("speaker_id").isin("click", "view", "signup")).select("episode_id", "turn_id", "start_ms", "end_ms")
    protected = turns.where("speaker_id = 'error'").select("episode_id", "start_ms", "end_ms")
    return iv.colliding(voiced, protected, EP, start="start_ms", stop="end_ms", probe_ids=["turn_id"])


@query("uncovered_words", """
WITH src AS (SELECT episode_id, turn_id, start_ms, start_ms + (end_ms - start_ms)//60 + 1 AS end_ms FROM turn),
""" + ISLANDS.format(cond="start_ms > reach") + """,
 m AS (SELECT episode_id, min(start_ms) AS ms, max(end_ms) AS me FROM islands GROUP BY episode_id, isl)
SELECT episode_id, pos, s, e FROM live_word w
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id=w.episode_id AND ms <= s AND e <= me)""")
def uncovered_words(spark, sf):
    windows = view(spark, sf, "turn").selectExpr("episode_id", "start_ms", "start_ms + (end_ms - start_ms) DIV 60 + 1 AS end_ms")
    return iv.uncovered_words(view(spark, sf, "live_word"), windows, EP)


@query("chunk_word_ownership", """
WITH RECURSIVE ch AS (
  SELECT episode_id, duration_ms, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start_ms, least(duration_ms, 240000) AS end_ms FROM media
  UNION ALL
  SELECT episode_id, duration_ms, chunk_no+1, end_ms-1000, least(duration_ms, end_ms-1000+240000) FROM ch WHERE end_ms < duration_ms),
 b AS (SELECT episode_id, chunk_no, start_ms, end_ms,
   CASE WHEN lag(end_ms) OVER w > start_ms THEN (start_ms + lag(end_ms) OVER w)//2 ELSE start_ms END AS lo_ms,
   CASE WHEN lead(start_ms) OVER w < end_ms THEN (lead(start_ms) OVER w + end_ms)//2 ELSE end_ms END AS hi_ms
   FROM ch WINDOW w AS (PARTITION BY episode_id ORDER BY chunk_no)),
 words AS (SELECT episode_id, chunk_no, start_ms + i*6000 AS s, start_ms + i*6000 + 400 AS e, lo_ms, hi_ms
   FROM (SELECT *, unnest(range(0, CAST(ceil((end_ms-start_ms)/6000) AS BIGINT))) AS i FROM b))
SELECT episode_id, chunk_no, count(*) AS owned, min(s) AS first_ms, max(e) AS last_ms FROM words WHERE s >= lo_ms AND s < hi_ms GROUP BY ALL""")
def chunk_word_ownership(spark, sf):
    whole = view(spark, sf, "media").withColumn("start_ms", F.lit(0).cast("long")).withColumn("end_ms", F.col("duration_ms"))
    chunks = iv.split_overlapping(whole, 240_000, 1_000, index="chunk_no").select("episode_id", "chunk_no", "start_ms", "end_ms")
    # Documents give one second per character, so this is about one word per six characters.
    count = F.ceil((F.col("end_ms") - F.col("start_ms")) / 6000).cast("long")
    words = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct(
        (F.col("start_ms") + i * 6000).alias("s"), (F.col("start_ms") + i * 6000 + 400).alias("e")))
    owned = iv.owned_in_row(iv.chunk_bounds(chunks, EP).withColumn("words", words))
    return owned.where(F.size("words") > 0).select(
        "episode_id", "chunk_no", F.size("words").cast("long").alias("owned"),
        F.array_min(F.transform("words", lambda w: w["s"])).alias("first_ms"), F.array_max(F.transform("words", lambda w: w["e"])).alias("last_ms"))


@query("adjacent_overlap_check", """
SELECT episode_id, turn_id, start_ms, prev_end_ms FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id) AS prev_end_ms FROM turn) WHERE prev_end_ms > start_ms""")
def adjacent_overlap_check(spark, sf):
    out = iv.adjacent_overlaps(view(spark, sf, "turn"), EP, ["start_ms", "end_ms", "turn_id"])
    return out.select("episode_id", "turn_id", "start_ms", "prev_end_ms")


@query("sample_grid", """
SELECT episode_id, count(*) AS samples, min(at_ms) AS first_ms, max(at_ms) AS last_ms, CAST(sum(at_ms) AS BIGINT) AS total_ms FROM (
  SELECT episode_id, 500 + (i*1000)//fps AS at_ms, duration_ms FROM (SELECT *, unnest(range(0, duration_ms*fps//1000+2)) AS i FROM media))
WHERE at_ms < 500 + duration_ms GROUP BY episode_id""")
def sample_grid(spark, sf):
    media = view(spark, sf, "media").selectExpr("episode_id", "fps", "500L AS start_ms", "500 + duration_ms AS end_ms")
    return iv.sample_grid(media, totals=EP)


@query("ocr_step_grid", """
SELECT series_id, count(*) AS frames, max(at_ms) AS last_ms FROM (
  SELECT series_id, unnest(range(0, duration_ms, 5000)) AS at_ms FROM media) GROUP BY series_id""")
def ocr_step_grid(spark, sf):
    return iv.step_grid(view(spark, sf, "media"), step_ms=5000).groupBy("series_id").agg(
        F.count("*").alias("frames"), F.max("at_ms").alias("last_ms")
    )


@query("halo_chunks", """
SELECT episode_id, start_ms, end_ms, greatest(0, start_ms-8000) AS left_ms, least(duration_ms, end_ms+8000) AS right_ms,
  greatest(0, 8000-(least(duration_ms, end_ms+8000)-greatest(0, start_ms-8000))) AS pad_ms
FROM (SELECT *, least(duration_ms, start_ms+60000) AS end_ms FROM (SELECT episode_id, duration_ms, unnest(range(0, duration_ms, 60000)) AS start_ms FROM media))""")
def halo_chunks(spark, sf):
    return iv.halo_chunks(view(spark, sf, "media")).select("episode_id", "start_ms", "end_ms", "left_ms", "right_ms", "pad_ms")


@query("history_frame_chunks", """
SELECT episode_id, first_frame, least(n, first_frame+40) AS end_frame, greatest(0, first_frame-8) AS history_from
FROM (SELECT episode_id, duration_ms//1000 AS n, unnest(range(0, duration_ms//1000, 40)) AS first_frame FROM media)""")
def history_frame_chunks(spark, sf):
    frames = view(spark, sf, "media").selectExpr("episode_id", "duration_ms DIV 1000 AS frame_count")
    return iv.history_chunks(frames).select("episode_id", "first_frame", "end_frame", "history_from")


@query("windows_padded_to_minimum", """
WITH c AS (SELECT episode_id, duration_ms, start_ms, least(duration_ms, start_ms+20000) AS end_ms FROM (
   SELECT episode_id, duration_ms, unnest(range(0, duration_ms, 45000)) AS start_ms FROM media)),
 p AS (SELECT *, CASE WHEN end_ms-start_ms < 30000 THEN greatest(0, start_ms-(30000-(end_ms-start_ms))//2) END AS f FROM c)
SELECT episode_id, CASE WHEN f IS NULL THEN start_ms ELSE greatest(0, least(duration_ms, f+30000)-30000) END AS start_ms,
  CASE WHEN f IS NULL THEN end_ms ELSE least(duration_ms, f+30000) END AS end_ms FROM p""")
def windows_padded_to_minimum(spark, sf):
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(45_000).cast("long")))
    cut = view(spark, sf, "media").withColumn("start_ms", starts).withColumn(
        "end_ms", F.least(F.col("duration_ms"), F.col("start_ms") + 20_000)
    )
    return iv.pad_to_minimum(cut).select("episode_id", "start_ms", "end_ms")
