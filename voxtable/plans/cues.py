"""The flagship job: from timed lines and voice clips to numbered subtitle cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.operators import subtitles as st
from voxtable.operators.scan import islands
from voxtable.plans.dialogue import EP
from voxtable.plans.registry import query
from voxtable.plans.views import view


def dubbed_cues(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues of every line with a clip, with its fitting decision and the speech window it lies in.

    A line's window is the run of padded lines that it belongs to, so one scan names it; a second one numbers the cues.
    """
    duration = segments.groupBy(*EP).agg(F.max("end_ms").alias("duration_ms"))
    target = F.col("end_ms") - F.col("start_ms")
    timed = segments.join(duration, EP).join(clips, [*EP, "ord"], "left").select(
        *EP, "ord", "start_ms", "end_ms", "duration_ms", "subtitle_vi", "dub_vi", F.col("actual_ms").isNotNull().alias("voiced"),
        ft.fitting_action(F.col("actual_ms"), target, F.col("attempts")).alias("fit"),
        F.greatest(F.lit(0), F.col("start_ms") - 600).alias("from_ms"), F.least(F.col("duration_ms"), F.col("end_ms") + 600).alias("to_ms"))
    placed = islands(timed, EP, ["from_ms", "ord"], start="from_ms", end="to_ms", gap=1200, inclusive=True, furthest=True, name="run")
    placed = placed.where("voiced").withColumn("window_ms", F.col("run.from_ms"))
    cues, _ = st.strict_cues(placed.drop("voiced", "run", "from_ms", "to_ms"), EP, carry=["window_ms", "fit"])
    return cues.select(*EP, "cue_no", "window_ms", "fit", "block")


@query("dubbed_cues", r"""
WITH src AS (SELECT episode_id, ord AS turn_id, greatest(0, start_ms-600) AS start_ms, least(max(end_ms) OVER (PARTITION BY episode_id), end_ms+600) AS end_ms FROM segment),
 isl AS (SELECT *, sum(opens) OVER (PARTITION BY episode_id ORDER BY start_ms, turn_id) AS g FROM (SELECT *, CASE WHEN reach IS NULL OR start_ms - reach > 1200 THEN 1 ELSE 0 END AS opens FROM (
   SELECT *, max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM src))),
 win AS (SELECT episode_id, turn_id AS ord, min(start_ms) OVER (PARTITION BY episode_id, g) AS window_ms FROM isl),
 f AS (SELECT s.*, c.actual_ms, attempts, abs(actual_ms-(end_ms-start_ms))/CAST(end_ms-start_ms AS DOUBLE) AS d FROM segment s JOIN clip c USING (episode_id, ord)),
 l AS (SELECT episode_id, ord, string_agg(replace(replace(replace(replace(replace(trim(x), '{', '｛'), '}', '｝'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) ORDER BY i) AS text
   FROM (SELECT episode_id, ord, unnest(string_split(zh_text, chr(10))) AS x, generate_subscripts(string_split(zh_text, chr(10)), 1) AS i FROM segment) WHERE trim(x) <> '' GROUP BY episode_id, ord),
 n AS (SELECT f.episode_id, f.ord, window_ms, start_ms, end_ms, text, CASE WHEN d <= 0.08 THEN 'STRETCH' WHEN attempts >= 3 THEN 'NEEDS_REVIEW' WHEN d <= 0.20 THEN 'SPEED' ELSE 'REWRITE' END AS fit,
   row_number() OVER (PARTITION BY f.episode_id ORDER BY start_ms, end_ms, text) AS cue_no FROM f JOIN l USING (episode_id, ord) JOIN win USING (episode_id, ord))
SELECT episode_id, cue_no, window_ms, fit, CAST(cue_no AS VARCHAR) || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms//3600000, start_ms//60000%60, start_ms//1000%60, start_ms%1000) || ' --> ' ||
  printf('%02d:%02d:%02d,%03d', end_ms//3600000, end_ms//60000%60, end_ms//1000%60, end_ms%1000) || chr(10) || text AS block FROM n""")
def dubbed_cues_query(spark, sf):
    segments = view(spark, sf, "segment").withColumn("subtitle_vi", F.col("zh_text")).withColumn("dub_vi", F.lit(""))
    return dubbed_cues(segments, view(spark, sf, "clip"))
