"""Clips, slots and subtitle cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators.intervals import colliding
from voxtable.operators.scan import BLOCK_ROWS, row_index

MAX_CUE_CHARS = 2048


def unresolved(lines: DataFrame) -> DataFrame:
    """Lines that hold an episode back: flagged, or to be dubbed without source or target text."""
    blank = (tx.strip(F.col("zh_text")) == "") | (tx.strip(F.col("dub_vi")) == "")
    return lines.where(F.col("needs_review") | (F.col("action") == "NEEDS_REVIEW") | ((F.col("action") == "DUB") & blank))


def clip_coverage(dubs: DataFrame, clips: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Per key: lines to dub, how many have no clip, and the first of them; ``missing_clips`` gives them all, as rows."""
    joined = dubs.join(clips.select(*keys, ident, F.lit(True).alias("__have")), [*keys, ident], "left")
    gone = F.col("__have").isNull()
    return joined.groupBy(*keys).agg(
        F.count("*").alias("dub_lines"), F.count_if(gone).alias("missing_clips"), F.min(F.when(gone, F.col(ident))).alias("first_missing"))


def missing_clips(dubs: DataFrame, clips: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """The lines to dub that have no clip."""
    return dubs.join(clips.select(*keys, ident), [*keys, ident], "left_anti")


def fitted_slots(
    voiced: DataFrame, protected: DataFrame, keys: Sequence[str], *, ident: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fit each clip between its first word and its line end; name the reason to keep the original.

    ``voiced``: keys, ident, ``end_ms, actual_ms, first_ms``. The voice may be sped up by at most 1.2,
    may overrun by 10 ms, and may not touch a protected event. ``right_ms`` keeps fractions: the clip ends inside a millisecond.
    """
    slot = F.col("end_ms") - F.col("first_ms")
    fitted = voiced.withColumn("factor", ft.slot_factor(F.col("actual_ms"), slot)).withColumn(
        "right_ms", F.col("first_ms") + F.col("actual_ms") / F.col("factor"))
    judged = colliding(fitted, protected, keys, start="first_ms", stop="right_ms", probe_ids=[ident], block_rows=block_rows)
    issue = (
        F.when(F.col("factor") > 1.2, "VOICE_EXCEEDS_FROZEN_DURATION_POLICY")
        .when(F.col("right_ms") > F.col("end_ms") + 10, "FIT_OVERFLOW_KEEP_ORIGINAL")
        .when(F.col("collides"), "PROTECTED_EVENT_COLLISION_KEEP_ORIGINAL")
    )
    return judged.withColumn("issue", issue).drop("collides")


def cue_errors(lines: DataFrame) -> Column:
    """Reason a line cannot become a cue, null when it can."""
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms"))
    return F.when(bad, "INVALID_CUE_BOUNDS").when(
        F.char_length(tx.strip(F.coalesce(F.nullif(F.col("subtitle_vi"), F.lit("")), F.col("dub_vi")))) > MAX_CUE_CHARS,
        "CUE_TEXT_TOO_LONG")


def strict_cues(lines: DataFrame, keys: Sequence[str], duration: str = "duration_ms", *, carry: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Numbered, escaped cues ordered by (start, end, text), and the rows that fail the checks.

    ``carry`` names columns of the lines to keep on the cues.
    """
    judged = lines.withColumn("error", cue_errors(lines))
    wording = F.coalesce(F.nullif(F.col("subtitle_vi"), F.lit("")), F.col("dub_vi"))
    cues = judged.where("error IS NULL").select(
        *keys, *carry,
        F.least("start_ms", duration).cast("long").alias("start_ms"),
        F.least("end_ms", duration).cast("long").alias("end_ms"),
        tx.cue_text(wording).alias("text"),
    ).where("end_ms > start_ms AND char_length(text) > 0")
    return _numbered(cues, keys, ["start_ms", "end_ms", "text"], block_rows, carry), judged.where("error IS NOT NULL")


def plain_cues(lines: DataFrame, keys: Sequence[str], order: Sequence[str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cues in input order: line breaks become blanks, nothing is escaped, empty lines are skipped."""
    text = F.translate(tx.strip(F.coalesce(F.col("subtitle_vi"), F.lit(""))), "\r\n", "  ")
    cues = lines.withColumn("text", text).where("char_length(text) > 0")
    return _numbered(cues, keys, order, block_rows)


def _numbered(cues: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int, carry: Sequence[str] = ()) -> DataFrame:
    placed = row_index(cues, keys, order, "__i", block_rows=block_rows)
    head = F.concat_ws(" --> ", tx.timestamp(F.col("start_ms")), tx.timestamp(F.col("end_ms")))
    number = (F.col("__i") + 1).alias("cue_no")
    block = F.concat_ws("\n", (F.col("__i") + 1).cast("string"), head, F.col("text")).alias("block")
    return placed.select(*keys, *carry, number, "start_ms", "end_ms", "text", block)


def write_srt(cues: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write cue blocks as text, one directory per key, without joining a file in memory.

    Rows are spread by range over (keys, cue number), so part files follow the cue order even when
    one episode holds most of the rows.
    """
    lines = cues.repartitionByRange(*keys, "cue_no").sortWithinPartitions(*keys, "cue_no")
    lines.select(*keys, F.concat(F.col("block"), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
