"""Processing states and the legal moves between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The states of the main line, in order.
MAIN_LINE = (
    "QUEUED", "UPLOADING", "PREPARING", "SEPARATING", "ASR", "ALIGNING", "TRANSLATING", "TTS", "TIMING",
    "AUDIO_MIX", "QC", "PREVIEW_READY", "AWAITING_ROI", "OCR_VERIFY", "TEXT_REMOVAL", "SUBTITLE_RENDER",
    "ENCODING", "COMPLETED",
)
# States beside the main line.
SIDE_STATES = ("V1_RUNNING", "NEEDS_REVIEW", "RETRYING", "PAUSED", "CHECKPOINTED", "FAILED", "SKIPPED")
# Moves beyond "next on the main line".
EXTRA_MOVES = {
    "QUEUED": ("PREPARING",),
    "UPLOADING": ("QUEUED",),
    "PREPARING": ("V1_RUNNING",),
    "TRANSLATING": ("AUDIO_MIX",),
    "QC": ("ENCODING", "TEXT_REMOVAL", "SUBTITLE_RENDER"),
    "TEXT_REMOVAL": ("ENCODING",),
    "V1_RUNNING": ("ENCODING", "COMPLETED"),
    "CHECKPOINTED": ("QUEUED", "ASR", "ALIGNING", "TRANSLATING", "SEPARATING", "TTS", "TIMING", "AUDIO_MIX",
                     "QC", "ENCODING", "V1_RUNNING"),
    "FAILED": ("RETRYING",),
    "NEEDS_REVIEW": ("RETRYING", "COMPLETED"),
    "RETRYING": ("QUEUED",),
    "PAUSED": ("QUEUED",),
}
# Moves open to every state except the closed ones.
ALWAYS_OPEN = ("FAILED", "CHECKPOINTED", "PAUSED", "NEEDS_REVIEW")
CLOSED = ("COMPLETED", "SKIPPED", "UPLOADING")
# States in which a worker holds the episode.
ACTIVE = ("V1_RUNNING", "PREPARING", "ASR", "ALIGNING", "TRANSLATING", "SEPARATING", "TTS", "TIMING",
          "AUDIO_MIX", "QC", "OCR_VERIFY", "TEXT_REMOVAL", "SUBTITLE_RENDER", "ENCODING")
# Active states a restart has to recover (the worker's list adds two waiting states).
RECOVERABLE = (*ACTIVE, "PREVIEW_READY", "AWAITING_ROI")
# Checkpoint stages in order.
STAGE_ORDER = ("PREPARING", "SEPARATING", "ASR", "ALIGNING", "TRANSLATING", "TTS", "TIMING", "AUDIO_MIX",
               "QC", "VISION_RENDER", "ENCODING")


def legal_moves() -> list[tuple[str, str]]:
    moves = set(zip(MAIN_LINE, MAIN_LINE[1:]))
    moves |= {(old, new) for old, targets in EXTRA_MOVES.items() for new in targets}
    moves |= {(old, new) for old in (*MAIN_LINE, *SIDE_STATES) if old not in CLOSED for new in ALWAYS_OPEN}
    return sorted(moves)


def moves_table(spark: SparkSession) -> DataFrame:
    """The fixed set of legal (old, new) pairs; its size does not depend on data."""
    return spark.createDataFrame(legal_moves(), "old string, new string")


def moves_sql() -> str:
    return "(VALUES " + ", ".join(f"('{a}','{b}')" for a, b in legal_moves()) + ") AS moves(old, new)"
