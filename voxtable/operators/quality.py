"""Quality measures over speech, audio and on-screen text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.functions.edit_distance import with_edit_distance
from voxtable.operators.scan import prefix
from voxtable.session import few_words, spread, staged

BOUNDARY = T.StructType().add("matched_words", T.LongType()).add("compared_boundaries", T.LongType()).add(
    "median_abs_error_ms", T.DoubleType()).add("p95_abs_error_ms", T.DoubleType()).add("errors", T.ArrayType(T.LongType()))


def error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Add ``cer`` and its parts for lines (see ``transcript_error_rates`` for whole transcripts). Normalization runs once per side."""
    out = spread(pairs).withColumn("__r", tx.normalize_chinese(F.col(reference))).withColumn("__h", tx.normalize_chinese(F.col(hypothesis)))
    return (
        out.withColumn("ref_chars", F.char_length("__r").cast("long"))
        .withColumn("cer", tx.cer(F.col("__r"), F.col("__h")))
        .drop("__r", "__h")
    )


def transcript_error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``error_rates`` for whole transcripts of any length: the same columns and ``edits``, without a quadratic table."""
    out = spread(pairs).withColumn("__r", tx.normalize_chinese(F.col(reference))).withColumn("__h", tx.normalize_chinese(F.col(hypothesis)))
    out = with_edit_distance(out, "__r", "__h").withColumn("ref_chars", F.char_length("__r").cast("long"))
    return out.withColumn("cer", F.when(F.col("ref_chars") > 0, F.col("edits") / F.col("ref_chars"))).drop("__r", "__h")


def joined_text(chunks: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Chunk texts of a case, joined in order. One case's transcript is one value by definition."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def _boundary(ref: list, hyp: list) -> dict:
    matcher = difflib.SequenceMatcher(a=[tx.compare_form(w["t"]) for w in ref], b=[tx.compare_form(w["t"]) for w in hyp], autojunk=False)
    errors: list[int] = []
    for a, b, size in matcher.get_matching_blocks():
        for left, right in zip(ref[a:a + size], hyp[b:b + size]):
            if None not in (left["s"], left["e"], right["s"], right["e"]):
                errors += [abs(left["s"] - right["s"]), abs(left["e"] - right["e"])]
    found = np.array(errors, dtype="float64")
    return {
        "matched_words": len(errors) // 2,
        "compared_boundaries": len(errors),
        "median_abs_error_ms": float(np.median(found)) if errors else None,
        "p95_abs_error_ms": float(np.percentile(found, 95)) if errors else None,
        "errors": errors,
    }


def word_boundary_errors(cases: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Per case: matched words, compared boundaries, median and 95th percentile of the error of the words that match in order; sides are
    arrays of ``t, s, e``."""
    cases = cases.drop("boundary")
    schema = T.StructType(cases.schema.fields + [T.StructField("boundary", BOUNDARY)])
    kind = to_arrow_type(BOUNDARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_words(batches, reference):
            for part in few_words([batch], hypothesis):
                found = [_boundary(r.as_py(), h.as_py()) for r, h in zip(part.column(reference), part.column(hypothesis))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=schema.names)

    return spread(cases).mapInArrow(run, schema)


def block_levels(samples: str | Column, window: int, threshold: float) -> Column:
    """Peak, clipped samples and silent windows of one block of samples.

    A block starts on a window boundary, so windows never cross blocks.
    """
    col = F.col(samples) if isinstance(samples, str) else samples
    size = F.size(col)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(window))
    energy = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    part = lambda i: F.slice(col, i + 1, window)
    quiet = F.filter(starts, lambda i: F.sqrt(energy(part(i)) / F.size(part(i))) <= threshold)
    return F.struct(
        size.cast("long").alias("samples"),
        F.array_max(F.transform(col, lambda x: F.abs(x.cast("long")))).alias("peak"),
        F.size(F.filter(col, lambda x: F.abs(x.cast("long")) >= 32767)).cast("long").alias("clipped"),
        F.size(starts).cast("long").alias("windows"),
        F.size(quiet).cast("long").alias("silent"),
    )


def audio_quality(blocks: DataFrame, keys: Sequence[str], *, samples: str = "samples", channels: int = 2, rate: int = 48_000,
                  silence_dbfs: float = -50.0) -> DataFrame:
    """Duration, peak, clipping and share of silent 100 ms windows per file."""
    window = max(1, rate * channels // 10)
    level = blocks.where(F.size(samples) > 0).withColumn("__l", block_levels(samples, window, ft.rms_threshold(silence_dbfs)))
    total = level.groupBy(*keys).agg(
        F.sum("__l.samples").alias("samples"), F.max("__l.peak").alias("peak"), F.sum("__l.clipped").alias("clipped"),
        F.sum("__l.windows").alias("windows"), F.sum("__l.silent").alias("silent"),
    )
    return total.select(
        *keys, "samples", "peak", "clipped", "windows", "silent",
        F.bround(F.col("samples") / channels * 1000 / rate).cast("long").alias("duration_ms"),
        ft.dbfs(F.col("peak")).alias("peak_dbfs"),
        (F.col("clipped") / F.col("samples")).alias("clipped_sample_ratio"),
        (F.col("silent") / F.col("windows")).alias("silence_window_ratio"),
    )


def ocr_counts(frames: DataFrame, keys: Sequence[str], *, texts: str = "texts", checked: Column, untouched: Column) -> DataFrame:
    """Sampled frames, texts seen, texts left in the ``checked`` frames, and whether all pixels outside masks are equal."""
    found = F.size(texts).cast("long")
    return frames.groupBy(*keys).agg(
        F.count("*").alias("sampled_frames"), F.sum(found).alias("text_instances"),
        F.sum(F.when(checked, found).otherwise(0)).alias("residual_text"), F.bool_and(untouched).alias("all_unmasked_equal"))


def mix_quality(measured: DataFrame, source_ms: str = "source_ms") -> DataFrame:
    """Pass or fail of a finished mix: at most 20 ms of drift and 1e-5 of clipped samples."""
    return (
        measured.withColumn("duration_drift_ms", F.abs(F.col("duration_ms") - F.col(source_ms)))
        .withColumn("duration_pass", F.col("duration_drift_ms") <= 20)
        .withColumn("clipping_pass", F.col("clipped_sample_ratio") <= 0.00001)
        .withColumn("technical_quality_pass", F.col("duration_pass") & F.col("clipping_pass"))
    )


def subtitle_bands(lines: DataFrame, keys: Sequence[str], *, width: Column, height: Column) -> DataFrame:
    """Persistent centred lower-screen band per episode, from OCR line boxes.

    The centre is the upper median (element n/2 of the sorted centres, not interpolated), found by a
    blocked running count over the distinct boxes, so no episode is collected.
    """
    candidate = (F.col("box_top") >= height * 0.55) & (F.abs((F.col("box_left") + F.col("box_right")) / 2 - width / 2) <= width * 0.22)
    rows = lines.where(candidate).select(
        *keys, "box_top", "box_bottom", ((F.col("box_top") + F.col("box_bottom")) / 2).alias("centre"),
        width.alias("__w"), height.alias("__h"))
    bands = rows.groupBy(*keys, "box_top", "box_bottom", "centre", "__h").agg(F.count("*").alias("n"))
    bands = staged(bands)
    totals = bands.groupBy(*keys).agg(F.sum("n").alias("total")).where("total >= 3")
    seen = prefix(bands, keys, ["centre", "box_top"], {"seen": ("sum", F.col("n"))})
    middle = seen.join(totals, list(keys)).where(
        (F.col("seen") <= F.floor(F.col("total") / 2)) & (F.floor(F.col("total") / 2) < F.col("seen") + F.col("n"))
    ).select(*keys, F.col("centre").alias("__m"))
    near = bands.join(middle, list(keys)).where(F.abs(F.col("centre") - F.col("__m")) < F.col("__h") * 0.06)
    box = near.groupBy(*keys, "__h").agg(F.sum("n").alias("support_count"), F.min("box_top").alias("t"), F.max("box_bottom").alias("b"))
    top = F.greatest(F.lit(0), (F.col("t") - 12).cast("long"))
    bottom = F.least(F.col("__h").cast("long"), (F.col("b") + 12).cast("long"))
    return box.where("support_count >= 3").select(
        *keys, "support_count", (top / F.col("__h")).alias("y"), ((bottom - top) / F.col("__h")).alias("h")
    )
