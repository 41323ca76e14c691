"""Validation as data: each rule is a column, the result is the full table of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators.scan import BLOCK_ROWS, previous
from voxtable.session import staged

# Kinds of benchmark material, and the time a representative corpus has to cover.
CATEGORIES = ("speech_clear", "music_loud", "nonverbal", "overlap", "subtitle_static", "subtitle_motion", "dark")
REQUIRED_MS = 600_000
# Accepted video extensions.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".mov", ".webm", ".avi", ".m4v")
# Numeric stage measurements that may be reported.
STAGE_METRICS = (
    "model_load_ms", "cold_load_ms", "load_ms", "inference_ms", "processed_media_ms", "device_allocator_peak_bytes",
    "device_allocator_peak_mb", "peak_allocated_bytes", "peak_reserved_bytes", "cuda_peak_allocated_bytes",
    "cuda_peak_reserved_bytes", "gpu_allocator_peak_bytes", "gpu_reserved_peak_bytes",
)
# Configuration keys that are never passed on.
SECRET_KEY = r"(?i)secret|token|password|credential|api[_-]?key|authorization"
ENV_KEYS = ("env", "env_vars", "environment", "environment_variables")
# Benchmark stages.
STAGES = ("probe", "asr", "align", "tts", "bandit", "ocr", "inpaint")


def violations(df: DataFrame, ids: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row ``ids, code`` per broken rule. A rule is true when the row is wrong; null counts as wrong."""
    codes = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()])
    return df.select(*ids, F.explode(F.array_compact(codes)).alias("code"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of issue streams by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def words_ordered(words: str | Column) -> Column:
    """Every word starts at or after the end of the word before it."""
    w = F.col(words) if isinstance(words, str) else words
    ends = F.transform(w, lambda x: x["e"])
    starts = F.transform(w, lambda x: x["s"])
    pairs = F.arrays_zip(F.slice(starts, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("s"), F.slice(ends, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("e"))
    return F.forall(pairs, lambda p: p["s"] >= p["e"])


def segment_contract(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    inside = F.forall("words", lambda w: (F.col("start_ms") <= w["s"]) & (w["s"] < w["e"]) & (w["e"] <= F.col("end_ms")))
    unit = F.forall(F.map_values("confidence"), lambda v: v.isNull() | v.between(0, 1))
    return violations(df, ids, {
        "EMPTY_SEGMENT": F.col("end_ms") <= F.col("start_ms"),
        "WORD_OUTSIDE_SEGMENT": ~inside,
        "CONFIDENCE_OUT_OF_RANGE": ~unit,
    })


def roi_contract(df: DataFrame, ids: Sequence[str], roi: str = "roi") -> DataFrame:
    """Stored regions (1e-6 of slack) and exact crops are judged apart."""
    part = [F.col(roi)[k] for k in ("x", "y", "w", "h")]
    return violations(df.where(F.col(roi).isNotNull()), ids, {
        "ROI_CONTRACT": ~ft.roi_in_frame(*part, slack=0.000001), "ROI_CROP": ~ft.roi_in_frame(*part)})


def series_rules(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return violations(df, ids, {
        "TITLE_LENGTH": ~F.char_length("title").between(1, 160) | (tx.strip(F.col("title")) == ""),
        "PRIORITY_RANGE": ~F.col("priority").between(0, 10_000)})


def episode_rules(df: DataFrame, ids: Sequence[str], *, max_bytes: int) -> DataFrame:
    """Upload admission: ordinal, plain file name, known extension, size limit."""
    name = F.col("filename")
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return violations(df, ids, {
        "ORDINAL_RANGE": ~F.col("ordinal").between(1, 100_000),
        "FILENAME_LENGTH": ~F.char_length(name).between(1, 200),
        "FILENAME_NOT_BASENAME": name.rlike(r"[/\\:\x00-\x1f]"),
        "UNSUPPORTED_EXTENSION": ~extension.isin(*VIDEO_EXTENSIONS),
        "FILE_TOO_LARGE": (F.col("total_bytes") <= 0) | (F.col("total_bytes") > max_bytes)})


def glossary_rules(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return violations(df, ids, {
        "TERM_LENGTH": ~F.char_length("zh").between(1, 200), "TARGET_LENGTH": ~F.char_length("vi").between(1, 300),
        "BLANK_TERM": (tx.strip(F.col("zh")) == "") | (tx.strip(F.col("vi")) == "")})


def duplicates(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Keys that occur more than once. Counts combine before the shuffle, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit(code).alias("code"))


def translation_input_rules(lines: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Lines that cannot be sent to translation: blank source text or an id used twice."""
    ids = [*keys, ident]
    blank = violations(lines, ids, {"BLANK_SOURCE_TEXT": tx.strip(F.col("zh_text")) == ""})
    return blank.unionByName(duplicates(lines, ids, "DUPLICATE_ID"))


def contained_path(path: Column) -> Column:
    """Relative path that stays below its root and is not the root itself."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda a, s: F.struct(
            F.when(s == "..", a["d"] - 1).otherwise(a["d"] + 1).alias("d"),
            (a["out"] | ((s == "..") & (a["d"] <= 0))).alias("out")),
        lambda a: ~a["out"] & (a["d"] > 0))
    return F.coalesce(~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:|\\") & depth, F.lit(False))


def corpus_rules(cases: DataFrame, inventory: DataFrame, ids: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """All problems of corpus cases. ``inventory``: ``source, sha256, duration_ms`` of the files found."""
    found = inventory.select("source", F.col("sha256").alias("__sha"), F.col("duration_ms").alias("__dur"), F.lit(True).alias("__found"))
    out = cases.join(found, "source", "left")
    bounds_ok = F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")), F.lit(False))
    path_ok = contained_path(F.col("source"))
    usable = bounds_ok & path_ok & F.col("__found").isNotNull()
    in_time = usable & (F.col("end_ms") <= F.col("__dur"))
    w = F.col("words")
    ranged = F.forall(w, lambda x: (F.col("start_ms") <= x["s"]) & (x["s"] < x["e"]) & (x["e"] <= F.col("end_ms")))
    starts = F.transform(w, lambda x: x["s"])
    roi = F.col("roi")
    hexed = F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$")
    rules = {
        "BLANK_ID": tx.strip(F.coalesce(F.col(ident[-1]).cast("string"), F.lit(""))) == "",
        "UNKNOWN_CATEGORY": ~F.col("category").isin(*CATEGORIES),
        "INVALID_BOUNDS": ~bounds_ok,
        "SOURCE_OUTSIDE_FOLDER": bounds_ok & ~path_ok,
        "SOURCE_NOT_FOUND": bounds_ok & path_ok & F.col("__found").isNull(),
        "MALFORMED_HASH": usable & F.col("source_sha256").isNotNull() & ~hexed,
        "HASH_MISMATCH": usable & F.coalesce(hexed & (F.lower("source_sha256") != F.lower("__sha")), F.lit(False)),
        "END_AFTER_SOURCE": usable & (F.col("end_ms") > F.col("__dur")),
        "WORDS_OUT_OF_RANGE": in_time & F.coalesce(~ranged | (F.array_sort(starts) != starts), F.lit(False)),
        "INVALID_ROI": in_time & roi.isNotNull() & ~ft.roi_in_frame(roi["x"], roi["y"], roi["w"], roi["h"]),
        "INVALID_TARGET_MS": in_time & F.coalesce(F.col("target_ms") <= 0, F.lit(False)),
    }
    rules = {code: F.coalesce(bad, F.lit(False)) if code not in ("UNKNOWN_CATEGORY",) else bad for code, bad in rules.items()}
    return violations(out, ids, rules).unionByName(duplicates(cases, ids, "DUPLICATE_ID"))


def corpus_coverage(cases: DataFrame, errors: DataFrame, keys: Sequence[str], *, representative: bool = True) -> DataFrame:
    """Covered time (plain sum), categories and status per corpus. ``cases`` are the checked ones."""
    wanted = F.array(*[F.lit(c) for c in sorted(CATEGORIES)])
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category"))
    rolled = cases.groupBy(*keys).agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_case_duration_ms"), F.count("*").alias("case_count"),
        F.array_sort(F.collect_set(known)).alias("covered"))
    failed = errors.groupBy(*keys).agg(F.count("*").alias("__errors"))
    out = rolled.join(failed, list(keys), "left").withColumn("missing", F.array_except(wanted, F.col("covered")))
    short = (F.size("missing") > 0) | (F.col("total_case_duration_ms") < REQUIRED_MS)
    broken = F.coalesce(F.col("__errors"), F.lit(0)) > 0
    good = "READY_FOR_REPRESENTATIVE_QUALITY_EVALUATION" if representative else "SYNTHETIC_SMOKE_ONLY"
    invalid = broken | short if representative else broken
    return out.withColumn("status", F.when(invalid, "INVALID").otherwise(good)).drop("__errors")


def public_map(settings: Column) -> Column:
    """Flat settings without credential-like keys."""
    return F.map_filter(settings, lambda k, _: ~k.rlike(SECRET_KEY))


def plan_map(settings: Column) -> Column:
    """Flat settings without environment keys."""
    return F.map_filter(settings, lambda k, _: ~F.lower(k).isin(*ENV_KEYS))


def measured_metrics(metrics: Column) -> Column:
    """Known numeric measurements that are finite and not negative."""
    return F.map_filter(metrics, lambda k, v: k.isin(*STAGE_METRICS) & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))


def plan_rules(jobs: DataFrame, keys: Sequence[str], inventory: DataFrame | None = None) -> DataFrame:
    """Benchmark plan rules per job; ids must be unique inside a plan."""
    ids = [*keys, "job_id"]
    rules = {
        "INVALID_ID": ~F.col("job_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"),
        "UNSUPPORTED_STAGE": ~F.col("stage").isin(*STAGES),
        "MISSING_INPUT": F.coalesce(F.col("input") == "", F.lit(True)),
        "CONFIG_REQUIRED": F.col("config").isNull() & (F.col("stage") != "probe"),
        "INVALID_TIMEOUT": (F.col("timeout_s") <= 0) | (F.col("timeout_s") > 86_400) | F.isnan("timeout_s"),
        "INVALID_RATE": F.col("hourly_rate").isNotNull() & ((F.col("hourly_rate") < 0) | F.isnan("hourly_rate")),
    }
    parts = [violations(jobs, ids, rules), duplicates(jobs, ids, "DUPLICATE_ID")]
    if inventory is not None:
        gone = jobs.join(inventory.select(F.col("source").alias("input")), "input", "left_anti")
        parts.append(gone.select(*ids, F.lit("INPUT_NOT_FOUND").alias("code")))
    return union_all(parts)


# States in which an episode's lines may be edited.
EDITABLE = ("NEEDS_REVIEW", "CHECKPOINTED")


def edit_violations(
    stored: DataFrame, edits: DataFrame, episodes: DataFrame, keys: Sequence[str], ident: str, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Review edits: same ids, ordered per track, inside the episode, decided, and complete when dubbed.

    ``episodes``: keys, ``duration_ms`` and, where it is known, ``status``: edits are taken in review or at a checkpoint only. Stored ids that
    are not unique are a conflict of their own. Codes of a whole episode have a null ident.
    """
    ids = [*keys, ident]
    have = stored.groupBy(*ids).agg(F.count("*").alias("__old"))
    sent = edits.groupBy(*ids).agg(F.count("*").alias("__sent"))
    both = have.join(sent, ids, "full_outer").select(*ids, F.when(
        F.col("__old").isNull() | F.col("__sent").isNull() | (F.col("__sent") > 1), "SEGMENT_SET_CHANGED").alias("code"))
    tracked = edits.withColumn("__track", F.coalesce(F.nullif(F.col("track_id"), F.lit("")), F.lit("legacy")))
    near = previous(tracked, [*keys, "__track"], ["sent_no"], {"__pe": F.col("end_ms")}, block_rows=block_rows)
    timed = near.join(episodes.select(*keys, "duration_ms"), list(keys), "left")
    words = F.col("words")
    rules = violations(timed, ids, {
        "OUT_OF_ORDER": F.coalesce(F.col("start_ms") < F.col("__pe"), F.lit(False)),
        "OUTSIDE_TIMELINE": F.col("end_ms") > F.col("duration_ms"),
        "BAD_WORDS": ~(words_ordered(words) & F.forall(words, lambda w: (tx.strip(w["t"]) != "") & (w["s"] >= F.col("start_ms")))),
        "UNDECIDED": ~F.col("action").isin("DUB", "KEEP") | F.col("needs_review"),
        "DUB_INCOMPLETE": (F.col("action") == "DUB") & ((F.size("words") == 0) | (tx.strip(F.col("dub_vi")) == "")),
    })
    whole = F.lit(None).cast(stored.schema[ident].dataType).alias(ident)
    edited = edits.select(*keys).distinct()
    status = F.col("status") if "status" in episodes.columns else F.lit(EDITABLE[0]).alias("status")
    closed = edited.join(episodes.select(*keys, status), list(keys), "left").where(~F.coalesce(F.col("status").isin(*EDITABLE), F.lit(False)))
    twice = have.where(F.col("__old") > 1).select(*keys).distinct().join(edited, list(keys), "left_semi")
    return union_all([
        both.where("code IS NOT NULL"), rules, closed.select(*keys, whole, F.lit("EPISODE_NOT_IN_REVIEW").alias("code")),
        twice.select(*keys, whole, F.lit("DUPLICATE_STORED_ID").alias("code"))])


def applied_edits(stored: DataFrame, edits: DataFrame, rejected: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Edited segments of the episodes without violations; confidence stays as stored."""
    ids = [*keys, ident]
    fine = edits.join(rejected.select(*keys).distinct(), list(keys), "left_anti").drop("confidence")
    return fine.join(stored.select(*ids, "confidence"), ids)


def mix_input_violations(segments: DataFrame, clips: DataFrame, keys: Sequence[str], ident: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What forbids mixing: undecided lines, bad words, overlaps, duplicate ids, clips that do not match."""
    ids = [*keys, ident]
    inside = F.forall("words", lambda w: (F.col("start_ms") <= w["s"]) & (w["s"] < w["e"]) & (w["e"] <= F.col("end_ms")))
    # Words are compared in time order, whatever order they arrive in.
    ordered = words_ordered(F.array_sort(F.transform("words", lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e")))))
    dub = F.col("action") == "DUB"
    rows = violations(segments, ids, {
        "NEEDS_REVIEW": F.col("needs_review") | (F.col("action") == "NEEDS_REVIEW"),
        "EMPTY_SEGMENT": (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "DUB_WITHOUT_WORDS": dub & (F.size("words") == 0),
        "WORD_OUTSIDE_SEGMENT": dub & ~inside,
        "WORDS_OVERLAP": dub & ~ordered,
    })
    near = previous(segments, keys, ["start_ms", "end_ms", ident], {"__pe": F.col("end_ms")}, block_rows=block_rows)
    crossed = near.where(F.col("__pe") > F.col("start_ms")).select(*ids, F.lit("SEGMENTS_OVERLAP").alias("code"))
    dubs = segments.where(dub)
    pairing = dubs.select(*ids, F.lit(1).alias("__d")).join(clips.select(*ids, F.lit(1).alias("__c")), ids, "full_outer")
    unmatched = pairing.where("__d IS NULL OR __c IS NULL").select(
        *ids, F.when(F.col("__c").isNull(), "CLIP_MISSING").otherwise("CLIP_WITHOUT_SEGMENT").alias("code"))
    return union_all([rows, crossed, duplicates(dubs, ids, "DUPLICATE_ID"), unmatched])


def preview_audio_verdict(rate: Column, channels: Column, drift_ms: Column) -> Column:
    """Render gate (500 ms) as a failure code, null when fine."""
    return F.when((channels != 2) | (rate != 48_000), "PREVIEW_AUDIO_FORMAT_MISMATCH").when(
        F.abs(drift_ms) > 500, "PREVIEW_AUDIO_DURATION_MISMATCH")


def preview_technical_pass(rate: Column, channels: Column, drift_ms: Column) -> Column:
    """Quality gate: same format, but only 250 ms of drift."""
    return (channels == 2) & (rate == 48_000) & (F.abs(drift_ms) <= 250)


def subtitle_mode(flags: Column, default: str) -> Column:
    """First usable SUBTITLE_MODE flag, else the default."""
    known = F.filter(flags, lambda f: f.isin("SUBTITLE_MODE=off", "SUBTITLE_MODE=burn", "SUBTITLE_MODE=replace"))
    return F.coalesce(F.substring_index(F.get(known, 0), "=", -1), F.lit(default))


def set_mismatch(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members on one side only, with the side; empty when the sets are equal."""
    only_left = left.select(*keys).join(right.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("left"))
    only_right = right.select(*keys).join(left.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def bag_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number differs between the sides, one row per surplus copy."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def dense_timeline_rules(frames: DataFrame, keys: Sequence[str], *, frame_cap: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Problems of a dense frame manifest, per key.

    ``frames``: keys, ``frame_index, at_ms, start_ms, end_ms, fps_num, fps_den, source_start_ms, source_frames``.
    """
    near = previous(frames, keys, ["frame_index"], {"__pi": F.col("frame_index"), "__pa": F.col("at_ms")}, block_rows=block_rows)
    period = F.lit(1000.0) * F.col("fps_den") / F.col("fps_num")
    slack = F.greatest(F.lit(1.1), F.lit(1000.0) / F.col("fps_num"))
    first = F.col("frame_index") - F.coalesce("__pi", F.lit(-1)) != 1
    outside = ~((F.col("start_ms") <= F.col("at_ms")) & (F.col("at_ms") < F.col("end_ms")))
    sparse = F.coalesce(F.abs(F.col("at_ms") - F.col("__pa") - period) > slack, F.lit(False))
    rolled = near.groupBy(*keys).agg(
        F.bool_or(first).alias("gap"), F.bool_or(outside).alias("outside"), F.bool_or(sparse).alias("sparse"),
        F.count("*").alias("n"), F.min("at_ms").alias("lo"), F.max("at_ms").alias("hi"), F.min_by("at_ms", "frame_index").alias("first_at"),
        F.first("start_ms").alias("start_ms"), F.first("end_ms").alias("end_ms"), F.first(period).alias("period"), F.first(slack).alias("slack"),
        F.first("source_start_ms").alias("source_start_ms"), F.first("source_frames").alias("source_frames"))
    edge = F.col("period") + F.col("slack")
    uncovered = F.when(F.col("n") > 1, (F.col("lo") - F.col("start_ms") > edge) | (F.col("end_ms") - F.col("hi") > edge)).otherwise(
        F.col("end_ms") - F.col("start_ms") > edge)
    offset = F.greatest(F.lit(0), F.bround((F.col("first_at") - F.col("source_start_ms")) / F.col("period")))
    rolled = staged(rolled.withColumn("offset", offset))
    placed = frames.join(rolled.select(*keys, "offset", "period", "slack"), list(keys))
    expected = F.col("source_start_ms") + F.bround((F.col("offset") + F.col("frame_index")) * F.col("period"))
    drifting = placed.groupBy(*keys).agg(F.bool_or(F.abs(F.col("at_ms") - expected) > F.col("slack")).alias("drift"))
    return violations(rolled.join(drifting, list(keys)), keys, {
        "INDEX_NOT_CONTIGUOUS": F.col("gap"), "TIME_OUTSIDE_INTERVAL": F.col("outside"), "NOT_DENSE": F.col("sparse"),
        "EDGES_UNCOVERED": uncovered, "MORE_FRAMES_THAN_SOURCE": F.col("offset") + F.col("n") > F.col("source_frames"),
        "NOT_ON_SOURCE_FRAMES": F.col("drift"), "FRAME_CAP_EXCEEDED": F.col("n") > frame_cap})


def repeated_timestamps(frames: DataFrame, keys: Sequence[str], at: str = "at_ms") -> DataFrame:
    """Frame times that occur more than once, where they must be unique."""
    return duplicates(frames, [*keys, at], "AMBIGUOUS_FRAME_TIME")


def cfr_drift(frames: DataFrame, keys: Sequence[str], *, index: str = "frame_index", at: str = "at_ms", render: bool = True) -> DataFrame:
    """Frames off their constant-rate position: 2 ms, or for rendering 5% of a frame when that is more."""
    period = F.lit(1000.0) * F.col("fps_den") / F.col("fps_num")
    slack = F.greatest(F.lit(2.0), period * 0.05) if render else F.lit(2.0)
    return frames.where(F.abs(F.col(at) - F.col(index) * period) > slack)
