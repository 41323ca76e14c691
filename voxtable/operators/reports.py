"""Run, stage, cost and plan reports."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators.scan import BLOCK_ROWS, null_safe_join
from voxtable.session import is_scan, staged

# Stages of a benchmark plan, in order, and the environment each runs in.
PLAN_STAGES = {"asr": "asr", "align": "asr", "tts": "tts", "bandit": "bandit", "ocr": "vision", "inpaint": "vision"}
# Evidence that a person still has to provide, by stage.
EVIDENCE = {"tts": "pronunciation_human_rating", "bandit": "sfx_preservation_reference",
            "ocr": "subtitle_text_reference", "inpaint": "residual_visual_review"}


def run_totals(stages: DataFrame, runs: DataFrame | None = None, *, rate: int = 6000) -> DataFrame:
    """Per run: total time, slowest stage, and with ``runs`` the real-time factor and cost.

    ``runs``: ``run_id, source_ms, api_cost`` (null cost stays null in the total).
    """
    # Equal times: the stage recorded first wins, as a maximum over the list would give.
    slowest = F.max_by("stage", F.struct(F.col("wall_ms"), -F.col("seq")))
    out = stages.groupBy("run_id").agg(
        F.sum("wall_ms").alias("total_ms"), F.count("*").alias("stages"),
        F.when(F.max("wall_ms") > 0, slowest).alias("bottleneck"))
    if runs is None:
        return out
    cost = F.col("total_ms") / 1000 * rate / 3600
    return out.join(runs, "run_id").withColumn("rtf", F.col("total_ms") / F.col("source_ms")).withColumn(
        "compute_cost", cost).withColumn("total_cost", cost + F.col("api_cost"))


def stage_fractions(stages: DataFrame, totals: DataFrame) -> DataFrame:
    share = F.when(F.col("total_ms") > 0, F.col("wall_ms") / F.col("total_ms")).otherwise(0.0)
    return stages.join(totals.select("run_id", "total_ms"), "run_id").withColumn("fraction_of_wall_time", share)


def suite_rollup(jobs: DataFrame, keys: Sequence[str], rate: Column) -> DataFrame:
    """Elapsed sum, cost and status; unfinished beats failed beats measured."""
    open_ = F.bool_or(F.col("status").isin("PENDING", "RUNNING", "TIMED_OUT", "INTERRUPTED"))
    status = F.when(open_, "INCOMPLETE").when(F.bool_or(F.col("status") == "FAILED"), "FAILED").otherwise("MEASURED")
    out = jobs.groupBy(*keys).agg(F.sum("wall_ms").alias("elapsed_ms"), status.alias("status"), F.count("*").alias("jobs"))
    return out.withColumn("cost", ft.rounded(F.col("elapsed_ms") * rate / 3_600_000, 2))


def realtime_factors(reports: DataFrame) -> DataFrame:
    """Real-time factor with the time it is based on: inference, else adapter, else the whole stage."""
    processed = F.coalesce("processed_ms", "source_ms")
    wall = F.coalesce("inference_ms", "adapter_ms", "wall_ms")
    basis = (
        F.when(F.col("inference_ms").isNotNull(), "adapter_inference_ms")
        .when(F.col("adapter_ms").isNotNull(), "adapter_wall_ms").otherwise("stage_wall_ms"))
    usable = processed > 0
    return (
        reports.withColumn("realtime_factor", F.when(usable, ft.rounded(wall / processed, 6)))
        .withColumn("basis_ms", F.when(usable, processed)).withColumn("wall_basis", F.when(usable, basis)))


def evidence_missing(stage: Column, reference: Column, words: Column, *, synthetic: bool) -> Column:
    """Evidence a stage still lacks, in reporting order."""
    own = (
        F.when((stage == "asr") & (F.coalesce(reference, F.lit("")) == ""), "zh_reference")
        .when((stage == "align") & (F.coalesce(F.size(words), F.lit(0)) <= 0), "words"))
    for name, item in EVIDENCE.items():
        own = own.when(stage == name, item)
    always = F.lit("representative_ground_truth" if synthetic else None).cast("string")
    return F.array_compact(F.array(own, always))


def merged_evidence(reported: Column, nested: Column) -> Column:
    """Union of two evidence lists in order; ``quality_evidence`` when both are absent."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(reported, nested), F.array_except(F.coalesce(nested, empty), F.coalesce(reported, nested)))
    return F.coalesce(both, F.array(F.lit("quality_evidence")))


def digest(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], *, spaced: bool = False) -> DataFrame:
    """SHA-256 of a canonical JSON list per key, and the number of its rows.

    The list is never built: rows stream through a hash in order (``streamed_digest``), so a list may have any length.
    ``fields`` are written in alphabetical order, nulls kept. ``spaced`` uses ``", "`` and ``": "``.
    """
    doc = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    if spaced:
        parts = [F.concat(F.lit(f'"{f}": '), F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1))
                 for f in sorted(fields)]
        doc = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    pieces = rows.select(*keys, F.col(order).alias("__order"), doc.alias("__doc"))
    return streamed_digest(pieces, keys, ["__order", "__doc"], "__doc", begin="[", between=", " if spaced else ",", end="]", count="files")


def streamed_digest(
    pieces: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, *, begin: str = "", between: str = "", end: str = "", name: str = "sha256", count: str = "n"
) -> DataFrame:
    """Per key the SHA-256 of its pieces in order, with fixed texts around and between them, and their number.

    Rows are dealt by key and sorted; a task holds one batch and one hash state, however long a key's pieces are together. A hash
    of one sequence is sequential by its nature; ``hash_tree`` is the parallel form. Null pieces are passed over.
    """
    keys = list(keys)
    schema = T.StructType([*[pieces.schema[k] for k in keys], T.StructField(name, T.StringType()), T.StructField(count, T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    head, glue, tail = (x.encode() for x in (begin, between, end))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n, first, done = None, None, 0, True, []

        def close() -> None:
            state.update(tail)
            done.append((*last, state.hexdigest(), n))

        for batch in batches:
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*keys, piece)]):
                if key != last:
                    if last is not None:
                        close()
                    last, state, n, first = key, hashlib.sha256(head), 0, True
                n += 1
                if text is not None:
                    if not first:
                        state.update(glue)
                    state.update(text.encode())
                    first = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)
                done.clear()
        if last is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

    held = pieces.select(*dict.fromkeys([*keys, *order, piece]))
    return held.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], doc: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Digest ``__h`` and length ``__b`` of each document with its place ``__i`` in its key and its run, and the keys of each ``__run``.

    Documents are dealt by range and sorted once, and only digests are written. A run is what one task holds of a key.
    """
    text = F.coalesce(F.col(doc), F.lit(""))
    digest, length = F.unhex(F.sha2(text, 256)).alias("__h"), F.octet_length(text).cast("long").alias("__b")
    more = [c for c in order if c not in keys]
    # Text that rows are sorted by is moved anyhow, and packs better than a digest.
    dealt = rows.select(*dict.fromkeys([*keys, *more, doc])) if doc in more else rows.select(*keys, *more, digest, length)
    by = [*keys, *more] if doc in more else [*keys, *more, "__h"]
    number = rows.count()
    tasks = max(1, math.ceil(number / block_rows), min(rows.sparkSession.sparkContext.defaultParallelism, number >> 12))
    at = F.monotonically_increasing_id()  # task and place in the task
    sorted_ = dealt.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    held = staged(sorted_.select(*keys, at.alias("__at"), *([digest, length] if doc in more else ["__h", "__b"])), "digests")
    runs = held.groupBy(*keys, F.shiftright("__at", 33).alias("__task")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = F.sum("__rows").over(W.partitionBy(*keys).orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    # A task and a key give one row: tasks and keys together at most.
    runs = staged(runs.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__run", F.monotonically_increasing_id()), "runs")
    named = held.withColumn("__task", F.shiftright("__at", 33))
    found = null_safe_join(named, runs, [*keys, "__task"], "inner")
    return found.select("__run", (F.col("__at") - F.col("__first") + F.col("__before")).alias("__i"), "__h", "__b"), runs.select("__run", *keys)


def hash_tree(rows: DataFrame, keys: Sequence[str], order: Sequence[str], doc: str, *, leaf_rows: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key ``n``, ``bytes`` and ``root``: a hash tree of two levels over the documents in order.

    A leaf is the SHA-256 of the SHA-256 digests of ``leaf_rows`` documents that follow each other, whatever task they lie in; the root is
    that of the leaves in order. Leaves are built in parallel, also inside one key; only one short row a leaf is walked in order. A changed
    byte, two rows in another order, a row more or a row twice all change the root. A null document counts as the empty one.
    """
    keys = list(keys)
    placed, counts = _placed(rows if is_scan(rows) else staged(rows, "documents"), keys, order, doc, block_rows)
    kinds = {"__run": "bigint", "__leaf": "bigint", "__i": "bigint", "__n": "bigint", "__b": "bigint", "__h": "binary", "__sha": "string"}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # run, leaf and place of the last row
        first, size, digests, done = 0, 0, [], []

        def close() -> None:
            whole = len(digests) == leaf_rows
            sha = hashlib.sha256("".join([h.hex() for h in digests]).encode()).hexdigest() if whole else None
            done.append((last[0], last[1], first, len(digests), size, None if whole else b"".join(digests), sha))

        def packed() -> pa.RecordBatch:
            types = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*done), kinds.values())], names=list(kinds))

        for batch in batches:
            for run, place, digest, length in zip(*[batch.column(c).to_pylist() for c in ("__run", "__i", "__h", "__b")]):
                if last is None or run != last[0] or place // leaf_rows != last[1] or place != last[2] + 1:
                    if last is not None:
                        close()
                    first, size, digests = place, 0, []
                last = run, place // leaf_rows, place
                digests.append(digest)
                size += length
            if done:
                yield packed()
                done.clear()
        if last is not None:
            close()
            yield packed()

    # Rows that follow each other are taken together where they lie; a leaf that goes over an edge of tasks is put together behind.
    pieces = staged(placed.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in kinds.items())).join(counts, "__run"), "leaf-pieces")
    held = F.sort_array(F.collect_list(F.struct("__i", "__h")))  # leaf_rows digests at most
    cut = pieces.where("__sha IS NULL").groupBy(*keys, "__leaf").agg(
        F.sha2(F.array_join(F.transform(held, lambda x: F.lower(F.hex(x["__h"]))), "").cast("binary"), 256).alias("__sha"), F.sum("__n").alias("__n"), F.sum("__b").alias("__b"))
    leaves = pieces.where("__sha IS NOT NULL").select(*cut.columns).unionByName(cut)
    leaves = staged(leaves, "leaves")
    roots = streamed_digest(leaves, keys, ["__leaf"], "__sha", name="root", count="leaves")
    sums = leaves.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum("__b").alias("bytes"))
    return null_safe_join(sums, roots, keys, "inner")


def plan_jobs(cases: DataFrame, keys: Sequence[str], *, synthetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every case with every stage it can run: (jobs, skipped with reason).

    The stage list is a fixed array, so this is an explode and not a cross join.
    ``cases``: keys, ``case_id, tts_text, roi, zh_reference, words``.
    """
    stage = F.explode(F.array(*[F.lit(s) for s in PLAN_STAGES]))
    all_ = cases.withColumn("stage", stage)
    speech = F.coalesce(tx.strip(F.col("tts_text")), F.lit("")) == ""
    reason = F.when((F.col("stage") == "tts") & speech, "missing_tts_text").when(
        F.col("stage").isin("ocr", "inpaint") & F.col("roi").isNull(), "missing_roi")
    judged = all_.withColumn("reason", reason)
    skipped = judged.where("reason IS NOT NULL").select(*keys, "case_id", "stage", "reason")
    jobs = job_ids(judged.where("reason IS NULL").drop("reason"), keys)
    # Asr and ocr have the same entry conditions as the stages that need them, so the id is enough.
    needed = F.when(F.col("stage") == "align", F.regexp_replace("job_id", "_align$", "_asr")).when(
        F.col("stage") == "inpaint", F.regexp_replace("job_id", "_inpaint$", "_ocr"))
    profile = F.element_at(F.create_map(*[F.lit(x) for kv in PLAN_STAGES.items() for x in kv]), F.col("stage"))
    jobs = jobs.withColumn("depends_on", needed).withColumn("profile", profile).withColumn(
        "missing_evidence", evidence_missing(F.col("stage"), F.col("zh_reference"), F.col("words"), synthetic=synthetic))
    return jobs, skipped


def job_ids(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable job id; a case whose id collides with an earlier case gets a hash suffix."""
    named = jobs.withColumn("__case", F.col("case_id").cast("string")).withColumn("__slug", tx.job_slug(F.col("__case")))
    first = named.groupBy(*keys, "__slug", "stage").agg(F.min_by("__case", F.struct("case_no", "__case")).alias("__first"))
    out = named.join(first, [*keys, "__slug", "stage"])
    cut = F.regexp_replace(F.substring("__slug", 1, 36), r"[-._]+$", "")
    hashed = F.concat_ws("_", cut, F.substring(F.sha2("__case", 256), 1, 8), F.col("stage"))
    plain = F.concat_ws("_", "__slug", "stage")
    return out.withColumn("job_id", F.when(F.col("__first") == F.col("__case"), plain).otherwise(hashed)).drop("__case", "__slug", "__first")


def report_lines(stages: DataFrame, totals: DataFrame, issues: DataFrame) -> DataFrame:
    """Markdown run report, one row per line, in ``run_id, part, position`` order."""
    head = totals.select("run_id", F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.format_string("# Run %s", F.col("run_id").cast("string")).alias("line")),
        F.struct(F.lit(1).alias("n"), F.format_string("Total wall: %.3f s", F.col("total_ms") / 1000).alias("line")),
        F.struct(F.lit(2).alias("n"), F.lit("| Stage | Status | Seconds |").alias("line")),
        F.struct(F.lit(3).alias("n"), F.lit("| --- | --- | ---: |").alias("line")))).alias("h")).select(
        "run_id", F.lit(0).alias("part"), F.col("h.n").cast("long").alias("position"), F.col("h.line").alias("line"))
    rows = stages.select("run_id", F.lit(1).alias("part"), F.col("seq").alias("position"),
                         F.format_string("| %s | %s | %.3f |", "stage", "status", F.col("wall_ms") / 1000).alias("line"))
    title = totals.select("run_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("position"),
                          F.lit("## Issues (no automatic corrections)").alias("line"))
    found = issues.select("run_id", F.lit(3).alias("part"), F.col("seq").alias("position"),
                          F.format_string("- %s: %s.", "stage", "code").alias("line"))
    return head.unionByName(rows).unionByName(title).unionByName(found)


def unchecked_cases(cases: DataFrame, checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each case with ``mismatch``: no report was made for it."""
    seen = checked.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return cases.join(seen, list(keys), "left").withColumn("mismatch", F.col("__seen").isNull()).drop("__seen")


def check_summary(checks: DataFrame, keys: Sequence[str], passed: str = "passed") -> DataFrame:
    """PASS only when every check passed, with counts."""
    ok = F.bool_and(passed)
    return checks.groupBy(*keys).agg(
        F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.count_if(F.col(passed)).alias("passed"),
        F.count_if(~F.col(passed)).alias("failed"))


