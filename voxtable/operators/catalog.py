"""Catalog, queue, checkpoint and table-update jobs. Updates return new table contents and reject rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions.states import ACTIVE, MAIN_LINE, RECOVERABLE, SIDE_STATES, STAGE_ORDER, legal_moves, moves_table
from voxtable.operators.reports import hash_tree
from voxtable.operators.scan import BLOCK_ROWS, Machine, following, global_rank, keyed_fold, machine_scan, null_safe_join, prefix, previous
from voxtable.schemas import ROI
from voxtable.session import staged
from voxtable.sources.versions import Tables

# Issues that keep an episode in review, and issues a saved review resolves.
REVIEW_CODES = ("DURATION_REWRITE_REQUIRED", "ALIGNMENT_REVIEW_REQUIRED", "TRANSCRIPT_REVIEW_REQUIRED", "MISSING_TTS_CLIP")
RESOLVED_BY_EDIT = (*REVIEW_CODES, "AUDIO_QC_FAILED")
# Columns of each table that an export may contain.
EXPORT_COLUMNS = {
    "series": ("series_id", "title", "priority", "created_at", "glossary_version", "roi_json"),
    "episode": ("episode_id", "series_id", "ordinal", "filename", "total_bytes", "duration_ms", "status", "roi_json"),
    "glossary": ("series_id", "zh", "vi", "locked", "updated_at"),
    "segment": ("episode_id", "segment_id", "start_ms", "end_ms", "zh_text", "action"),
    "issue": ("issue_id", "episode_id", "code", "severity", "resolved"),
    "workspace": ("id", "schema_version", "created_at"),
}

QUEUE_ORDER = ("priority", "series_created_at", "series_id", "ordinal", "episode_id")


def queued(episodes: DataFrame, series: DataFrame) -> DataFrame:
    """Requested queued episodes with the order columns of their series."""
    lead = series.select("series_id", "priority", F.col("created_at").alias("series_created_at"))
    return episodes.where("status = 'QUEUED' AND queue_requested").join(lead, "series_id")


def next_episode(episodes: DataFrame, series: DataFrame) -> DataFrame:
    """The one episode to process next: a top-1, not a full sort."""
    return queued(episodes, series).orderBy(*QUEUE_ORDER).limit(1)


def queue_order(episodes: DataFrame, series: DataFrame) -> DataFrame:
    """The whole queue with its rank."""
    return global_rank(queued(episodes, series), [F.col(c) for c in QUEUE_ORDER], "queue_rank")


def detail_rows(series: DataFrame, episodes: DataFrame, glossary: DataFrame, issues: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Series detail as one JSON row per child, so that a large series is never one value.

    Rows sort by ``series_id, kind, position`` into the nested document.
    """
    def child(df: DataFrame, kind: str, position: str, fields: Sequence[str]) -> DataFrame:
        doc = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        return df.select("series_id", F.lit(kind).alias("kind"), F.col(position).cast("long").alias("position"), doc.alias("doc"))

    owner = episodes.select("episode_id", "series_id")
    parts = [
        child(series, "0_series", "series_id", ["series_id", "title", "priority"]),
        child(glossary, "1_glossary", "updated_at", ["zh", "vi", "locked"]),
        child(episodes, "2_episode", "ordinal", ["episode_id", "ordinal", "filename", "status"]),
        child(issues.join(owner, "episode_id"), "3_issue", "issue_id", ["episode_id", "issue_id", "code", "severity", "resolved"]),
        child(artifacts.join(owner, "episode_id"), "4_artifact", "artifact_id", ["episode_id", "kind", "bytes"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_artifact(artifacts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Newest artifact of the kinds per episode."""
    newest = F.max_by(F.struct("kind", "artifact_id", "bytes", "created_at"), F.struct("created_at", "artifact_id"))
    return artifacts.where(F.col("kind").isin(*kinds)).groupBy("episode_id").agg(newest.alias("a")).select("episode_id", "a.*")


def replace_latest(artifacts: DataFrame) -> DataFrame:
    """One artifact per episode and kind: the last registered wins."""
    last = F.max_by(F.struct("artifact_id", "bytes", "created_at"), F.struct("created_at", "artifact_id"))
    return artifacts.groupBy("episode_id", "kind").agg(last.alias("a")).select("episode_id", "kind", "a.*")


def event_page(events: DataFrame, cursor: int, size: int = 100) -> DataFrame:
    return events.where(F.col("event_id") > cursor).orderBy("event_id").limit(size)


def quota_admission(
    requests: DataFrame, keys: Sequence[str], quota: int, *, reserved: DataFrame | None = None, order: str = "seq"
) -> DataFrame:
    """Admit upload requests in arrival order while they fit; a refused request reserves nothing.

    Whether a request fits depends on every answer before it, so each key is walked in order; rows stream, and the state
    is one number. ``reserved``: keys and ``reserved_bytes`` held before the batch. Null sizes are refused.
    """
    held = requests.withColumn("__base", F.lit(0).cast("long"))
    if reserved is not None:
        base = reserved.select(*keys, F.col("reserved_bytes").alias("__held"))
        held = null_safe_join(requests, base, list(keys), "left").withColumn("__base", F.coalesce("__held", F.lit(0)).cast("long")).drop("__held")

    def step(state: dict, values: tuple) -> tuple[bool, int]:
        size, base = values
        used = state.get("used", base)
        fits = size is not None and used + size <= quota
        state["used"] = used + size if fits else used
        return fits, used

    return keyed_fold(held, keys, [order], ["total_bytes", "__base"], {"admitted": "boolean", "reserved_bytes": "bigint"}, step).drop("__base")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Unresolved issues by code and severity, with totals per code and overall."""
    return issues.where("NOT resolved").rollup("code", "severity").agg(F.count("*").alias("n"))


def review_gate(episodes: DataFrame, issues: DataFrame, segments: DataFrame) -> DataFrame:
    """Episodes in review that may go on: no open review issue and no flagged line."""
    held = issues.where(~F.col("resolved") & F.col("code").isin("ROI_REQUIRED", *REVIEW_CODES)).select("episode_id")
    flagged = segments.where(F.col("needs_review") | (F.col("action") == "NEEDS_REVIEW")).select("episode_id")
    waiting = episodes.where("status = 'NEEDS_REVIEW'")
    return waiting.join(held, "episode_id", "left_anti").join(flagged, "episode_id", "left_anti")


def checkpoint_mismatches(recorded: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare recorded artifact hashes with the files found, both ways."""
    r = recorded.select(*keys, "stage", F.col("sha256").alias("__want"))
    c = current.select(*keys, F.col("sha256").alias("__have"))
    reason = (
        F.when(F.col("__want").isNull(), "NOT_INDEXED").when(F.col("__have").isNull(), "MISSING")
        .when(F.col("__want") != F.col("__have"), "CHECKSUM_MISMATCH")
    )
    return r.join(c, list(keys), "full_outer").select(*keys, "stage", reason.alias("reason")).where("reason IS NOT NULL")


def usable_roi(json: Column) -> Column:
    """Parsed region when it is valid under the stored contract, else null."""
    roi = F.from_json(json, ROI)
    return F.when(ft.roi_in_frame(roi["x"], roi["y"], roi["w"], roi["h"], slack=0.000001), roi)


def resolved_roi(episodes: DataFrame, series: DataFrame) -> DataFrame:
    """Episode region, else the series region, else the issue ROI_REQUIRED."""
    lead = series.select("series_id", usable_roi(F.col("roi_json")).alias("__series"))
    out = episodes.join(lead, "series_id", "left").withColumn("roi", F.coalesce(usable_roi(F.col("roi_json")), F.col("__series")))
    return out.withColumn("issue", F.when(F.col("roi").isNull(), "ROI_REQUIRED")).drop("__series")


def glossary_upsert(current: DataFrame, requests: DataFrame, series: DataFrame, *, max_entries: int = 5_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply glossary requests in the order of ``request_id``: (new glossary, series with raised version, rejects).

    ``requests``: ``request_id, series_id, zh, vi, locked, updated_at``. Too many entries, a duplicate term, or a model term
    over a user-locked one rejects the whole request. A lock made by an accepted request holds for those after it, so the
    requests of a series are walked in order; a request is one row of at most ``max_entries`` terms.
    """
    ids = ["series_id", "request_id"]
    counted = requests.groupBy(*ids).agg(F.count("*").alias("n"), F.count_distinct("zh").alias("terms"))
    code = F.when(F.col("n") > max_entries, "TOO_MANY_ENTRIES").when(F.col("terms") < F.col("n"), "DUPLICATE_TERM")
    judged = counted.select(*ids, code.alias("code"))
    fine = requests.join(judged.where("code IS NULL").select(*ids), ids)
    locked = current.where("locked").select("series_id", "zh", F.lit(True).alias("__held")).distinct()
    walked = fine.join(locked, ["series_id", "zh"], "left").groupBy(*ids).agg(
        F.collect_list(F.struct("zh", "locked", F.coalesce("__held", F.lit(False)).alias("held"))).alias("terms"))

    def step(state: dict, values: tuple) -> tuple[bool]:
        terms = values[0]
        if any((t["held"] or t["zh"] in state) and not t["locked"] for t in terms):
            return (False,)
        state.update((t["zh"], True) for t in terms if t["locked"])
        return (True,)

    accepted = staged(keyed_fold(walked, ["series_id"], ["request_id"], ["terms"], {"fits": "boolean"}, step).select(*ids, "fits"), "upsert")
    rejects = judged.where("code IS NOT NULL").select("request_id", "code").unionByName(
        accepted.where("NOT fits").select("request_id", F.lit("LOCKED_TERM").alias("code")))
    good = fine.join(accepted.where("fits").select(*ids), ids)
    fields = ("vi", "locked", "updated_at")
    old = current.select("series_id", "zh", *fields, F.lit(None).cast("long").alias("__age"))
    new = good.select("series_id", "zh", *fields, F.col("request_id").cast("long").alias("__age"))
    latest = old.unionByName(new).groupBy("series_id", "zh").agg(F.max_by(F.struct(*fields), F.struct(F.col("__age").isNotNull(), "__age")).alias("r"))
    raised = accepted.where("fits").groupBy("series_id").agg(F.count("*").alias("__up"))
    versions = series.join(raised, "series_id", "left").withColumn(
        "glossary_version", F.col("glossary_version") + F.coalesce(F.col("__up"), F.lit(0))).drop("__up")
    return latest.select("series_id", "zh", "r.*"), versions, rejects


def judged_moves(events: DataFrame, keys: Sequence[str], order: Sequence[str], *, state: str = "state") -> DataFrame:
    """Each event with the state before it and whether the move is legal (null for the first event)."""
    near = previous(events, keys, order, {"from_state": F.col(state)})
    moves = F.broadcast(moves_table(events.sparkSession).withColumn("__legal", F.lit(True)))
    out = near.join(moves, (near["from_state"] == moves["old"]) & (near[state] == moves["new"]), "left")
    legal = F.when(F.col("from_state").isNotNull(), F.coalesce(F.col("__legal"), F.lit(False)))
    return out.withColumn("legal", legal).drop("old", "new", "__legal")


def time_in_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], *, state: str = "state") -> DataFrame:
    """Milliseconds until the next event of the key; null while it is the last one."""
    nxt = following(events, keys, order, {"__next": F.col("ts_ms")})
    return nxt.withColumn("in_state_ms", F.col("__next") - F.col("ts_ms")).drop("__next")


#: Only legal moves leave a state; every other request stays where it is.
STATUS_MACHINE = Machine([*MAIN_LINE, *SIDE_STATES], {move: move[1] for move in legal_moves()})


def apply_transitions(
    episodes: DataFrame, requests: DataFrame, *, order: Sequence[str] = ("ts_ms", "status", "message"), block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested statuses in order: (updated episodes, event rows, rejects).

    Each request is judged against the state that the accepted ones before it left: the machine of legal moves is run along
    each episode's requests (``scan.machine_scan``); ``n`` numbers them. A status that is unknown or null is no legal move.
    """
    both = requests.select("episode_id", "status", "message", "ts_ms", *[c for c in order if c not in ("status", "message", "ts_ms")]).join(
        episodes.select("episode_id", F.col("status").alias("__old"), F.lit(True).alias("__known")), "episode_id", "left")
    run = machine_scan(both, ["episode_id"], list(order), STATUS_MACHINE, symbol="status", start="__old", before="from_state", block_rows=block_rows)
    moves = F.broadcast(moves_table(episodes.sparkSession).withColumn("__legal", F.lit(True)))
    run = run.join(moves, (F.col("from_state") == F.col("old")) & (F.col("status") == F.col("new")), "left")
    code = F.when(F.col("__known").isNull(), "EPISODE_NOT_FOUND").when(F.col("__legal").isNull(), "INVALID_TRANSITION")
    judged = staged(run.withColumn("code", code).drop("old", "new", "__legal"), "transitions")
    rejects = judged.where("code IS NOT NULL").select("episode_id", "from_state", F.col("status").alias("to_state"), "code")
    done = judged.where("code IS NULL").select("episode_id", F.col("status").alias("state"), "message", "ts_ms", "n")
    last = done.groupBy("episode_id").agg(F.max_by("state", "n").alias("__s"))
    updated = episodes.join(last, "episode_id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")
    return updated, done, rejects


def first_rejected_chunk(chunks: DataFrame, keys: Sequence[str], totals: DataFrame | None = None, *, order: str = "seq") -> DataFrame:
    """First chunk of each upload whose offset is not the bytes so far, or which overruns the total."""
    run = prefix(chunks, keys, [order], {"expected": ("sum", F.col("length"))})
    bad = F.col("offset") != F.col("expected")
    if totals is not None:
        run = run.join(totals.select(*keys, "total_bytes"), list(keys), "left")
        bad = bad | (F.col("offset") + F.col("length") > F.col("total_bytes"))
    first = F.min_by(F.struct(order, "offset", "expected"), F.col(order))
    return run.where(bad).groupBy(*keys).agg(first.alias("f")).select(*keys, "f.*")


def recovery_plan(episodes: DataFrame, checkpoints: DataFrame, hashes: DataFrame, *, accepting: bool = True) -> DataFrame:
    """What to do with episodes found active at a restart.

    ``checkpoints``: ``episode_id, checkpoint_stage, valid`` where a checkpoint exists; ``hashes``:
    ``episode_id, source_ok``.
    """
    out = episodes.where(F.col("status").isin(*RECOVERABLE)).join(checkpoints, "episode_id", "left").join(hashes, "episode_id", "left")
    no_checkpoint = F.col("checkpoint_stage").isNull() & F.col("valid").isNull()
    fresh = (F.col("status") == "PREPARING") & no_checkpoint
    frozen = F.col("status") == "V1_RUNNING"
    bad = ~F.coalesce(F.col("source_ok"), F.lit(False)) | (~frozen & ~fresh & ~F.coalesce(F.col("valid"), F.lit(True)))
    stage = (
        F.when(frozen, "V1_RUNNING").when(fresh, "PREPARING")
        .otherwise(F.coalesce(F.col("checkpoint_stage"), F.lit("SEPARATING")))
    )
    requeue = F.col("queue_requested") & (frozen | fresh | F.lit(accepting))
    return out.select(
        "episode_id", "status",
        F.when(bad, "FAILED").when(requeue, "QUEUED").otherwise("CHECKPOINTED").alias("decision"),
        F.when(~bad, stage).alias("next_stage"), F.when(bad, "CHECKPOINT_INVALID").alias("code"))


def stage_number(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), stage).cast("int")


def invalidate_from(records: DataFrame, damaged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage records that stay valid: those before the first damaged stage of their key."""
    first = damaged.groupBy(*keys).agg(F.min(stage_number(F.col("stage"))).alias("__first"))
    out = records.join(first, list(keys), "left")
    return out.where(F.col("__first").isNull() | (stage_number(F.col("stage")) < F.col("__first"))).drop("__first")


def stages_to_run(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stages without a finished run of the same input, and everything after them."""
    miss = wanted.join(done.select(*keys, "stage", "input_hash"), [*keys, "stage", "input_hash"], "left_anti")
    first = miss.groupBy(*keys).agg(F.min(stage_number(F.col("stage"))).alias("__first"))
    out = wanted.join(first, list(keys))
    return out.where(stage_number(F.col("stage")) >= F.col("__first")).drop("__first")


def resolve_issues(issues: DataFrame, episodes: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Mark the open issues of the given episodes resolved, optionally only some codes."""
    hit = episodes.select("episode_id", F.lit(True).alias("__hit")).distinct()
    match = F.col("__hit").isNotNull()
    if codes is not None:
        match = match & F.col("code").isin(*codes)
    return issues.join(hit, "episode_id", "left").withColumn("resolved", F.col("resolved") | match).drop("__hit")


def capped_history(history: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """Old and new rows together, the last ``keep`` per key. The rank limit also runs before the shuffle."""
    both = history.unionByName(fresh)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return both.withColumn("__r", rank).where(F.col("__r") <= keep).drop("__r")


def series_memory(history: DataFrame, lines: DataFrame, *, keep_history: int = 200, keep_lines: int = 30) -> tuple[DataFrame, DataFrame]:
    """Series memory after a run: the last addressing rows, and the last lines of the run.

    Speaker labels belong to one episode, so they are not part of either table. ``history``:
    ``series_id, run_no, start_ms, segment_id, speaker, addressee, addressing``; ``lines`` adds the new run.
    """
    order = ["run_no", "start_ms", "segment_id"]
    known = F.col("character_id").isNotNull() & F.col("addressee_id").isNotNull() & (F.size("addressing") > 0)
    fresh = lines.where(known).select("series_id", *order, F.col("character_id").alias("speaker"), F.col("addressee_id").alias("addressee"), "addressing")
    last = capped_history(lines.limit(0), lines, ["series_id"], order, keep_lines)
    return capped_history(history, fresh, ["series_id"], order, keep_history), last.select(
        "series_id", *order, "zh_text", "subtitle_vi", "character_id")


def deletable(parents: DataFrame, children: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Parents none of whose children a worker is holding."""
    busy = children.where(F.col(status).isin(*ACTIVE)).select(key)
    return parents.join(busy, key, "left_anti")


def without_deleted(table: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(deleted.select(*keys), list(keys), "left_anti")


def delete_series(tables: Tables, wanted: DataFrame) -> tuple[int, DataFrame]:
    """Delete the wanted series (``series_id``) and all that hangs on them, in one commit: (new version, series that stay as they are busy).

    ``series`` and ``episode`` are tables of the log; every other table with an ``episode_id`` loses the rows of deleted episodes.
    Either all tables show the deletion or none.
    """
    base = tables.version()
    read = {name: tables.read(name, base) for name in tables.names(base)}
    asked = read["series"].join(wanted.select("series_id").distinct(), "series_id", "left_semi")
    gone = staged(deletable(asked, read["episode"], "series_id").select("series_id"), "deleted-series")
    episodes = staged(read["episode"].join(gone, "series_id", "left_semi").select("episode_id"), "deleted-episodes")
    kept = {"series": without_deleted(read["series"], gone, ["series_id"])}
    kept |= {name: without_deleted(df, episodes, ["episode_id"]) for name, df in read.items() if "episode_id" in df.columns}
    return tables.commit(kept, base), asked.join(gone, "series_id", "left_anti")


def change_tables(tables: Tables, changes: dict[str, Callable[[DataFrame], DataFrame]]) -> int:
    """Change several tables in one commit, each by a function of its present rows (``resolve_issues``, new segments)."""
    base = tables.version()
    return tables.commit({name: change(tables.read(name, base)) for name, change in changes.items()}, base)


def replace_partitions(df: DataFrame, path: str, key: str = "episode_id") -> None:
    """Overwrite only the partitions present in ``df``.

    Rows are spread by range over the key and the rest of the row, so that one large episode is
    written by many tasks.
    """
    spread = df.repartitionByRange(F.col(key), F.xxhash64(*df.columns))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def frozen_run_changes(runs: DataFrame, now: DataFrame) -> DataFrame:
    """Runs that cannot resume, with what changed first: configuration, source or code."""
    n = now.select("run_id", *[F.col(c).alias(f"__{c}") for c in ("config_sha256", "input_sha256", "code_sha256")])
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    reason = (
        F.when(changed("config_sha256"), "CONFIG_CHANGED").when(changed("input_sha256"), "SOURCE_CHANGED")
        .when(changed("code_sha256"), "CODE_CHANGED"))
    return runs.join(n, "run_id", "left").select("run_id", reason.alias("reason")).where("reason IS NOT NULL")


def export_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Whitelisted columns of each table as JSON rows; paths and secrets are never selected."""
    out = None
    for name, df in tables.items():
        doc = F.to_json(F.struct(*EXPORT_COLUMNS[name]), {"ignoreNullFields": "false"})
        part = df.select(F.lit(name).alias("table_name"), doc.alias("doc"))
        out = part if out is None else out.unionByName(part)
    return out


def export_manifest(rows: DataFrame, order: Sequence[str] = ("doc",), *, leaf_rows: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per exported table its rows, bytes, leaves and the root of a SHA-256 hash tree over its documents.

    Tables have no order of their own, so documents are taken in the order of their text unless ``order`` names columns (a position in the
    file) that come first.
    """
    order = [*order] if "doc" in order else [*order, "doc"]
    return hash_tree(rows, ["table_name"], order, "doc", leaf_rows=leaf_rows, block_rows=block_rows)


def write_export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the export as text per table; returns ``path, bytes, sha256`` of every file written."""
    export_rows(tables).write.mode("overwrite").partitionBy("table_name").text(f"{path}/tables")
    files = tables[next(iter(tables))].sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/tables")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


