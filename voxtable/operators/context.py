"""Dialogue context, glossary and translation-batch operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions import text as tx
from voxtable.operators.scan import keyed_fold, neighbours, null_safe_join, row_index
from voxtable.session import spread, staged

SEEDS = (8, 4, 2, 1)  # Lengths of term heads, longest first.


def nearby_dialogue(
    lines: DataFrame, keys: Sequence[str], index: str = "ord", *, text: str = "zh_text", speaker: str = "speaker_id",
    reach: int = 3, limit: int = 600,
) -> DataFrame:
    """Add ``nearby`` (rows around and including the line, with speakers) and ``nearby_text`` (without it)."""
    pair = F.struct(F.col(speaker).alias("speaker_id"), F.col(text).alias("zh_text"))
    out = neighbours(lines, keys, index, reach, reach, {"nearby": (pair, True), "__others": (F.col(text), False)})
    return out.withColumn("nearby_text", F.substring(F.array_join("__others", " / "), 1, limit)).drop("__others")


def numbered_batches(lines: DataFrame, keys: Sequence[str], order: Sequence[str], *, size: int = 10) -> DataFrame:
    """Fixed-size batch number, position in the batch and short alias of each line."""
    placed = row_index(lines, keys, order, "__i")
    return (
        placed.withColumn("batch_no", F.floor(F.col("__i") / size).cast("long"))
        .withColumn("pos", (F.col("__i") % size).cast("long"))
        .withColumn("alias", F.concat(F.lit("s"), (F.col("pos") + 1).cast("string")))
        .drop("__i")
    )


def packed_batches(
    lines: DataFrame, keys: Sequence[str], index: str = "ord", tokens: str = "tokens", *, max_lines: int = 4,
    max_tokens: int = 4096, block_rows: int = 4096,
) -> DataFrame:
    """Greedy packing: each batch takes up to ``max_lines`` lines while their tokens fit.

    Where a batch starting at a line would end depends on that line and the next few only. So every
    line first gets its own jump length; a block of lines then maps each possible entry offset to the
    offset at which the chain of batches leaves it, and only these small maps are walked per key. Lines are numbered here, in
    the order of ``index``, which may start anywhere and have gaps; null tokens count as none.
    Output: one row per batch with ``first_ord, lines, tokens, too_long``.
    """
    numbered = row_index(lines.select(*keys, index, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__tok")), keys, [index], "__i")
    ahead = neighbours(numbered, keys, "__i", 0, max_lines - 1, {"__t": (F.col("__tok"), True)})
    sums = F.transform("__t", lambda _, i: F.aggregate(F.slice("__t", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    jumps = (
        ahead.withColumn("__s", sums)
        .withColumn("lines", F.greatest(F.lit(1), F.size(F.filter("__s", lambda x: x <= max_tokens))).cast("long"))
        .withColumn("batch_tokens", F.get("__s", F.col("lines").cast("int") - 1))
        .withColumn("__blk", F.floor(F.col("__i") / block_rows).cast("long"))
    )
    jumps = staged(jumps.drop("__t", "__s", "__tok"))
    blocks = jumps.groupBy(*keys, "__blk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("lines").alias("n")))),
                    lambda r: r["n"]).alias("__jumps"),
    )
    entries = F.array(*[F.lit(e).cast("long") for e in range(max_lines)])

    def leave(entry: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), entry.alias("next"))
        walked = F.aggregate("__jumps", start, lambda a, n: F.struct(
            (a["at"] + 1).alias("at"), F.when(a["at"] == a["next"], a["next"] + n).otherwise(a["next"]).alias("next")))
        return walked["next"] - F.size("__jumps")

    maps = blocks.select(*keys, "__blk", F.transform(entries, leave).alias("__exit"))

    def enter(state: dict, values: tuple) -> tuple[int]:
        entry = state.get("entry", 0)
        state["entry"] = values[0][entry]
        return (entry,)

    entry = keyed_fold(maps, keys, ["__blk"], ["__exit"], {"__entry": "bigint"}, enter).drop("__exit")

    def begin(state: dict, values: tuple) -> tuple[list[int]]:
        jumps_, at = values
        out = []
        while at < len(jumps_):
            out.append(at)
            at += jumps_[at]
        return (out,)

    both = null_safe_join(blocks, entry, [*keys, "__blk"], "inner")
    starts = keyed_fold(both, [*keys, "__blk"], [], ["__jumps", "__entry"], {"__at": "array<bigint>"}, begin)
    starts = starts.select(*keys, F.explode(F.transform("__at", lambda a: F.col("__blk") * block_rows + a)).alias("__i"))
    return null_safe_join(jumps, starts, [*keys, "__i"], "inner").select(
        *keys, F.col(index).alias("first_ord"), "lines", F.col("batch_tokens").alias("tokens"),
        (F.col("batch_tokens") > max_tokens).alias("too_long"),
    )


def term_matches(lines: DataFrame, terms: DataFrame, keys: Sequence[str], *, text: str, term: str) -> DataFrame:
    """Join every line with the terms that occur in it as a substring (same ``keys``); empty and null terms match nothing.

    One way for any number of terms. The head of a term is its first 8, 4, 2 or 1 characters, the longest that fit. A line
    gives the hashes of its different runs of the head lengths that occur, in one pass over its characters; an equi-join
    on (keys, hash) finds candidates, each a line's hash and a term's, and the whole term is then looked up in the line. Texts are
    not sent with their runs. Lines that agree in every column share their candidates.
    """
    length = F.char_length(term)
    size = F.when(length >= SEEDS[0], SEEDS[0])
    for n in SEEDS[1:]:
        size = size.when(length >= n, n)
    wanted = terms.withColumns({"__len": size, "__tid": F.xxhash64(*_flagged(terms))}).where("__len IS NOT NULL")
    used = sorted(r[0] for r in wanted.select("__len").distinct().collect())  # four lengths at most
    seeded = _run_hashes(wanted.select(*keys, "__tid", F.substr(F.col(term), F.lit(1), F.col("__len")).alias("__text")), [*keys, "__tid"], used, whole=True)
    named = spread(lines).withColumn("__lid", F.xxhash64(*_flagged(lines)))
    runs = _run_hashes(named.select(*keys, "__lid", F.coalesce(F.col(text), F.lit("")).alias("__text")), [*keys, "__lid"], used)
    found = runs.join(seeded, [*keys, "__run"]).select("__lid", "__tid").distinct()
    full = wanted.drop(*keys, "__len").distinct()
    hits = named.join(found, "__lid").join(full, "__tid").where(F.contains(F.col(text), F.col(term)))
    return hits.drop("__lid", "__tid")


def _flagged(df: DataFrame) -> list[Column]:
    # xxhash64 passes over nulls, so that null takes part through its own flag.
    return [c for n in df.columns for c in (F.col(n).isNull(), F.col(n))]


def _run_hashes(df: DataFrame, keep: list[str], sizes: list[int], *, whole: bool = False) -> DataFrame:
    """``keep`` and ``__run``, a hash for every different run of ``sizes`` characters of ``__text``; with ``whole`` of the text itself."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("__run", T.LongType())])

    def hashed(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found = []
        for n in [len(text)] if whole else sizes:
            m = len(points) - n + 1
            if m > 0:
                value = np.full(m, n, np.uint64)
                for k in range(n):
                    value = (value ^ points[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                    value ^= value >> np.uint64(29)
                found.append(value.view(np.int64))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                runs = [hashed(t) for t in part.column("__text").to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(runs)), [len(r) for r in runs]))
                values = np.concatenate(runs) if runs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(owner) for k in keep], pa.array(values)], names=[*keep, "__run"])

    return df.mapInArrow(cut, schema)


def relevant_terms(batches: DataFrame, terms: DataFrame, keys: Sequence[str], batch: Sequence[str], *, text: str, term: str) -> DataFrame:
    """Distinct terms that occur in some line of the batch."""
    hits = term_matches(batches, terms, keys, text=text, term=term)
    wanted = [*dict.fromkeys([*keys, *batch]), term]
    return hits.select(*wanted).distinct()


def locked_term_rejects(
    lines: DataFrame, terms: DataFrame, keys: Sequence[str], batch: Sequence[str], *, source: str, subtitle: str,
    dub: str, term: str, target: str,
) -> DataFrame:
    """Batches that must be rejected: a line has the term but its translation lacks the locked wording."""
    hits = term_matches(lines, terms, keys, text=source, term=term)
    # A missing translation lacks every wording.
    folded = hits.select("*", *[tx.casefold(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((subtitle, "__sub"), (dub, "__dub"), (target, "__want"))])
    missing = folded.where(~F.contains(F.col("__sub"), F.col("__want")) | ~F.contains(F.col("__dub"), F.col("__want")))
    return missing.groupBy(*dict.fromkeys([*keys, *batch])).agg(F.count("*").alias("omissions"))


def with_characters(lines: DataFrame, speakers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Map speaker labels to characters; unmapped or unaddressed lines are uncertain."""
    out = lines.join(speakers, [*keys, "speaker_id"], "left")
    return out.withColumn("uncertain", F.col("character_id").isNull() | F.col("addressee_id").isNull())


RESPONSE_FIELDS = ("id", "subtitle_vi", "dub_vi", "emotion", "punctuation")


def response_items(responses: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Decode replies strictly: ``ok`` tells whether the document has the exact shape."""
    item = "OBJECT<" + ", ".join(f"{f}: STRING" for f in sorted(RESPONSE_FIELDS)) + ">"
    decoded = responses.withColumn("__items", F.from_json(body, T.StructType().add("segments", T.ArrayType(T.VariantType())))["segments"])
    shaped = F.col("__items").isNotNull() & (F.json_object_keys(body) == F.array(F.lit("segments")))
    exact = F.forall("__items", lambda v: F.coalesce(F.schema_of_variant(v) == item, F.lit(False)))
    fields = F.transform("__items", lambda v: F.struct(
        *[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in RESPONSE_FIELDS]))
    return decoded.select(*keys, F.coalesce(shaped & exact, F.lit(False)).alias("ok"), fields.alias("items"))


def matched_translations(lines: DataFrame, responses: DataFrame, keys: Sequence[str], *, ident: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """Match model replies to their batches, all or nothing.

    ``lines`` carry ``keys`` (the batch), ``pos``, ``alias`` and ``ident``. Returns accepted lines with
    ``subtitle_vi, dub_vi, emotion`` and rejected batches with ``reason``. A batch is small by
    construction (its size is fixed), so it is checked as one array row. A batch with several replies is rejected once.
    """
    batch = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(ident).alias("id"), "alias"))).alias("members"))
    replies = responses.groupBy(*keys).agg(F.count("*").alias("__replies"), F.min("body").alias("body"))
    both = batch.join(response_items(replies, [*keys, "__replies"]), list(keys), "left")
    members = F.col("members")
    lookup = F.map_from_arrays(F.transform(members, lambda m: m["alias"]), F.transform(members, lambda m: m["id"]))
    resolved = F.transform("items", lambda r: F.struct(
        F.coalesce(F.try_element_at(lookup, r["id"]), r["id"]).alias("id"),
        tx.strip(r["subtitle_vi"]).alias("subtitle_vi"), tx.strip(r["dub_vi"]).alias("dub_vi"),
        tx.strip(r["emotion"]).alias("emotion"), tx.repaired_mark(r["punctuation"]).alias("mark")))
    both = both.withColumn("__r", resolved)
    ids = F.transform("__r", lambda r: r["id"])
    blank = F.exists("__r", lambda r: (r["subtitle_vi"] == "") | (r["dub_vi"] == "") | (r["emotion"] == ""))
    want = F.transform(members, lambda m: m["id"])
    reason = (
        F.when(F.col("ok").isNull(), "NO_RESPONSE")
        .when(F.col("__replies") > 1, "DUPLICATE_RESPONSE")
        .when(~F.col("ok"), "INVALID_SHAPE")
        .when((F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(ids, lambda i: i == ""), "DUPLICATE_ID")
        .when(blank, "EMPTY_TEXT")
        .when(F.sort_array(ids) != F.sort_array(want), "IDS_DO_NOT_MATCH")
    )
    judged = both.withColumn("reason", reason)
    rejected = judged.where("reason IS NOT NULL").select(*keys, "reason")
    accepted = judged.where("reason IS NULL").select(*keys, F.inline("__r")).select(
        *keys, F.col("id").alias(ident), tx.with_terminal(F.col("subtitle_vi"), F.col("mark")).alias("subtitle_vi"),
        tx.with_terminal(F.col("dub_vi"), F.col("mark")).alias("dub_vi"), "emotion",
    )
    return accepted, rejected


def kept_originals(lines: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of rejected batches: the original speech stays and the line goes to review."""
    return lines.join(rejected, list(keys)).withColumn("action", F.lit("KEEP")).withColumn("needs_review", F.lit(True))


def context_proposals(
    proposals: DataFrame, lines: DataFrame, characters: DataFrame, keys: Sequence[str], series: str = "series_id"
) -> DataFrame:
    """Judge identity proposals: ``accepted`` only with a real quote, known characters and allowed keys.

    ``proposals``: keys, series, ``alias, character_id, addressee_id, addressing, evidence``. The quote
    may come from any line of the batch, so the batch text is joined as one bounded array. A proposal for a line or a batch that
    is not there stays as a row: not ``accepted``, with ``known_line`` false and no ``segment_id``.
    """
    batch = lines.groupBy(*keys).agg(F.collect_list("zh_text").alias("__texts"))
    named = lines.select(*keys, "alias", "segment_id", F.lit(True).alias("known_line"))
    known = characters.select(series, F.col("character_id").alias("__known")).distinct()
    out = null_safe_join(null_safe_join(proposals, named, [*keys, "alias"], "left"), batch, list(keys), "left").withColumn("known_line", F.coalesce("known_line", F.lit(False)))
    for field in ("character_id", "addressee_id"):
        hit = known.select(series, F.col("__known").alias(field), F.lit(True).alias(f"__ok_{field}"))
        out = out.join(hit, [series, field], "left")
    known_ok = lambda f: F.col(f).isNull() | F.col(f"__ok_{f}").isNotNull()
    quoted = (F.char_length("evidence") > 0) & F.exists("__texts", lambda t: F.contains(t, F.col("evidence")))
    keys_ok = F.size(F.array_except(F.map_keys("addressing"), F.array(F.lit("self"), F.lit("other")))) == 0
    good = F.col("known_line") & quoted & known_ok("character_id") & known_ok("addressee_id") & keys_ok & ~F.exists(F.map_values("addressing"), lambda v: v.isNull())
    return out.withColumn("accepted", F.coalesce(good, F.lit(False))).drop("__texts", "__ok_character_id", "__ok_addressee_id")


def memory_lookup(requests: DataFrame, memory: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split requests into translation-memory hits (with ``result``) and misses."""
    return requests.join(memory, list(keys)), requests.join(memory.select(*keys), list(keys), "left_anti")


def usage_totals(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum the valid token counts of each call."""
    def valid(name: str) -> Column:
        # Only whole non-negative numbers count; "12.5", "true" or text do not.
        raw = F.get_json_object("usage", f"$.{name}")
        return F.when(raw.rlike(r"^[0-9]+$") & (F.schema_of_variant(F.try_variant_get(F.try_parse_json("usage"), f"$.{name}", "variant")) == "BIGINT"), raw.cast("long"))

    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(valid(n)).alias(n) for n in names])
