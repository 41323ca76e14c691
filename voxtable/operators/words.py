"""Word-level operators on rows that carry their own word array. No shuffle: one row, one result."""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable.functions import text as tx
from voxtable.functions.binding import let
from voxtable.schemas import WORD
from voxtable.session import few_words, spread

GAP_MS, MIN_MS, MAX_MS = 400, 800, 12_000
MIN_SCORE, MIN_SPAN_MS = 0.01, 100

_TAIL = regex.compile(r"[\s\p{P}\p{S}\x1c-\x1f]*")


# --- alignment verdicts -----------------------------------------------------------------------

def to_ms(seconds: Column) -> Column:
    """Model seconds to milliseconds, half-even; null when not finite or negative."""
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(good, F.bround(seconds * 1000).cast("long"))


def word_verdict(word: Column, start_ms: Column, end_ms: Column) -> Column:
    """Reason code of one raw aligned word, null when it is good."""
    s, e, score = to_ms(word["start"]), to_ms(word["end"]), word["score"]
    return (
        F.when(s.isNull() | e.isNull() | score.isNull(), "MISSING_OR_INVALID_WORD_ALIGNMENT")
        .when(~((start_ms <= s) & (s < e) & (e <= end_ms)), "WORD_OUTSIDE_ASR_WINDOW")
        .when(F.isnan(score) | ~score.between(MIN_SCORE, 1), "LOW_CTC_MATCH_SCORE")
    )


def _units(col: Column) -> Column:
    # \p{L}\p{N} is the JVM-side test for "has letters or digits"; exact folding is text_units.
    return F.regexp_replace(col, r"[^\p{L}\p{N}]", "")


def alignment_verdicts(segments: DataFrame, raw: str = "raw_words") -> DataFrame:
    """Add ``words`` (accepted) and ``reason`` (first problem in word order, else of the whole group)."""
    def judged_words(b: Column) -> Column:
        kept = F.filter(b["raw"], lambda w: F.char_length(_units(F.coalesce(w["word"], F.lit("")))) > 0)
        return F.transform(kept, lambda w: F.struct(
            tx.strip(w["word"]).alias("t"), to_ms(w["start"]).alias("s"), to_ms(w["end"]).alias("e"),
            word_verdict(w, b["lo"], b["hi"]).alias("reason")))

    judged = let({"raw": F.col(raw), "lo": F.col("start_ms"), "hi": F.col("end_ms")}, judged_words)
    # Exploding the one result keeps the judging from being computed again for every use below.
    out = spread(segments).withColumn("__w", F.explode(F.array(judged)))
    w = F.col("__w")
    # One pass in word order: a word's own problem comes before its order problem.
    start = F.struct(F.lit(None).cast("long").alias("until"), F.lit(None).cast("string").alias("reason"))
    walk = F.aggregate(
        w, start,
        lambda a, x: F.struct(
            x["e"].alias("until"),
            F.coalesce(a["reason"], x["reason"], F.when(a["until"] > x["s"], "NON_MONOTONIC_WORD_ALIGNMENT")).alias("reason"),
        ),
        lambda a: a["reason"],
    )
    out = out.withColumn("__first", walk)
    # Marked nondeterministic so that a filter on the verdict is not pushed below the Python step.
    covers = tx.same_units.asNondeterministic()
    out = out.withColumn("__covers", covers(F.array_join(F.transform(w, lambda x: x["t"]), ""), F.col("zh_text")))
    span = F.element_at(w, -1)["e"] - F.element_at(w, 1)["s"]
    reason = (
        F.when(F.col("__first").isNotNull(), F.col("__first"))
        .when((F.size(w) == 0) | ~F.col("__covers"), "INCOMPLETE_TEXT_ALIGNMENT")
        .when(span < MIN_SPAN_MS, "COLLAPSED_UTTERANCE_ALIGNMENT")
    )
    out = out.withColumn("reason", reason)
    words = F.transform(w, lambda x: F.struct(x["t"], x["s"], x["e"]))
    empty = F.array().cast(f"array<{WORD}>")
    out = out.withColumn("words", F.when(F.col("reason").isNull(), words).otherwise(empty))
    return out.drop("__w", "__first", "__covers")


def alignment_rollup(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Aligned lines, whether every line has word times, the status that follows, and the media time judged."""
    timed = F.bool_and(F.size("words") > 0)
    return verdicts.groupBy(*keys).agg(
        F.count_if(F.col("reason").isNull()).alias("aligned_segments"), timed.alias("word_timing_available"),
        F.when(timed, "ALIGNED").otherwise("PARTIAL_REVIEW_REQUIRED").alias("alignment_status"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("processed_media_ms"))


def review_fallback(segments: DataFrame) -> DataFrame:
    """A rejected group keeps its text and window, loses words and confidence, and goes to review."""
    bad = F.col("reason").isNotNull()
    return (
        segments.withColumn("action", F.when(bad, "NEEDS_REVIEW").otherwise(F.col("action")))
        .withColumn("needs_review", bad | F.col("needs_review"))
        .withColumn("confidence", F.when(~bad, F.col("confidence")))
    )


def native_words(df: DataFrame, raw: str = "raw_words") -> DataFrame:
    """Split native recogniser words into ``words`` inside the window and ``issues`` rows."""
    def sorted_out(b: Column) -> Column:
        inside = lambda w: (w["s"] >= b["lo"]) & (w["s"] < w["e"]) & (w["e"] <= b["hi"])
        # In word order: inside but too short to be real, or not inside at all.
        doubtful = F.filter(b["t"], lambda w: ~inside(w) | (w["e"] - w["s"] < 20))
        found = F.transform(doubtful, lambda w: F.struct(
            F.when(inside(w), "VERY_SHORT_NATIVE_WORD_TIME").otherwise("INVALID_NATIVE_WORD_TIME").alias("code"),
            w["t"].alias("token"), w["s"].alias("s"), w["e"].alias("e")))
        untimed = F.array(F.struct(F.lit("NATIVE_WORD_TIMING_UNAVAILABLE").alias("code"), F.lit(None).cast("string").alias("token"),
                                   F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e")))
        issues = F.when(F.exists(b["t"], inside), found).otherwise(F.concat(found, untimed))
        return F.struct(F.filter(b["t"], inside).alias("words"), issues.alias("issues"))

    def timed(b: Column) -> Column:
        return F.transform(b["raw"], lambda w: F.struct(
            w["word"].alias("t"), (b["lo"] + F.bround(w["start"] * 1000)).cast("long").alias("s"),
            (b["lo"] + F.bround(w["end"] * 1000)).cast("long").alias("e")))

    window = {"lo": F.col("start_ms"), "hi": F.col("end_ms")}
    split = let({"raw": F.col(raw), **window}, lambda b: let({"t": timed(b), "lo": b["lo"], "hi": b["hi"]}, sorted_out))
    # Exploding the one result keeps it from being computed again for each field.
    out = spread(df).withColumn("__r", F.explode(F.array(split)))
    return out.withColumn("words", F.col("__r.words")).withColumn("issues", F.col("__r.issues")).drop("__r")


def dub_decision(df: DataFrame, text: str = "zh_text", words: str = "words", speakers: str = "speaker_ids") -> DataFrame:
    """KEEP exclamations, overlaps and lines without word times; DUB the rest."""
    overlap, silent = F.size(speakers) != 1, F.size(words) == 0
    shout = tx.nonverbal(F.col(text))
    return (
        df.withColumn("speech_kind", F.when(shout, "nonverbal").otherwise("lexical"))
        .withColumn("action", F.when(overlap | shout | silent, "KEEP").otherwise("DUB"))
        .withColumn("needs_review", overlap | silent)
        .withColumn("speaker_id", F.when(~overlap, F.get(speakers, 0)))
        .withColumn("track_id", F.when(overlap, "overlap").otherwise(F.get(speakers, 0)))
    )


_NONE = -(1 << 60)  # stands for "no bound yet"


def _running_max(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running maximum inside each run of ``sizes`` values, by ranks, so that one pass serves all runs."""
    kinds, rank = np.unique(values, return_inverse=True)
    base = np.repeat(np.arange(len(sizes)), sizes) * len(kinds)
    return kinds[np.maximum.accumulate(base + rank) - base]


def _repaired(words: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """A word ends one millisecond behind the one before it or at its own end, whichever is later. In the max-plus algebra that is a
    running maximum of (own end less position), so a row of any length takes one linear pass."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    own = lambda name, instead: pc.fill_null(pc.struct_field(flat, name), instead).to_numpy(zero_copy_only=False).astype(np.int64)
    bound = lambda column, instead: np.repeat(pc.fill_null(column, instead).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    start, end, low, high = own("s", _NONE), own("e", _NONE), bound(lo, _NONE), bound(hi, -_NONE)
    at = np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    reach = np.maximum(np.where(start > _NONE, start + 1, _NONE), end)
    # ``free`` is where the word would end without the chunk's end, ``before`` where the one before it would.
    free = np.maximum(_running_max(np.where(reach > _NONE, reach - at, _NONE), sizes), np.where(low > _NONE, low + 1, _NONE))
    free = np.where(free > _NONE, free + at, _NONE)
    before = np.where(at == 0, low, np.minimum(np.r_[_NONE, free[:-1]][: len(free)], high))
    begin = np.maximum(start, before)
    over = free > high
    latest = np.maximum(low, high - 1)
    begin = np.where(over, np.where(begin > _NONE, np.minimum(begin, latest), latest), begin)
    ended = np.where(over, high, free)
    times = [pa.array(x, pa.int64(), mask=x == _NONE) for x in (begin, ended)]
    fixed = pa.StructArray.from_arrays([pc.struct_field(flat, "t"), *times], names=["t", "s", "e"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), fixed, mask=pc.is_null(words))


def repaired_words(df: DataFrame, words: str = "words", chunk_start: str = "start_ms", chunk_end: str = "end_ms") -> DataFrame:
    """Force aligned words to be ordered and inside the chunk, one millisecond long at least; the words are replaced."""
    plain = F.transform(words, lambda w: F.struct(w["t"].alias("t"), w["s"].cast("long").alias("s"), w["e"].cast("long").alias("e")))
    bound = df.withColumns({words: plain, "__lo": F.col(chunk_start).cast("long"), "__hi": F.col(chunk_end).cast("long")})
    kept = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = _repaired(batch.column(words), batch.column("__lo"), batch.column("__hi"))
            yield pa.RecordBatch.from_arrays([fixed if c == words else batch.column(c) for c in kept], names=kept)

    return spread(bound).mapInArrow(work, bound.select(*kept).schema)


# --- utterance kernel ---------------------------------------------------------------------------

def locate(text: str, tokens: list[str]) -> tuple[list[int], list[int], list[str]]:
    """Per token: offset in the text (-1 when not found), where its punctuation ends, and that punctuation."""
    at, reach = [], 0
    for token in tokens:
        pos = text.find(token, reach) if token else -1
        at.append(pos)
        if pos >= 0:
            reach = pos + len(token)
    tails, marks = [-1] * len(tokens), [""] * len(tokens)
    upper = len(text)
    for i in range(len(tokens) - 1, -1, -1):
        if at[i] < 0:
            continue
        stop = at[i] + len(tokens[i])
        tails[i] = _TAIL.match(text, stop, upper).end()
        marks[i] = "".join(text[stop:tails[i]].split())
        upper = at[i]
    return at, tails, marks


def utterance_cuts(
    starts: list[int], ends: list[int], marks: list[str], *, gap_ms: int, min_ms: int, max_ms: int
) -> list[tuple[int, int]]:
    """Ranges ``[a, b)`` of words that form one utterance each."""
    n = len(starts)
    closes = [any(c in tx.SENTENCE_END for c in m) for m in marks]
    pauses = [any(c in tx.CLAUSE_END for c in m) for m in marks]
    length = lambda a, b: ends[b - 1] - starts[a]

    pieces, head = [], 0
    for i in range(n - 1):
        if starts[i + 1] - ends[i] >= gap_ms or (closes[i] and length(head, i + 1) >= min_ms):
            pieces.append((head, i + 1))
            head = i + 1
    pieces.append((head, n))

    done: list[tuple[int, int]] = []
    todo = pieces[::-1]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or length(a, b) <= max_ms:
            done.append((a, b))
            continue
        options = [
            (starts[c] - ends[c - 1] + (1000 if closes[c - 1] else 250 if pauses[c - 1] else 0),
             -abs(length(a, c) - length(c, b)), -c)
            for c in range(a + 1, b)
            if length(a, c) >= min_ms and length(c, b) >= min_ms
        ]
        cut = -max(options)[2] if options else a + max(1, (b - a) // 2)
        todo += [(cut, b), (a, cut)]

    # Join short pieces to the nearer neighbour. A merge only makes its neighbours less able to
    # merge, so everything before the merged piece is settled and one forward pass is enough.
    i = 0
    while i < len(done):
        a, b = done[i]
        sides = []
        if length(a, b) < min_ms:
            for left in (i - 1, i):
                if 0 <= left and left + 1 < len(done):
                    gap = starts[done[left + 1][0]] - ends[done[left][1] - 1]
                    if gap < 2 * gap_ms and length(done[left][0], done[left + 1][1]) <= max_ms:
                        sides.append((gap, left))
        if sides:
            left = min(sides)[1]
            done[left:left + 2] = [(done[left][0], done[left + 1][1])]
            i = left
        else:
            i += 1
    return done


def utterances(
    text: str, words: list, window: tuple[int, int] | None = None, *,
    gap_ms: int = GAP_MS, min_ms: int = MIN_MS, max_ms: int = MAX_MS,
) -> list[dict]:
    """Utterances of one recogniser segment. ``words`` are ``(t, s, e)``; ``window`` keeps starts in [lo, hi)."""
    if not words:
        return []
    at, tails, marks = locate(text, [w[0] for w in words])
    own = [i for i, w in enumerate(words) if window is None or window[0] <= w[1] < window[1]]
    if not own:
        return []
    cuts = utterance_cuts([words[i][1] for i in own], [words[i][2] for i in own], [marks[i] for i in own],
                          gap_ms=gap_ms, min_ms=min_ms, max_ms=max_ms)
    out = []
    for a, b in cuts:
        first, last = own[a], own[b - 1]
        found = at[first] >= 0 and at[last] >= 0
        wording = text[at[first]:tails[last]].strip() if found else ""
        out.append({
            "start_ms": words[first][1], "end_ms": words[last][2],
            "text": wording or " ".join(words[i][0] for i in own[a:b]),
            "words": [words[i] for i in own[a:b]],
        })
    return out


UTTERANCE = f"start_ms bigint, end_ms bigint, text string, words array<{WORD}>"


def build_utterances(
    segments: DataFrame, carry: list[str], *, text: str = "zh_text", words: str = "words",
    lo: str | None = None, hi: str | None = None, gap_ms: int = GAP_MS, min_ms: int = MIN_MS, max_ms: int = MAX_MS,
    min_span_ms: int = 0,
) -> DataFrame:
    """One row per utterance: ``carry`` columns, ``utterance_no`` and the utterance fields.

    A segment with an utterance shorter than ``min_span_ms`` gives no rows at all.
    """
    names = [f.name for f in segments.schema.fields if f.name in carry]
    schema = T.StructType([f for f in segments.schema.fields if f.name in carry] + T._parse_datatype_string(f"utterance_no bigint, {UTTERANCE}").fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_words(batches, words):
            at, made = [], []
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i].as_py()
                listed = [(w["t"], int(w["s"]), int(w["e"])) for w in value(words)]
                window = (value(lo), value(hi)) if lo else None
                found = utterances(value(text), listed, window, gap_ms=gap_ms, min_ms=min_ms, max_ms=max_ms)
                if any(u["end_ms"] - u["start_ms"] < min_span_ms for u in found):
                    continue
                at += [i] * len(found)
                made += [(n, u["start_ms"], u["end_ms"], u["text"], [{"t": t, "s": s, "e": e} for t, s, e in u["words"]]) for n, u in enumerate(found)]
            if made:
                kept = [batch.column(n).take(pa.array(at)).cast(kinds.field(n).type) for n in names]
                own = [pa.array(c, f.type) for c, f in zip(zip(*made), list(kinds)[len(names):])]
                yield pa.RecordBatch.from_arrays([*kept, *own], names=kinds.names)

    need = [*names, *[c for c in (text, words, lo, hi) if c and c not in names]]
    return spread(segments.select(*need)).mapInArrow(run, schema)


def slot_bounds(utts: DataFrame, keys: list[str], slot_start: str = "slot_start", slot_end: str = "slot_end") -> DataFrame:
    """First utterance starts at the slot start and the last ends at the slot end; words are untouched.

    ``keys`` name one recogniser segment, so a window group holds the utterances of a single row.
    """
    last = F.max("utterance_no").over(W.partitionBy(*keys))
    out = utts.withColumn("__last", last)
    return (
        out.withColumn("start_ms", F.when(F.col("utterance_no") == 0, F.col(slot_start)).otherwise(F.col("start_ms")))
        .withColumn("end_ms", F.when(F.col("utterance_no") == F.col("__last"), F.col(slot_end)).otherwise(F.col("end_ms")))
        .drop("__last", slot_start, slot_end)
    )


def _alnum_count(text: str) -> int:
    return sum(c.isalnum() for c in unicodedata.normalize("NFKC", text))


def sentence_cuts(text: str, tokens: list[str]) -> list[tuple[int, int, str]]:
    """Word ranges and wording of each sentence; one range when the text cannot be mapped to the words."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if c.isalnum())
    whole = [(0, len(tokens), text)]
    if not tokens or fold(text) != fold("".join(tokens)):
        return whole
    ahead = [0, *accumulate(_alnum_count(c) for c in text)]
    out, head, begin, at = [], 0, 0, 0
    for i, token in enumerate(tokens):
        need = _alnum_count(token)
        stop = max(at, bisect.bisect_left(ahead, ahead[at] + need)) if need else at
        # Marks and blanks after the word belong to it.
        stop = max(stop, bisect.bisect_right(ahead, ahead[stop]) - 1)
        if any(c in tx.SENTENCE_CUT for c in text[at:stop]):
            out.append((head, i + 1, text[begin:stop]))
            head, begin = i + 1, stop
        at = stop
    if head < len(tokens):
        out.append((head, len(tokens), text[begin:]))
    return out if len(out) > 1 else whole


def split_sentences(segments: DataFrame, *, text: str = "zh_text", words: str = "words", ident: str = "segment_id") -> DataFrame:
    """Split segments after sentence marks at native word bounds; new ids end in ``:s<n>``."""
    kinds = to_arrow_schema(segments.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_words(batches, words):
            rows = []
            for i in range(batch.num_rows):
                record = {c: batch.column(c)[i].as_py() for c in kinds.names}
                listed = record[words]
                cuts = sentence_cuts(record[text], [w["t"] for w in listed])
                if len(cuts) == 1:
                    rows.append(record)
                    continue
                for n, (a, b, wording) in enumerate(cuts):
                    rows.append({**record, ident: f"{record[ident]}:s{n}", text: wording, words: listed[a:b],
                                 "start_ms": listed[a]["s"], "end_ms": listed[b - 1]["e"]})
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], names=kinds.names)

    return spread(segments).mapInArrow(run, segments.schema)
