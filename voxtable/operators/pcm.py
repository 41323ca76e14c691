"""Sample-exact mixing on blocks of interleaved stereo samples.

A block is ``rate`` frames (one second). Everything that touches a block is first cut to the block, so
a task works on one second at a time and a long film is as parallel as it is long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxtable.operators.intervals import coalesce_intervals, uncovered_words

RATE = 48_000


def frame_of(ms: Column, rate: int = RATE) -> Column:
    """Frame number of a time, half-even."""
    return F.bround(ms * rate / 1000).cast("long")


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _ramp(frames: np.ndarray, lo: int, hi: int, ramp: int) -> np.ndarray:
    """Gain that rises over the first frames of ``[lo, hi)`` and falls over the last."""
    if not ramp:
        return np.ones(len(frames))
    return np.clip(np.minimum(np.minimum(1.0, (frames - lo + 1) / ramp), (hi - frames) / ramp), 0.0, 1.0)


#: Frames and blocks that a Python step holds before it hands them on: 64 seconds at 48 kHz.
HELD_FRAMES, HELD_BLOCKS = 64 * RATE, 4096


def _folded(pieces: DataFrame, names: Sequence[str], values: Sequence[str], out: str, begin: Callable, add: Callable, finish: Callable) -> DataFrame:
    """Per key one array out of its pieces: ``begin()``, ``add(state, *values)`` a piece, ``finish(state)``.

    Pieces are dealt by key and sorted, so that a task walks through many short keys in a batch and holds one state. The last of
    ``values`` is an array, the others are numbers.
    """
    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField(out, pieces.schema[values[-1]].dataType)])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done, held = None, None, [], 0

        def packed() -> pa.RecordBatch:
            keys = [pa.array(c, t) for c, t in zip(zip(*[k for k, _ in done]), kinds)]
            ends = np.cumsum([0, *[len(a) for _, a in done]]).astype("int32")
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a for _, a in done]), kinds[-1].value_type), type=kinds[-1])
            return pa.RecordBatch.from_arrays([*keys, arrays], names=schema.names)

        for batch in batches:
            numbers = [batch.column(n).to_pylist() for n in values[:-1]]
            lists = batch.column(values[-1])
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(zip(*[batch.column(n).to_pylist() for n in names])):
                if key != last:
                    if last is not None:
                        done.append((last, finish(state)))
                        held += len(done[-1][1]) // 2
                        if held >= HELD_FRAMES or len(done) == HELD_BLOCKS:
                            yield packed()
                            done, held = [], 0
                    last, state = key, begin()
                add(state, *[c[i] for c in numbers], flat[ends[i]:ends[i + 1]])
        if last is not None:
            done.append((last, finish(state)))
            yield packed()

    held = pieces.select(*names, *values)
    return held.repartition(*names).sortWithinPartitions(*names).mapInArrow(work, schema)


def clip_pieces(clips: DataFrame, keys: Sequence[str], *, rate: int = RATE, ramp: int = 0) -> DataFrame:
    """Cut clips (``left, right`` frames and samples) to blocks and add up those of a block.

    A clip whose length differs from its slot is read at proportional positions. Pieces are summed per
    task before the shuffle, so a block that many clips touch arrives as a few dense arrays, and these
    are added one after the other.
    """
    fields = f"{_key_types(clips, keys)}, block_no bigint, samples array<double>"
    names = [*keys, "block_no"]

    def pieces(row: dict) -> Iterator[tuple]:
        left, right = int(row["left"]), int(row["right"])
        voice = np.asarray(row["samples"], dtype="float64").reshape(-1, 2)
        for block in range(left // rate, (right - 1) // rate + 1):
            frames = np.arange(max(left, block * rate), min(right, (block + 1) * rate))
            source = np.minimum(len(voice) - 1, (frames - left) * len(voice) // (right - left))
            yield (*[row[k] for k in keys], block), frames - block * rate, voice[source] * _ramp(frames, left, right, ramp)[:, None]

    def flushed(total: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, values.ravel()) for key, values in total.items()], columns=[*names, "samples"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for key, at, part in pieces(row):
                    total.setdefault(key, np.zeros((rate, 2)))[at] += part
                if len(total) * rate > HELD_FRAMES or len(total) > HELD_BLOCKS:
                    yield flushed(total)
                    total = {}
        yield flushed(total)

    def add(total: np.ndarray, part: np.ndarray) -> None:
        total += part

    usable = clips.where("left < right AND size(samples) > 0")
    return _folded(usable.mapInPandas(cut, fields), names, ["samples"], "samples", lambda: np.zeros(2 * rate), add, lambda total: total)


def block_masks(words: DataFrame, keys: Sequence[str], *, rate: int = RATE) -> DataFrame:
    """Union of word spans in frames, cut to blocks: at most half a block of disjoint ranges each."""
    spans = words.select(*keys, frame_of(F.col("s"), rate).alias("start_ms"), frame_of(F.col("e"), rate).alias("end_ms")).where("start_ms < end_ms")
    merged = coalesce_intervals(spans, keys, gap_ms=0)
    cut = merged.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start_ms") / rate).cast("long"), F.floor((F.col("end_ms") - 1) / rate).cast("long"))))
    lo = F.greatest(F.col("start_ms") - F.col("block_no") * rate, F.lit(0))
    hi = F.least(F.col("end_ms") - F.col("block_no") * rate, F.lit(rate))
    return cut.groupBy(*keys, "block_no").agg(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("mask"))


def stem_mix(blocks: DataFrame, words: DataFrame, clips: DataFrame, keys: Sequence[str], *, rate: int = RATE) -> DataFrame:
    """Three stems plus voice: speech is silenced under the words, stems and clips are added, then clipped.

    ``blocks``: keys, ``block_no, speech, music, effects``. Output: keys, ``block_no, samples, clipped``.
    """
    voices = clip_pieces(clips, keys, rate=rate).withColumnRenamed("samples", "voice")
    joined = blocks.join(block_masks(words, keys, rate=rate), [*keys, "block_no"], "left").join(voices, [*keys, "block_no"], "left")
    fields = f"{_key_types(blocks, keys)}, block_no bigint, samples array<smallint>, clipped bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                speech = np.array(row["speech"], dtype="float32").reshape(-1, 2)
                for span in row["mask"] if row["mask"] is not None else ():
                    speech[span["lo"]:span["hi"]] = 0
                mixed = speech + np.asarray(row["music"], dtype="float32").reshape(-1, 2) + np.asarray(row["effects"], dtype="float32").reshape(-1, 2)
                if row["voice"] is not None:
                    mixed += np.asarray(row["voice"], dtype="float32").reshape(-1, 2)[:len(mixed)]
                loud = int(np.count_nonzero(np.abs(mixed) > 32767))
                rows.append((*[row[k] for k in keys], row["block_no"], np.clip(mixed, -32768, 32767).astype("int16").ravel(), loud))
            yield pd.DataFrame(rows, columns=[*keys, "block_no", "samples", "clipped"])

    return joined.select(*keys, "block_no", "speech", "music", "effects", "mask", "voice").mapInPandas(run, fields)


def dialogue_pieces(windows: DataFrame, keys: Sequence[str], *, rate: int = RATE) -> DataFrame:
    """Separated dialogue windows (``left, right`` frames and samples) as one track per block.

    Where windows overlap, the one that starts first counts. Pieces of a block stream in; each frame keeps the start of the
    window that it shows, so the order of arrival does not matter.
    """
    fields = f"{_key_types(windows, keys)}, block_no bigint, lo bigint, hi bigint, w_left bigint, w_right bigint, samples array<smallint>"

    names = [*keys, "block_no", "lo", "hi", "w_left", "w_right", "samples"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                left, voice = int(row["left"]), np.asarray(row["samples"], dtype="int16").reshape(-1, 2)
                right = min(int(row["right"]), left + len(voice))
                for block in range(left // rate, (right - 1) // rate + 1):
                    lo, hi = max(left, block * rate), min(right, (block + 1) * rate)
                    rows.append((*[row[k] for k in keys], block, lo - block * rate, hi - block * rate, left, right, voice[lo - left:hi - left].ravel()))
                    held += hi - lo
                    if held >= HELD_FRAMES or len(rows) == HELD_BLOCKS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def blank() -> tuple:
        none = np.iinfo("int64").max
        return np.zeros((rate, 2), dtype="int16"), np.full(rate, none), np.full(rate, none)

    def paint(state: tuple, lo: int, hi: int, left: int, right: int, samples: np.ndarray) -> None:
        track, since, until = (x[lo:hi] for x in state)
        earlier = (left < since) | ((left == since) & (right < until))
        track[earlier] = samples.astype("int16").reshape(-1, 2)[earlier]
        since[earlier], until[earlier] = left, right

    usable = windows.where("left < right AND size(samples) > 0")
    return _folded(usable.mapInPandas(cut, fields), [*keys, "block_no"], names[-5:], "dialogue", blank, paint, lambda state: state[0].ravel())


def subtract_mix(
    blocks: DataFrame, words: DataFrame, clips: DataFrame, windows: DataFrame, keys: Sequence[str], *, rate: int = RATE, ramp_ms: int = 5
) -> DataFrame:
    """Source minus separated dialogue under the words, plus voice, with short ramps at every edge.

    ``blocks``: keys, ``block_no, samples``. The whole episode is mixed or none of it: where any word lacks separated dialogue,
    ``uncovered`` counts such words and every block of the episode stays as it is, voice left out too.
    """
    ramp = rate * ramp_ms // 1000
    voices = clip_pieces(clips, keys, rate=rate, ramp=ramp).withColumnRenamed("samples", "voice")
    spans = words.select(*keys, frame_of(F.col("s"), rate).alias("a"), frame_of(F.col("e"), rate).alias("b")).where("a < b").distinct()
    # Words that overlap are one span, so dialogue is taken away once; spans that touch keep their own ramps.
    apart = coalesce_intervals(spans, keys, "a", "b", gap_ms=0, inclusive=False).select(*keys, F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    cut = apart.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("a") / rate).cast("long"), F.floor((F.col("b") - 1) / rate).cast("long"))))
    held = windows.select(*keys, F.col("left").cast("long").alias("start_ms"), F.least(F.col("right"), F.col("left") + F.size("samples") / 2).cast("long").alias("end_ms")).where("start_ms < end_ms")
    refused = uncovered_words(spans.withColumnsRenamed({"a": "s", "b": "e"}), held, keys).groupBy(*keys).agg(F.count("*").alias("uncovered"))
    # Spans lie apart, so a block holds at most one a frame.
    masks = cut.groupBy(*keys, "block_no").agg(F.collect_list(F.struct("a", "b")).alias("mask"))
    on = [*keys, "block_no"]
    joined = blocks.join(masks, on, "left").join(voices, on, "left").join(dialogue_pieces(windows, keys, rate=rate), on, "left")
    joined = joined.join(refused, list(keys), "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))
    fields = f"{_key_types(blocks, keys)}, block_no bigint, samples array<smallint>, clipped bigint, uncovered bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                source = np.asarray(row["samples"], dtype="float64").reshape(-1, 2)
                n, base = len(source), int(row["block_no"]) * rate
                mixed, missing = source.copy(), int(row["uncovered"])
                if row["voice"] is not None:
                    mixed += np.asarray(row["voice"]).reshape(-1, 2)[:n]
                for span in row["mask"] if row["mask"] is not None and not missing else ():
                    frames = np.arange(max(span["a"], base), min(span["b"], base + n))
                    at = frames - base
                    speech = np.asarray(row["dialogue"], dtype="float64").reshape(-1, 2)[at]
                    mixed[at] -= speech * _ramp(frames, span["a"], span["b"], ramp)[:, None]
                final = source if missing else np.clip(np.rint(mixed), -32768, 32767)
                rows.append((*[row[k] for k in keys], row["block_no"], final.astype("int16").ravel(),
                             int(np.count_nonzero(np.abs(final) >= 32767)), missing))
            yield pd.DataFrame(rows, columns=[*keys, "block_no", "samples", "clipped", "uncovered"])

    return joined.select(*on, "samples", "mask", "voice", "dialogue", "uncovered").mapInPandas(run, fields)


def passthrough(blocks: DataFrame, dubs: DataFrame, windows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split blocks into those of episodes to mix and those to copy: no dubbed line, or no windows."""
    ready = dubs.select(*keys).distinct().join(windows.select(*keys).distinct(), list(keys))
    return blocks.join(ready, list(keys), "left_semi"), blocks.join(ready, list(keys), "left_anti")
