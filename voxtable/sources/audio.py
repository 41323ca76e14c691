"""PCM16 WAV files to one-second sample blocks, and back.

``wav_blocks`` takes files that are already in a cell. ``wav_ranges`` takes paths: a file of any length is read by many tasks, each of
which opens it, reads its header and then only the blocks that begin in its own range of bytes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.sources.files import located, put

#: Bytes of a file that one task reads in a row.
DEALT_BYTES = 1 << 25

BLOCK = "block_no bigint, rate bigint, channels bigint, frames bigint, samples array<smallint>, error string"


def _blocks(content: bytes) -> Iterator[tuple]:
    try:
        with wave.open(io.BytesIO(content), "rb") as wav:
            rate, channels, width = wav.getframerate(), wav.getnchannels(), wav.getsampwidth()
            if width != 2 or channels not in (1, 2) or rate < 1:
                yield 0, rate, channels, 0, None, "NOT_PCM16_MONO_OR_STEREO"
                return
            number = 0
            while True:
                raw = wav.readframes(rate)
                samples = np.frombuffer(raw[:len(raw) - len(raw) % (2 * channels)], dtype="<i2")
                if not len(samples):
                    break
                yield number, rate, channels, len(samples) // channels, samples, None
                number += 1
            if not number:
                yield 0, rate, channels, 0, None, "NO_SAMPLES"
    except (wave.Error, EOFError, RuntimeError):  # a chunk beyond the end of its file is a RuntimeError
        yield 0, None, None, 0, None, "UNREADABLE"


def wav_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Decode WAV rows. One row per second of audio, so later work never needs a whole file."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "block_no", "rate", "channels", "frames", "samples", "error"]
        for pdf in batches:
            for ident, data in zip(pdf[key], pdf[content]):
                rows = []
                for block in _blocks(bytes(data)):
                    rows.append((ident, *block))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, {BLOCK}")


def _range_blocks(source: pa.NativeFile, start: int, stop: int) -> Iterator[tuple]:
    """The blocks that begin in bytes ``start`` to ``stop`` of the open file; what concerns the whole file comes from its first range."""
    source.seek(0)
    try:
        wav = wave.open(source, "rb")
        rate, channels, width, frames = wav.getframerate(), wav.getnchannels(), wav.getsampwidth(), wav.getnframes()
        if width != 2 or channels not in (1, 2) or rate < 1:
            if start == 0:
                yield 0, rate, channels, 0, None, "NOT_PCM16_MONO_OR_STEREO"
            return
        data, size = source.tell(), 2 * channels * rate
        number = max(0, -(-(start - data) // size))
        while data + number * size < stop and number * rate < frames:
            wav.setpos(number * rate)
            raw = wav.readframes(rate)
            samples = np.frombuffer(raw[:len(raw) - len(raw) % (2 * channels)], dtype="<i2")
            if not len(samples):
                break
            yield number, rate, channels, len(samples) // channels, samples, None
            number += 1
        if start == 0 and (not frames or source.size() - data < 2 * channels):
            yield 0, rate, channels, 0, None, "NO_SAMPLES"
    except (wave.Error, EOFError, RuntimeError):  # a chunk beyond the end of its file is a RuntimeError
        if start == 0:
            yield 0, None, None, 0, None, "UNREADABLE"


def wav_files(spark: SparkSession, folder: str, glob: str = "*.wav") -> DataFrame:
    """``path`` and ``length`` of the files below a folder; contents are not read. Spark passes over empty files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    # Spark counts 4 MB for each file and so puts 32 into a split, which is far too few where only lengths are looked up.
    return listed.coalesce(max(spark.sparkContext.defaultParallelism * 4, listed.rdd.getNumPartitions() // 64))


def wav_ranges(files: DataFrame, *, range_bytes: int = 1 << 25) -> DataFrame:
    """``path`` and the columns of ``wav_blocks`` for files given by ``path`` and ``length``, read by ranges of bytes.

    Ranges are rows and are dealt evenly, so a recording of days is spread like many short ones; a task holds 64 seconds of stereo at
    48 kHz. Ranges that follow each other within ``DEALT_BYTES`` of a file share a task, which opens the file once for them. An empty
    file is ``UNREADABLE``.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    number, total = files.groupBy().agg(F.sum(F.size(starts)), F.sum("length")).first()
    number, total = int(number or 0), int(total or 0)
    place = F.floor(F.col("start") / max(range_bytes, DEALT_BYTES))
    ranges = files.select("path", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + range_bytes)
    names = ["path", "block_no", "rate", "channels", "frames", "samples", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for path, part in pdf.groupby("path", sort=False):
                files, place = located(path)
                with files.open_input_file(place) as source:
                    for start, stop in zip(part["start"], part["stop"]):
                        for block in _range_blocks(source, int(start), int(stop)):
                            rows.append((path, *block))
                            held += 0 if block[4] is None else len(block[4])
                            if len(rows) == 4096 or held >= 64 * 96_000:
                                yield pd.DataFrame(rows, columns=names)
                                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    # Tasks follow the bytes; ranges alone ask for more only by the thousand. A plain shuffle of so few bytes would be put into one task.
    tasks = min(number, max(files.sparkSession.sparkContext.defaultParallelism * 4, total // (8 * DEALT_BYTES), number // 4096)) or 1
    return ranges.repartition(tasks, "path", place).sortWithinPartitions("path", "start").mapInPandas(run, f"path string, {BLOCK}")


def write_wavs(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's bytes as ``folder/name.wav``; the number of files. Runs at once; a task that is run again replaces its files."""
    located(folder)[0].create_dir(located(folder)[1], recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, data in zip(pdf[name], pdf[content]):
                put(f"{folder.rstrip('/')}/{ident}.wav", bytes(data), TaskContext.get().taskAttemptId())
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select(name, content).mapInPandas(run, "n bigint").groupBy().sum("n").first()[0] or 0


def wav_bytes(samples: np.ndarray, rate: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as wav:
        wav.setnchannels(channels)
        wav.setsampwidth(2)
        wav.setframerate(rate)
        wav.writeframes(np.asarray(samples, dtype="<i2").tobytes())
    return out.getvalue()
