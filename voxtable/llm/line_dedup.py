"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased; its 128-bit hash stands for it.
:class:`LineRuns` keeps runs, Parquet tables sorted by hash with the number of documents of each line. A new batch
of lines merge-anti-joins the runs (lines that are settled as repeated need no further counting) and adds what is
left as a run of its own. ``fanout`` runs of a level are compacted to one run of the next.

Lines found in at least ``min_docs`` rows (each row is a document; a line counts once in each) are taken out of
every document. A null or empty text is one empty line. Keys under ``min_points`` code points are never taken out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import fresh_path, staged

HASH = ["hi", "lo"]


def _line_key(line: bytes) -> bytes:
    return line.strip(rows.SPACE_BYTES).lower()  # bytes.lower() touches A-Z only


def _hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, keep: list[str], min_points: int = 1) -> DataFrame:
    """One row per document and different line that may be taken out: the ``keep`` columns, ``hi``, ``lo``."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for part in rows.slices(batches, "text", 1 << 23):
            owner, digests = [], []
            for i, text in enumerate(rows.raw(part.column("text"))):
                found = {_line_key(line) for line in text.split(b"\n")}
                found = {_hash(k) for k in found if k and (min_points < 2 or len(k.decode("utf-8", "replace")) >= min_points)}
                owner.extend([i] * len(found))
                digests.extend(found)
            pairs = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            taken = [part.column(c).take(pa.array(owner, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=[*keep, *HASH])

    own = docs.select(*keep, "text")
    return own.mapInArrow(explode, rows.widened(own.drop("text"), hi="bigint", lo="bigint"))


class LineRuns:
    """Runs of (hash, number of documents), level by level; level 0 holds the newest."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, counts: DataFrame) -> DataFrame:
        """A run: hashes dealt by hash, sorted in each file, so that a merge reads it in order."""
        path = fresh_path(self.spark, "line-run")
        counts.repartition(*HASH).sortWithinPartitions(*HASH).write.parquet(path)
        return self.spark.read.schema("hi bigint, lo bigint, docs bigint").parquet(path)

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        """Hashes that any single run already shows as repeated."""
        empty = self.spark.createDataFrame([], "hi bigint, lo bigint")
        found = [r.where(F.col("docs") >= self.min_docs).select(*HASH) for r in self._runs()]
        for run in found:
            empty = empty.unionAll(run)
        return empty.distinct()

    def add(self, lines: DataFrame) -> None:
        """Count a batch's lines (one row per document and line), without those that are settled."""
        counts = lines.groupBy(*HASH).agg(F.count("*").alias("docs"))
        if self._runs():
            counts = counts.join(self.settled(), HASH, "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(self._write(merged))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionAll(run)
        return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def repeated(self) -> DataFrame:
        """Hashes of the lines found in at least ``min_docs`` documents of all batches."""
        if not self._runs():
            return self.spark.createDataFrame([], "hi bigint, lo bigint")
        return self._merged(self._runs()).where(F.col("docs") >= self.min_docs).select(*HASH)


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_points: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; columns of these names are replaced.

    Every row stays, rows that are repeated included. A text of which no line is left becomes empty; a null text too.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped", *rows.KEY)
    held = rows.keyed(docs, "doc_id", "text")
    lines = staged(line_hashes(held.select(*rows.KEY, "text"), [*rows.KEY], min_points).withColumn("batch", F.pmod(F.col(rows.KEY[0]), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    repeated = staged(runs.repeated(), "repeated-lines")
    gone = lines.drop("batch").distinct().join(repeated, HASH, "left_semi")
    # One document's own lines: bounded by that document.
    gone = gone.groupBy(*rows.KEY).agg(F.collect_list(F.struct(*HASH)).alias("__gone"))
    columns = docs.columns

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(parts, "text", 1 << 23):
            texts, counts, drops = [], [], []
            for text, found in zip(rows.raw(part.column("text")), part.column("__gone").to_pylist()):
                split = text.split(b"\n")
                bad = {r["hi"].to_bytes(8, "big", signed=True) + r["lo"].to_bytes(8, "big", signed=True) for r in found or ()}
                kept = [x for x in split if _hash(_line_key(x)) not in bad] if bad else split
                texts.append(b"\n".join(kept))
                counts.append(len(split))
                drops.append(len(split) - len(kept))
            yield rows.with_columns(part, columns, kept_text=pa.array(texts, pa.binary()).cast(pa.string()), n_lines=pa.array(counts, pa.int64()), n_dropped=pa.array(drops, pa.int64()))

    joined = held.join(gone, [*rows.KEY], "left").select(*columns, "__gone")
    return joined.mapInArrow(cut, rows.widened(docs, kept_text="string", n_lines="bigint", n_dropped="bigint"))


SQL = r"""
WITH l AS (SELECT doc_id, i, x, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (l.k IN (SELECT k FROM r)) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (l.k NOT IN (SELECT k FROM r)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""


@query("op3_line_dedup", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(rows.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
