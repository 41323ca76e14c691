"""Spelling variants: words one edit apart, found by edit matrices over sorted lists.

Words are counted over all texts first. Two words one edit apart agree before and behind the edit, so with a word of m code
points cut into segments each pair shares all but one segment. Words meet in a bucket of what is shared (two segments at first; a
bucket of more than ``bucket_rows`` words is cut again, down to one code point, where the alphabet bounds it). A pair belongs to the one segment in
which its words first differ, so no pair is counted twice and none is lost.

Inside a bucket the words are sorted. Every word is held against the sorted list: the banded edit matrix has one row of three cells
for each code point of the list's word, a word that shares a prefix with the one before it goes on from the row behind that prefix,
and where a row has no cell of at most one edit, all words that share this prefix are skipped. Rows are kept as one byte and all words of
many buckets step at once. Only the part outside of what the bucket shares is compared.

No pairs leave a task: for each word and bucket only the number of near words and the best of them do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import staged

_RUN = "A-Za-zÀ-ÿ"
BUCKET = ["b1", "b2"]
_FAR = 2  # stands for two or more edits


def damaged(run: str, doc_id: str, every: int) -> str:
    """The run, or the run without one code point for one of ``every`` pairs of document and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, min_points: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """``word`` and ``n`` for each different word of at least ``min_points`` code points and ``min_count`` occurrences.

    A null text has no words; a null ``doc_id`` counts as the empty string.
    """
    pattern = re.compile(f"[{_RUN}]{{{min_points},}}")  # greedy from the run's start, so runs come whole

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 24):
            total: Counter[str] = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                # Distinct runs of one document, A-Z lowered: equal runs of a document share the hash.
                for run, n in Counter(rows.lowered_ascii(r) for r in pattern.findall(text or "")).items():
                    word = damaged(run, "" if doc_id is None else str(doc_id), every)
                    if len(word) >= min_points:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _transitions() -> np.ndarray:
    """Next row of the banded matrix for each row (three cells of 0, 1, far) and each pattern of equal code points.

    Cell k of row d holds the distance between d code points of the list's word and d + k - 1 of the query's.
    """
    table = np.zeros((64, 8), np.uint8)
    for code in range(64):
        old = [min(code >> 2 * k & 3, _FAR) for k in range(3)]
        for same in range(8):
            new: list[int] = []
            for k in range(3):
                best = old[k] + (not same >> k & 1)
                if k < 2:
                    best = min(best, old[k + 1] + 1)
                if k:
                    best = min(best, new[k - 1] + 1)
                new.append(min(best, _FAR))
            table[code, same] = new[0] | new[1] << 2 | new[2] << 4
    return table


_NEXT = _transitions()
_START = np.uint8(_FAR | 0 << 2 | 1 << 4)  # before the first code point: nothing, no edit, one insertion
_DEAD = np.uint8(_FAR | _FAR << 2 | _FAR << 4)


def _common_prefixes(chars: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code points that each word shares with the word before it; -1 for the first word of a bucket."""
    common = np.zeros(len(start), np.int64)
    common[first] = -1
    live = np.flatnonzero(~first)
    at = 0
    while len(live):
        live = live[np.minimum(size[live], size[live - 1]) > at]
        live = live[chars[start[live] + at] == chars[start[live - 1] + at]]
        common[live] += 1
        at += 1
    return common


def _next_smaller(common: np.ndarray) -> np.ndarray:
    """For each word the next one that shares fewer code points with its predecessor; buckets end at -1."""
    after = np.arange(1, len(common) + 1)
    padded = np.r_[common, -2]
    while True:
        far = padded[after] >= common
        far &= after < len(common)
        if not far.any():
            return after
        at = np.flatnonzero(far)
        after[at] = after[after[at]]


def near_words(chars: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, bucket: np.ndarray, width: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a sorted list: how many words of its bucket are one edit away, and the place of the most frequent.

    ``start`` and ``size`` give the part of ``chars`` that the bucket does not share; rows of a bucket stand together, sorted by word.
    ``width`` is the length of the segment: parts have this length or one more, and two longer ones belong elsewhere. A pair whose words first
    differ behind the segment belongs to the next segment, unless this one is the ``last``. The place is -1 where there is none.
    """
    total = len(start)
    near, best = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    if not total:
        return near, best
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    common = _common_prefixes(chars, start, size, first)
    smaller = _next_smaller(common)
    head = np.flatnonzero(first)
    many = np.diff(np.r_[head, total])
    common = np.r_[common, -1]
    # One stack of rows a query, as deep as the longest part of its bucket.
    deep = np.repeat(np.maximum.reduceat(size, head), many) + 1
    base = np.cumsum(deep) - deep
    stack = np.full(int(deep.sum()), _DEAD)
    stack[base] = _START
    active = np.flatnonzero(np.repeat(many, many) > 1)
    word, depth = np.repeat(head, many)[active], np.zeros(len(active), np.int64)
    padded = np.r_[chars, 0]
    while len(active):
        ended = depth == size[word]
        # A word that is read to its end: its last row tells its distance from the query.
        done = np.flatnonzero(ended)
        if len(done):
            q, w = active[done], word[done]
            gap = size[q] - size[w] + 1
            row = stack[base[q] + size[w]]
            hit = (gap >= 0) & (gap <= 2)
            hit &= (row >> (2 * np.where(hit, gap, 0)).astype(np.uint8) & 3) == 1
            hit &= (size[q] == width[q]) | (size[w] == width[q])
            # The middle cell behind the segment: no edit so far means that the words differ behind it only.
            hit &= last[q] | (stack[base[q] + np.minimum(width[q], size[w])] >> 2 & 3 != 0)
            q, w = q[hit], w[hit]
            near[q] += 1
            better = (best[q] < 0) | (n[w] > n[best[q]])  # the list is sorted, so the first of equals stays
            best[q[better]] = w[better]
        step = np.flatnonzero(~ended)
        w, d, q = word[step], depth[step], active[step]
        c = padded[start[w] + d]
        at, left = start[q] + d, size[q] - d
        same = ((d > 0) & (left >= 0) & (padded[np.minimum(at - 1, len(chars))] == c)).astype(np.uint8)
        same |= ((left > 0) & (padded[np.minimum(at, len(chars))] == c)).astype(np.uint8) << 1
        same |= ((left > 1) & (padded[np.minimum(at + 1, len(chars))] == c)).astype(np.uint8) << 2
        row = _NEXT[stack[base[q] + d], same]
        stack[base[q] + d + 1] = row
        depth[step] = d + 1
        # Words read to the end move to the next one; a dead row leaves all words that share the prefix behind.
        word[done] += 1
        dead = step[row == _DEAD]
        word[dead] += 1
        moved = np.r_[done, dead]
        skip = dead[common[word[dead]] >= depth[dead]]
        while len(skip):
            word[skip] = smaller[word[skip]]
            skip = skip[common[word[skip]] >= depth[skip]]
        depth[moved] = common[word[moved]]
        if len(moved):
            keep = depth >= 0
            active, word, depth = active[keep], word[keep], depth[keep]
    return near, best


def _bucket(word: str = "word", lo: str = "lo", hi: str = "hi") -> dict:
    shared = [F.col("m"), F.col(lo), F.col(hi), F.substring(F.col(word), F.lit(1), F.col(lo)), F.substring(F.col(word), F.col("len") - F.col("m") + F.col(hi) + 1, F.col("m") - F.col(hi))]
    return {BUCKET[0]: F.xxhash64(*shared), BUCKET[1]: F.xxhash64(F.lit(0x5EED), *shared)}


def _cut(dealt: DataFrame) -> DataFrame:
    """Each row once for either half of its segment."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return dealt.withColumn("__s", F.explode(halves)).withColumns({"lo": F.col("__s.lo"), "hi": F.col("__s.hi")}).drop("__s").withColumns(_bucket())


def near_word_rows(vocabulary: DataFrame, *, bucket_rows: int = 4096) -> DataFrame:
    """``word``, ``n_near``, ``best`` (``word`` and ``n`` of the most frequent near word, ties by code points), partial by bucket."""
    words = vocabulary.select("word", "n", F.char_length("word").cast("int").alias("len"))
    # As the shorter or an equal word of a pair (m = its length), and as the longer one (m is one less).
    words = words.withColumn("m", F.explode(F.array(F.col("len"), F.col("len") - 1))).where("m > 0").withColumns({"lo": F.lit(0), "hi": F.col("m")})
    dealt = _cut(words)
    ready = None
    while True:
        crowded = dealt.where("hi - lo > 1").groupBy(*BUCKET).agg(F.count("*").alias("held")).where(F.col("held") > bucket_rows).select(*BUCKET)
        crowded = staged(crowded, "crowded-buckets")
        if crowded.isEmpty():
            ready = dealt if ready is None else ready.unionByName(dealt)
            break
        rest = dealt.join(crowded.hint("merge"), BUCKET, "left_anti").select(*dealt.columns)
        ready = rest if ready is None else ready.unionByName(rest)
        dealt = staged(_cut(dealt.join(crowded.hint("merge"), BUCKET, "left_semi").select(*dealt.columns)), "cut-buckets")
    placed = ready.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "word")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(c).to_numpy() for c in BUCKET])
            edge = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True]
            table = table.take(pa.array(np.flatnonzero(~(edge[1:] & edge[:-1]))))  # alone in the bucket
            keys = np.stack([table.column(c).to_numpy() for c in BUCKET])
            words = table.column("word").to_pylist()
            m, lo, hi, length, n = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi", "len", "n"))
            chars = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
            bucket = np.cumsum(np.r_[False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(words) else m
            near, best = near_words(chars, np.cumsum(length) - length + lo, length - (m - hi) - lo, n, bucket, hi - lo, hi == m)
            pick = np.flatnonzero(near)
            to = pa.array(best[pick])
            text = table.column("word").combine_chunks()
            form = pa.StructArray.from_arrays([text.take(to), pa.array(n[best[pick]])], names=["word", "n"])
            return pa.RecordBatch.from_arrays([text.take(pa.array(pick)), pa.array(near[pick]), form], names=["word", "n_near", "best"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in BUCKET]
            stop = size - int(np.argmin(((keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]))[::-1]))  # the last bucket may go on
            if stop < size or keys[0][0] != keys[0][-1] or keys[1][0] != keys[1][-1]:
                yield one(table.slice(0, stop))
                table = table.slice(stop)
            held, size = table.to_batches(), table.num_rows
        if size:
            yield one(pa.Table.from_batches(held))

    return placed.mapInArrow(scan, "word string, n_near bigint, best struct<word: string, n: bigint>")


def followed(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the steps ``word`` to ``form`` end. Steps go to larger counts, so they end.

    Each round follows twice as many steps as the one before, until no root moves.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        now = moved.drop("on")
        if moved.where("on").isEmpty():
            return now


def spelling_variants(docs: DataFrame, *, min_points: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31, bucket_rows: int = 4096) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``docs`` (see :func:`word_counts`).

    ``form`` is the most frequent near word (ties: smallest in code-point order) where it occurs ``ratio`` times as often, else null;
    ``root`` is the end of the chain of forms, the word itself without one. Only ``doc_id`` and ``text`` are read, so other columns
    may have any name; repeated rows count as often as they stand. No words: no rows.
    """
    vocabulary = staged(word_counts(docs, min_points=min_points, min_count=min_count, every=every), "words")
    better = F.min(F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word"))).alias("best")
    found = near_word_rows(vocabulary, bucket_rows=bucket_rows).groupBy("word").agg(F.sum("n_near").alias("n_near"), better)
    joined = vocabulary.join(found.hint("merge"), "word", "left")
    taken = -F.col("best.minus") >= F.col("n") * ratio
    named = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")), "word-forms")
    roots = followed(named.where("form IS NOT NULL"))
    return named.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(rows.table(spark, sf_dir, "documents"))
