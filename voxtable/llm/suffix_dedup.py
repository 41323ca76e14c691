"""Suffix-array dedup of long repeated byte strings, one suffix bucket at a time.

A string of ``length`` bytes that starts in two places must be found in both. Suffixes are put in buckets by content: the
bucket of a suffix is the 32-byte run with the lowest hash among those inside its first ``length`` bytes (its anchor), so equal
strings always meet, at the same distance from the anchor. About one byte in 185 is an anchor, and only anchors travel.

An anchor's surroundings are the bytes that any of its strings can cover. Surroundings that occur twice are settled by their hash.
For the rest a bucket splits by the half that two equal strings must share: every string covers ``half`` bytes to the left of
its anchor or as many to the right. What still meets is sorted, bucket by bucket: the suffixes that start at the anchor, and
the prefixes that end there read backwards. Long ties are the rule there, so they are resolved by ranks of a cover sample:
every 16th byte from the anchor has its rank among all sample suffixes computed from the far end, and a comparison takes the
bytes up to the next sample place and then that rank. All suffixes of a bucket that can tie lie at the same distance from the anchor, so
one residue covers each pair of them, and the difference cover needs no second. Memory holds one bucket's surroundings only, and a
bucket of too many goes another, exact way.

From both orders and the common lengths of neighbours in them follows for each distance which strings are equal.

Texts are UTF-8 bytes, null and empty ones have none; strings never cross texts. Rows with equal texts count as places of
their own, so a text of ``length`` bytes or more that occurs twice goes whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import staged

GRAM, SAMPLE = 32, 16
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at every place."""
    n = len(text) - 7
    words = np.ndarray((n,), "<u8", text, strides=(1,))
    mixed = words[: n - 24] * np.uint64(_MIX[0])
    for k in (1, 2, 3):
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed + words[8 * k : n - 24 + 8 * k]) * np.uint64(_MIX[k])
    return mixed ^ (mixed >> np.uint64(32))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of all strings of ``length`` bytes: place and hash of the lowest run, the leftmost of equals."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(text)
    width = length - GRAM + 1
    # The place in the lower half makes the leftmost of equals the lowest. Texts are shorter than 4 GB.
    ordered = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    # Minimum of every window from running minima inside blocks of the window's width, from both ends.
    blocks = -(-len(hashes) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(hashes)] = ordered
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(hashes) - width + 1
    lowest = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    place = (lowest[np.r_[True, lowest[1:] != lowest[:-1]]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place, hashes[place].view(np.int64)


def _sample_ranks(blocks: np.ndarray) -> np.ndarray:
    """Ranks of rows of blocks: names of the blocks, then ranks of the sample suffixes from the far end to the near one."""
    rank = np.zeros(len(blocks), np.int64)
    for q in range(blocks.shape[1] - 1, -1, -1):
        _, rank = np.unique(blocks[:, q] * (len(blocks) + 1) + rank, return_inverse=True)
    return rank


def _sorted_side(side: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their bytes, and how many bytes each shares with the row before it in that order."""
    width = side.shape[1]
    blocks = side.reshape(len(side), width // SAMPLE, SAMPLE)
    halves = np.ascontiguousarray(blocks).view(">u8").reshape(-1, 2).astype(np.uint64)
    _, high = np.unique(halves[:, 0], return_inverse=True)
    _, low = np.unique(halves[:, 1], return_inverse=True)
    _, names = np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)
    # A text's end sorts before any byte, a zero byte included.
    order = np.lexsort((have, _sample_ranks(names.reshape(len(side), -1))))
    common = np.zeros(len(side), np.int64)
    for at in range(1, len(side), 1 << 12):
        a, b = order[at - 1 : at - 1 + (1 << 12)], order[at : at + (1 << 12)]
        a = a[: len(b)]
        differ = side[a] != side[b]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[at : at + len(b)] = np.minimum(shared, np.minimum(have[a], have[b]))
    return order, common


def equal_strings(left: np.ndarray, left_has: np.ndarray, right: np.ndarray, right_has: np.ndarray, bucket: np.ndarray, length: int, distances: range) -> np.ndarray:
    """For each row and each of the distances: whether the string that starts that many bytes before the anchor also
    starts at another row of the bucket. ``left`` is read backwards from the anchor, ``right`` forwards; both are padded."""
    n = len(bucket)
    orders = []
    for side, have in ((left, left_has), (right, right_has)):
        order, common = _sorted_side(side, have)
        orders.append((order, common))
    found = np.zeros((n, length - GRAM + 1), bool)
    number = np.unique(bucket, return_inverse=True)[1]
    for a in distances:
        valid = np.flatnonzero((left_has >= a) & (right_has >= length - a))
        if len(valid) < 2:
            continue
        key = number[valid]
        for (order, common), depth in zip(orders, (a, length - a)):
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(common < depth)
            key = key * (n + 1) + name[valid]
            if depth == a:
                key = np.unique(key, return_inverse=True)[1]
        values, back, many = np.unique(key, return_inverse=True, return_counts=True)
        found[valid, a] = many[back] > 1
    return found


def _spans(found: np.ndarray, place: np.ndarray, length: int) -> list[list[int]]:
    """Covered bytes of each row as start, end, start, end...; column a is the string that starts a bytes before the place."""
    out = []
    for flags, at in zip(found, place):
        steps = np.flatnonzero(np.diff(np.r_[0, flags[::-1].astype(np.int8), 0]))
        base = int(at) - (len(flags) - 1)
        out.append([int(x) + base + (length - 1 if i & 1 else 0) for i, x in enumerate(steps)])
    return out


def repeated_spans(texts: DataFrame, length: int, *, bucket_rows: int = 50_000) -> DataFrame:
    """``__k1``, ``__k2``, ``spans`` (start, end, ...) of the bytes covered by strings found elsewhere too.

    ``texts`` has the row's key and the bytes ``text``; rows that agree in both count as places of their own. A bucket of more
    than ``bucket_rows`` different surroundings is not sorted in one task: each of its strings travels as a 128-bit hash
    and is counted, which gives the same answer.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    half = (length - GRAM) // 2
    # A string that starts ``half`` bytes or more before its anchor is settled on the left side, the others on the right.
    sides = {0: range(half, length - GRAM + 1), 1: range(half)}
    key = [*rows.KEY]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for part in rows.slices(batches, "text", 1 << 22):
            owner, place, gram, around, left, right = [], [], [], [], [], []
            for i, text in enumerate(rows.raw(part.column("text"))):
                at, hashes = anchors(text, length)
                owner.extend([i] * len(at))
                place.extend(at.tolist())
                gram.append(hashes)
                view = memoryview(text)
                for p in at.tolist():
                    start = max(0, p - length + GRAM)
                    # The distance to the text's start takes part: it tells how far strings can reach to the left.
                    around.append(digest(view[start : p + length], p - start))
                    left.append(digest(view[p - half : p + GRAM], 1) if p >= half else None)
                    right.append(digest(view[p : p + GRAM + half], 2) if p + GRAM + half <= len(text) else None)
            grams = np.concatenate(gram) if gram else np.zeros(0, np.int64)
            unsigned = lambda v: pa.array(np.array([x or 0 for x in v], np.uint64).view(np.int64), mask=np.array([x is None for x in v], bool))
            taken = [part.column(k).take(pa.array(owner, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(place, pa.int64()), pa.array(grams), unsigned(around), unsigned(left), unsigned(right)], names=[*key, "at", "g", "c", "l", "r"])

    own = texts.select(*key, "text")
    found = staged(own.mapInArrow(scan, rows.widened(own.select(*key), at="bigint", g="bigint", c="bigint", l="bigint", r="bigint")), "anchors")
    # Written before it is joined: a join of two plain shuffles can be split where one run holds many anchors.
    several = staged(found.groupBy("g").agg(F.count("*").alias("places")).where("places > 1").select("g"), "several")
    found = staged(found.join(several, "g", "left_semi"), "repeated-anchors")
    # Different surroundings of each anchor; one place stands for all where they are alike.
    kinds = staged(found.groupBy("g", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in (*key, "at", "l", "r")]), "anchor-kinds")
    # Found twice with all its surroundings: all of it goes.
    whole = found.join(kinds.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select(*key, "at").distinct()
    whole = whole.select(*key, F.array(F.greatest(F.col("at") - (length - GRAM), F.lit(0)), F.col("at") + length).alias("spans"))
    # Otherwise strings may be shared in part: halves that at least two surroundings have, one of them not settled yet.
    place = ["g", "n", *key, "at"]
    split = kinds.select(*place, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("h")), F.struct(F.lit(1).alias("side"), F.col("r").alias("h")))).alias("s"))
    split = split.select(*place, "s.side", "s.h").where("h IS NOT NULL")
    met = split.groupBy("g", "side", "h").agg(F.count("*").alias("rows"), F.min("n").alias("least")).where("rows > 1 AND least = 1")
    asked = split.join(met.select("g", "side", "h", (F.col("rows") > bucket_rows).alias("crowded")), ["g", "side", "h"])
    asked = asked.groupBy(*key).agg(F.collect_list(F.struct("at", "side", "crowded", F.xxhash64("g", "side", "h").alias("bucket"), (F.col("n") > 1).alias("known"))).alias("asked"))
    surroundings = "bucket bigint, at bigint, side int, crowded boolean, known boolean, back binary, ahead binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 22):
            owner, out = [], {n: [] for n in ("bucket", "at", "side", "crowded", "known", "back", "ahead")}
            for i, (text, wanted) in enumerate(zip(rows.raw(part.column("text")), part.column("asked").to_pylist())):
                for w in wanted:
                    p = w["at"]
                    owner.append(i)
                    for n in ("bucket", "at", "side", "crowded", "known"):
                        out[n].append(w[n])
                    out["back"].append(text[max(0, p - length + GRAM) : p][::-1])
                    out["ahead"].append(text[p : p + length])
            kinds_ = {"bucket": pa.int64(), "at": pa.int64(), "side": pa.int32(), "crowded": pa.bool_(), "known": pa.bool_(), "back": pa.binary(), "ahead": pa.binary()}
            taken = [part.column(k).take(pa.array(owner, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(out[n], t) for n, t in kinds_.items()]], names=[*key, *out])

    both = texts.select(*key, "text").join(asked, key)
    cut_out = both.mapInArrow(cut, f"__k1 bigint, __k2 bigint, {surroundings}")
    large = asked.select(F.exists("asked", lambda w: w["crowded"]).alias("x")).where("x")
    if not large.isEmpty():
        cut_out = staged(cut_out, "surroundings")
    dealt = cut_out.where("NOT crowded").repartition("bucket").sortWithinPartitions("bucket")

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            of = table.column("side").to_numpy()
            for side, distances in sides.items():
                own = table.take(pa.array(np.flatnonzero(of == side)))
                if own.num_rows:
                    yield one_side(own, distances)

        def one_side(table: pa.Table, distances: range) -> pa.RecordBatch:
            read = []
            for name, width in (("back", length - GRAM), ("ahead", length)):
                width = -(-width // SAMPLE) * SAMPLE
                values = table.column(name).to_pylist()
                read.append(np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width))
                read.append(np.array([len(v) for v in values]))
            got = equal_strings(*read, table.column("bucket").to_numpy(), length, distances)
            place = table.column("at").to_numpy()
            open_ = ~table.column("known").to_numpy() & got.any(axis=1)
            pick = np.flatnonzero(open_)
            spans = _spans(got[pick], place[pick], length)
            taken = [table.column(k).combine_chunks().take(pa.array(pick)) for k in key]
            return pa.RecordBatch.from_arrays([*taken, pa.array(spans, pa.list_(pa.int64()))], names=[*key, "spans"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 13:
                continue
            table = pa.Table.from_batches(held)
            buckets = table.column("bucket").to_numpy()
            stop = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            if stop:
                yield from work(table.slice(0, stop))
            held, size = table.slice(stop).to_batches(), len(buckets) - stop
        if size:
            yield from work(pa.Table.from_batches(held))

    part = dealt.mapInArrow(settle, "__k1 bigint, __k2 bigint, spans array<bigint>")
    every = whole.unionByName(part)
    if not large.isEmpty():

        def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    owner, start, digests = [], [], []
                    for i, (back, ahead, place, side) in enumerate(zip(*[piece.column(c).to_pylist() for c in ("back", "ahead", "at", "side")])):
                        around = memoryview(back[::-1] + ahead)
                        for a in sides[side]:
                            if a <= len(back) and length - a <= len(ahead):
                                owner.append(i)
                                start.append(place - a)
                                digests.append(xxhash.xxh3_128_digest(around[len(back) - a : len(back) - a + length]))
                    pairs = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                    taken = [piece.column(k).take(pa.array(owner, pa.int64())) for k in (*key, "known")]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(start, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=[*key, "known", "start", "h1", "h2"])

        single = cut_out.where("crowded").mapInArrow(strings, "__k1 bigint, __k2 bigint, known boolean, start bigint, h1 bigint, h2 bigint")
        single = staged(single, "crowded-strings")
        # A string may lie in the surroundings of several anchors: places count, not rows; what is known has two.
        place = F.xxhash64(*key, "start")
        twice = single.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("known").alias("known"))
        twice = twice.where("low <> high OR known").select("h1", "h2")
        hit = single.where("NOT known").join(twice, ["h1", "h2"], "left_semi")
        every = every.unionByName(hit.select(*key, F.array(F.col("start"), F.col("start") + length).alias("spans")))
    return every.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # bounded by the text


def drop_repeated_bytes(docs: DataFrame, *, length: int = 400, bucket_rows: int = 50_000) -> DataFrame:
    """``doc_id``, the row's key, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` for every row of ``docs``."""
    base = rows.keyed(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")), "doc_id", "text")
    key = [*rows.KEY]
    # Texts too short for any string take no part.
    spans = staged(repeated_spans(base.where(F.octet_length("text") >= length).select(*key, "text"), length, bucket_rows=bucket_rows), "byte-spans")
    joined = base.join(spans, key, "left")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 23):
            kept, counts, removed, runs = [], [], [], []
            for text, found in zip(rows.raw(part.column("text")), part.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for start, end in sorted(zip(found[::2], found[1::2])) if found else []:
                    end = min(end, len(text))
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *[x for s in merged for x in s], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                counts.append(len(text))
                removed.append(sum(e - s for s, e in merged))
                runs.append(len(merged))
            yield rows.with_columns(part, ["doc_id", *key], kept=pa.array(kept, pa.binary()), n_bytes=pa.array(counts, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()))

    return joined.mapInArrow(work, rows.widened(base.select("doc_id", *key), kept="binary", n_bytes="bigint", n_removed="bigint", n_spans="bigint"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_bytes(rows.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
