"""SimHash near-dedup by bit-sliced comparison.

A text's fingerprint has bit k set if over half of its shingles' hashes do. Two fingerprints at most ``radius`` bits apart
agree in two of ``radius + 2`` bit blocks, so every pair of blocks makes a table, and fingerprints of equal blocks meet in a
bucket. Inside a bucket 64 fingerprints share a machine word for each bit (bit planes). One query updates the distances
to 64 fingerprints at once with carry-save counters, and drops a word as soon as all its lanes exceed the radius.
A bucket is searched breadth first: a fingerprint that was reached is not compared as a lane again, so a bucket of n gives
at most n - 1 links and never all its pairs. Equal fingerprints are merged before; buckets over ``bucket_rows`` are dealt
in pairs of parts, which loses no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.components import components
from voxtable.llm.registry import query
from voxtable.session import staged

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    found = _WORD.findall(text.lower())  # bytes.lower() touches A-Z only
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    digest, ends, starts = xxhash.xxh64_intdigest, [], []
    at = 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    if len(found) <= width:
        return np.array([digest(joined, 42)], "<u8")
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], "<u8")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority of each bit over the hashes, as a signed 64-bit number."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, *, shingle: int = 4, name: str = "__fp") -> DataFrame:
    """All columns but ``text``, and the fingerprint as a bigint."""
    docs = docs.drop(name)
    columns = [c for c in docs.columns if c != "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 23):
            prints = [fingerprint(t, shingle) for t in rows.raw(part.column("text"))]
            yield rows.with_columns(part, columns, **{name: pa.array(prints, pa.int64())})

    return docs.mapInArrow(work, rows.widened(docs.select(*columns), **{name: "bigint"}))


def sets_within(prints: np.ndarray, buckets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions, positions) that connect, inside each bucket, all fingerprints joined by steps of at most ``radius`` bits.

    ``buckets`` numbers the rows' buckets and is sorted.
    """
    n = len(prints)
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word_first = np.cumsum(words) - words
    # Lane (word, bit) of each row, and the bit planes: planes[k][word] holds bit k of 64 fingerprints.
    inside = np.arange(n) - np.repeat(first, size)
    lane = np.repeat(word_first, size) * 64 + inside
    total = int(words.sum())
    slots = np.zeros(total * 64, np.uint64)
    slots[lane] = prints.view(np.uint64)
    live = np.zeros(total * 64, np.uint8)
    live[lane] = 1
    waiting = np.packbits(live, bitorder="little").view("<u8").copy()
    bits = np.unpackbits(slots.view(np.uint8).reshape(total, 64, 8), axis=2, bitorder="little").reshape(total, 64, BITS)
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(BITS, total)
    row_at = np.full(total * 64, -1, np.int64)
    row_at[lane] = np.arange(n)

    queue = np.zeros(n, np.int64)  # per bucket, rows reached and not yet used as query
    head, tail, seed = first.copy(), first.copy(), first.copy()
    reached = np.zeros(n, bool)
    out_a, out_b = [], []
    active = np.flatnonzero(size > 1)
    while len(active):
        idle = active[head[active] == tail[active]]
        while len(idle):  # a bucket without a frontier starts again from its next unreached row
            idle = idle[seed[idle] < first[idle] + size[idle]]
            fresh = ~reached[seed[idle]]
            start = idle[fresh]
            queue[tail[start]] = seed[start]
            reached[seed[start]] = True
            at = lane[seed[start]]
            waiting[at >> 6] &= ~(np.uint64(1) << (at & 63).astype(np.uint64))
            tail[start] += 1
            idle = idle[~fresh]
            seed[idle] += 1
        active = active[head[active] < tail[active]]
        if not len(active):
            break
        asked = queue[head[active]]
        head[active] += 1
        # One item per query and word with waiting lanes.
        reps = words[active]
        item_query = np.repeat(asked, reps)
        item_word = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(word_first[active], reps)
        some = waiting[item_word] != 0
        item_query, item_word = item_query[some], item_word[some]
        item_query, item_word, near = _near(planes, prints, item_query, item_word, waiting[item_word], radius)
        if len(near):
            hit = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, bit = np.nonzero(hit)
            found = row_at[item_word[item] * 64 + bit]
            out_a.append(item_query[item])
            out_b.append(found)
            waiting[item_word] &= ~near
            reached[found] = True
            group = np.searchsorted(first, found, side="right") - 1
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            many = np.diff(np.r_[starts, len(group)])
            queue[tail[group] + np.arange(len(group)) - np.repeat(starts, many)] = found
            tail[group[starts]] += many
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none


def _near(planes: np.ndarray, prints: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item, the lanes of its word within the radius of its query; items without such lanes are left out."""
    width = (radius + 8).bit_length()  # between two checks a live lane gains at most 8
    value = prints[query].view(np.uint64)
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
    for k in range(BITS):
        carry = planes[k][word] ^ (np.uint64(0) - ((value >> np.uint64(k)) & np.uint64(1)))
        carry &= alive
        for c in counters:
            c ^= carry
            carry &= ~c  # goes on where the sum fell back to zero
        if k % 8 == 7 or k == BITS - 1:
            over = np.zeros(len(query), np.uint64)
            same = np.full(len(query), ~np.uint64(0))
            for i in range(width - 1, -1, -1):
                if radius >> i & 1:
                    same &= counters[i]
                else:
                    over |= same & counters[i]
                    same &= ~counters[i]
            alive &= ~over
            keep = np.flatnonzero(alive)
            if len(keep) < len(query):
                query, word, value, alive = query[keep], word[keep], value[keep], alive[keep]
                counters = [c[keep] for c in counters]
            if not len(query):
                break
    return query, word, alive


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """True where two fingerprints are at most ``radius`` bits apart: 64 pairs a word, what differs as bit planes."""
    total = -(-len(a) // 64)
    slots = np.zeros(total * 64, np.uint64)
    slots[: len(a)] = a.view(np.uint64) ^ b.view(np.uint64)
    live = np.packbits(np.arange(total * 64) < len(a), bitorder="little").view("<u8").copy()
    bits = np.unpackbits(slots.view(np.uint8).reshape(total, 64, 8), axis=2, bitorder="little").reshape(total, 64, BITS)
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(BITS, total)
    _, word, near = _near(planes, np.zeros(1, np.int64), np.zeros(total, np.int64), np.arange(total), live, radius)
    found = np.zeros((total, 64), bool)
    found[word] = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return found.ravel()[: len(a)]


def block_masks(radius: int, matched: int = 2) -> list[int]:
    """One mask per table: ``matched`` of ``radius + matched`` blocks of bits."""
    edges = [BITS * i // (radius + matched) for i in range(radius + matched + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, matched)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int, *, matched: int = 2, bucket_rows: int = 8192) -> DataFrame:
    """Links (``a``, ``b``) between different fingerprints of the one bigint column, enough to connect all within the radius.

    More ``matched`` blocks make more tables of smaller buckets, for very many fingerprints; the links are the same sets.
    """
    name = prints.columns[0]
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(radius, matched)])
    dealt = prints.select(F.col(name).alias("fp")).distinct().select("fp", F.posexplode(masks).alias("t", "m"))
    dealt = dealt.select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
    # A bucket of more rows than one task should hold is cut in parts; every pair of parts meets once.
    crowded = dealt.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    crowded = crowded.select("t", "v", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts"))
    cut = dealt.join(crowded, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cut = cut.withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("t", "v", F.least("p", "q"), F.greatest("p", "q"))
    placed = cut.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [], []

        def search(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Planes take 4 KB a word of up to 64 rows: rows alone in their bucket need none, and few buckets are laid out at once.
            edge = np.r_[True, k[1:] != k[:-1], True]
            together = ~(edge[1:] & edge[:-1])
            k, f = k[together], f[together]
            start = 0
            while start < len(k):
                stop = min(len(k), start + (1 << 14))
                stop = len(k) if stop == len(k) else int(np.searchsorted(k, k[stop], side="right"))
                a, b = sets_within(f[start:stop], k[start:stop], radius)
                yield pa.RecordBatch.from_arrays([pa.array(f[start:stop][a]), pa.array(f[start:stop][b])], names=["a", "b"])
                start = stop

        for batch in batches:
            held_k.append(batch.column(0).to_numpy())
            held_f.append(batch.column(1).to_numpy())
            if sum(map(len, held_k)) < 1 << 17:
                continue
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            stop = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0  # the last bucket may go on
            if stop:
                yield from search(k[:stop], f[:stop])
            held_k, held_f = [k[stop:]], [f[stop:]]
        if held_k and sum(map(len, held_k)):
            yield from search(np.concatenate(held_k), np.concatenate(held_f))

    return placed.mapInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (bigint) and ``component_id`` for every row.

    Null and empty texts have fingerprint zero and are linked like any other. ``component_id`` is the smallest ``doc_id``
    reachable; null ids are passed over, and a component of null ids only has a null one. Repeated rows stay repeated.
    """
    prints = staged(with_fingerprints(docs.select("doc_id", "text"), shingle=shingle), "simhash")
    first = prints.groupBy("__fp").agg(F.min("doc_id").alias("first_id"))
    label = staged(components(near_links(first.select("__fp"), radius)), "simhash-sets")
    joined = first.join(label, F.col("__fp") == F.col("node"), "left").select("__fp", "first_id", F.coalesce("label", "__fp").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # Fingerprints that stand alone need no second look.
    named = joined.join(smallest, "label").select(F.col("__fp").alias("fp"), "component_id")
    return prints.join(named, prints["__fp"] == named["fp"]).select("doc_id", F.col("__fp").alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, shingle: int, columns: list[str], kinds: str, pack) -> DataFrame:
    """``pack`` of each bounded slice: the named columns, and the slice's shingle sets as sorted hashes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 22):
            yield pack(part, [np.unique(shingle_hashes(t, shingle)) for t in rows.raw(part.column("text"))])

    return docs.select(*columns, "text").mapInArrow(work, kinds)


def _set_id(s: np.ndarray) -> int:
    """A 63-bit hash of a set of shingles; equal sets share it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), 42) >> 1


def _shared_shingles(docs: DataFrame, shingle: int, total: int) -> DataFrame:
    """``g, token, df`` for each shingle held by two or more different sets: the set, the shingle, the number of sets.

    Every shingle of the corpus is shuffled once, packed by ranges of the hash.
    """
    bits = max(0, (total >> 19).bit_length())

    def pack(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        token = np.concatenate(found)
        at = np.repeat(np.arange(len(found)), [len(s) for s in found])
        ids = np.array([_set_id(s) for s in found], np.int64)
        place = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
        order = np.argsort(place, kind="stable")
        token, at, place = token[order], at[order], place[order]
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
        tokens, owners, sets = [], [], []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(place)]):
            here, owner = np.unique(at[lo:hi], return_inverse=True)
            tokens.append(token[lo:hi].tobytes())
            owners.append(owner.astype("<u4").tobytes())
            sets.append(ids[here].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(place[cuts], pa.int64()), *(pa.array(x, pa.binary()) for x in (tokens, owners, sets))], names=["place", "tokens", "owners", "sets"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for place, t, o, g in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(place, []).append((np.frombuffer(t, "<u8"), np.frombuffer(g, "<i8")[np.frombuffer(o, "<u4")]))
        while held:
            _, blobs = held.popitem()
            token, g = (np.concatenate(x) for x in zip(*blobs))
            order = np.lexsort((g, token))
            token, g = token[order], g[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (g[1:] != g[:-1])]  # texts of equal sets count once
            token, g = token[new], g[new]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            df = np.diff(np.r_[first, len(token)])
            df = np.repeat(df, df)
            keep = np.flatnonzero(df > 1)
            for at in range(0, len(keep), 1 << 16):
                k = keep[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(g[k]), pa.array(token[k].view(np.int64)), pa.array(df[k].astype(np.int64))], names=["g", "token", "df"])

    packed = _sets(docs, shingle, [], "place bigint, tokens binary, owners binary, sets binary", pack)
    return packed.repartition(1 << bits, "place").mapInArrow(count, "g bigint, token bigint, df bigint")


def _prefixes(shared: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """``token, g, s, i, leads, rank``: the shingles by which two sets at the similarity must meet.

    In one order of all shingles, rare before frequent, two such sets share one of the first s - ceil(similarity x s) + 1
    of each. A set with as many shingles of its own has no partner. ``i`` shingles of the set come before this one. The
    smaller set of a pair meets the other where ``leads`` is true, as what is left behind ``i`` bounds the overlap.
    """
    held = shared.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    held = held.join(sizes.hint("merge"), "g").withColumn("own", F.col("s") - F.size("found"))
    length = F.col("s") - F.ceil(F.col("s") * F.lit(similarity) - 1e-9) + 1
    held = held.withColumn("more", (length - F.col("own")).cast("int")).where("more > 0")
    met = held.select("g", "s", "own", F.posexplode(F.slice("found", F.lit(1), F.col("more"))).alias("pos", "x"))
    met = met.select("x.token", "g", "s", (F.col("own") + F.col("pos")).alias("i"))
    met = met.withColumn("leads", F.col("s") - F.col("i") >= F.col("s") * F.lit(2 * similarity / (1 + similarity)) - 1e-6)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("leads"), "g")) - 1)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets of shingles have at least this Jaccard similarity."""
    a, b = sets.select("g", "shingles").toDF("a", "sa"), sets.select("g", "shingles").toDF("b", "sb")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("shared")) - 1e-9).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """The pairs (``a``, ``b``) and whether their fingerprints are ``near``, by bit planes."""
    fa, fb = sets.select("g", "fp").toDF("a", "fa"), sets.select("g", "fp").toDF("b", "fb")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pairs_within(*(batch.column(c).to_numpy() for c in ("fa", "fb")), radius)
            yield rows.with_columns(batch, ["a", "b"], near=pa.array(near))

    both = pairs.join(fa.hint("merge"), "a").join(fb.hint("merge"), "b").select("a", "b", "fa", "fb")
    return both.mapInArrow(work, "a bigint, b bigint, near boolean")


def _joined_sets(met: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``node`` and ``label`` of all sets that steps of at least the similarity connect; a step counts only once it is checked.

    ``met`` are the ``_prefixes``. In each round some sets of a shingle, 1, 7, 56, ... by rank, meet all behind them that
    are not connected yet, and fingerprints within the radius are checked. So a large group takes about one check a member.
    What fingerprints hold apart is checked last, where its ends are not connected by then: no pair is passed over
    unless its ends are connected already.
    """
    most = met.where("leads").agg(F.max("rank")).first()[0]
    links = met.select(F.col("g").alias("a"), F.col("g").alias("b")).where("false")
    label, apart = links.toDF("node", "label"), links
    lo, hi = 0, 1
    while most is not None and lo <= most:
        now = met.join(label.hint("merge"), F.col("g") == F.col("node"), "left").withColumn("label", F.coalesce("label", "g")).drop("node")
        main = now.where("rank = 0").select("token", F.col("label").alias("main"))
        now = staged(now.join(main.hint("merge"), "token").withColumn("other", F.col("label") != F.col("main")).drop("main"), "simhash-labels")
        ahead = now.where(f"leads AND rank >= {lo} AND rank < {hi}").select("token", *[F.col(c).alias(f"{c}_a") for c in ("g", "s", "i", "label", "rank", "other")])
        # Sets of a shingle's main group need not meet each other.
        found = [x.join(y.hint("merge"), "token") for x, y in ((ahead.where("NOT other_a"), now.where("other")), (ahead.where("other_a"), now))]
        least = (F.col("s") + F.col("s_a")) * F.lit(similarity / (1 + similarity)) - 1e-6
        fits = (F.col("rank") > F.col("rank_a")) & (F.col("label") != F.col("label_a")) & (F.least(F.col("s") - F.col("i"), F.col("s_a") - F.col("i_a")) >= least)
        pairs = found[0].unionAll(found[1]).where(fits).select(F.least("g", "g_a").alias("a"), F.greatest("g", "g_a").alias("b")).distinct()
        pairs = staged(_compared(pairs, sets, radius), "simhash-pairs")
        near, far = pairs.where("near").drop("near"), pairs.where("NOT near").drop("near")
        if not near.isEmpty():
            links = staged(links.unionAll(_alike(near, sets, similarity)), "simhash-links")
            label = staged(components(links), "simhash-sets")
        apart = apart.unionAll(far)
        lo, hi = hi, hi * 8
    if most is None or apart.isEmpty():
        return label
    ends = [label.toDF(c, f"label_{c}").hint("merge") for c in "ab"]
    open_ = apart.distinct().join(ends[0], "a", "left").join(ends[1], "b", "left")
    open_ = open_.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    more = staged(_alike(open_, sets, similarity), "simhash-links")
    return label if more.isEmpty() else staged(components(links.unionAll(more)), "simhash-sets")


def one_of_each(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """One document of each near-duplicate group, with all its columns.

    Two texts are linked if their sets of word shingles have at least the given Jaccard similarity (above 0). Sets that share
    a rare shingle meet (``_prefixes``), their fingerprints are compared by bit planes, and what is within the radius is
    checked. Sets of similarity 0.8 are some 10 to 12 bits apart; those beyond the radius are checked behind the others
    (``_joined_sets``), so that no pair is missed. A fingerprint is of the set, each shingle once. Shingles and sets are known by 64- and
    63-bit hashes. Of a group the smallest ``doc_id`` stays (null ids come last, then the text's hash decides); of rows
    that agree in id and text one stays. All empty and null texts are one group.
    """
    held = rows.keyed(docs, "doc_id", "text")
    key = [*rows.KEY]

    def named(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        return rows.with_columns(part, ["doc_id", *key], g=pa.array([_set_id(s) for s in found], pa.int64()), s=pa.array([len(s) for s in found], pa.int64()))

    ids = held.select("doc_id", *key)
    known = staged(_sets(held, shingle, ["doc_id", *key], rows.widened(ids, g="bigint", s="bigint"), named), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *key)
    first = staged(known.groupBy("g", "s").agg(F.min(order).alias("one"), F.count("*").alias("n")), "simhash-first")
    total = known.agg(F.sum("s")).first()[0] or 0
    met = staged(_prefixes(_shared_shingles(held, shingle, total), first.select("g", "s"), similarity), "simhash-met")

    def listed(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        prints = pa.array([fingerprint_of(s) for s in found], pa.int64())
        return rows.with_columns(part, ["g"], fp=prints, shingles=pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())))

    ends = first.join(met.where("leads").select("token").distinct().join(met, "token").select("g").distinct().hint("merge"), "g", "left_semi")
    texts = held.select(*key, "text").join(ends.select("g", *[F.col(f"one.{k}").alias(k) for k in key]).hint("merge"), key).dropDuplicates(["g"])
    sets = staged(_sets(texts, shingle, ["g"], "g bigint, fp bigint, shingles array<bigint>", listed), "shingle-sets")
    label = _joined_sets(met, sets, similarity, radius)
    grouped = first.join(label.hint("merge"), F.col("g") == F.col("node"), "left").withColumn("set", F.coalesce("label", "g"))
    best = grouped.groupBy("set").agg(F.min("one").alias("stays"), F.sum("n").alias("n")).where("n > 1")
    stays = grouped.select("g", "set").join(best.drop("n"), "set").select(F.col("g").alias("of"), "stays")
    gone = known.join(stays, F.col("g") == F.col("of")).where((F.col(key[0]) != F.col(f"stays.{key[0]}")) | (F.col(key[1]) != F.col(f"stays.{key[1]}")))
    # What goes grows with the documents, so it is met by shuffle at every size.
    kept = held.join(gone.select(*key).distinct().hint("merge"), key, "left_anti")
    if not known.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(key)
    return kept.select(*docs.columns)


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(rows.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
