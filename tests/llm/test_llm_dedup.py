"""Line, SimHash and suffix dedup against brute force; odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxtable.llm import components, line_dedup, simhash, suffix_dedup

SHINGLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_lines(texts, least):
    def key(line):
        return lowered(line.strip(" \t\n\v\f\r"))

    split = [(t or "").split("\n") for t in texts]
    docs = collections.Counter(k for lines in split for k in {key(x) for x in lines})
    out = []
    for lines in split:
        kept = [x for x in lines if not key(x) or docs[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    rnd = random.Random(batches)
    pool = ["Alpha ", "alpha", "\tBETA", "beta\r", "", " ", "İx", "gamma", "Ünique"] + [f"line {i}" for i in range(30)]
    texts = [None if rnd.random() < 0.05 else "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = line_dedup.drop_repeated_lines(docs, min_docs=10, batches=batches, fanout=fanout).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got] == brute_lines(texts, 10)


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for batch in ([(1, 1), (1, 1), (2, 2)], [(1, 1), (3, 3)], [(1, 1), (2, 2), (3, 3), (3, 3)], [(2, 2)]):
        runs.add(spark.createDataFrame(batch, "hi bigint, lo bigint"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(r["hi"] for r in runs.repeated().collect()) == [1, 2, 3]


def test_line_odd_rows(odd, empty):
    out = line_dedup.drop_repeated_lines(odd, min_docs=2).collect()
    assert len(out) == odd.count()
    assert {r["n_lines"] for r in out if r["text"] in (None, "")} == {1}
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def print_of(text, width):
    w = SHINGLE_WORD.findall(lowered(text))
    found = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in found]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def sets_of(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_bit_sliced_sets_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(25):
        radius, n = int(rng.integers(0, 12)), int(rng.integers(1, 260))
        buckets = np.sort(rng.integers(0, max(1, n // int(rng.integers(1, 90))), n))
        prints = rng.integers(-(2**62), 2**62, 4)[rng.integers(0, 4, n)]
        for _ in range(int(rng.integers(0, 14))):
            prints = prints ^ (np.int64(1) << rng.integers(0, 63, n))
        a, b = simhash.sets_within(prints, buckets, radius)
        near = np.bitwise_count((prints[:, None] ^ prints[None]).view(np.uint64)) <= radius
        want = sets_of(n, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j and buckets[i] == buckets[j]])
        assert sets_of(n, zip(a.tolist(), b.tolist())) == want and len(a) == n - len(set(want))


def test_block_tables_lose_no_pair():
    rnd = random.Random(1)
    for radius, matched in ((0, 2), (4, 2), (8, 2), (5, 3)):
        masks = simhash.block_masks(radius, matched)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for k in rnd.sample(range(64), radius):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("bucket_rows", [8192, 3])
def test_near_duplicates(spark, bucket_rows):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(150)) for _ in range(4)]
    texts = [None, "", "a", "A", "a b c d e", *base]
    for _ in range(60):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = [print_of(t, 4) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {i * 3 + 1: (prints[i], s * 3 + 1) for i, s in enumerate(sets_of(len(texts), near))}
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in got} == want
    links = simhash.near_links(spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "p bigint"), 4, bucket_rows=bucket_rows).collect()
    at = {p: i for i, p in reversed(list(enumerate(prints)))}
    same = [(i, at[p]) for i, p in enumerate(prints)]
    assert sets_of(len(texts), same + [(at[r["a"] % 2**64], at[r["b"] % 2**64]) for r in links]) == sets_of(len(texts), near)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["label"] for r in got.collect()} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_odd_rows(odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[7]["component_id"] == by_id[6]["component_id"] == 5
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each(odd, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 9, 11, 12, 13, None]
    assert simhash.one_of_each(empty).count() == 0


def numbered(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect())


def brute_kept(texts):
    def shingles(t):
        w = SHINGLE_WORD.findall(lowered(t))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    return sorted(set(sets_of(len(sets), linked)))


def test_one_of_each_is_pure_jaccard(spark):
    """Tails of all lengths around the threshold, short and long texts, chains, blocks that move."""
    rnd = random.Random(11)
    texts = ["", None, " ", "a", "A", "a b c d e", "a b c d e f"]
    for n in (8, 12, 60, 150, 400):
        for _ in range(12):
            base = numbered(rnd, n)
            texts.append(" ".join(base))
            for part in (0.05, 0.15, 0.19, 0.2, 0.21, 0.25):
                m = int(n * part * rnd.uniform(0.5, 1.1))
                texts.append(" ".join(rnd.choice([base[: n - m] + numbered(rnd, m // 2), base[m:] + base[:m], base[m:], base + numbered(rnd, m)])))
    rnd.shuffle(texts)
    assert kept_ids(spark, texts) == brute_kept(texts)


def test_bystanders_hide_no_pair(spark):
    """A long passage shared by many texts that are unlike each other (0.71), and pairs of 0.8 or more among them."""
    rnd = random.Random(12)
    passage = numbered(rnd, 250)
    texts = [" ".join(passage + numbered(rnd, 50)) for _ in range(300)]
    for _ in range(30):
        own = numbered(rnd, 50)
        texts += [" ".join(passage + own), " ".join(passage + own[: rnd.randrange(25, 50)] + numbered(rnd, 5))]
    rnd.shuffle(texts)
    want = brute_kept(texts)
    assert len(want) < len(texts) - 20 and kept_ids(spark, texts) == want


def test_equal_fingerprints_are_checked(spark):
    """One repeated shingle outvotes all others, so unlike texts have one fingerprint."""
    rnd = random.Random(13)
    texts = ["- " * 260 + " ".join(numbered(rnd, 200)) for _ in range(60)]
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts}) == 1
    assert kept_ids(spark, texts + texts[:5]) == list(range(60))


def brute_bytes(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,seed,bucket_rows", [(64, 1, 50_000), (100, 2, 50_000), (400, 3, 50_000), (100, 2, 3)])
def test_suffix_dedup(spark, length, seed, bucket_rows):
    rnd = random.Random(seed)

    def noise(n):
        return "".join(rnd.choice("ab \0é") for _ in range(n))

    shared = [noise(rnd.randint(length - 20, 3 * length)) for _ in range(6)] + ["a" * 2 * length, ("xyz" + noise(47)) * 12, "\0" * 2 * length]
    texts = [noise(rnd.randint(0, length)) + rnd.choice(shared) + noise(rnd.randint(0, 60)) + (rnd.choice(shared)[rnd.randint(0, 50) :] if rnd.random() < 0.5 else "") for _ in range(70)]
    texts += [None, "", "a" * (length - 1), "a" * length, "b" * length, "c" * (length + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.drop_repeated_bytes(docs, length=length, bucket_rows=bucket_rows).orderBy("doc_id")
    got = got.select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    assert [tuple(r) for r in got] == brute_bytes(texts, length)


def test_suffix_odd_rows(odd, empty):
    out = suffix_dedup.drop_repeated_bytes(odd, length=64).collect()
    assert len(out) == odd.count()
    prose = [r for r in out if r["doc_id"] in (5, 6)]
    assert len(prose) == 3 and all(r["n_removed"] == r["n_bytes"] and r["kept"] == b"" for r in prose)
    assert suffix_dedup.drop_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(odd, 50)


def test_pairs_within_by_bit_planes():
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63, 1000, np.int64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 40), replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    apart = np.array([int(f).bit_count() for f in flips])
    for radius in (0, 4, 20):
        assert (simhash.pairs_within(a, b, radius) == (apart <= radius)).all()
    assert len(simhash.pairs_within(a[:0], b[:0], 4)) == 0


def test_fingerprints_hold_near_sets_within_the_radius():
    """Sets of Jaccard 0.8 and more: at least 0.99 of the pairs lie within the 20 bits of the first check."""
    rng = np.random.default_rng(6)
    for size in (5, 10, 40, 400):
        other = size // 10 if size >= 10 else 0
        near = []
        for _ in range(500):
            h = rng.integers(0, 2**64, size + other, np.uint64)
            one, two = (h[:size], h[other:]) if other else (h, h[1:])
            near.append(int(simhash.fingerprint_of(one) ^ simhash.fingerprint_of(two)) % 2**64)
        assert sum(x.bit_count() <= 20 for x in near) >= 495


@pytest.mark.parametrize("radius", [0, 20, 64])
def test_near_stage_compares_fingerprints_and_loses_no_pair(spark, radius, monkeypatch):
    """Whatever the radius lets through first, the same documents stay."""
    text = [f"w{i}" for i in range(60)]
    near = [" ".join([*text[:at], "x", *text[at + 1:]]) for at in (1, 30, 58)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(text), *near, " ".join(text[:30] + ["y"] * 30)])], "doc_id long, text string")
    seen = []
    compared = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda *a: seen.append(a[2]) or compared(*a))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, radius=radius).collect()) == [0, 4]
    assert seen and set(seen) == {radius}
