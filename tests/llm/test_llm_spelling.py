import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxtable.llm import rows, spelling

SF = "/root/testdata/sf0.001"


def edits(a, b):
    """Plain Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def counted(docs, least=7):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def brute(words):
    less = {}  # words of one edit are equal once at most one code point is taken from each
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            less.setdefault(x, set()).add(w)
    out = {}
    for w, n in words.items():
        near = set().union(*(less[x] for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}))
        near = [x for x in near if edits(w, x) == 1]
        best = min(near, key=lambda x: (-words[x], x)) if near else None
        out[w] = [n, len(near), *((best, words[best]) if best and words[best] >= 10 * n else (None, None))]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got}


def made(seed, words, alphabet="ab", length=9):
    """Texts over few letters, so that words have many near ones, with very uneven counts."""
    rnd = random.Random(seed)
    found = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(7, length + 1))) for _ in range(words)]
    return [(i, " ".join(rnd.choices(found, weights=[rnd.choice([1, 1, 1, 30, 900]) for _ in found], k=400))) for i in range(40)]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 4096), (2, 3), (3, 1), (4, 20)])
def test_against_brute_force(spark, seed, bucket_rows):
    """Also where buckets are cut down to single code points."""
    docs = made(seed, 400, "ab" if seed % 2 else "aÀß", 8)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute(counted(docs))
    assert max(v[1] for v in want.values()) > 5 and any(v[2] for v in want.values())
    assert result(spelling.spelling_variants(df, bucket_rows=bucket_rows)) == want


def test_chains_of_forms(spark):
    text = " ".join(["abcdefgh"] * 20_000 + ["abcdefgx"] * 2000 + ["abcdefyx"] * 200 + ["abcdezyx"] * 20 + ["abcdwzyx"] * 2)
    got = result(spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), every=1 << 40))
    assert got["abcdwzyx"] == (2, 1, "abcdezyx", 20, "abcdefgh") and got["abcdefgh"] == (20_000, 1, None, None, "abcdefgh")


def test_given_documents(spark):
    docs = rows.table(spark, SF, "documents")
    want = brute(counted([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert result(spelling.op11(spark, SF)) == want


def test_near_words_on_random_lists():
    rnd = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([4, 5]))) for _ in range(rnd.randrange(1, 40))})
        size = np.array([len(w) for w in words])
        n = np.array([rnd.randrange(1, 5) for _ in words])
        chars = np.frombuffer("".join(words).encode(), np.uint8)
        near, best = spelling.near_words(chars, np.cumsum(size) - size, size, n, np.zeros(len(words), np.int64), np.full(len(words), 4), np.ones(len(words), bool))
        for i, w in enumerate(words):
            others = [j for j, x in enumerate(words) if edits(w, x) == 1 and min(len(w), len(x)) == 4]
            assert near[i] == len(others)
            assert best[i] == (min(others, key=lambda j: (-n[j], words[j])) if others else -1)


def test_odd_rows(spark, odd, plain, empty):
    want = brute(counted([(r["doc_id"], r["text"]) for r in plain.collect()]))
    assert result(spelling.spelling_variants(odd)) == result(spelling.spelling_variants(plain)) == want
    assert result(spelling.spelling_variants(empty)) == {}
    long = spark.createDataFrame([(1, "x" * 60_000 + " " + "x" * 60_001), (2, "x" * 60_000 + " " + "x" * 60_001 + " Éclairs éclairs Éclairs éclairs")], "doc_id bigint, text string")
    got = result(spelling.spelling_variants(long, every=1 << 40))
    assert {len(w): v[1] for w, v in got.items() if w[0] == "x"} == {60_000: 1, 60_001: 1}
    assert got["Éclairs"] == (2, 1, None, None, "Éclairs")  # only A-Z is lowered
