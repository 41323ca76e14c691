import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxtable.llm import alignment, rows

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def brute(tools, docs):
    """Plain loops: tokens one by one, groups by walking both lists, overlaps by comparing ranges."""
    a, b = tools
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    to_byte, extra = {chr(x): x for x in shown}, 256
    for x in range(256):
        if x not in shown:
            to_byte[chr(extra)] = x
            extra += 1

    def spans(parts):
        at, out = 0, []
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    links, counted, base = [], defaultdict(set), []
    for number, (doc_id, text) in enumerate(docs):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            base.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        sa, sb = spans(parts_a), spans(parts_b)
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, sa) if s >= low and e <= high) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, sb) if s >= low and e <= high))
            low = high
        base.append((doc_id, len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        met = [(x, y) for x, (s, e) in zip(ids_a, sa) for y, (t, f) in zip(ids_b, sb) if s < f and t < e]
        links.append(met)
        for pair in met:
            counted[pair].add(number)
    count = {p: len(d) for p, d in counted.items()}
    high = Counter()
    for (x, _), n in count.items():
        high[x] = max(high[x], n)
    return [(i, na, nb, ng, len(met), sum(count[p] == high[p[0]] for p in met), sum(count[p] for p in met), h) for (i, na, nb, ng, h), met in zip(base, links)]


def result(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed):
    rnd = random.Random(seed)
    parts = ["the ", "house", "naïve ", "Straße ", "日本語", "🙂👍🏽", "\n\n", "\t", "  ", "foo_bar(x);", "'s", "12345", "ключ ", "<|endoftext|>", "</s>", "<0x41>", "▁", " ", "\0", "ﬁ", "é", "‍"]
    return [(i, "".join(rnd.choice(parts[: 18 if i % 3 else len(parts)]) for _ in range(rnd.randrange(1, 40)))) for i in range(60)]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 23])
def test_against_brute_force(spark, tools, block_bytes):
    docs = made(block_bytes) + [(100, None), (101, ""), (102, " "), (103, "▁"), (None, "no id"), (104, "same text"), (104, "same text")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = brute(tools, docs)
    assert any(w[1] for w in want) and any(not w[1] and t for w, (_, t) in zip(want, docs))
    assert result(alignment.align(df, block_bytes=block_bytes)) == sorted(want, key=repr)


def test_given_documents(spark, tools):
    docs = [(r["doc_id"], r["text"]) for r in rows.table(spark, SF, "documents").where("length(text) < 1500").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(alignment.align(df)) == sorted(brute(tools, docs), key=repr)
    assert alignment.op12(spark, SF).count() == rows.table(spark, SF, "documents").count()


def test_groups_and_links_of_random_ends():
    rnd = random.Random(2)
    for _ in range(300):
        ends, whole, base = ([], []), [], 0
        for _ in range(rnd.randrange(1, 4)):
            n = rnd.randrange(1, 30)
            begin = [len(e) for e in ends]
            for e in ends:
                e.extend(base + x for x in sorted({n, *(x for x in range(1, n) if rnd.random() < rnd.choice([0.1, 0.5, 0.9]))}))
            whole.append((begin[0], len(ends[0]), begin[1], len(ends[1])))
            base += n
        a, b = (np.array(e) for e in ends)
        groups = alignment.leaf_groups(a, b, np.array(whole))
        assert [int(a[g[1] - 1]) for g in groups] == [int(b[g[3] - 1]) for g in groups] == sorted(set(ends[0]) & set(ends[1]))
        starts = [[0, *e[:-1]] for e in ends]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        got = list(zip(*(x.tolist() for x in alignment.links(groups, a, b))))
        assert len(got) == len(want) and set(got) == want


def test_odd_rows(spark, odd, plain, empty):
    got = result(alignment.align(odd))
    assert got == result(alignment.align(plain)) and len(got) == plain.count()
    assert all(r[1:7] == (0,) * 6 and r[7] == "" for r in got if r[0] in (1, 2))
    assert result(alignment.align(empty)) == []


def test_vocabulary_too_large(plain):
    with pytest.raises(ValueError, match="at most 10"):
        alignment.align(plain, max_bytes=10)


def test_byte_alphabet_is_that_of_the_vocabulary():
    used = {c for t in json.load(open(alignment.BYTE_LEVEL))["model"]["vocab"] for c in t}
    assert used <= set(alignment.byte_level_alphabet()) | set("<|endoftext|>")


def test_rank_encoder_gives_the_ids_of_the_vocabulary():
    """Every 37th code point, between letters, digits, signs and blanks of several kinds (all of them were compared once)."""
    codec = alignment.Codec(open(alignment.BYTE_LEVEL, "rb").read(), open(alignment.PIECES, "rb").read())
    assert codec.ranked is not None
    points = [chr(x) for x in [*range(1, 0x3000), *range(0x3000, 0x110000, 37)] if not 0xD800 <= x < 0xE000]
    texts = [f"a{c}b 1{c}2{c} {c}{c}!{c}  {c}\n{c}'{c}s" for c in points] + ["  \n\t x  ", "don't WE'LL", "<|endoftext|>", " " * 700, "ab" * 700]
    assert codec.by_a(texts) == [e.ids for e in codec.a.encode_batch(texts, add_special_tokens=False)]
    other = json.load(open(alignment.BYTE_LEVEL))
    other["pre_tokenizer"]["add_prefix_space"] = True
    assert alignment.ranked_vocabulary(json.dumps(other).encode()) is None
