"""Edit distance of long texts, streamed digests and hash trees."""

import hashlib
import json
import random
import time

import pytest
from listing import listed
from pyspark.sql import functions as F

from voxtable.functions import edit_distance as ed
from voxtable.operators import catalog as ct
from voxtable.operators import context as cx
from voxtable.operators import quality as ql
from voxtable.operators import reports as rp
from voxtable.operators import scan
from voxtable.session import staged


def table_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("band", [1, 2, 7, 64])
def test_edit_distance_equals_the_table(monkeypatch, band):
    monkeypatch.setattr(ed, "FIRST_BAND", band)
    rnd = random.Random(band)
    for _ in range(300):
        a = "".join(rnd.choice("ab你🙂") for _ in range(rnd.randrange(50)))
        b = "".join(c for c in a if rnd.random() < 0.8) if rnd.random() < 0.5 else "".join(rnd.choice("ab你") for _ in range(rnd.randrange(50)))
        assert ed.edit_distance(a, b) == table_of(a, b) == ed.edit_distance(b, a)


def test_long_texts_need_no_table(spark):
    """200,000 characters: a table would have 40 billion cells."""
    rnd = random.Random(1)
    a = "".join(rnd.choice("天地玄黄宇宙洪荒abcdef") for _ in range(200_000))
    places = sorted(rnd.sample(range(200_000), 300))
    b = list(a)
    for i in places:
        b[i] = "Z"
    started = time.perf_counter()
    got = spark.createDataFrame([(a, "".join(b)), (a, a[7:]), ("", a), (None, a)], "x string, y string")
    got = ed.with_edit_distance(got, "x", "y", "d").collect()
    assert [r["d"] for r in got] == [300, 7, 200_000, None] and time.perf_counter() - started < 120


def test_transcript_rates_equal_line_rates(spark, rows):
    rnd = random.Random(2)
    data = [(i, "".join(rnd.choice("你好吗，。 ab") for _ in range(rnd.randrange(40))), "".join(rnd.choice("你好吗，。 ab") for _ in range(rnd.randrange(40)))) for i in range(60)] + [(60, None, "x"), (61, "你", None)]
    df = rows("id int, reference string, hypothesis string", data)
    assert listed(ql.transcript_error_rates(df), "id", "ref_chars", "cer") == listed(ql.error_rates(df), "id", "ref_chars", "cer")


def test_digest_streams_rows_in_order(spark, rows):
    rnd = random.Random(3)
    data = [(k, f"p{rnd.randrange(40):03d}", i, None if i % 5 == 0 else "é\"" + str(i)) for i, k in enumerate(rnd.choices(["a", "b", None], k=500))]
    df = rows("k string, path string, bytes bigint, note string", data).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for spaced in (False, True):
            got = {r["k"]: (r["sha256"], r["files"]) for r in rp.digest(df, ["k"], "path", ["path", "bytes", "note"], spaced=spaced).collect()}
            for key in ("a", "b", None):
                docs = [(p, json.dumps({"bytes": b, "note": n, "path": p}, ensure_ascii=False, separators=(", ", ": ") if spaced else (",", ":"))) for k, p, b, n in data if k == key]
                want = "[" + (", " if spaced else ",").join(d for _, d in sorted(docs)) + "]"
                assert got[key] == (hashlib.sha256(want.encode()).hexdigest(), len(docs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rp.digest(df.where("false"), ["k"], "path", ["path"]).count() == 0


def test_every_change_moves_the_root(spark, rows):
    data = [("t", i, f"doc {i} é") for i in range(100)] + [("u", 0, None)]

    def roots(data, **options):
        df = rows("table_name string, pos bigint, doc string", data).repartition(3)
        return {r["table_name"]: (r["n"], r["bytes"], r["leaves"], r["root"]) for r in ct.export_manifest(df, ["pos"], leaf_rows=8, **options).collect()}

    def plain(docs):
        digests = [hashlib.sha256((d or "").encode()).hexdigest() for d in docs]
        leaves = [hashlib.sha256("".join(digests[i : i + 8]).encode()).hexdigest() for i in range(0, len(digests), 8)]
        return len(docs), sum(len((d or "").encode()) for d in docs), len(leaves), hashlib.sha256("".join(leaves).encode()).hexdigest()

    base = roots(data)
    assert base == {"t": plain([d for _, _, d in data[:-1]]), "u": plain([None])}
    assert roots(data[::-1]) == base == roots(data, block_rows=9)  # neither row order nor blocks matter
    one_byte = [("t", i, d.replace("é", "è") if i == 50 else d) for _, i, d in data[:100]]
    swapped = [("t", {3: 77, 77: 3}.get(i, i), d) for _, i, d in data[:100]]
    doubled = data[:100] + [data[42]]
    shorter = data[:99]
    found = [roots(x)["t"][3] for x in (one_byte, swapped, doubled, shorter)]
    assert len({base["t"][3], *found}) == 5


def test_a_hash_tree_writes_digests_and_no_documents(rows, monkeypatch):
    written = []
    for module in (rp, scan):
        monkeypatch.setattr(module, "staged", lambda df, *name: written.append(df.columns) or staged(df, *name))
    docs = [("t", str(i)) for i in range(100)] + [(None, "x")] * 20 + [(None, None)]
    got = {r["table_name"]: (r["n"], r["bytes"], r["root"]) for r in ct.export_manifest(rows("table_name string, doc string", docs), leaf_rows=8, block_rows=9).collect()}
    assert written and not any("doc" in columns for columns in written)
    for key in ("t", None):
        mine = sorted(d or "" for k, d in docs if k == key)
        digests = [hashlib.sha256(d.encode()).hexdigest() for d in mine]
        leaves = [hashlib.sha256("".join(digests[i : i + 8]).encode()).hexdigest() for i in range(0, len(digests), 8)]
        assert got[key] == (len(mine), sum(map(len, mine)), hashlib.sha256("".join(leaves).encode()).hexdigest())


def test_a_proposal_for_an_unknown_line_is_a_row(rows):
    lines = rows("batch bigint, alias string, segment_id string, zh_text string", [(1, "s1", "seg_a", "你好 吗")])
    people = rows("series_id bigint, character_id string", [(9, "anna")])
    schema = "series_id bigint, batch bigint, alias string, character_id string, addressee_id string, addressing map<string,string>, evidence string"
    offers = rows(schema, [(9, 1, "s1", "anna", None, {"self": "x"}, "你好"), (9, 1, "s7", "anna", None, {"self": "x"}, "你好"), (9, 2, "s1", "anna", None, {}, "你好"), (9, None, None, None, None, None, None)])
    got = cx.context_proposals(offers, lines, people, ["batch"])
    assert listed(got, "batch", "alias", "segment_id", "known_line", "accepted") == sorted(
        [(1, "s1", "seg_a", True, True), (1, "s7", None, False, False), (2, "s1", None, False, False), (None, None, None, False, False)], key=repr)


def test_a_missing_translation_lacks_the_locked_wording(rows):
    lines = rows("series_id bigint, batch bigint, zh string, sub string, dub string", [
        (1, 1, "甲乙", None, None), (1, 2, "甲乙", "ja", None), (1, 3, "甲乙", "JA!", "ja"), (1, 4, "丙", None, None)])
    terms = rows("series_id bigint, term string, vi string", [(1, "甲", "Ja")])
    got = cx.locked_term_rejects(lines, terms, ["series_id"], ["batch"], source="zh", subtitle="sub", dub="dub", term="term", target="vi")
    assert listed(got, "batch", "omissions") == [(1, 1), (2, 1)]
