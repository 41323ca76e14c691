"""Fingerprints, decontamination, mixing, token counts, HTML and the pipeline."""

import hashlib
import random
import re
import sys
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

from test_llm_dedup import SHINGLE_WORD, brute_lines, lowered, sets_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from voxtable.llm import decontamination, fingerprints, html_text, mixing, quality, registry, rows, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_edited_texts(spark):
    texts = [(None, "zero null id"), (3, "abcdefgh"), (5, None), (5, "x"), (9, "ééééüüüü"), (9, "ééééüüüü"), (12, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r["doc_id"], r["text"]): r["edited"] for r in fingerprints.edited_texts(docs).collect()}
    assert got[(9, "ééééüüüü")] == "ééééüü" and got[(12, "")] == "" and got[(None, "zero null id")] == "zero nullabc"
    out = fingerprints.edit_likeness(docs)
    assert out.count() == len(texts)
    assert fingerprints.edit_likeness(docs.where("doc_id = 3")).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def brute_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    return w


def test_fingerprints(spark, odd, empty):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A  b\nC"), (3, ""), (4, "a")], "k bigint, text string")
    got = {r["k"]: r["fingerprint"] for r in fingerprints.fingerprints(docs, ["k"]).collect()}
    assert got[1] == got[2] and got[3] == 0 and brute_print("A  b\nC") == ["a", "b", "c"]
    assert got[4] == spark.range(1).select(F.xxhash64(F.lit("a")).alias("h")).first()["h"]
    votes = [(r["h"], r["g"]) for r in spark.sql("SELECT xxhash64('a') h, 1 g UNION ALL SELECT xxhash64('b'), 1 UNION ALL SELECT xxhash64('c'), 1 UNION ALL SELECT xxhash64('a','b'), 2 UNION ALL SELECT xxhash64('b','c'), 2").collect()]
    want = sum(1 << k for k in range(64) if 2 * sum(g for h, g in votes if h % 2**64 >> k & 1) > 7)
    assert got[1] % 2**64 == want
    assert fingerprints.edit_likeness(odd).count() == odd.count() and fingerprints.edit_likeness(empty).count() == 0


def test_within_radius(spark):
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(50)]
    for p in list(prints):
        for n in range(6):
            q = p
            for k in rnd.sample(range(64), n):
                q ^= 1 << k
            prints.append(q)
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "p bigint")
    asked = spark.createDataFrame(signed[:40], "p bigint")
    got = {(r["a"], r["b"], r["bits"]) for r in fingerprints.within_radius(table, asked, 3).collect()}
    assert got == {(a, b, (x ^ y).bit_count()) for (a,), x in zip(signed[:40], prints) for (b,), y in zip(signed, prints) if (x ^ y).bit_count() <= 3}


def test_decontamination(spark, odd, empty):
    rnd = random.Random(6)
    item = [f"q{i}" for i in range(30)]
    noise = lambda n: [f"n{rnd.randrange(10**6)}" for _ in range(n)]
    partly, broken = item[:27], [x for i, x in enumerate(item) for x in ((x, "z") if i % 4 == 3 else (x,))]
    strewn = " ".join(f"{x.upper()}###" for x in item)
    docs = spark.createDataFrame([
        (9, "Ähm! " + strewn), (1, " ".join(noise(3000) + [x.upper() for x in item] + noise(3000))), (2, " ".join(partly)), (3, " ".join(item[:20])), (4, " ".join(broken)),
        (5, "short Item"), (6, "a short item"), (None, " ".join(item)), (7, None), (8, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short item"), (3, None), (4, ""), (None, " ".join(item))], "item_id bigint, text string")
    for limit in (200_000, 1):
        got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontamination.contained_items(docs, bench, broadcast_rows=limit).collect()}
        assert got == {(9, 1, 26, 26), (9, None, 26, 26), (1, 1, 26, 26), (1, None, 26, 26), (2, 1, 23, 26), (2, None, 23, 26), (None, 1, 26, 26), (None, None, 26, 26), (5, 2, 1, 1), (6, 2, 1, 1)}
    assert sorted(r["doc_id"] for r in decontamination.without_contaminated(docs, bench).collect()) == [3, 4, 7, 8]
    kept = decontamination.without_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontamination.contained_items(empty, bench).count() == 0 and decontamination.without_contaminated(odd, bench.where("false")).count() == odd.count()


def test_sketch_is_never_too_short():
    for n in range(1, 400):
        top = min(400, 2 ** (n.bit_length()) - 1)
        for threshold in (0.5, 0.8, 1.0):
            need = -int(-(threshold * n) // 1)
            length = top - -int(-(threshold * top - 1e-9) // 1) + 1
            assert min(length, n) > n - need


def test_budget_fits_exactly_where_it_can():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 6)))
        counts = [rnd.randint(1, 4) for _ in lengths]
        budget = rnd.randint(0, sum(n * c for n, c in zip(lengths, counts)))
        taken = mixing.fit_budget(lengths, counts, budget)
        total = sum(n * t for n, t in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and total <= budget
        assert budget - total < max(lengths)
    assert mixing.fit_budget([2, 3, 100], [5, 5, 1], 11) in ([4, 1, 0], [1, 3, 0]) and mixing.fit_budget([1, 7], [9, 9], 33)[0] * 1 + mixing.fit_budget([1, 7], [9, 9], 33)[1] * 7 == 33


def test_targets_reshare(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 50), ("d", 10), (None, 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    weights, caps = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])), {s: 2.0 * n for s, n in sizes}
    want, left, free = {}, 1.5 * 1160, set(weights)
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > caps[s]}
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
        free -= over
    want |= {s: level * weights[s] for s in free}
    assert got == pytest.approx(want)


def test_mix(spark, odd, empty):
    docs = rows.table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count() and (out["taken"] <= 2 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 5
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(out.doc_id, out.taken)) == dict(zip(again.doc_id, again.taken))


def test_token_counts(spark, odd, empty):
    counted = token_counts.with_token_counts(odd).select("text", "n_tokens").collect()
    encode = token_counts._encoder(Path(token_counts.VOCABULARY).read_bytes(), token_counts.PATTERN).encode_ordinary
    lengths = [len(encode(r["text"] or "")) for r in counted]
    assert [r["n_tokens"] for r in counted] == lengths
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd)).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and r["docs_upto"] == sum(x <= n for x in lengths)
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    ordered = sorted(lengths)
    for share in (0.01, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, share) == ordered[max(0, -int(-(share * len(ordered)) // 1) - 1)]
    none = token_counts.suffix_sums(token_counts.length_histogram(empty))
    assert none.count() == 0 and token_counts.truncated_total(none, 5) == 0 and token_counts.quantile(none, 0.5) is None
    with pytest.raises(ValueError):
        token_counts.with_token_counts(odd, max_bytes=10)


def test_html_layout():
    cases = {
        "<p>one<p>two<br>three<div>four</div>five": "one\n\ntwo\nthree\n\nfour\nfive",
        "<ul><li>a<li>b<ol start=3><li>x<li value=9>y<li>z</ol></ul>": "- a\n- b\n\n  3. x\n  9. y\n  10. z",
        "<table><caption>C</caption><tr><th>Name<th>N<tr><td>long name<td>1<tr><td rowspan=2>q<td>22<tr><td>é</table>": "C\nName       N\nlong name  1\nq          22\n           é",
        "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>": "wide cell     x\na          b  c",
        "<table><tr><td>l1<br>l2<td>r</table>": "l1  r\nl2",
        "a<script>b</script><style>c</style><template>d</template><p hidden>e</p><i style='display: none'>f</i>g": "ag",
        "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>": "b",
        "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>d</dialog>": "s\nt\nyes",
        "<select><option>a<option selected>b</select>": "b",
        "<pre>\n a\n   b\n</pre><blockquote>q</blockquote>": " a\n   b\n\n  q",
        "x &lt;y&gt; &amp;&nbsp;z <!-- c --> w": "x <y> & z w",
        "<title>T</title><body>1 < 2 <b>bold</i> end": "1 < 2 bold end",
        "": "", "<td>stray": "stray", "plain\n  text": "plain text",
    }
    for html, want in cases.items():
        assert html_text.render(html) == want, html
    deep = html_text.render("<div>" * 4000 + "in" + "</div>" * 4000 + "<p>out")
    assert deep == "in\n\nout"


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attributes):
        self.skip += tag in ("script", "style", "head")
        self.out.append(" " if tag in html_text.BLOCKS or tag == "br" else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out.append(" " if tag in html_text.BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_keeps_all_visible_words(spark):
    pages = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for page, html in pages:
        flat = _Flat()
        flat.feed(html)
        words = lambda t: [w for w in t.split() if not re.fullmatch(r"-|\d+\.", w)]
        assert words(got[page]) == words("".join(flat.out)), page


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "<p>a", "z"), (1, "<p>a", "z"), (2, "<b>" + "w " * 200_000, "t")], "page_id bigint, html string, text string")
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "text"] and sorted(len(r["text"]) for r in out.collect()) == [0, 0, 1, 1, 399_999]
    assert html_text.extract_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<p title=don't>Shown it's here</p> after", "Shown it's here\n\nafter"),
    ("<div class=\"a\"\">x</div>", "x"),
    ("<a href=x?a='b>one</a> two", "one two"),
    ("<img alt=\"a > b\" src='c>d'>text", "text"),
    ("<p data-x = \"1>2\" hidden>no</p><p data-y= '>'>yes</p>", "yes"),
    ("<p 'a' \"b\">quoted names</p>", "quoted names"),
    ("<p a=\"never closed>still here", "still here"),
    ("<br/><input value=a/>end", "end"),
])
def test_html_attributes(page, text):
    assert html_text.render(page).strip() == text


def test_html_very_deep():
    """Below the tree's depth: visible text stays, hidden text does not come out."""
    deep = "<div>" * 400
    assert html_text.render(deep + "seen<p hidden>no<b>no</b></p>too<span style='display:none'>no</span><i style='visibility:hidden'>no</i>!" + "</div>" * 400 + "end").split() == ["seentoo!", "end"]


def test_html_tags_are_read_once():
    """No input makes the tag pattern go back over what it read."""
    import time

    started = time.perf_counter()
    for piece in ("<a " + "=x" * 50_000, "<a " + "='x' " * 50_000, "<a b=\"" * 3_000, "<a " + "= " * 50_000, "<" * 50_000, "<a b='" + "x" * 100_000):
        html_text.render(piece)
    assert time.perf_counter() - started < 60


def test_short_items_are_found_inside_long_documents(spark):
    """Plain Python: an item of n words is looked for among all runs of min(n, 5) words."""
    rnd = random.Random(6)
    vocab = ["a", "b", "c", "d", "é"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 30)))) for i in range(40)] + [(None, "x y"), (40, None), (41, "Q1, only")]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 9)))) for i in range(25)] + [(None, "y"), (30, "only"), (31, "q1 ONLY!"), (32, "")]
    items += [(50 + i, " ".join(t.split()[2 : 7 + i % 3])) for i, t in docs[:20]]

    def cut(text, width):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    want = set()
    for item, text in items:
        width = min(len(re.findall(r"[^\W_]+", text.lower())), 5)
        own = cut(text, width) if width else set()
        want |= {(doc, item, len(own & cut(t, width)), len(own)) for doc, t in docs if own and len(own & cut(t, width)) >= 0.8 * len(own) - 1e-9}
    got = decontamination.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got.collect()} == want
    assert {n for _, _, _, n in want} >= {1, 2, 3}


def test_pipeline_stages(spark, plain, odd, empty):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "line_stage", "near_stage", "benchmark_stage", "mixing_stage"]
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, SF)
            assert out.columns[:5] == corpus_pipeline.COLUMNS
            assert out.count() <= docs.count()


def test_pipeline_against_brute_force(spark):
    """Each stage on what the stage before it kept, in plain Python; the mix is checked by its sums."""
    docs = rows.table(spark, SF, "documents")
    held = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit_quality(docs.select("doc_id", "text"), rows.table(spark, SF, "labels"))
    kept = [i for i in sorted(held) if model.scores([(held[i]["text"] or "").encode()])[0] >= 0.3]
    lines = brute_lines([held[i]["text"] for i in kept], 10)
    text = {i: None if held[i]["text"] is None else x for i, (_, _, x) in zip(kept, lines)}

    def shingles(t):
        w = SHINGLE_WORD.findall(lowered(t))
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    sets = {i: shingles(text[i]) for i in kept}

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9

    groups = sets_of(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if linked(kept[a], kept[b])])
    kept = [i for k, i in enumerate(kept) if groups[k] == k]
    def plain(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    items = [plain(r["text"]) for r in rows.table(spark, SF, "benchmark").collect()]
    kept = [i for i in kept if not any(len(x & plain(text[i])) >= 0.8 * len(x) - 1e-9 for x in items if x)]

    now = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert sorted(got) == kept and got == {i: text[i] for i in kept}
    mixed = corpus_pipeline.STAGES[4][1](spark, now, SF).toPandas()
    size = {i: len(SHINGLE_WORD.findall(text[i] or "")) for i in kept}
    assert set(mixed["doc_id"]) <= set(kept) and all(size[i] == n for i, n in zip(mixed["doc_id"], mixed["size"]))
    for source, g in mixed.groupby("source"):
        own = [size[i] for i in kept if held[i]["source"] == source]
        assert g["source_size"].iloc[0] == sum(own) and abs(g["target"].iloc[0] - g["taken"].sum()) <= max(own)


def test_pipeline_by_stages(spark):
    docs = rows.table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(out) < docs.count() and out["doc_id"].is_unique
    assert ((out["taken"] == out["repeats"] * out["size"]) & (out["repeats"] > 0)).all()
    kept = spark.createDataFrame(out[["doc_id", "text"]], "doc_id bigint, text string")
    assert decontamination.contained_items(kept, rows.table(spark, SF, "benchmark")).count() == 0
