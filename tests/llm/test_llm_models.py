"""Classifiers: held-out accuracy, independence of rows, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.llm import language, quality, rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit_quality(rows.table(spark, SF, "documents"), rows.table(spark, SF, "labels"))


def test_quality_on_held_out_rows(spark, model):
    docs, labels = rows.table(spark, SF, "documents").select("doc_id", "text"), rows.table(spark, SF, "labels")
    scored = quality.score_quality(docs, model).where(rows.held_out()).join(labels, "doc_id").toPandas()
    right = ((scored["score"] >= 0.3).astype(int) == scored["quality"]).mean()
    good, bad = scored[scored.quality == 1].score.values, scored[scored.quality == 0].score.values
    assert right >= 0.9 and (good[:, None] > bad[None]).mean() >= 0.95


def test_quality_score_does_not_depend_on_neighbours(model):
    texts = [b"", b"one", b"Some text. " * 3000, b"$$$ ### " * 50, b"z" * (quality.PIECE + 77)]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)
    assert ((together >= 0) & (together <= 1)).all()


def test_quality_reads_the_end_of_long_texts(model):
    tail = model.scores([b"Calm words here. " * 5000, b"Calm words here. " * 5000 + b"$$$ ### %%% " * 20000])
    assert tail[0] != tail[1]


def test_quality_gradient():
    net = quality.ByteConvNet()
    net.weights["out"] = np.random.default_rng(1).normal(size=2 * quality.FILTERS)
    texts, labels = [b"abc def " * 40, b"%%% " * 100], np.array([1.0, 0.0])
    grads = net._gradients(texts, labels)

    def loss():
        p = net.scores(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, at in (("out", (3,)), ("base", (0,)), ("filter", (2, 1, 4)), ("code", (37, 2))):
        kept = net.weights[name][at]
        net.weights[name][at] = kept + 1e-3
        up = loss()
        net.weights[name][at] = kept - 1e-3
        down = loss()
        net.weights[name][at] = kept
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name


def test_quality_odd_rows(odd, empty, spark, model):
    out = quality.score_quality(odd, model)
    assert out.count() == odd.count() and out.where("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.score_quality(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert set(quality.score_quality(odd, quality.fit_quality(odd, none)).select("score").toPandas()["score"]) == {0.5}


def test_language(spark):
    docs = rows.table(spark, SF, "documents")
    found = language.identify_language(docs, language.fit_language(docs)).where(rows.held_out()).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() >= 0.97
    assert found["score"].between(0, 1).all()


def test_language_odd_rows(odd, empty):
    model = language.fit_language(odd)
    out = language.identify_language(odd, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.fit_language(empty) is None
    assert {r["lang_pred"] for r in language.identify_language(odd, None).collect()} == {"und"}


def test_language_families_and_pairs(spark):
    texts = {"en": "the thing with that", "de": "der schnee und nicht", "fr": "le château est que", "es": "el niño que los", "xx": "qqq zzz qzq"}
    docs = spark.createDataFrame([(i, f"{t} {i} {t[::-1]}", k) for i in range(40) for k, t in texts.items()], "doc_id bigint, text string, lang string")
    model = language.fit_language(docs)
    assert sorted(model.families.names) == ["germanic", "romance", "xx"] and model.within["romance"].names == ["es", "fr"]
    names, score = model.predict([*texts.values(), "123"])
    assert names == [*texts, "und"] and score[-1] == 0
    alone = [model.predict([t])[0][0] for t in texts.values()]
    assert alone == names[:-1]


def test_a_share_may_be_tiny(spark):
    """A share below a millionth still draws rows, and all rows are drawn by a share of one."""
    df = spark.range(20_000_000)
    n = df.where(rows.drawn(4e-7, F.col("id"))).count()
    assert 1 <= n <= 25 and spark.range(1000).where(rows.drawn(1.0, F.col("id"))).count() == 1000
    assert abs(df.where(rows.drawn(0.01, F.col("id"))).count() - 200_000) < 3000


def test_scores_equal_nested_loops():
    """A plain forward pass: every filter at every place, chunks of two strides, the mean and the maximum over chunks."""
    net = quality.ByteConvNet(seed=3)
    rng = np.random.default_rng(5)
    net.weights["out"], net.weights["bias"], net.weights["base"] = rng.normal(0, 1, 2 * quality.FILTERS), rng.normal(0, 0.1, quality.FILTERS), np.array([0.2])
    texts = [b"", b"x", b"short text", bytes(rng.integers(32, 127, quality.STRIDE - 1, dtype=np.uint8)), bytes(rng.integers(0, 256, 3 * quality.STRIDE + 7, dtype=np.uint8))]
    w, got = net.weights, net.scores(texts)
    for text, score in zip(texts, got):
        n = -(-(len(text) + quality.WIDTH) // quality.STRIDE)
        data, peaks = text.ljust((n + 1) * quality.STRIDE, b"\0"), []
        for s in range(n):
            best = [-1e9] * quality.FILTERS
            for at in range(s * quality.STRIDE, (s + 1) * quality.STRIDE, quality.STEP):
                if at >= n * quality.STRIDE - quality.WIDTH:
                    continue  # would reach behind the text's own padding
                for f in range(quality.FILTERS):
                    best[f] = max(best[f], sum(float(w["code"][data[at + k]] @ w["filter"][k][:, f]) for k in range(quality.WIDTH)))
            peaks.append(best)
        chunks = [[max(0.0, max(peaks[c][f], peaks[min(c + 1, n - 1)][f]) + w["bias"][f]) for f in range(quality.FILTERS)] for c in range(n)]
        x = [sum(c[f] for c in chunks) / n for f in range(quality.FILTERS)] + [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
        assert abs(score - 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, w["out"])) + w["base"][0])))) < 1e-4


def test_language_equals_a_plain_count_of_wins(spark):
    docs = rows.table(spark, SF, "documents")
    model = language.fit_language(docs)
    texts = [r["text"] for r in docs.where("text IS NOT NULL").limit(80).collect()] + ["", "1234", "a", "der die das", "é"]
    names, scores = model.predict(texts)

    def winner(machines, runs, count):
        wins, total, least = ({n: 0.0 for n in machines.names} for _ in range(3))
        least = {n: 1.0 for n in machines.names}
        for k, (a, b) in enumerate(machines.pairs):
            margin = sum(float(machines.weights[r, k]) for row in runs for r in row) / count + machines.bias[k]
            sure = 1 / (1 + np.exp(-4 * margin))
            for n, gain, p in ((machines.names[a], margin, sure), (machines.names[b], -margin, 1 - sure)):
                wins[n], total[n], least[n] = wins[n] + (gain > 0), total[n] + gain, min(least[n], p)
        best = max(machines.names, key=lambda n: (wins[n], total[n], -machines.names.index(n)))
        return best, least[best]

    for text, name, score in zip(texts, names, scores):
        runs, _, letters = language.features([text])
        if not letters[0]:
            assert (name, score) == ("und", 0)
            continue
        count = max(1, int((runs < 1 << language.BITS).sum()))
        family, sure = winner(model.families, runs, count)
        inner = model.within[family]
        want, certain = (inner.names[0], 1.0) if len(inner.names) == 1 else winner(inner, runs, count)
        assert name == want and abs(score - sure * certain) < 1e-4
