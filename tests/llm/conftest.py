import random

import pytest

#: Names that the operators use themselves.
CLASHING = ("__k1", "__k2", "__fp", "score", "size", "taken", "target", "lang_pred", "kept_text", "n_tokens", "spans", "n", "h", "at", "g", "batch", "label", "a", "b")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, ties, repeated rows, columns with clashing names."""
    rnd = random.Random(3)
    prose = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rnd.randrange(50)) for _ in range(120))
    texts = [
        (None, None), (None, "orphan text"), (1, ""), (2, None), (3, " \n\t \n"), (4, "word " * 40_000), (5, prose), (5, prose),
        (6, prose), (7, prose.upper()), (8, prose + " tail"), (9, "x"), (10, "x"), (11, "ключ 你好 é "), (12, "a\0b\nline\r\nlast"), (13, "line\nline\nLINE  "),
    ]
    made = [(i, t, "en" if i and i % 2 else None, None if i == 9 else f"s{(i or 0) % 3}", len(t) if t else None) for i, t in texts]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHING])


@pytest.fixture
def plain(odd):
    return odd.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture
def empty(plain):
    return plain.where("false")
