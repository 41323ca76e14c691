"""Language identification in two steps: the family first, then linear machines for each pair within it.

Features are hashed runs of one to three letters, lower-cased, with word edges; digits, signs and symbols
count as edges. A model is one weight per feature, and a document's margin is the mean of its features'
weights, so whole texts are read and length does not matter. The family is the one that wins most of its
one-versus-one comparisons; among the languages of that family the same is done by machines that saw only
these languages. Null texts and texts without a letter get ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query

BITS = 14
#: Which family a language code belongs to; a code that is not named is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed runs of all texts one after another, how many each text has, and its letters."""
    edge = "\0\0\0"
    lowered = [f"{edge}{t.lower()}" for t in texts] + [edge]
    sizes = np.array([len(t) for t in lowered[:-1]], dtype=np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[points]
    code = np.where(alpha, points, 0).astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = (code + np.uint64(1)) * mix
    two = (one[:-2] ^ (code[1:-1] + np.uint64(3))) * mix
    three = (two ^ (code[2:] + np.uint64(7))) * mix
    shift = np.uint64(64 - BITS)
    runs = np.stack([one[:-2] >> shift, two >> shift, three >> shift], axis=1).astype(np.int64)
    runs = runs[: int(sizes.sum())]
    # A run counts where it holds a letter; the other places point at the spare feature behind the table.
    live = alpha[:-2] | alpha[1:-1] | alpha[2:]
    runs[~live[: len(runs)]] = 1 << BITS
    first = np.cumsum(sizes) - sizes
    letters = np.add.reduceat(alpha[: len(runs)].astype(np.int64), first)
    return runs, sizes, letters


def _vectors(texts: list[str]) -> np.ndarray:
    """Relative counts of the features, one row per text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        runs, _, _ = features([text])
        counts = np.bincount(runs.ravel(), minlength=(1 << BITS) + 1)[:-1]
        out[i] = counts / max(1, counts.sum())
    return out


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 60, soft: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine: squared hinge loss, accelerated gradient steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = np.float32(0.5 / max(1e-9, float(share @ (x * x).sum(axis=1)) + 1))
    look_w, look_b, t = w, b, 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ look_w + look_b)) * share * y
        w2 = look_w - rate * (np.float32(soft) * look_w - 2 * (x.T @ gap))
        b2 = look_b + rate * 2 * gap.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pull = np.float32((t - 1) / t2)
        look_w, look_b = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class Machines:
    """One-versus-one machines over ``names``; column ``k`` of ``weights`` decides ``pairs[k]``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, names: list[str], scale: np.ndarray) -> Machines:
        pairs = list(combinations(range(len(names)), 2))
        weights, bias = np.zeros(((1 << BITS) + 1, len(pairs)), np.float32), np.zeros(len(pairs))
        live = np.flatnonzero((x > 0).sum(axis=0) >= min(3, len(x)))  # what too few texts hold gets no weight
        x, scale = (x[:, live] * scale[live]).astype(np.float32), scale[live]
        for k, (a, b) in enumerate(pairs):
            pick = (labels == names[a]) | (labels == names[b])
            w, bias[k] = _machine(x[pick], np.where(labels[pick] == names[a], 1.0, -1.0).astype(np.float32))
            weights[live, k] = w * scale
        return cls(names, pairs, weights, bias)

    def decide(self, runs: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each text (ties go to the larger sum of margins, then to the first name) and its certainty."""
        n = len(first)
        wins, margins, least = np.zeros((n, len(self.names))), np.zeros((n, len(self.names))), np.ones((n, len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            column = self.weights[:, k]
            sums = np.add.reduceat(column[runs].sum(axis=1, dtype=np.float64), first)
            margin = sums / counts + self.bias[k]
            sure = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
            for side, gain, p in ((a, margin, sure), (b, -margin, 1 - sure)):
                wins[:, side] += gain > 0
                margins[:, side] += gain
                least[:, side] = np.minimum(least[:, side], p)
        best = np.lexsort((np.broadcast_to(-np.arange(len(self.names)), wins.shape), margins, wins), axis=1)[:, -1]
        return best, least[np.arange(n), best]


@dataclass
class LanguageModel:
    families: Machines
    within: dict[str, Machines]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        runs, sizes, letters = features(texts)
        first = np.cumsum(sizes) - sizes
        counts = np.maximum(1, np.add.reduceat((runs < 1 << BITS).sum(axis=1), first))
        family, sure = self.families.decide(runs, first, counts)
        names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for i, name in enumerate(self.families.names):
            pick = np.flatnonzero((family == i) & (letters > 0))
            if not len(pick):
                continue
            machines = self.within[name]
            if len(machines.names) == 1:
                names[pick], score[pick] = machines.names[0], sure[pick]
                continue
            own = np.concatenate([runs[first[j] : first[j] + sizes[j]] for j in pick])
            starts = np.cumsum(sizes[pick]) - sizes[pick]
            best, inner = machines.decide(own, starts, counts[pick])
            names[pick], score[pick] = np.array(machines.names, object)[best], sure[pick] * inner
        return names.tolist(), score


def fit_language(docs: DataFrame, *, per_language: int = 400, max_bytes: int = 32768, families: dict[str, str] | None = None) -> LanguageModel | None:
    """Learn from at most ``per_language`` documents of each language outside the held-out fifth.

    The rows are the lowest in a hash of the id; for learning only, texts over ``max_bytes`` are passed over.
    Without any labelled text there is no model, and every prediction is ``und``.
    """
    families = FAMILIES if families is None else families
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~rows.held_out() & (F.octet_length("text") <= max_bytes))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, 1.3 * per_language / n))])
    drawn = known.where(rows.drawn(F.element_at(shares, F.col("lang")), F.col("doc_id"), F.lit(11))).select("doc_id", "text", "lang")
    ranked = sorted(drawn.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    taken: dict[str, int] = {}
    texts, labels = [], []
    for r in ranked:
        if taken.setdefault(r["lang"], 0) < per_language and any(c.isalpha() for c in r["text"]):
            taken[r["lang"]] += 1
            texts.append(r["text"])
            labels.append(r["lang"])
    if not texts:
        return None
    x, lang = _vectors(texts), np.array(labels, object)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    group = np.array([families.get(name, name) for name in labels], object)
    top = Machines.fit(x, group, sorted(set(group)), scale)
    within = {f: Machines.fit(x[group == f], lang[group == f], sorted(set(lang[group == f])), scale) for f in top.names}
    return LanguageModel(top, within)


def identify_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "text", 1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            names, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield rows.with_columns(part, columns, lang_pred=pa.array(names, pa.string()), score=pa.array(score))

    return docs.mapInArrow(predict, rows.widened(docs, lang_pred="string", score="double"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select("doc_id", rows.held_out().alias("held_out"), "lang_pred", "score")
