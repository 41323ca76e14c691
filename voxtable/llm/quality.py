"""Quality classifier: a byte-level convolutional network in numpy.

A document is read as bytes, cut into overlapping chunks that cover all of it. Learned filters run over
every chunk; the strongest answer of each filter is kept (max-pooling), and a document's chunks are put
together by their mean and their maximum into one probability. Null and empty texts are read as one chunk of padding and get a score
like any other. Nothing but the text enters a score, and a score does not depend on the rows beside it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query

WIDTH, STEP, STRIDE = 8, 2, 128  # bytes a filter sees, bytes between its places, bytes between chunks
FILTERS, CODE = 24, 8
PIECE = 1 << 19


@dataclass
class ByteConvNet:
    """Filters over byte codes. A chunk is two neighbouring strides, so chunks overlap by half."""

    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)
        self.weights = {
            "code": rng.normal(0, 0.5, (256, CODE)),
            "filter": rng.normal(0, (WIDTH * CODE) ** -0.5, (WIDTH, CODE, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": np.zeros(2 * FILTERS),
            "base": np.zeros(1),
        }

    def _tables(self) -> np.ndarray:
        w = self.weights
        return np.einsum("bc,kcf->kbf", w["code"], w["filter"]).astype(np.float32)

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one byte array, each followed by padding of a filter's width at least; strides of each."""
        strides = np.array([-(-(len(t) + WIDTH) // STRIDE) for t in texts], dtype=np.int64)
        data = b"".join(t.ljust(int(n) * STRIDE, b"\0") for t, n in zip(texts, strides))
        return np.frombuffer(data, np.uint8), strides

    @staticmethod
    def _strides(data: np.ndarray, strides: np.ndarray, tables: np.ndarray, place: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The strongest answer of each filter in each stride, and where in the stride it was."""
        peaks, places = [], []
        final = np.zeros(len(data) // STRIDE, bool)
        final[np.cumsum(strides) - 1] = True
        for start in range(0, len(data), PIECE):
            stop = min(len(data), start + PIECE)
            part = np.zeros(stop - start + WIDTH, np.uint8)
            end = min(len(data), stop + WIDTH)
            part[: end - start] = data[start:end]
            n = (stop - start) // STEP
            answers = tables[0][part[0 : 2 * n : STEP]]
            for k in range(1, WIDTH):
                answers += tables[k][part[k : k + STEP * n : STEP]]
            answers = answers.reshape(-1, STRIDE // STEP, FILTERS)
            # What starts in the last bytes of a text's padding would reach into the next text.
            answers[final[start // STRIDE : stop // STRIDE], -(WIDTH // STEP) :] = -1e9
            peaks.append(answers.max(axis=1))
            if place:
                places.append(answers.argmax(axis=1) * STEP + np.arange(start, stop, STRIDE)[:, None])
        return np.concatenate(peaks), np.concatenate(places) if place else None

    def _features(self, peaks: np.ndarray, strides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document the mean and the maximum over chunks; also each chunk's answers and its source stride."""
        first = np.cumsum(strides) - strides
        last = np.zeros(len(peaks), bool)
        last[first + strides - 1] = True
        beside = np.where(last, np.arange(len(peaks)), np.arange(len(peaks)) + 1)
        right = peaks[beside] > peaks
        source = np.where(right, beside[:, None], np.arange(len(peaks))[:, None])
        chunks = np.maximum(np.maximum(peaks, peaks[beside]) + self.weights["bias"].astype(np.float32), 0)
        mean = np.add.reduceat(chunks, first, axis=0) / strides[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunks, first, axis=0)], axis=1).astype(np.float64), chunks, source

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text."""
        if not texts:
            return np.zeros(0)
        data, strides = self.layout(texts)
        peaks, _ = self._strides(data, strides, self._tables(), False)
        x, _, _ = self._features(peaks, strides)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights["out"] + self.weights["base"], -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 1000, batch: int = 64, rate: float = 0.01) -> ByteConvNet:
        """Adam on the log loss, about ``steps`` batches. With no rows it stays at one half; with one class it learns that class."""
        rng = np.random.default_rng(self.seed)
        w = self.weights
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step, epochs = 0, -(-steps * batch // max(1, len(texts)))
        for epoch in range(epochs if len(texts) else 0):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients([texts[i] for i in pick], labels[pick])
                step += 1
                pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] -= pace * m / (np.sqrt(v) + 1e-8)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        data, strides = self.layout(texts)
        peaks, places = self._strides(data, strides, self._tables(), True)
        x, chunks, source = self._features(peaks, strides)
        error = (1 / (1 + np.exp(-np.clip(x @ w["out"] + w["base"], -30, 30))) - labels) / len(texts)
        grads = {"out": x.T @ error + 1e-5 * w["out"], "base": np.array([error.sum()])}
        doc = np.repeat(np.arange(len(texts)), strides)
        flow = (error / strides)[doc][:, None] * w["out"][None, :FILTERS]
        best = chunks >= x[:, FILTERS:].astype(np.float32)[doc]
        ties = np.add.reduceat(best.astype(np.float64), np.cumsum(strides) - strides, axis=0)
        flow += best / ties[doc] * error[doc][:, None] * w["out"][None, FILTERS:]
        flow *= chunks > 0
        grads["bias"] = flow.sum(axis=0)
        at = np.take_along_axis(places, source, axis=0)
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        names = np.broadcast_to(np.arange(FILTERS), flow.shape)
        grads["code"], grads["filter"] = np.zeros_like(w["code"]), np.zeros_like(w["filter"])
        for k in range(WIDTH):
            seen = padded[at + k].astype(np.int64)
            table = np.bincount((seen * FILTERS + names).ravel(), weights=flow.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grads["code"] += table @ w["filter"][k].T
            grads["filter"][k] = w["code"].T @ table
        return grads


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 8000, max_bytes: int = 32768) -> list[tuple[bytes, float]]:
    """The rows to learn from: at most ``max_rows`` labelled documents outside the held-out fifth.

    The rows are the lowest in a hash of the id. Only for learning, texts over ``max_bytes`` are passed over, which bounds
    what reaches the driver. Several labels of one document are averaged; null labels and null ids are passed over.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~rows.held_out())
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("__label"))
    total = known.count()
    share = min(1.0, 1.2 * max_rows / max(total, 1))
    known = known.where(rows.drawn(share, F.col("doc_id")))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).where(F.octet_length("__text") <= max_bytes)
    found = text.join(known, "doc_id").select("doc_id", "__text", "__label")
    picked = found.orderBy(F.xxhash64("doc_id"), "doc_id", "__text").limit(max_rows).collect()
    return [(r["__text"].encode(), r["__label"]) for r in picked]


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, steps: int = 1000) -> ByteConvNet:
    sample = labelled_sample(docs, labels, max_rows=max_rows)
    return ByteConvNet().fit([t for t, _ in sample], np.array([y for _, y in sample]), steps=steps)


def score_quality(docs: DataFrame, model: ByteConvNet, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability; every row stays, whatever its columns hold.

    A column that already bears the name of the score is replaced.
    """
    weights = model.weights
    docs = docs.drop(name)
    columns = docs.columns

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteConvNet(weights=weights)
        for part in rows.slices(batches, "text", 1 << 20):
            yield rows.with_columns(part, columns, **{name: pa.array(net.scores(rows.raw(part.column("text"))))})

    return docs.mapInArrow(score, rows.widened(docs, **{name: "double"}))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, rows.table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", rows.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
