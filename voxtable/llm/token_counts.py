"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Every whole text is encoded by a byte-level BPE vocabulary; only its length is kept. Documents are aggregated by length, and
suffix sums over the lengths answer totals, quantiles and truncated totals for every context limit without touching
the documents again. Null and empty texts have length 0 and are counted.

The vocabulary is read on the driver from ``path`` and sent to the tasks; it is refused above ``max_bytes``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
_ENCODERS: dict[tuple[int, str], object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    key = (hash(vocabulary), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def with_token_counts(docs: DataFrame, *, path: str = VOCABULARY, pattern: str = PATTERN, name: str = "n_tokens", max_bytes: int = 1 << 26) -> DataFrame:
    """All columns of ``docs`` and the number of tokens of the whole text; a column of that name is replaced."""
    data = Path(path).read_bytes()
    if len(data) > max_bytes:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {max_bytes} are sent to the tasks")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    docs = docs.drop(name)
    columns = docs.columns

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value, pattern).encode_ordinary
        for part in rows.slices(batches, "text", 1 << 22):
            lengths = [len(encode(t)) if t else 0 for t in part.column("text").to_pylist()]
            yield rows.with_columns(part, columns, **{name: pa.array(lengths, pa.int64())})

    return docs.mapInArrow(count, rows.widened(docs, **{name: "bigint"}))


def length_histogram(docs: DataFrame, **options) -> DataFrame:
    """``n_tokens`` and ``n_docs`` for every length that occurs."""
    counted = with_token_counts(docs.select("text"), **options)
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, read as a context limit L:

    ``docs_from`` and ``tokens_from``: documents of L or more tokens and their tokens; ``docs_upto``: documents of at most L;
    ``truncated_total``: tokens that stay when every document is cut to L; ``share_upto``: the quantile of L.
    Sums run inside blocks of lengths; one row per block is summed over all, so no task sees the whole histogram.
    """
    held = staged(histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "length-histogram")
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = held.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry = totals.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    inside = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    summed = held.join(carry, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.sum("n_docs").over(inside) + F.col("d_later")).alias("docs_from"), (F.sum(tokens).over(inside) + F.col("t_later")).alias("tokens_from"))
    upto = F.col("d_all") - F.col("docs_from") + F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", upto.alias("docs_upto"),
        (F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        (upto / F.col("d_all")).alias("share_upto"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that stay when every document is cut to ``limit``, any limit, from the suffix sums alone."""
    longer = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").select("docs_from", "tokens_from").first()
    total = sums.orderBy("n_tokens").select("tokens_from").first()
    if total is None:
        return 0
    return total[0] if longer is None else total[0] - longer[1] + limit * longer[0]


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed; null for no documents."""
    row = sums.where(F.col("share_upto") >= share - 1e-12).orderBy("n_tokens").select("n_tokens").first()
    return None if row is None else row[0]


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(rows.table(spark, sf_dir, "documents")))
