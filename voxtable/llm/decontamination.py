"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Everything is DataFrame functions. Test items are partitioned by their number of different shingles in powers of two. In a
partition the sketch of an item is the smallest hashes of its shingles (one MinHash order for all), so many that a document
that holds at least ``threshold`` of the item must hold one of them: n - ceil(threshold * n) + 1, taken for the largest
item of the partition. A document is long against an item, so its whole set of shingles is looked up, not a sketch of it.
Hits are candidates; each is then settled by counting the item's shingles, as texts, in the document.

Words are runs of letters, marks and digits, lower-cased, so that neither punctuation nor symbols strewn over a passage hide it.
A shingle has ``shingle`` words. A shorter item is one shingle of its own length, and documents are also cut into shingles of each such
length that occurs among the items, so a short item is found anywhere in a text. Items and documents without words match nothing. Rows that agree
in id and text are one document or item; null ids are ids like others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.binding import let
from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import at_most, staged

SHINGLE, THRESHOLD = 5, 0.8
ITEM = ("__i1", "__i2")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _shingled(text: Column, widths: list[int], whole: Callable[[list[Column]], Column], kind: str) -> Column:
    """Shingles of the widest of ``widths`` that the text has words for; none for a text of fewer words."""
    def cut(bound: Column) -> Column:
        w, found = bound["w"], F.array().cast(f"array<{kind}>")
        for width in sorted(widths):
            many = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(width)), lambda i: whole([F.get(w, i + k) for k in range(width)]))
            found = F.when(F.size(w) >= width, many).otherwise(found)
        return found

    return let({"w": _words(text)}, cut)


def shingles(text: Column, *widths: int) -> Column:
    """The word shingles of a text, repeats included, as an array of texts."""
    return _shingled(text, list(widths), lambda w: F.concat_ws(" ", *w), "string")


def shingle_hashes(text: Column, *widths: int) -> Column:
    """The MinHash order: a hash of each shingle's words, repeats included; no shingle is put together as a text."""
    return _shingled(text, list(widths), lambda w: F.xxhash64(*w), "bigint")


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """Per item and sketch hash: the item's key, ``part`` (its size class), ``n`` and ``h``, from ``n`` and ``hashes``."""
    sized = items.withColumn("part", F.floor(F.log2(F.col("n"))).cast("int"))
    largest = sized.groupBy("part").agg(F.max("n").alias("top"))
    sized = sized.join(largest, "part")
    length = (F.col("top") - F.ceil(F.col("top") * F.lit(threshold) - 1e-9) + 1).cast("int")
    return sized.select(*ITEM, "part", "n", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), length)).alias("h"))


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Sent to every task if it was counted and is small; else joined by shuffle. Both give the same rows."""
    return F.broadcast(df) if at_most(df, limit) else df


def contained_items(docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, broadcast_rows: int = 200_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shingles``, ``n_shared`` and ``containment`` of each item held by a document."""
    texts = rows.keyed(docs.select("doc_id", "text"), "doc_id", "text")
    items = rows.keyed(benchmark.select("item_id", "text"), "item_id", "text", names=ITEM).dropDuplicates([*ITEM])
    every = range(1, shingle + 1)
    items = items.select("item_id", *ITEM, F.array_distinct(shingles(F.col("text"), *every)).alias("shingles"), F.array_distinct(shingle_hashes(F.col("text"), *every)).alias("hashes"))
    items = staged(items.withColumns({"n": F.size("shingles"), "width": F.size(F.split(F.get("shingles", F.lit(0)), " "))}).where("n > 0"), "test-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # ``shingle`` values at most
    index = _small(sketches(items, threshold), broadcast_rows)

    # A document cannot hold more of an item than it has shingles.
    # One lookup for each width that occurs; benchmarks without short items have one.
    looked = _united([texts.select(*rows.KEY, shingle_hashes(F.col("text"), w).alias("h")).select(*rows.KEY, F.size("h").alias("m"), F.explode("h").alias("h")) for w in widths or [shingle]])
    hits = looked.join(index, "h").where(F.col("m") >= F.col("n") * F.lit(threshold) - 1e-9)
    found = staged(hits.select(*rows.KEY, *ITEM).distinct(), "contained-candidates")

    wanted = items.join(found.select(*ITEM).distinct(), [*ITEM], "left_semi").select(*ITEM, F.explode("shingles").alias("s"))
    # Only candidates' texts are cut again: the explode keeps the cutting behind the join.
    held = texts.join(found.select(*rows.KEY).distinct(), [*rows.KEY], "left_semi")
    shared = _united([held.select("doc_id", *rows.KEY, F.explode(shingles(F.col("text"), w)).alias("s")) for w in widths or [shingle]]).join(_small(wanted, broadcast_rows), "s")
    shared = shared.select("doc_id", *rows.KEY, *ITEM, "s").distinct().groupBy("doc_id", *rows.KEY, *ITEM).agg(F.count("*").alias("n_shared"))
    settled = shared.join(found, [*rows.KEY, *ITEM], "left_semi").join(items.select("item_id", *ITEM, F.col("n").cast("long").alias("n_shingles")), [*ITEM])
    settled = settled.where(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold) - 1e-9)
    return settled.select("doc_id", *rows.KEY, "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    bad = contained_items(docs, benchmark, **options).select(*rows.KEY).distinct()
    return rows.keyed(docs, "doc_id", "text").join(bad, [*rows.KEY], "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, text, s FROM (SELECT doc_id, text, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM d, k WHERE len(w) >= k)),
bs AS (SELECT DISTINCT item_id, text, s FROM (SELECT item_id, text, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, text, count(*) AS n_shingles FROM bs GROUP BY item_id, text)
SELECT ds.doc_id, n.item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM bs JOIN ds ON ds.s = bs.s JOIN n ON n.item_id = bs.item_id AND n.text = bs.text
GROUP BY ds.doc_id, ds.text, n.item_id, n.text, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""


@query("op9_benchmark_decontamination", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(rows.table(spark, sf_dir, "documents"), rows.table(spark, sf_dir, "benchmark")).drop(*rows.KEY)
