"""Document fingerprints: weighted term hashes vote on signed bits; permuted block tables find near ones.

Everything is DataFrame functions. The terms of a text are its words (A-Z lower-cased), with weight 1, and its pairs of
neighbouring words, with weight 2, each as often as it occurs. A term's hash votes for every bit that it has set and against
every other; a bit of the fingerprint is set where the votes for it are more. Two votes travel in one long (32 bits each),
so a text may hold some 400 million words. A text without words has fingerprint zero. Equal texts have equal fingerprints.

:func:`within_radius` finds for a query set all fingerprints at most ``radius`` bits away: fingerprints are cut in
``radius + 1`` blocks, one of which is equal in any such pair; each table is keyed by one block (a permutation that
puts that block first), and the exact distance settles what meets in a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.binding import let
from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.operators.scan import global_rank
from voxtable.session import staged

BITS, PAIR_WEIGHT = 64, 2
LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    """Hash and weight of each term."""
    def cut(bound: Column) -> Column:
        w = bound["w"]
        single = F.transform(w, lambda x: F.struct(F.xxhash64(x).alias("h"), F.lit(1).alias("g")))
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.xxhash64(F.element_at(w, i.cast("int")), F.element_at(w, (i + 1).cast("int"))).alias("h"), F.lit(PAIR_WEIGHT).alias("g")))
        return F.when(F.size(w) > 1, F.concat(single, pairs)).otherwise(single)

    return let({"w": rows.words(rows.ascii_lower(text))}, cut)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``fingerprint`` (bigint) for each different value of ``keys``; rows with equal keys must hold equal texts.

    The votes of a text are added up where it was read; one row per text is shuffled.
    """
    voted = texts.select(*keys, F.explode_outer(_terms(F.col("text"))).alias("t")).select(*keys, "t.h", "t.g")
    # Bits k and k + 32 share a long: their weights in its lower and upper half.
    votes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES)) * F.col("g")).alias(f"v{k}") for k in range(32)]
    total = voted.groupBy(*keys).agg(F.sum("g").alias("all"), *votes)
    bits = []
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for votes_for, bit in ((low, k), (high, k + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            bits.append(F.when(votes_for * 2 > F.col("all"), F.lit(value)).otherwise(F.lit(0).cast("bigint")))
    return total.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for those that differ in every bit."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """``a`` (a query), ``b`` and ``bits`` for every pair of fingerprints at most ``radius`` bits apart, ``a`` itself included.

    Both tables hold one bigint column; each is made distinct first, so copies cost nothing.
    """
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    tables = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])

    def dealt(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col(df.columns[0]).alias(name)).distinct().select(name, F.posexplode(tables).alias("t", "m"))
        return distinct.select(name, "t", F.col(name).bitwiseAND(F.col("m")).alias("v"))

    met = dealt(queries, "a").join(dealt(prints, "b"), ["t", "v"]).withColumn("bits", distance(F.col("a"), F.col("b")))
    return met.where(F.col("bits") <= radius).select("a", "b", "bits").distinct()


def edited_texts(docs: DataFrame) -> DataFrame:
    """Each text with its last quarter replaced by the first part of the next document's.

    Columns: ``doc_id``, the row's key, ``text`` (null: empty), ``edited``, the next row's key and ``next_id``. Rows are in the order of
    ``doc_id`` (null first), then of the text's hash; rows that agree in both are one place and come out once. Behind the
    last is the first. Only keys and lengths are sorted; of the next text only the part that is needed is sent.
    """
    base = rows.keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    places = base.groupBy(*rows.KEY, "doc_id").agg(F.max(F.char_length("text")).alias("n"))
    ranked = staged(global_rank(places, [F.col("doc_id").asc_nulls_first(), F.col(rows.KEY[0]), F.col(rows.KEY[1])], "at"), "places")
    total = ranked.agg(F.max("at")).first()[0]  # one number
    before = F.when(F.col("at") == 1, F.lit(total)).otherwise(F.col("at") - 1)
    following = ranked.select(before.cast("long").alias("at"), *[F.col(k).alias(f"n{k}") for k in rows.KEY])
    chain = ranked.join(following, "at").select(*rows.KEY, "n", *[f"n{k}" for k in rows.KEY])
    need = chain.select(*[F.col(f"n{k}").alias(k) for k in rows.KEY], *[F.col(k).alias(f"p{k}") for k in rows.KEY], F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = base.join(need, [*rows.KEY]).select(*[F.col(f"p{k}").alias(k) for k in rows.KEY], *[F.col(k).alias(f"n{k}") for k in rows.KEY], F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("doc_id").alias("next_id"))
    # Both joins take the same columns of ``base`` by the same key, so that texts are shuffled once.
    joined = base.join(heads.dropDuplicates([*rows.KEY]), [*rows.KEY])
    n = F.char_length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    return joined.select("doc_id", *rows.KEY, "text", F.concat(kept, "head").alias("edited"), *[f"n{k}" for k in rows.KEY], "next_id")


def edit_likeness(docs: DataFrame, *, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``n_within`` is, for rows whose id is divisible by 100, the number of rows (itself included) whose fingerprint lies
    within ``radius`` bits, and null for the others.
    """
    own = [*rows.KEY, *[f"n{k}" for k in rows.KEY], "doc_id", "next_id", "n_chars", "edited_sha256", "which"]
    both = edited_texts(docs)
    sides = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text"), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.char_length("text").cast("long").alias("n_chars"), F.lit("").alias("edited_sha256")))
    sided = both.select(*own[:6], F.explode(sides).alias("s")).select(*own[:6], "s.which", "s.text", "s.n_chars", "s.edited_sha256")
    marked = staged(fingerprints(sided, own), "fingerprints")
    first, second = marked.where("which = 0"), marked.where("which = 1").select(*rows.KEY, F.col("fingerprint").alias("edited_fingerprint"))
    beside = first.select(*[F.col(k).alias(f"n{k}") for k in rows.KEY], F.col("fingerprint").alias("next"))
    found = first.drop("which").join(second, [*rows.KEY]).join(beside, [f"n{k}" for k in rows.KEY])
    copies = rows.keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text").groupBy(*rows.KEY).agg(F.count("*").alias("rows"))
    found = staged(found.join(copies, [*rows.KEY]), "fingerprint-pairs")
    asked = found.where(F.col("doc_id") % 100 == 0)
    near = within_radius(found.select("fingerprint"), asked.select("fingerprint"), radius)
    each = found.groupBy(F.col("fingerprint").alias("b")).agg(F.sum("rows").alias("rows"))
    counted = near.join(each, "b").groupBy(F.col("a").alias("fingerprint")).agg(F.sum("rows").alias("n_within"))
    counted = asked.select(*rows.KEY, "fingerprint").join(counted, "fingerprint").drop("fingerprint")
    out = found.join(counted, [*rows.KEY], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"), "n_within", "next_id")


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_likeness(rows.table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("fingerprint", "edited_fingerprint")})
