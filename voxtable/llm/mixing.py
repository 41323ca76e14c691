"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of the whole budget by weight, at most ``most`` times its size; what that cuts off goes
to the others by weight. A source takes all its documents as often as fits whole; the remaining budget is filled from the
histogram of exact document lengths: an even share of every length first, then bounded-knapsack dynamic programming
over what is left, so that the words taken are the budget or as near below it as lengths allow. Which documents of a
length are taken is settled by a seeded hash of the row, so reruns agree; rows that are alike in every column are
interchangeable.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order. Null ids are allowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import staged

WEIGHTS = (3, 1, 2)
BINS = 1 << 16


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``target`` for each (source, source_size); one row per source.

    Resharing the excess until none is above has one end state: each source gets its weight times one common level, or its
    cap. Sources fill up in the order of cap by weight, so running sums over that order give the level.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    listed = listed.withColumn("__cap", F.lit(most) * F.col("source_size"))
    full = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    # Up to the first source that does not fill up the level grows; from there on that source's level holds for all.
    marked = listed.withColumn("__level", level)
    stop = F.first(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")), ignorenulls=True).over(full.rowsBetween(W.unboundedPreceding, 0))
    return marked.select("source", "source_size", F.when(stop.isNull(), F.col("__cap")).otherwise(F.least(stop * F.col("__w"), F.col("__cap"))).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words sum to ``budget`` or as near below it as found.

    Every length first gives the same share of its documents. What then remains is less than the sum of all lengths; the
    longest that fit are taken down to a rest below the longest length, and the rest is settled exactly, over all lengths
    that are left, by dynamic programming on reachable sums.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]]
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - longest) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    # reach holds a bit for each sum; when a step adds sums, it is kept, so that the choice can be read back.
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        left, piece = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left and not reach >> rest & 1:
            step = min(piece, left)
            grown = (reach | reach << step * lengths[i]) & mask
            if grown != reach:
                steps.append((i, step, reach))
                reach = grown
            left, piece = left - step, piece * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, step, earlier in reversed(steps):
        if not earlier >> at & 1:
            taken[i] += step
            at -= step * lengths[i]
    return taken


def _position(seed: int, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[c for n in columns for c in (F.col(n).isNull(), F.col(n))])


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``; columns of these names are replaced.

    Counts and sums are aggregated before they are shuffled. The documents of one length of one source fall into bins by
    their seeded position; a histogram of the bins gives each bin its quota, so no task ranks a whole length.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    columns = docs.columns
    word_count = F.size(rows.words(F.col("text"))).cast("long")
    place = _position(seed, [c for c in ("doc_id", "text") if c in columns])
    sized = docs.withColumns({"size": word_count, "__pos": place})
    sized = sized.withColumn("__bin", F.pmod(F.shiftrightunsigned("__pos", 20), F.lit(BINS)).cast("int"))
    by_bin = staged(sized.groupBy("source", "size", "__bin").agg(F.count("*").alias("n")), "mix-bins")
    lengths = by_bin.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = staged(targets(sizes, weights=weights, share=share, most=most), "mix-targets")

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["size"] > 0].sort_values("size")
        if group.empty:
            return pd.DataFrame({"source": [], "size": [], "whole": [], "more": []})
        goal_words, own = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
        whole = min(int(most), int(goal_words // own))
        n, c = group["size"].astype(int).tolist(), group["n"].astype(int).tolist()
        more = fit_budget(n, c, round(goal_words) - whole * own) if whole < int(most) else [0] * len(n)
        return pd.DataFrame({"source": group["source"], "size": n, "whole": whole, "more": more})

    # One row per different length: as long as a length list, however many documents there are.
    plan = lengths.join(goal, lengths["source"].eqNullSafe(goal["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    plan = staged(plan.groupBy("source").applyInPandas(choose, "source string, size bigint, whole bigint, more bigint"), "mix-plan")

    # For each bin of a length, how many of its documents are still wanted. Every row has its bin here.
    # A row's cell as plain columns: the join by it and the ranking inside it share one shuffle of the rows.
    cell = ["__named", "__source", "size", "__bin"]

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumns({"__named": F.col("source").isNotNull(), "__source": F.coalesce(F.col("source").cast("string"), F.lit(""))})

    same = [by_bin["source"].eqNullSafe(plan["source"]), by_bin["size"] == plan["size"]]
    ordered = W.partitionBy("source", "size").orderBy("__bin")
    steps = by_bin.join(plan, same, "left").select(by_bin["source"], by_bin["size"], "__bin", "n", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("more", F.lit(0)).alias("more"))
    steps = steps.withColumn("__before", F.sum("n").over(ordered) - F.col("n"))
    aims = goal.toDF("__g", "source_size", "target")
    quota = celled(steps.join(aims, F.col("source").eqNullSafe(F.col("__g")))).select(
        *cell, "whole", "source_size", "target", F.greatest(F.col("more") - F.col("__before"), F.lit(0)).alias("__want"))
    # Cells grow with the documents, so they are met by shuffle at every size.
    joined = celled(sized).join(staged(quota, "mix-quota").hint("merge"), cell)
    inside = W.partitionBy(*cell).orderBy("__pos")
    both = joined.withColumn("__in", (F.row_number().over(inside) <= F.col("__want")).cast("int"))
    taken = (F.col("whole") + F.col("__in")) * F.col("size")
    return both.select(*columns, "size", "source_size", "target", taken.cast("long").alias("taken"))


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
