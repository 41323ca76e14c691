"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.session import staged


def _mark(links: DataFrame) -> tuple[int, int]:
    """Number of links and a checksum: equal when the set of links did not change."""
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for every node in ``links`` (two bigint columns).

    Each round points every larger neighbour of a node at the smallest (large star), then does the same for the smaller
    ones (small star), until no link changes; the number of rounds grows with the logarithm of the longest chain. A node
    with very many links is aggregated before it is shuffled. Rounds are written to the shared folder, so that a lost
    executor costs one round at most.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = staged(now, "links")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
        small = small.select(F.greatest("p.b", "p.m").alias("a"), F.least("p.b", "p.m").alias("b")).where("a <> b").distinct()
        now = staged(small, "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labelled = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labelled.unionAll(roots.join(labelled.select("node"), "node", "left_anti"))
