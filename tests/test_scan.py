"""Blocked scans equal plain windows, whatever the block width and however skewed the keys are."""

import math
import random

import pytest
from listing import listed
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.operators import intervals as iv
from voxtable.operators import scan
from voxtable.session import is_scan


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    # One key holds most rows; times repeat.
    data = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 20), i, rnd.randrange(5000), rnd.randrange(1, 60)) for i in range(3000)]
    return spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in data], "key bigint, id bigint, start_ms bigint, end_ms bigint").cache()


@pytest.mark.parametrize("width", [5, 100, 10_000])
def test_prefix_equals_window(skewed, width):
    w = W.partitionBy("key").orderBy("start_ms", "id").rowsBetween(W.unboundedPreceding, -1)
    want = skewed.select("id", F.coalesce(F.sum("end_ms").over(w), F.lit(0)).alias("a"), F.max("end_ms").over(w).alias("b"),
                         F.min("end_ms").over(w).alias("c"), F.last("end_ms").over(w).alias("d"))
    got = scan.prefix(skewed, ["key"], ["start_ms", "id"], {
        "a": ("sum", F.col("end_ms")), "b": ("max", F.col("end_ms")), "c": ("min", F.col("end_ms")), "d": ("last", F.col("end_ms"))}, block_rows=width)
    assert listed(got, "id", "a", "b", "c", "d") == listed(want, "id", "a", "b", "c", "d")


@pytest.mark.parametrize("width", [100, 10_000])
def test_following_equals_lead(skewed, width):
    w = W.partitionBy("key").orderBy("start_ms", "id")
    want = skewed.select("id", F.lead("end_ms").over(w).alias("n"))
    got = scan.following(skewed, ["key"], ["start_ms", "id"], {"n": F.col("end_ms")}, block_rows=width)
    assert listed(got, "id", "n") == listed(want, "id", "n")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [3, 97, 10_000])
def test_coalesce_equals_loop(skewed, width, inclusive):
    gap = 2
    want = []
    for key, group in _by_key(skewed):
        current = None
        for s, e in sorted(group):
            if current and (s - current[1] <= gap if inclusive else s - current[1] < gap):
                current[1] = max(current[1], e)
                current[2] += 1
            else:
                current = [s, e, 1]
                want.append((key, current))
    got = iv.coalesce_intervals(skewed, ["key"], gap_ms=gap, inclusive=inclusive, block_rows=width)
    assert listed(got, "key", "start_ms", "end_ms", "n") == sorted(((k, *c) for k, c in want), key=repr)


@pytest.mark.parametrize("width", [5, 10_000])
def test_silence_groups_equal_loop(skewed, width):
    want = []
    for key, group in _by_key(skewed, "id"):
        last, current = None, None
        for s, _, e in sorted((s, i, e) for s, e, i in group):
            if last is None or s - last >= 3:
                current = [s, e, 0]
                want.append((key, current))
            current[1], current[2], last = max(current[1], e), current[2] + 1, e
    got = iv.silence_groups(skewed, ["key"], ["start_ms", "id"], gap_ms=3, block_rows=width, start="start_ms", end="end_ms")
    assert listed(got, "key", "start_ms", "end_ms", "n_words") == sorted(((k, *c) for k, c in want), key=repr)


def _by_key(df, *extra):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["key"], []).append((r["start_ms"], r["end_ms"], *[r[c] for c in extra]))
    return groups.items()


def test_neighbours_cross_blocks(spark):
    df = spark.range(50).selectExpr("id % 2 AS key", "id DIV 2 AS i", "id AS v")
    w = W.partitionBy("key").orderBy("i").rowsBetween(-3, 2)
    want = df.select("v", F.collect_list("v").over(w).alias("near"))
    for block in (1, 4, 1000):
        got = scan.neighbours(df, ["key"], "i", 3, 2, {"near": (F.col("v"), True)}, block_rows=block)
        assert listed(got, "v", "near") == listed(want, "v", "near")


def test_global_rank(skewed):
    got = scan.global_rank(skewed, [F.col("start_ms"), F.col("id")], "r")
    ordered = [r["id"] for r in sorted(got.collect(), key=lambda r: r["r"])]
    assert ordered == [r["id"] for r in skewed.orderBy("start_ms", "id").collect()]
    assert got.agg(F.max("r")).first()[0] == 3000


def test_hot_key_is_cut_by_rows(spark, skewed):
    """All rows lie in five seconds; the large key still gets many blocks of few rows."""
    small, big = scan._parted(skewed, ["key"], ["start_ms", "id"], 500)
    blocks = [r["count"] for r in big.groupBy("key", scan.BLK).count().collect()]
    assert sum(blocks) > 1500 and len(blocks) == math.ceil(sum(blocks) / 500) + 1 and max(blocks) < 700
    assert small.count() + sum(blocks) == skewed.count()
    # Rows that agree in the first order column only are cut as well.
    tied = spark.range(1000).selectExpr("1 AS key", "0 AS start_ms", "id")
    _, big = scan._parted(tied, ["key"], ["start_ms", "id"], 100)
    assert max(r["count"] for r in big.groupBy(scan.BLK).count().collect()) < 250
    got = scan.row_index(tied, ["key"], ["start_ms", "id"], "i", block_rows=100)
    assert got.where("i <> id").count() == 0 and got.count() == 1000


def test_ordinary_keys_take_one_plain_window(skewed):
    assert scan._parted(skewed, ["key"], ["id"], 3000)[1] is None and scan._parted(skewed, ["key"], ["id"], 2999)[1] is None
    plan = scan.row_index(skewed, ["key"], ["start_ms", "id"], "i", block_rows=2999)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Union" not in plan and "Join" not in plan


MACHINE = scan.Machine(["a", "b", "c"], {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("a", "y"): "c", ("c", "z"): "b"})


def walked(data):
    """Plain loop: rows of each key in order."""
    out, seen = [], {}
    for key, i, symbol, start in sorted(data, key=lambda r: r[1]):
        state, n = seen.get(key, (start, 0))
        out.append((i, state, n + 1))
        moves = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("a", "y"): "c", ("c", "z"): "b"}
        seen[key] = (moves.get((state, symbol), state), n + 1)
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_machine_scan_equals_loop(spark, block_rows):
    rnd = random.Random(block_rows)
    starts = {None: "a", 0: "b", 1: "gone", 2: None, 3: "c"}
    data = []
    for i in range(40 if block_rows < 3 else 3000):
        key = rnd.choice([None, 0, 0, 0, 1, 2, 3])
        data.append((key, i, rnd.choice(["x", "x", "y", "z", None, "?"]), starts[key]))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "key bigint, i bigint, s string, start string")
    got = scan.machine_scan(df, ["key"], ["i"], MACHINE, symbol="s", start="start", block_rows=block_rows)
    assert got.columns == ["key", "i", "s", "start", "before", "n"]
    assert listed(got, "i", "before", "n") == walked(data)


def test_large_key_runs_as_many_blocks(spark):
    """One key of two million rows: its blocks are walked in many tasks, none of which holds more than a block or two."""
    df = spark.range(2_000_000).selectExpr("7 AS key", "id AS i", "elt(1 + int(id % 3), 'x', 'y', 'z') AS s", "'a' AS start")
    got = scan.machine_scan(df, ["key"], ["i"], MACHINE, symbol="s", start="start", block_rows=200_000)
    state, want = "a", {"a": 0, "b": 0, "c": 0}
    moves = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("a", "y"): "c", ("c", "z"): "b"}
    for i in range(2_000_000):
        want[state] += 1
        state = moves.get((state, "xyz"[i % 3]), state)
    assert {r["before"]: r["count"] for r in got.groupBy("before").count().collect()} == {k: v for k, v in want.items() if v}
    assert got.where("n <> i + 1").count() == 0


def test_is_scan_by_named_plans(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for plain in (df, df.where("id > 3"), df.selectExpr("key", "id * 2 AS x"), df.union(df), df.select(F.explode(F.array("id"))), spark.range(4), spark.createDataFrame([(1,)], "a int"), skewed):
        assert is_scan(plain)
    same = F.pandas_udf(lambda v: v, "bigint")
    works = (df.groupBy("key").count(), df.distinct(), df.join(df.select("id"), "id"), df.orderBy("id"), df.repartition(3), df.limit(5), df.select(same("id")),
             df.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id"))), df.mapInArrow(lambda b: b, df.schema), df.dropDuplicates(["key"]))
    for work in works:
        assert not is_scan(work)


def test_null_keys_and_times_are_kept(spark):
    data = [(k, t, i) for i, (k, t) in enumerate([(None, 1), (None, None), (None, 3), (1, None), (1, None), (1, 2), (1, 5), (2, 9)] * 4)]
    df = spark.createDataFrame(data, "key bigint, t bigint, id bigint")
    w = W.partitionBy("key").orderBy("t", "id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("i"), F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    for rows_ in (3, 1000):
        got = scan.row_index(df, ["key"], ["t", "id"], "i", block_rows=rows_)
        got = scan.previous(got, ["key"], ["t", "id"], {"p": F.col("id")}, block_rows=rows_)
        got = scan.following(got, ["key"], ["t", "id"], {"n": F.col("id")}, block_rows=rows_)
        assert listed(got, "id", "i", "p", "n") == listed(want, "id", "i", "p", "n")
        named = scan.islands(df, ["key"], ["t", "id"], start="t", end="t", gap=1, inclusive=True, furthest=False, block_rows=rows_)
        assert named.count() == len(data) and named.where("island IS NULL").count() == 0
        near = scan.neighbours(df.withColumn("o", F.col("id")), ["key"], "o", 1, 1, {"near": (F.col("id"), False)}, block_rows=rows_)
        v = W.partitionBy("key").orderBy("id")
        both = df.select("id", F.array_compact(F.array(F.lag("id").over(v), F.lead("id").over(v))).alias("near"))
        assert listed(near, "id", "near") == listed(both, "id", "near")


def test_a_chain_of_scans_reads_its_source_once(spark, skewed, tmp_path):
    """A scan of a table is read where it stands; what comes behind a scan is read from a written table."""
    skewed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = scan.row_index(df, ["key"], ["start_ms", "id"], "i")
    two = scan.previous(one, ["key"], ["start_ms", "id"], {"p": F.col("id")})
    three = scan.following(two, ["key"], ["start_ms", "id"], {"n": F.col("id")})
    plan = three._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in three._jdf.queryExecution().executedPlan().toString() and "start_ms" in plan


def test_building_a_query_only_counts_rows(spark, skewed):
    """A scan of few rows is settled by one count; operators without a scan start no job at all."""
    tracker = spark.sparkContext.statusTracker()
    base = skewed.selectExpr("key", "id", "start_ms", "end_ms")
    base.count()
    before = len(tracker.getJobIdsForGroup(None))
    base.count()
    one = len(tracker.getJobIdsForGroup(None)) - before
    scan.prefix(base, ["key"], ["start_ms", "id"], {"a": ("sum", F.col("end_ms"))})
    assert len(tracker.getJobIdsForGroup(None)) == before + 2 * one
    before = len(tracker.getJobIdsForGroup(None))
    iv.split_overlapping(base.groupBy("key").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")), 100, 10)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_keyed_fold_carries_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 AS k", "id", "id % 5 AS v")

        def step(state, values):
            state["s"] = state.get("s", 0) + values[0]
            return (state["s"],)

        got = scan.keyed_fold(df, ["k"], ["id"], ["v"], {"s": "bigint"}, step)
        want = df.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy("id")))
        assert listed(got, "id", "s") == listed(want, "id", "s")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reachable_overlap_joins_have_no_cross_product(skewed):
    turns = skewed.selectExpr("key AS episode_id", "id AS turn_id", "start_ms", "end_ms", "CAST(id % 3 AS STRING) AS speaker_id")
    plan = iv.speaker_overlaps(turns, ["episode_id"], leaf_ms=64)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
