"""Ordered scans that never put a hot key into one task, and lose no row.

A plain window per key sends a hot key to one task. Here a table of more than ``block_rows`` rows is counted by key first. Where no
key has more rows than that, the plain window is the whole plan. Large keys are cut along their whole order into blocks of about
equal row counts (a range split, written down); the window runs inside a block, every block is summed up in one row, the
block rows are scanned per key, and the carry is joined back. Both ways give the same rows.

Keys and order values may be null: a null key is a key, null order values come first. An input that is more than a scan of a
table is written once, so that a chain of scans reads its source once. Only rows that agree in all order columns stay in one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxtable.session import is_scan, staged

BLOCK_ROWS = 1 << 20
BLK = "__blk"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on columns of both sides, null equal to null; the columns come from the left."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"__r_{c}" for c in on])


def _parted(df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of large keys with their block number (None where no key is large)."""
    if df.count() <= block_rows:
        return df, None
    large = staged(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block_rows), "large-keys")
    rows = large.agg(F.sum("__n")).first()[0]
    if not rows:
        return df, None
    # At most one key in block_rows rows: bounded by the table's size over block_rows.
    named = F.broadcast(large.select(*keys))
    small = null_safe_join(df, named, keys, "left_anti")
    big = null_safe_join(df, named, keys, "left_semi").repartitionByRange(math.ceil(rows / block_rows) + 1, *keys, *order)
    # A range split is sampled, so it is written before it is used twice.
    return small, staged(big.withColumn(BLK, F.spark_partition_id()), "blocks")


def _scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int, plain: Callable[[DataFrame], DataFrame], blocked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    once = df if is_scan(df) else staged(df, "scan")
    small, big = _parted(once, keys, order, block_rows)
    return plain(small) if big is None else plain(small).unionByName(blocked(big))


def _fold(kind: str, col: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "max":
        return F.max(col)
    if kind == "min":
        return F.min(col)
    return F.last(col, ignorenulls=True)


def prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column]], *,
    reverse: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add, per spec ``name -> (kind, column)``, the fold over all *earlier* rows of the key.

    Kinds: ``sum`` (0 when there is none), ``max``, ``min`` and ``last`` (latest non-null value;
    null when there is none). ``reverse`` scans from the end, so "earlier" means "later".
    """
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    keys = list(keys)

    def merged(name: str, inner: Column, outer: Column | None) -> Column:
        kind = specs[name][0]
        if kind == "sum":
            return (F.coalesce(inner, F.lit(0)) + (F.coalesce(outer, F.lit(0)) if outer is not None else 0)).alias(name)
        if outer is None:
            return inner.alias(name)
        return {"max": F.greatest, "min": F.least}.get(kind, F.coalesce)(inner, outer).alias(name)

    def plain(rows: DataFrame) -> DataFrame:
        before = W.partitionBy(*keys).orderBy(*ordering).rowsBetween(W.unboundedPreceding, -1)
        return rows.select(*df.columns, *[merged(n, _fold(kind, c).over(before), None) for n, (kind, c) in specs.items()])

    def blocked(rows: DataFrame) -> DataFrame:
        src = rows.select("*", *[c.alias(f"__v_{n}") for n, (_, c) in specs.items()])
        before = W.partitionBy(*keys, BLK).orderBy(*ordering).rowsBetween(W.unboundedPreceding, -1)
        local = src.select("*", *[_fold(kind, F.col(f"__v_{n}")).over(before).alias(f"__l_{n}") for n, (kind, _) in specs.items()])
        pos, pick = F.struct(*order), F.min_by if reverse else F.max_by
        totals = src.groupBy(*keys, BLK).agg(*[
            (pick(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), pos)) if kind == "last" else _fold(kind, F.col(f"__v_{n}"))).alias(f"__t_{n}")
            for n, (kind, _) in specs.items()])
        earlier = W.partitionBy(*keys).orderBy(F.col(BLK).desc() if reverse else F.col(BLK).asc()).rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(*keys, BLK, *[_fold(kind, F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (kind, _) in specs.items()])
        joined = null_safe_join(local, carry, [*keys, BLK], "inner")
        return joined.select(*df.columns, *[merged(n, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in specs])

    return _scanned(df, keys, order, block_rows, plain, blocked)


def previous(df, keys, order, columns: dict[str, Column], *, reverse=False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``lag`` (or ``lead`` with ``reverse``) of the named columns across blocks."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = prefix(df, keys, order, {"__prev": ("last", packed)}, reverse=reverse, block_rows=block_rows)
    return out.select(*df.columns, *[F.col(f"__prev.{n}").alias(n) for n in columns])


def following(df, keys, order, columns: dict[str, Column], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return previous(df, keys, order, columns, reverse=True, block_rows=block_rows)


def row_index(df, keys, order, name: str = "idx", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Zero-based position of each row inside its key."""
    return prefix(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, block_rows=block_rows)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, start: str, end: str, gap: int, inclusive: bool,
    furthest: bool, name: str = "island", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Name, for each row, the first row of its run: a struct of the ``order`` values.

    A row opens a run when it starts more than ``gap`` after what lies before it (``inclusive``), or
    at least ``gap`` after it. "Before" is the furthest end so far (``furthest``) or the end of the row
    just before. For a large key one scan is enough: whether the last opening of a block stands can be told from the
    block's own summary and the carry of the earlier blocks. A null start or end opens no run by distance.
    """
    keys, kind, pos = list(keys), "max" if furthest else "last", F.struct(*order)

    def opens(at: Column, reach: Column) -> Column:
        distance = at - reach
        return reach.isNull() | (distance > gap if inclusive else distance >= gap)

    def until(window):
        return window.rowsBetween(W.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        every = W.partitionBy(*keys).orderBy(*order)
        reached = rows.withColumn("__reach", _fold(kind, F.col(end)).over(until(every)))
        opened = F.last(F.when(opens(F.col(start), F.col("__reach")), pos), ignorenulls=True)
        return reached.select(*df.columns, opened.over(every.rowsBetween(W.unboundedPreceding, 0)).alias(name))

    def blocked(rows: DataFrame) -> DataFrame:
        inside = W.partitionBy(*keys, BLK).orderBy(*order)
        local = rows.withColumn("__pos", pos).withColumn("__reach", _fold(kind, F.col(end)).over(until(inside)))
        marked = local.withColumn("__at", F.when(opens(F.col(start), F.col("__reach")), F.struct("__pos", F.col(start).alias("s"))))
        blocks = marked.groupBy(*keys, BLK).agg(
            (F.max(end) if furthest else F.max_by(end, F.when(F.col(end).isNotNull(), F.col("__pos")))).alias("__out"),
            F.max("__at").alias("__at"), F.min("__pos").alias("__head"))
        earlier = until(W.partitionBy(*keys).orderBy(BLK))
        blocks = blocks.withColumn("__carry", _fold(kind, F.col("__out")).over(earlier))
        stands = opens(F.col("__at.s"), F.col("__carry"))
        if not furthest:
            # Behind the first row of a block the carry no longer matters.
            stands = stands | (F.col("__at.__pos") != F.col("__head"))
        blocks = blocks.withColumn("__from", F.last(F.when(stands, F.col("__at.__pos")), ignorenulls=True).over(earlier))
        both = null_safe_join(local, blocks.select(*keys, BLK, "__carry", "__from"), [*keys, BLK], "inner")
        reach = F.greatest("__reach", "__carry") if furthest else F.coalesce("__reach", "__carry")
        opened = F.last(F.when(opens(F.col(start), reach), F.col("__pos")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
        return both.select(*df.columns, F.coalesce(opened, F.col("__from")).alias(name))

    return _scanned(df, keys, order, block_rows, plain, blocked)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, before: int, after: int, columns: dict[str, tuple[Column, bool]], *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Collect the ``before``/``after`` rows around each row into arrays, in the order of ``order``.

    Rows count, not values: ``order`` may have gaps. In a large key rows next to a block edge are also sent to the
    neighbouring block, so every frame is complete inside one block. ``columns`` maps the new array name to
    (value, whether the row itself is kept).
    """
    keys = list(keys)

    def plain(rows: DataFrame) -> DataFrame:
        every = W.partitionBy(*keys).orderBy(order)

        def near(value: Column, keep_self: bool) -> Column:
            held = F.collect_list(F.struct(value.alias("v")))
            if keep_self:
                found = held.over(every.rowsBetween(-before, after))
            else:
                sides = [held.over(every.rowsBetween(-before, -1))] if before else []
                sides += [held.over(every.rowsBetween(1, after))] if after else []
                found = F.concat(*sides)
            return F.transform(found, lambda r: r["v"])

        return rows.select(*df.columns, *[near(v, keep).alias(n) for n, (v, keep) in columns.items()])

    def blocked(rows: DataFrame) -> DataFrame:
        counted = rows.withColumn("__row", F.row_number().over(W.partitionBy(*keys, BLK).orderBy(order)).cast("long"))
        sizes = rows.groupBy(*keys, BLK).agg(F.count("*").alias("__n"))
        ahead = sizes.select(*keys, BLK, F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
        dense = null_safe_join(counted, ahead, [*keys, BLK], "inner").withColumn("__i", F.col("__row") + F.col("__off") - 1).drop(BLK, "__row", "__off")
        at = F.col("__i")
        home = F.floor(at / block_rows).cast("long")
        blocks = F.sequence(F.floor((at - after) / block_rows).cast("long"), F.floor((at + before) / block_rows).cast("long"))
        sent = dense.withColumn("__home", home).withColumn(BLK, F.explode(blocks))
        frame = W.partitionBy(*keys, BLK).orderBy("__i").rowsBetween(-before, after)
        packed = {n: F.collect_list(F.struct(at.alias("i"), v.alias("v"))).over(frame) for n, (v, _) in columns.items()}
        out = sent.select("*", *[c.alias(f"__f_{n}") for n, c in packed.items()]).where(F.col(BLK) == F.col("__home"))

        def shaped(name: str, keep_self: bool) -> Column:
            held = F.col(f"__f_{name}")
            if not keep_self:
                held = F.filter(held, lambda r: r["i"] != at)
            return F.transform(held, lambda r: r["v"]).alias(name)

        return out.select(*df.columns, *[shaped(n, keep) for n, (_, keep) in columns.items()])

    return _scanned(df, keys, [order], block_rows, plain, blocked)


def keyed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], adds: dict[str, str], step: Callable[[dict, tuple], tuple]) -> DataFrame:
    """Walk each key's rows in order with a state, where the next answer needs the one before.

    ``step(state, values of reads)`` gives the values of the added columns (name -> type); the state starts as an
    empty dict for each key. Rows stream through a task in sorted order, so memory holds one batch and one state, however
    many rows a key has; the walk along one key is sequential by its nature.
    """
    kept, keys = df.columns, list(keys)
    schema = T.StructType(df.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in adds.items()])
    kinds = [to_arrow_type(schema[n].dataType) for n in adds]

    def walk(batches):
        last, state = None, {}
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in keys]
            out = []
            for at, values in enumerate(zip(*[batch.column(c).to_pylist() for c in reads])):
                key = tuple(n[at] for n in names)
                if key != last:
                    last, state = key, {}
                out.append(step(state, values))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, *adds])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


class Machine:
    """A finite machine as tables: the place of each state, and for each symbol the map from states to states.

    A map is a string of bytes, so that composing two of them is one translation. States and symbols that are not known share the last
    place: such a state is never left, and such a symbol moves nothing.
    """

    def __init__(self, states: Sequence[str], moves: dict[tuple[str, str], str]) -> None:
        self.states = tuple(states)
        if len(self.states) > 254:
            raise ValueError("a machine has at most 254 states")
        self.symbols = tuple(sorted({symbol for _, symbol in moves}))
        at = {s: i for i, s in enumerate(self.states)}
        self.identity = bytes(range(len(self.states) + 1))
        self.maps = [bytes([at[moves[s, x]] if (s, x) in moves else at[s] for s in self.states] + [len(self.states)]) for x in self.symbols] + [self.identity]

    def place(self, state: Column) -> Column:
        return _placed(state, self.states)

    def symbol(self, value: Column) -> Column:
        return _placed(value, self.symbols)

    def named(self, place: Column, other: Column) -> Column:
        return F.when(place < len(self.states), F.element_at(F.array(*[F.lit(s) for s in self.states]), place + 1)).otherwise(other)


def _placed(value: Column, names: Sequence[str]) -> Column:
    found = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(found > 0, found - 1).otherwise(F.lit(len(names))).cast("int")


def machine_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, *, symbol: str, start: str, before: str = "before", number: str = "n",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run a finite machine along each key: add the state ``before`` each row and the row's one-based ``number`` in its key.

    ``start`` names the state before the key's first row (equal in all rows of a key). What a row does depends on all rows before it,
    but whatever the state at a block's start, a block of rows is a map from states to states. For a large key the blocks are
    turned into maps in parallel, the maps are composed in order (one short row a block), and a second pass over the blocks, each from its own
    state, gives the answers. Small keys take the second pass at once.
    """
    keys, columns, nothing = list(keys), df.columns, machine.identity
    coded = df.withColumns({"__sym": machine.symbol(F.col(symbol)), "__at": machine.place(F.col(start))})
    steps, passed = [t.ljust(256, b"\0") for t in machine.maps], coded.columns  # bytes.translate takes 256 places

    def walk(group: list[str]) -> Callable:
        def work(batches):
            last, state, n = None, 0, 0
            for batch in batches:
                names = list(zip(*[batch.column(k).to_pylist() for k in group]))
                at, count = [], []
                for key, s, start_at, ahead in zip(names, *[batch.column(c).to_pylist() for c in ("__sym", "__at", "__ahead")]):
                    if key != last:
                        last, state, n = key, start_at, ahead
                    n += 1
                    at.append(state)
                    count.append(n)
                    state = steps[s][state]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(at, pa.int32()), pa.array(count, pa.int64())], names=[*passed, "__was", number])

        return work

    answered = T.StructType([*coded.schema.fields, T.StructField("__was", T.IntegerType()), T.StructField(number, T.LongType())])

    def run(rows: DataFrame, group: list[str]) -> DataFrame:
        dealt = rows.repartition(*group).sortWithinPartitions(*group, *order).select(*passed, *[c for c in group if c not in passed], "__ahead")
        return dealt.mapInArrow(walk(group), answered)

    def plain(rows: DataFrame) -> DataFrame:
        return run(rows.withColumn("__ahead", F.lit(0).cast("long")), keys)

    def composed(batches):
        last, held = None, None
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in (*keys, BLK)]))
            done = []
            for key, s, start_at in zip(names, *[batch.column(c).to_pylist() for c in ("__sym", "__at")]):
                if key != last:
                    if last is not None:
                        done.append((last, held))
                    last, held = key, [nothing, 0, start_at]
                held[0] = held[0].translate(steps[s])
                held[1] += 1
            if done:
                yield block_rows_of(done, batch.schema)
            schema = batch.schema
        if last is not None:
            yield block_rows_of([(last, held)], schema)

    def block_rows_of(done: list, schema: pa.Schema) -> pa.RecordBatch:
        named = [pa.array([k[i] for k, _ in done], schema.field(c).type) for i, c in enumerate((*keys, BLK))]
        kinds = (pa.binary(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([*named, *[pa.array([h[i] for _, h in done], kind) for i, kind in enumerate(kinds)]], names=[*keys, BLK, "__map", "__rows", "__first"])

    def blocked(rows: DataFrame) -> DataFrame:
        narrow = rows.select(*keys, BLK, *[c for c in order if c not in keys], "__sym", "__at")
        kinds = T.StructType([*[narrow.schema[c] for c in (*keys, BLK)], T.StructField("__map", T.BinaryType()), T.StructField("__rows", T.LongType()), T.StructField("__first", T.IntegerType())])
        maps = narrow.repartition(*keys, BLK).sortWithinPartitions(*keys, BLK, *order).mapInArrow(composed, kinds)

        def enter(state: dict, values: tuple) -> tuple[int, int]:
            block, size, first = values
            at, ahead = state.get("at", first), state.get("ahead", 0)
            state["at"], state["ahead"] = block[at], ahead + size
            return at, ahead

        entered = keyed_fold(maps, keys, [BLK], ["__map", "__rows", "__first"], {"__entry": "int", "__ahead": "bigint"}, enter)
        both = null_safe_join(rows, entered.select(*keys, BLK, "__entry", "__ahead"), [*keys, BLK], "inner")
        return run(both.withColumn("__at", F.col("__entry")), [*keys, BLK])

    out = _scanned(coded, keys, order, block_rows, plain, blocked)
    return out.select(*columns, machine.named(F.col("__was"), F.col(start)).alias(before), number)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """One-based rank over the whole table without a single-task window.

    Rows are range-partitioned on the full order, the placement is written down (a range split is
    sampled, so it must not be recomputed), ranked inside a partition, and shifted by the row counts
    of the partitions before. The offsets are one row per partition, which bounds the broadcast.
    The last order column should make rows unique, so that no run of ties has to stay together.
    """
    placed = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    inside = W.partitionBy("__part").orderBy(*order)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__off"))
    return (
        placed.withColumn("__rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__part")
        .select(*df.columns, (F.col("__rn") + F.col("__off")).cast("long").alias(name))
    )
