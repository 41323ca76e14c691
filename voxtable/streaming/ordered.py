"""Keyed streaming in event-time order, whatever order files and triggers bring the rows in.

Rows wait in state, in slots of time, until the watermark says that nothing earlier will come; then they are handed out in order of
their time and the other ``fields``. A row may come ``reorder_ms`` behind the latest one. A row later than that comes out at once as a
``late`` row while it is within ``grace_ms`` more; beyond both Spark drops it and counts it (``numRowsDroppedByWatermark``). State holds the
rows of the last ``reorder_ms`` and the processor's own value of each key.

Many keys share a bucket, by hash: Python and the state store are called per bucket and trigger, not per key. Waiting rows lie there as
Arrow blocks, values in parts that are read only for the keys that rows came for.

Rows of the last ``reorder_ms`` come out once later rows move the watermark on; :func:`voxtable.streaming.jobs.end_marker` ends an input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxtable.functions.states import legal_moves

SLOT_MS = 3_600_000
#: Added to times for the watermark, which starts at zero and would drop what is not behind it: times may be counted from any start.
ORIGIN_MS = 1 << 40
#: Rows of a state block and of a batch that comes out.
BLOCK_ROWS = 1 << 16
#: Parts of a bucket's values.
PARTS = 32
#: Spark renames columns that begin with an underscore on their way to a processor.
_KEY, _NULLS, _BUCKET, _AT = "key__", "nulls__", "bucket__", "at__"


def _part(key) -> int:
    return zlib.crc32(str(key).encode()) % PARTS


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Base of the processors: ``fields`` (the time in ms first) are read, ``kinds`` is the DDL of what comes out."""

    fields: tuple[str, ...] = ()
    kinds = ""
    slot_ms = SLOT_MS
    #: Arrow types of the key and the fields, set by ``in_order``.
    types: tuple[pa.DataType, ...] = ()

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def step(self, key: tuple, state: list | None, row: list) -> tuple[list, list[tuple]]:
        """The state behind a row, and what comes out."""
        raise NotImplementedError

    def late(self, key: tuple, row: list) -> tuple:
        raise NotImplementedError

    def due(self, state: list | None) -> int | None:
        """The time at which the state changes without a further row."""
        return None

    def expire(self, key: tuple, state: list) -> tuple[list | None, list[tuple]]:
        return state, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, block bigint", "rows binary")
        self.values = handle.getMapState("values", "part bigint", "held string")
        self.dues = handle.getMapState("dues", "part bigint", "at bigint")
        self.blocks = handle.getValueState("blocks", "n bigint")
        self.names = [f.split(" ")[0] for f in self.kinds.split(", ")]
        self.expires = type(self).due is not InOrder.due

    def _edge(self, timers) -> int | None:
        """Everything before it was handed out; None before there is a watermark."""
        at = timers.getCurrentWatermarkInMs()
        return at + self.grace_ms - ORIGIN_MS if at > 0 else None

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(max(at + ORIGIN_MS - self.grace_ms + 1, 1))  # when the edge is behind ``at``

    def _table(self, pdf: pd.DataFrame) -> pa.Table:
        """Key and fields; numbers come with zero for null, so that pandas does not make them fractions, and a mask of nulls."""
        columns, nulls = [], pdf[_NULLS].to_numpy()
        for i, (name, kind) in enumerate(zip((_KEY, *self.fields), self.types)):
            gone = (nulls >> i & 1).astype(bool)
            columns.append(pa.array(pdf[name], kind, mask=gone if gone.any() else None, from_pandas=True))
        return pa.table(columns, names=[_KEY, *self.fields])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)

    def _put(self, tables: list[pa.Table]) -> None:
        """Append rows to the blocks of their slots."""
        rows = pa.concat_tables(tables)
        slot = pd.Series(rows.column(1).to_numpy()) // self.slot_ms
        number = (self.blocks.get() or (0,))[0]
        for at, index in slot.groupby(slot).indices.items():
            self.waiting.updateValue((int(at), number), (_packed(rows.take(pa.array(index))),))
        self.blocks.update((number + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edge, fresh, held, first = self._edge(timerValues), [], 0, None
        for pdf in rows:
            table = self._table(pdf)
            if edge is not None:
                behind = pc.less(table.column(1), edge)
                late = table.filter(behind)
                if len(late):
                    yield self._frame([self.late((k,), list(row)) for k, *row in zip(*(c.to_pylist() for c in late.columns))])
                    table = table.filter(pc.invert(behind))
            if not len(table):
                continue
            least = pc.min(table.column(1)).as_py()
            first = least if first is None else min(first, least)
            fresh.append(table)
            held += len(table)
            if held >= BLOCK_ROWS:
                self._put(fresh)
                fresh, held = [], 0
        if fresh:
            self._put(fresh)
        if first is not None:
            self._wake(first)
        yield self._frame([])

    def _ready(self, edge: int) -> tuple[pa.Table | None, list[int]]:
        """The rows before the edge, in order, and times from which there may be more."""
        ready, ahead = [], []
        for slot, block in list(self.waiting.keys()):
            if slot * self.slot_ms >= edge:
                ahead.append(slot * self.slot_ms)
                continue
            table = pa.ipc.open_stream(bytes(self.waiting.getValue((slot, block))[0])).read_all()
            if (slot + 1) * self.slot_ms > edge:
                behind = pc.less(table.column(1), edge)
                kept, table = table.filter(pc.invert(behind)), table.filter(behind)
                if len(kept):
                    ahead.append(pc.min(kept.column(1)).as_py())
                    if len(table):
                        self.waiting.updateValue((slot, block), (_packed(kept),))
                        ready.append(table)
                    continue
            self.waiting.removeKey((slot, block))
            ready.append(table)
        if not ready:
            return None, ahead
        return pa.concat_tables(ready).sort_by([(n, "ascending") for n in (_KEY, *self.fields)]), ahead

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = self._edge(timerValues)
        if edge is None:
            return
        rows, ahead = self._ready(edge)
        parts: dict[int, dict] = {}

        def values(part: int) -> dict:
            if part not in parts:
                held = self.values.getValue((part,)) if self.values.containsKey((part,)) else None
                parts[part] = {k: state for k, state in json.loads(held[0])} if held else {}
            return parts[part]

        out: list[tuple] = []
        for batch in rows.to_batches(max_chunksize=BLOCK_ROWS) if rows is not None else []:
            name = known = state = None
            for one, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if known is None or one != name[0]:
                    if known is not None:
                        known[name[0]] = state
                    name, known = (one,), values(_part(one))
                    state = known.get(one)
                if self.expires:
                    while (at := self.due(state)) is not None and at <= row[0]:
                        state, found = self.expire(name, state)
                        out += found
                state, found = self.step(name, state, row)
                out += found
            known[name[0]] = state
            yield self._frame(out)
            out = []
        if self.expires:
            for (part,), (at,) in list(self.dues.iterator()):
                if at <= edge:
                    values(part)
            for held in parts.values():
                for one, state in held.items():
                    while (at := self.due(state)) is not None and at <= edge:
                        state, found = self.expire((one,), state)
                        out += found
                    held[one] = state
        for part, held in parts.items():
            kept = [(one, state) for one, state in held.items() if state is not None]
            if kept:
                self.values.updateValue((part,), (json.dumps(kept),))
            elif self.values.containsKey((part,)):
                self.values.removeKey((part,))
            if self.expires:
                times = [at for _, state in kept if (at := self.due(state)) is not None]
                if times:
                    self.dues.updateValue((part,), (min(times),))
                elif self.dues.containsKey((part,)):
                    self.dues.removeKey((part,))
        ahead += [at for (at,) in self.dues.values()] if self.expires else []
        if ahead:
            self._wake(max(min(ahead), edge))
        yield self._frame(out)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, processor: InOrder, reorder_ms: int, *, buckets: int = 256) -> DataFrame:
    """Run the processor over each key; rows without a key or a time have no place in an order and are left out.

    A task holds one bucket's rows that become ready at once. The number of buckets stays with the checkpoint.
    """
    lag = f"{reorder_ms + processor.grace_ms} milliseconds"
    kinds = [stream.schema[c].dataType for c in (key, *processor.fields)]
    processor.types = tuple(to_arrow_type(k) for k in kinds)
    processor.slot_ms = max(SLOT_MS, reorder_ms // 32)
    whole = [isinstance(k, T.IntegralType) for k in kinds]
    nulls = sum((F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate((key, *processor.fields)) if whole[i]), F.lit(0).cast("long"))
    values = [F.coalesce(F.col(c), F.lit(0).cast(k)).alias(n) if w else F.col(c).alias(n)
              for c, n, k, w in zip((key, *processor.fields), (_KEY, *processor.fields), kinds, whole)]
    timed = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    timed = timed.select(*values, nulls.alias(_NULLS), F.pmod(F.xxhash64(key), F.lit(buckets)).alias(_BUCKET), F.timestamp_millis(F.col(time) + ORIGIN_MS).alias(_AT))
    return timed.withWatermark(_AT, lag).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.kinds, outputMode="Append", timeMode="EventTime")


class Moves(InOrder):
    """Keeps the last state of an episode; reports each move, whether it is legal, and how long the state before it lasted."""

    fields = ("ts_ms", "event_id", "state")
    kinds = "episode_id bigint, event_id bigint, from_state string, state string, legal boolean, previous_ms bigint, late boolean"

    def init(self, handle) -> None:
        super().init(handle)
        self.moves = set(legal_moves())

    def step(self, key, state, row):
        at, event, new = row
        if state is None:
            return [new, at], []
        return [new, at], [(key[0], event, state[0], new, (state[0], new) in self.moves, at - state[1], False)]

    def late(self, key, row):
        return key[0], row[1], None, row[2], None, None, True


class Uploads(InOrder):
    """Accepts a chunk only at the committed length and within the total; others learn where to resume. A late chunk is a reject."""

    fields = ("seq", "offset", "length", "total_bytes")
    kinds = "upload_id bigint, seq bigint, reject string, committed_bytes bigint, complete boolean"

    def step(self, key, state, row):
        seq, offset, length, total = row
        done, verdict = (state or [0])[0], None
        if done == total:
            verdict = "ALREADY_COMPLETE"
        elif offset != done:
            verdict = "OFFSET_MISMATCH"
        elif offset + length > total:
            verdict = "EXCEEDS_TOTAL"
        else:
            done += length
        return [done], [(key[0], seq, verdict, done, done == total)]

    def late(self, key, row):
        return key[0], row[0], "TOO_LATE", None, None


class Sessions(InOrder):
    """Runs of words with less than ``gap_ms`` between them; a silence of ``gap_ms`` closes a session, and only then it comes out."""

    fields = ("at_ms", "pos", "length_ms")
    kinds = "episode_id bigint, first_ms bigint, n_words bigint, late_ms bigint"

    def __init__(self, grace_ms: int, gap_ms: int) -> None:
        super().__init__(grace_ms)
        self.gap_ms = gap_ms

    def step(self, key, state, row):
        first, reach, n = state or (row[0], row[0], 0)
        return [first, max(reach, row[0] + row[2]), n + 1], []

    def due(self, state):
        return None if state is None else state[1] + self.gap_ms

    def expire(self, key, state):
        return None, [(key[0], state[0], state[2], None)]

    def late(self, key, row):
        return key[0], None, None, row[0]


def monitored_moves(events: DataFrame, *, reorder_ms: int, grace_ms: int = 3_600_000) -> DataFrame:
    """``events``: ``episode_id, event_id, ts_ms, state`` as a stream, in any order within ``reorder_ms``."""
    return in_order(events, "episode_id", "ts_ms", Moves(grace_ms), reorder_ms)


def assembled_uploads(chunks: DataFrame, *, reorder_ms: int, grace_ms: int = 3_600_000) -> DataFrame:
    """``chunks``: ``upload_id, seq, offset, length, total_bytes`` as a stream; ``seq`` orders them and counts as milliseconds."""
    return in_order(chunks, "upload_id", "seq", Uploads(grace_ms), reorder_ms)


def word_sessions(words: DataFrame, *, gap_ms: int, reorder_ms: int, grace_ms: int = 3_600_000) -> DataFrame:
    """``words``: ``episode_id, at_ms, pos, length_ms`` as a stream; late words come out as rows with ``late_ms`` only."""
    return in_order(words, "episode_id", "at_ms", Sessions(grace_ms, gap_ms), reorder_ms)
