"""The keyed processors without Spark: state that counts its calls."""

import pandas as pd
import pyarrow as pa

from voxtable.streaming import ordered as so


class Held(dict):
    calls = 0

    def _seen(self):
        Held.calls += 1

    def containsKey(self, key):
        self._seen()
        return key in self

    def getValue(self, key):
        self._seen()
        return self.__getitem__(key)

    def updateValue(self, key, value):
        self._seen()
        self[key] = value

    def removeKey(self, key):
        self._seen()
        del self[key]

    def iterator(self):
        return iter(self.items())


class One:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, *_):
        return Held()

    def getValueState(self, *_):
        return One()

    def registerTimer(self, at):
        pass


class At:
    def __init__(self, edge):
        self.edge = edge

    def getCurrentWatermarkInMs(self):
        return self.edge


def test_keys_of_a_bucket_share_calls_and_nulls_keep_numbers_whole():
    moves = so.Moves(0)
    moves.types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    moves.init(Handle())
    big = 2**53 + 1
    data = [(key, at, big + 2 * key + at, "QUEUED" if at else None, 4 if key == 7 else 0) for key in range(3000) for at in (1, 0)]
    pdf = pd.DataFrame(data, columns=[so._KEY, *moves.fields, so._NULLS])
    Held.calls = 0
    assert not sum(map(len, moves.handleInputRows((0,), iter([pdf]), At(0))))
    out = pd.concat(list(moves.handleExpiredTimer((0,), At(so.ORIGIN_MS + 10), None)))
    assert Held.calls < 200  # not one for each of the keys
    want = [(key, None if key == 7 else big + 2 * key + 1, None, "QUEUED") for key in range(3000)]
    assert [tuple(r) for r in out[["episode_id", "event_id", "from_state", "state"]].itertuples(index=False)] == want
    assert len(moves.waiting) == 0 and sum(len(so.json.loads(v[0])) for v in moves.values.values()) == 3000
