"""Edit distance of long texts, bit-parallel in a band that doubles.

One column of the distance table is kept as two bit vectors: in which rows the value rises by one from the row above, and in which it
falls. A character of the other text moves the whole column on with a few operations on these vectors. Only a band of rows around the
diagonal is kept; values above the band are taken to rise with every column, which never makes a path cheaper, so a distance
of at most the band's half width is exact. Otherwise the band is doubled. Time grows with length times distance over the word size, memory with the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIRST_BAND = 64


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_band(rows: np.ndarray, columns: np.ndarray, half: int) -> int:
    """The cheapest way inside of the band; the distance itself if it is at most ``half``."""
    step = max(half, 256)
    low, high = 0, 0
    rises = falls = top = 0
    for at in range(0, len(columns), step):
        part = columns[at : at + step]
        # Rows of the band for these columns. Rows left above are summed up, new rows below rise by one each.
        new_low, new_high = max(low, min(at - half, len(rows))), min(len(rows), at + len(part) + half)
        gone = (1 << (new_low - low)) - 1
        top += (rises & gone).bit_count() - (falls & gone).bit_count()
        rises, falls = rises >> (new_low - low), falls >> (new_low - low)
        rises |= ((1 << (new_high - high)) - 1) << (high - new_low)
        low, high = new_low, new_high
        window, every = rows[low:high], (1 << (high - low)) - 1
        found = {c: int.from_bytes(np.packbits(window == c, bitorder="little").tobytes(), "little") for c in np.unique(part).tolist()}
        for c in part.tolist():
            same = found[c]
            level = same | falls
            diagonal = (((same & rises) + rises) ^ rises) | same
            right = ((falls | ~(diagonal | rises)) & every) << 1 | 1
            left = (rises & diagonal) << 1
            rises = (left | ~(level | right)) & every
            falls = right & level & every
        top += len(part)
    if not len(columns):
        return len(rows)
    rises |= ((1 << (len(rows) - high)) - 1) << (high - low)
    return top + rises.bit_count() - falls.bit_count()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points."""
    x, y = _points(a), _points(b)
    for _ in range(2):  # what both begin or end with costs nothing
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        same = int(differ[0]) if len(differ) else n
        x, y = x[same:][::-1], y[same:][::-1]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    half = max(FIRST_BAND, abs(len(x) - len(y)))
    while True:
        found = _in_band(x, y, half)
        if found <= half or half >= max(len(x), len(y)):
            return found
        half *= 2


def with_edit_distance(df: DataFrame, a: str, b: str, name: str = "edits") -> DataFrame:
    """Add the Levenshtein distance of two texts of any length; null where one of them is null."""
    kept = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())
            found = pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, name])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
