"""What the corpus operators share: row identity, word patterns and byte-bounded batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word and line contracts, as the inside of a character class.
SPACE = "\\x20\\x09-\\x0D"
SPACE_BYTES = b" \t\n\v\f\r"
KEY = ("__k1", "__k2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat(columns: Iterable[str]) -> list[Column]:
    # xxhash64 passes over nulls, so that null takes part through its own flag.
    return [c for name in columns for c in (F.col(name).isNull(), F.col(name))]


def keyed(df: DataFrame, *columns: str, names: tuple[str, str] = KEY) -> DataFrame:
    """Add a 128-bit key of the named columns; rows that agree in them (null included) share it."""
    flat = _flat(columns)
    return df.withColumns({names[0]: F.xxhash64(*flat), names[1]: F.xxhash64(F.lit(0x5EED), *flat)})


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the documents, by their id alone; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drawn(share: Column | float, *parts: Column) -> Column:
    """True for about this share of all rows, by a hash of ``parts``; the share may be as small as a double can tell."""
    coarse = F.pmod(F.xxhash64(*parts), F.lit(1_000_000))
    fine = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(0xF1FE)), 11) / F.lit(float(1 << 53))
    return coarse + fine < F.lit(1_000_000.0) * share


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(sizes):
            continue
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> list[bytes]:
    """The values as bytes; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def widened(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with further columns; ``df`` must not hold them yet."""
    return T.StructType(df.schema.fields + T._parse_datatype_string(", ".join(f"`{n}` {k}" for n, k in kinds.items())).fields)


def with_columns(batch: pa.RecordBatch, names: list[str], **extra) -> pa.RecordBatch:
    """The named columns of the batch, followed by the extra ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(extra.values()), names=names + list(extra))
