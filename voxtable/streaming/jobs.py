"""Structured Streaming jobs over the event log and live words: sources, resumable sinks, native sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: str, glob: str, *, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream; the checkpointed file log replaces an integer cursor.

    ``files_per_trigger`` bounds what one trigger holds. Keyed jobs in event-time order are in ``streaming.ordered``.
    """
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def run_once(stream: DataFrame, name: str, *, mode: str = "append", stateful: bool = False) -> DataFrame:
    """Process all available input into a fresh table in the shared folder and read it back.

    Append results go through the file sink, which commits each batch exactly once. Complete results
    replace the table of the batch before, each in its own folder.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, name)
    with _state_store(spark, stateful):
        writer = stream.writeStream.option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
        if mode == "append":
            writer.outputMode("append").format("parquet").option("path", f"{root}/data").start().awaitTermination()
            return spark.read.schema(stream.schema).parquet(f"{root}/data")
        last: list[int] = []

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/data-{number}")
            last.append(number)

        writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/data-{last[-1]}")


@contextmanager
def _state_store(spark: SparkSession, needed: bool) -> Iterator[None]:
    """Keyed processors need the RocksDB state store; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if needed:
        spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if needed and before is None:
            spark.conf.unset(key)
        elif needed:
            spark.conf.set(key, before)


def resume(stream: DataFrame, target: str, *, stateful: bool = False) -> DataFrame:
    """Process what came in since the last call with this ``target``; returns the rows of this call.

    The checkpoint below ``target`` is the cursor. Each batch is a version in a folder of its own, overwritten if the batch has to run again,
    and counts once its number is in the checkpoint's commits. So a run that is stopped anywhere loses and repeats nothing.
    """
    spark = stream.sparkSession
    before = versions(spark, target)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_version(target, number))

    with _state_store(spark, stateful):
        stream.writeStream.option("checkpointLocation", f"{target}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return read_versions(spark, target, stream.schema, after=before[-1] if before else -1)


def _version(target: str, number: int) -> str:
    return f"{target}/versions/{number:09d}"


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the committed batches of ``target``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/log/commits")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n) for n in found if n.isdigit())


def read_versions(spark: SparkSession, target: str, schema: T.StructType, *, after: int = -1) -> DataFrame:
    """The rows of the committed batches behind ``after``."""
    paths = [_version(target, n) for n in versions(spark, target) if n > after]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


#: The first millisecond of the year 2200; nanoseconds, which pandas counts in, end in 2262.
END_MS = 7_258_118_400_000


def end_marker(spark: SparkSession, schema: str, key: str, time: str) -> DataFrame:
    """One row far ahead in time, on a key of its own (-1): behind it the watermark has passed all other rows."""
    fields = T._parse_datatype_string(schema).fields
    held = {key: -1, time: END_MS}
    return spark.range(1).select(*[F.lit(held.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def silence_sessions(words: DataFrame, *, gap_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Sessions of live words: ``episode_id, at timestamp, length_ms``; a silence of ``gap_ms`` closes one.

    Spark joins sessions that touch, so each word reaches one millisecond less than the gap.
    """
    reach = F.concat((F.col("length_ms") + gap_ms - 1).cast("string"), F.lit(" milliseconds"))
    sessions = words.withWatermark("at", lateness).groupBy("episode_id", F.session_window("at", reach).alias("w"))
    return sessions.agg(F.count("*").alias("n_words"), F.min("at").alias("first_at")).select("episode_id", "first_at", "n_words")
