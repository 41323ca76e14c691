"""Tables that change together: a log of commits that point to files.

A commit writes the changed tables to new folders and then one small entry in the log; the entry is the change, for all its tables at once.
Readers follow the newest whole entry, so a writer that stops half way leaves nothing to be seen, and a version that was read stays readable.
An entry has the number behind the one its writer read, and is created only if it is not there: the second of two writers is refused.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from voxtable.session import fresh_path


class Conflict(Exception):
    """Another writer was first."""


class Tables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._log = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        self._files = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{number:012d}.json")

    def version(self) -> int:
        """The newest commit, -1 before the first."""
        if not self._files.exists(self._log):
            return -1
        names = [s.getPath().getName().removesuffix(".json") for s in self._files.listStatus(self._log)]
        for number in sorted((int(n) for n in names if n.isdigit()), reverse=True):
            if self._read(number) is not None:
                return number
        return -1

    def _read(self, number: int) -> dict[str, str] | None:
        stream = self._files.open(self._entry(number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None  # still being written

    def names(self, version: int | None = None) -> dict[str, str]:
        number = self.version() if version is None else version
        return {} if number < 0 else self._read(number)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.names(version)[name])

    def commit(self, changes: dict[str, DataFrame], expected: int) -> int:
        """Put the changed tables in place of the old ones, all or none; ``expected`` is the version they were made from."""
        now = self.names(expected) if expected >= 0 else {}
        if self._files.exists(self._entry(expected + 1)):
            raise Conflict(f"version {expected + 1} is there already")
        for name, df in changes.items():
            path = f"{self.root}/data/{fresh_path(self.spark, name).rsplit('/', 1)[-1]}"
            df.write.parquet(path)
            now[name] = path
        try:
            out = self._files.create(self._entry(expected + 1), False)
        except Py4JJavaError as error:
            raise Conflict(f"version {expected + 1} is there already") from error
        try:
            out.write(bytearray(json.dumps(now).encode() + b"\n"))
        finally:
            out.close()
        return expected + 1


def lay_out(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Write a table in buckets by key, sorted inside them; scans, groups and joins by these keys need no exchange."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
