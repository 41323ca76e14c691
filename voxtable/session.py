"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words that a Python step holds as objects at a time.
WORDS_AT_ONCE = 1 << 14

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "8", app: str = "voxtable", **conf: str) -> SparkSession:
    """A one-JVM session for tests and benchmarks; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary folder is made, on a local master only:
    on a cluster every executor would write to its own disk.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxtable-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage where a result is used more than once, and fixes row placement, so later stages
    agree with each other even after an executor is lost.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Logical nodes that keep rows where they are. A node that is not listed counts as work.
PLAIN_NODES = frozenset({"Project", "Filter", "Generate", "Expand", "Union", "SubqueryAlias", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation", "InMemoryRelation", "Range", "OneRowRelation"})


def is_scan(df: DataFrame) -> bool:
    """True when ``df`` only reads, filters and projects; the plan's nodes are looked at, nothing runs."""
    waiting = [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() not in PLAIN_NODES:
            return False
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.size()))
    return True


def spread(df: DataFrame) -> DataFrame:
    """Even out the rows before work that costs much more per row than moving the row.

    Only a bare scan with fewer splits than the cluster has cores (a few small files) is moved. Behind a shuffle the
    rows are dealt already, and asking for their number of splits would run that shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_scan(df) and df.rdd.getNumPartitions() < cores else df


def few_words(batches: Iterable[pa.RecordBatch], words: str, limit: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the word arrays of each hold about ``limit`` words; a longer row stands alone.

    Spark counts rows, not what they hold, and a word is many times larger as a Python object than in its batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit
