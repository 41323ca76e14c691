"""Contracts of model and service calls, judged on their recorded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def result_problem(model_revision: Column, weights: Column, metrics: Column) -> Column:
    """What an adapter result lacks, null when the contract holds."""
    return (
        F.when(metrics.isNull(), "MISSING_QUALITY_METRICS")
        .when(F.exists(F.map_values(metrics), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "NON_FINITE_METRICS")
        .when((F.coalesce(model_revision, F.lit("")) == "") | (F.coalesce(weights, F.lit("")) == ""), "MISSING_MODEL_IDENTITY"))


def stage_support(runs: DataFrame, supported: Sequence[str], stage: str = "stage") -> DataFrame:
    """Add ``problem``: UNSUPPORTED_STAGE for a stage that no adapter is registered for."""
    known = F.coalesce(F.col(stage).isin(*supported), F.lit(False))
    return runs.withColumn("problem", F.when(~known, "UNSUPPORTED_STAGE"))


def transient(status: Column) -> Column:
    """Whether a call is tried again: no answer, too many requests, or a server error."""
    return status.isNull() | (status == 429) | ((status >= 500) & (status <= 599))


def retry_outcomes(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status", *, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """How each call ended, from its recorded attempts: ``attempts, status, error``.

    The first attempt with a final answer ends a call; otherwise the last of at most ``limit`` does. Attempts recorded
    behind the end are surplus and are counted in ``surplus``. ``order`` must number a call's attempts without ties.
    """
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
    numbered = attempts.select(*keys, F.col(status).alias("status"), turn.alias("k"))
    tried = F.col("k") <= limit
    last = F.coalesce(F.min(F.when(tried & ~transient(F.col("status")), F.col("k"))), F.max(F.when(tried, F.col("k"))))
    ended = numbered.groupBy(*keys).agg(F.count("*").alias("__recorded"), last.alias("attempts"), F.collect_list(F.when(tried, F.struct("k", "status"))).alias("__t"))
    answer = F.get(F.filter("__t", lambda t: t["k"] == F.col("attempts")), 0)["status"]
    out = ended.withColumn("status", answer)
    good = (F.col("status") >= 200) & (F.col("status") <= 299)
    error = F.when(F.col("status").isNull(), "TRANSPORT_FAILED").when(good, None).when(transient(F.col("status")), "TRANSIENT_HTTP_FAILURE").otherwise("HTTP_FAILURE")
    return out.select(*keys, "attempts", "status", error.alias("error"), (F.col("__recorded") - F.col("attempts")).alias("surplus"))
