"""Metrics over call records (agent, endpoint, ts, duration_ms, success, error)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agent_bucket(agent: Column) -> Column:
    return F.when(agent == "DENETCI", "DENETCI").otherwise("OKUYUCU")


def error_class(kind: Column) -> Column:
    """timeout, 5xx, 4xx or parse; NULL where there is no error."""
    k = F.coalesce(kind, F.lit(""))
    return F.when(k.isin("", "yok"), None).when(k.isin("zaman_asimi", "iptal", "timeout"), "timeout").when(k.startswith("http_4"), "4xx").when(k == "parse", "parse").otherwise("5xx")


def since(calls: DataFrame, hours: int | None = None, start: datetime | None = None, now: Column | None = None) -> DataFrame:
    """Calls since an explicit start, else since so many hours (default 24, at most 168) before ``now`` (default: the last call)."""
    if start is not None:
        return calls.where(F.col("ts") >= F.lit(start))
    span = min(hours if hours and hours > 0 else 24, 168)
    if now is None:
        last = calls.agg(F.max("ts").alias("__last"))  # one row
        return calls.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("__last") - F.expr(f"INTERVAL {span} HOURS")).drop("__last")
    return calls.where(F.col("ts") >= now - F.expr(f"INTERVAL {span} HOURS"))


def call_metrics(calls: DataFrame) -> DataFrame:
    """Totals, by agent and by endpoint, in one pass: (level, name, n_calls, n_ok, n_failed, mean_ms, p95_ms).

    p95 is the nearest-rank percentile. Grouping sets expand each row three times before
    the partial aggregation; all that is shuffled is a row for each group and task, with
    the distinct durations of the group.
    """
    shaped = calls.select(agent_bucket(F.col("agent")).alias("agent"), F.coalesce(F.nullif("endpoint", F.lit("")), F.lit("uc1")).alias("endpoint"), F.greatest("duration_ms", F.lit(0)).alias("ms"), F.col("success").cast("int").alias("ok"))
    ms = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)")
    grouped = shaped.groupingSets([[], [F.col("agent")], [F.col("endpoint")]], "agent", "endpoint").agg(F.grouping_id().alias("g"), F.count("*").alias("n_calls"), F.sum("ok").alias("n_ok"), F.sum(1 - F.col("ok")).alias("n_failed"), F.avg("ms").alias("mean_ms"), ms.cast("double").alias("p95_ms"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "agent").otherwise("endpoint")
    return grouped.select(level.alias("level"), F.coalesce("agent", "endpoint", F.lit("")).alias("name"), "n_calls", "n_ok", "n_failed", "mean_ms", "p95_ms")


def error_histogram(calls: DataFrame) -> DataFrame:
    """(rank, error, n) of failed calls in the fixed order timeout, 5xx, 4xx, parse; kinds that do not occur are left out."""
    kinds = calls.where(~F.col("success")).select(error_class(F.col("error")).alias("error")).where("error is not null")
    rank = F.when(F.col("error") == "timeout", 1).when(F.col("error") == "5xx", 2).when(F.col("error") == "4xx", 3).otherwise(4)
    return kinds.groupBy("error").agg(F.count("*").alias("n")).select(rank.alias("rank"), "error", "n")


def recent(calls: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The last calls, newest first: 20 by default, at most 100."""
    n = min(limit if limit and limit > 0 else 20, 100)
    return calls.orderBy(F.desc("ts"), F.desc(key)).limit(n)
