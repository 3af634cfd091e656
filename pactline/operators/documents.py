"""Queries and conditional updates over stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, newest: str, key: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page, newest first with the key as tie-break: limit 20 by default and 100 at most, offset 0 at least."""
    n = min(limit if limit and limit > 0 else 20, 100)
    return df.orderBy(F.desc(newest), F.desc(key)).offset(max(offset or 0, 0)).limit(n)


def visible(df: DataFrame, org: Column, user: Column, actor_org: str | None, actor_user: str) -> DataFrame:
    """Rows of the actor's organisation, or the actor's own rows that belong to none."""
    return df.where(org == actor_org) if actor_org else df.where((user == actor_user) & org.isNull())


def latest(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """The row of each key with the greatest values in the given columns, combined on the map side."""
    rest = [c for c in df.columns if c != key and c not in newest]
    top = df.groupBy(key).agg(F.max(F.struct(*newest, *rest)).alias("__top"))
    return top.select(*(F.col(key) if c == key else F.col(f"__top.{c}").alias(c) for c in df.columns))


def retained(df: DataFrame, ts: str, days: int, anchor: Column | None = None) -> DataFrame:
    """Rows not older than so many days before the anchor (default: the newest row)."""
    if anchor is None:
        last = df.agg(F.max(ts).alias("__last"))  # one row
        return df.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last")
    return df.where(F.col(ts) >= anchor - F.expr(f"INTERVAL {days} DAYS"))


def upsert(events: DataFrame, keys: list[str], ts: str, newest: list[str]) -> DataFrame:
    """One row a key: when first and last seen, and the newest values of some columns."""
    last = F.max(F.struct(ts, *newest))
    out = events.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), last.alias("__last"))
    return out.select(*keys, "first_seen", "last_seen", *(F.col(f"__last.{c}").alias(c) for c in newest))


def without_deleted(df: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What an erasure leaves of a table."""
    return df.join(deleted, key, "left_anti")


def anonymised(df: DataFrame, who: Column, user: str, blank: list[str]) -> DataFrame:
    """User ids of the erased replaced by a fixed word, and their traces blanked."""
    out = df.withColumn("__gone", who)
    out = out.withColumn(user, F.when(F.col("__gone"), "silinmis").otherwise(F.col(user).cast("string")))
    for c in blank:
        out = out.withColumn(c, F.when(F.col("__gone"), "").otherwise(F.col(c)))
    return out.drop("__gone")
