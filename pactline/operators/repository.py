"""Reads and writes of stored collections: each write returns the collection's next state.

Predicates are SQL conditions over the collection's columns, so that scans push them down.
Unique keys are kept by joins on the keys; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point(df: DataFrame, where: str) -> DataFrame:
    """The document that the condition names, the one of the least id if there are several."""
    return df.where(where).orderBy("id").limit(1)


def scan(df: DataFrame, where: str, order: list[str]) -> DataFrame:
    """Every matching document in the given order (``-`` before a column: descending), then by id."""
    return df.where(where).orderBy(*(F.desc(c[1:]) if c[:1] == "-" else F.asc(c) for c in order), "id")


def count(df: DataFrame, where: str) -> DataFrame:
    return df.where(where).agg(F.count("*").alias("n"))


def inserted(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """With the new documents, but those whose unique key is taken (by a stored one, or by a new one of lesser id)."""
    first = new.groupBy(*keys).agg(F.min("id").alias("id"))
    free = new.join(first, [*{*keys, "id"}], "left_semi").join(df, keys, "left_anti")
    return df.unionByName(free.select(df.columns))


def replaced(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored documents of the new ones' keys give way to them; new ones without a stored one are dropped."""
    return df.join(new, keys, "left_anti").unionByName(new.join(df, keys, "left_semi").select(df.columns))


def upserted(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``replaced``, but new ones without a stored one are added."""
    return df.join(new, keys, "left_anti").unionByName(new.select(df.columns))


def deleted(df: DataFrame, where: str) -> DataFrame:
    """Without the matching documents; where the condition is null, a document stays."""
    return df.where(~F.coalesce(F.expr(where), F.lit(False)))


def updated(df: DataFrame, where: str, values: dict[str, str]) -> DataFrame:
    """Matching documents get new values, all computed from the old document."""
    hit = F.expr(where)
    return df.select(*(F.when(hit, F.expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def consumed(df: DataFrame, where: str, values: dict[str, str]) -> DataFrame:
    """A guarded update in one step: the next state, and in ``returned`` which documents the caller gets back."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    changed = [F.when(hit, F.expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]
    return df.select(*changed, hit.alias("returned"))


def duplicates(df: DataFrame, keys: list[str], where: str = "true") -> DataFrame:
    """Unique keys that several documents hold, counted among the documents that the (partial) index covers."""
    return df.where(where).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
