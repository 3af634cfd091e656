"""Where the values of a contract's fields stand: needles from its tree, found on its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.bind import let
from pactline.operators.normalize import is_kind, items

LEAST = 3  # characters of a needle without white space


def _children(v: Column) -> Column:
    """The values in an array or object; null for a scalar."""
    return F.coalesce(items(v), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def scalars(trees: DataFrame, value: str) -> DataFrame:
    """``trees`` with a row for each scalar below the VARIANT in a column, however deep; nulls give none.

    A tree is taken apart within its row, level by level, so that the rows below are computed once.
    """
    none = F.array().cast("array<variant>")
    # each level opens at least one bracket
    levels = F.length(F.regexp_replace(F.to_json(F.col(value)), r"[^\[{]", ""))

    def step(state: Column, _: Column) -> Column:
        parts = F.transform(state["level"], lambda v: F.struct(v.alias("v"), _children(v).alias("below")))
        return let(parts, lambda own: F.struct(
            F.flatten(F.transform(F.filter(own, lambda b: b["below"].isNotNull()), lambda b: b["below"])).alias("level"),
            F.concat(state["leaves"], F.transform(F.filter(own, lambda b: b["below"].isNull()), lambda b: b["v"])).alias("leaves"),
        ))

    start = F.struct(F.array(F.col(value)).alias("level"), none.alias("leaves"))
    found = F.aggregate(F.sequence(F.lit(0), levels), start, lambda state, k: F.when(F.size(state["level"]) == 0, state).otherwise(step(state, k)), lambda state: state["leaves"])
    each = trees.where(F.col(value).isNotNull()).withColumn(value, F.explode(found))
    return each.where(F.col(value).isNotNull() & ~F.is_variant_null(value))


def needle(v: Column) -> Column:
    """A scalar as it is looked for: trimmed, in lower case, whole numbers without decimals; null if it is too short to tell."""
    number = F.try_variant_get(v, "$", "double")
    text = F.when(is_kind(v, "DECIMAL", "DOUBLE", "FLOAT"), F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.cast("bigint").cast("string")).otherwise(number.cast("string"))).otherwise(F.try_variant_get(v, "$", "string"))
    low = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(F.length(F.regexp_replace(low, r"\s", "")) >= LEAST, low)


def needles(trees: DataFrame) -> DataFrame:
    """(doc_id, field, needle) of the values (doc_id, field, value: VARIANT)."""
    return scalars(trees.select("doc_id", "field", "value"), "value").select("doc_id", "field", needle(F.col("value")).alias("needle")).where("needle is not null").distinct()


def field_pages(trees: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, field, page): the first page (doc_id, page, text) of a contract that holds a value of the field; null for none.

    A contract's needles meet its own pages only.
    """
    low = pages.select("doc_id", "page", F.lower("text").alias("text"))
    found = needles(trees).join(low, "doc_id").where(F.contains("text", F.col("needle"))).groupBy("doc_id", "field").agg(F.min("page").alias("page"))
    return trees.select("doc_id", "field").distinct().join(found, ["doc_id", "field"], "left")
