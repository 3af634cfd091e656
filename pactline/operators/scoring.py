"""Scoring of predicted contracts against gold ones, field by field and free of order.

A field's canonical form is a text in which rows stand sorted and only what is compared is left:
notes go, unset enumerations are named, numbers are equal whatever their spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.bind import let
from pactline.operators.normalize import UNSET, fields, is_kind, is_of, items
from pactline.operators.schema import CONTRACT, conforms

CORE = ("donem", "oda_kontenjanlari", "fiyatlar", "release", "stop_sale")
#: fixed values: what is compared of a field's rows; a trailing ? marks what counts as unset where there is nothing
COMPARED = {
    "donem": ("baslangic", "bitis"), "alt_donemler": ("ad", "baslangic", "bitis"), "oda_kontenjanlari": ("oda_tipi", "adet"), "fiyatlar": ("oda_tipi", "tutar", "birim", "pansiyon?", "alt_donem_ad"),
    "release": ("gun", "kapsam?"), "stop_sale": ("baslangic", "bitis", "kapsam", "bildirim_yontemi?"),
}


def _value(v: Column) -> Column:
    """A JSON value as text; null for nothing."""
    number = F.try_variant_get(v, "$", "double")
    text = lambda kind: F.when(kind.isNull() | (kind == "VOID"), "null").when(is_of(kind, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number.cast("string")).otherwise(F.to_json(v))
    return let(F.schema_of_variant(v), text)


def _compared(own: Column, key: str) -> Column:
    value = let(F.try_element_at(own, F.lit(key.rstrip("?"))), _value)
    if not key.endswith("?"):
        return value
    return let(value, lambda text: F.when(text.isin("null", '""', "0.0", "false", "[]", "{}"), F.lit(f'"{UNSET}"')).otherwise(text))


def _record(own: Column, name: str) -> Column:
    """What is compared of one object, given its fields. The parts are JSON texts, so that the commas between them are clear."""
    return F.concat_ws(",", *(_compared(own, key) for key in COMPARED[name]))


def _records(rows: Column, name: str) -> Column:
    """The records of an array's objects, sorted; null for no array."""
    each = F.transform(rows, lambda e: let(fields(e), lambda own: F.when(own.isNotNull(), _record(own, name))))
    return F.array_join(F.array_sort(F.array_compact(each)), ";")


def canonical(value: Column, name: str) -> Column:
    """The canonical text of a core field's value (VARIANT) in a contract; null where it has none. A value of a wrong kind stays as it is."""
    return let(value, lambda v: _canonical(v, name))


def _canonical(v: Column, name: str) -> Column:
    listed = lambda rows: F.coalesce(_records(rows, name), F.lit(""))
    if name == "donem":
        whole = lambda own: F.concat_ws("|", _record(own, name), F.coalesce(_records(items(F.try_element_at(own, F.lit("alt_donemler"))), "alt_donemler"), F.lit("")))
    else:
        whole = (lambda own: _record(own, name)) if name == "release" else listed
    read = fields if name in ("donem", "release") else items
    other = F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).otherwise(F.concat(F.lit("?"), _value(v)))
    return let(read(v), lambda own: F.when(own.isNotNull(), F.concat(F.lit("="), whole(own))).otherwise(other))


def answered(text: Column) -> Column:
    """The JSON object (VARIANT) of a model's answer: in its first fence if there is one, from the first { to the last }; null for none."""
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    inner = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    tree = F.try_parse_json(F.regexp_extract(inner, r"(?s)(\{.*\})", 1))
    return F.when(is_kind(tree, "OBJECT"), tree)


def scored(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(doc_id, valid_json, schema_ok, one boolean for each core field, error) of every gold contract (doc_id, contract: JSON).

    ``predictions`` (doc_id, answer, error): a row with an error counts as wrong in everything, and
    so does a contract without a prediction. An answer without JSON is compared as an empty contract.
    """
    own = gold.select("doc_id", F.try_parse_json("contract").alias("gold"))
    pred = predictions.select("doc_id", answered(F.col("answer")).alias("pred"), F.coalesce("error", F.lit("")).alias("error"))
    both = own.join(pred, "doc_id", "left").withColumn("error", F.when(F.col("error").isNull(), "yanıt yok").otherwise(F.nullif("error", F.lit(""))))
    both = both.withColumns({"__gold": fields(F.col("gold")), "__pred": fields(F.col("pred"))})
    fine = F.col("error").isNull()
    field = lambda side, name: canonical(F.try_element_at(f"__{side}", F.lit(name)), name)
    same = {name: fine & field("gold", name).eqNullSafe(field("pred", name)) for name in CORE}
    valid = fine & F.col("pred").isNotNull()
    return both.select("doc_id", valid.alias("valid_json"), (valid & conforms(F.col("pred"), CONTRACT)).alias("schema_ok"), *(c.alias(name) for name, c in same.items()), "error")


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """n, the rates of valid answers and of each field, and the number of errors, for each group; rates of no rows are 0."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), rate("valid_json").alias("valid_json_rate"), rate("schema_ok").alias("schema_ok_rate"), *(rate(c).alias(c) for c in CORE), F.count("error").alias("errors"))


def percent(share: Column) -> Column:
    """A share as a percentage of fixed width."""
    return F.format_string("%5.1f%%", 100 * share)
