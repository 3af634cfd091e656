"""A contract's audit: what the rules find and what a model finds, in one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions import text as x
from pactline.operators import contracts as c
from pactline.operators import json_repair as j
from pactline.operators import normalize as n

MOST = 5  # findings of a model's answer that are read
#: the fields of a model's finding
FIELDS = ("baslik", "aciklama", "onem", "alan")


def model_findings(answers: DataFrame) -> DataFrame:
    """(doc_id, code, severity, source, path, title, description) of model answers (doc_id, answer).

    Of the first ``MOST`` those count that have a title, a description and a known severity. The
    code is made of the title, or of the finding's place where it has no letter. An answer that
    is no array of objects of texts, cannot be read, or is null has no findings.
    """
    rows = n.items(F.try_parse_json(j.findings_repaired(F.col("answer"))))
    typed = lambda v: n.is_kind(v, "VOID") | (n.is_kind(v, "OBJECT") & F.forall(F.array(*(n.is_missing(n.part(v, k)) | n.is_kind(n.part(v, k), "STRING") for k in FIELDS)), lambda ok: ok))
    told = lambda v: F.struct(*(F.trim(F.coalesce(n.part(v, k, "string"), F.lit(""))).alias(k) for k in FIELDS))
    read = answers.select("doc_id", F.transform(F.array(rows), lambda r: F.when(F.forall(r, typed), F.transform(F.slice(r, 1, MOST), told)))[0].alias("rows"))
    each = read.select("doc_id", F.posexplode("rows").alias("slot", "x")).select("doc_id", "slot", "x.*").withColumn("severity", F.upper("onem"))
    code = F.coalesce(F.nullif(x.slug(F.col("baslik")), F.lit("")), (F.col("slot") + 1).cast("string"))
    kept = each.where((F.col("baslik") != "") & (F.col("aciklama") != "") & F.col("severity").isin(*c.SEVERITIES))
    return kept.select("doc_id", F.concat(F.lit("MODEL_"), code).alias("code"), "severity", F.lit("MODEL").alias("source"), F.col("alan").alias("path"), F.col("baslik").alias("title"), F.col("aciklama").alias("description"))


def audited(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Both kinds of findings with their rank in the contract; rules have neither title nor description here."""
    return c.ranked(rules.unionByName(model, allowMissingColumns=True))


def for_prompt(tree: Column) -> Column:
    """The JSON of a contract that an auditing model is given: without how it was extracted; ``{}`` of anything but an object."""
    own = F.map_filter(F.try_variant_get(tree, "$", "map<string,variant>"), lambda k, _: k != "cikarim_meta")
    return F.coalesce(F.to_json(own), F.lit("{}"))
