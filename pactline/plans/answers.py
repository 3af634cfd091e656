"""Model answers: repair of broken JSON. The answers are the events' properties, broken in a way that their key says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import json_repair as j
from pactline.sources.tables import load

_ID = "event_id % 10"
#: SQL, the same for both engines: an answer for each event, intact or broken
_ANSWER = f"""CASE {_ID}
  WHEN 0 THEN '{{"v": ' || k || ', "t": "' || event_type || '"}}'
  WHEN 1 THEN 'Yanıt: ```json {{"v": ' || k || ', "t": "' || event_type || '"}} ``` tamam'
  WHEN 2 THEN '{{"v": ' || k || ', "t": "' || event_type || '", "kesik": "ya'
  WHEN 3 THEN '{{"v": ' || k || '}}, "t": "' || event_type || '"}}'
  WHEN 4 THEN '{{"v": ' || k || '}} ve {{"t": "' || event_type || '"}}'
  WHEN 5 THEN '{{"v": ' || k || ', "t": "' || event_type || '", "x": {{"y": 1'
  WHEN 6 THEN '{{"v": [' || k || '], "t": "bos"}} {{"v": [' || k || '], "t": "' || event_type || '"}}'
  WHEN 7 THEN 'yanıt yok'
  WHEN 8 THEN ''
  ELSE '``` {{"v": ' || k || ', "t": "' || event_type || '"' END"""
_KEY = "regexp_extract(props, '([0-9]+)', 1)"


def answers(s: SparkSession, p: str) -> DataFrame:
    e = load(s, p, "events").selectExpr("event_id", "event_type", f"{_KEY} AS k")
    return e.selectExpr("event_id", "event_type", "k", f"{_ANSWER} AS answer")


_SQL = f"WITH a AS (SELECT event_id, event_type, k, {_ANSWER} AS answer FROM (SELECT event_id, event_type, {_KEY} AS k FROM events) x)"


def _read(column) -> callable:
    def run(s: SparkSession, p: str) -> DataFrame:
        return answers(s, p).select("event_id", column(F.col("answer")).alias("object"))

    return run


def _typed(s: SparkSession, p: str) -> DataFrame:
    """The repaired answers' typed fields, and how many answers stay unreadable: the repair is read by its schema."""
    fixed = answers(s, p).select("event_type", j.repaired(F.col("answer")).alias("object"))
    own = F.from_json("object", "v string, t string")
    return fixed.groupBy("event_type").agg(F.count("object").alias("n_read"), F.count_if(F.col("object").isNull()).alias("n_lost"), F.sum(F.try_to_number(own["v"], F.lit("999999"))).cast("long").alias("total"))


def _text(name: str, value: str) -> str:
    return f"""'"{name}":' || {value}"""


def _object(*fields: str) -> str:
    return "'{' || " + " || ',' || ".join(fields) + " || '}'"


_T, _V = _text("t", "'\"' || event_type || '\"'"), _text("v", "k")
_WHOLE = _object(_T, _V)
#: what each kind of answer stands for, from the values it was made of
_REPAIRED = f"""CASE {_ID} WHEN 5 THEN {_object(_T, _V, _text("x", "'{\"y\":1}'"))} WHEN 6 THEN {_object(_T, _text("v", "'[' || k || ',' || k || ']'"))} WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE {_WHOLE} END"""
_UPDATED = f"""CASE {_ID} WHEN 2 THEN NULL WHEN 3 THEN {_object(_V)} WHEN 5 THEN NULL WHEN 6 THEN {_object(_T, _text("v", "'[' || k || ']'"))} WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE {_WHOLE} END"""
_FIRST = f"CASE WHEN {_ID} < 2 THEN {_WHOLE} END"


def _clipped(s: SparkSession, p: str) -> DataFrame:
    a = F.col("answer")
    return answers(s, p).select("event_id", j.fence_stripped(a).alias("inside"), j.object_span(a).alias("span"))


QUERIES = {
    "json_repair": _read(j.repaired),
    "json_repair_part": _read(j.part_repaired),
    "json_first_object": _read(j.first_read),
    "json_updated_objects": _read(j.updates_read),
    "json_findings": lambda s, p: _findings(s, p),
    "json_fence_and_span": _clipped,
    "json_repair_typed": _typed,
}


def _findings(s: SparkSession, p: str) -> DataFrame:
    """Findings in a model's answers: at most five slots, those with a title, a text and a known severity."""
    found = answers(s, p).select("event_id", j.findings_repaired(F.concat(F.lit("Bulgular: ["), _row("event_type"), F.lit(", "), _row("k"), F.lit("] son"))).alias("rows"))
    rows = F.from_json("rows", "array<struct<baslik string, aciklama string, onem string>>")
    each = found.select("event_id", F.posexplode(F.slice(rows, 1, 5)).alias("slot", "x")).select("event_id", "slot", *(F.trim(f"x.{c}").alias(c) for c in ("baslik", "aciklama", "onem")))
    severity = F.upper("onem")
    return each.where((F.col("baslik") != "") & (F.col("aciklama") != "") & severity.isin("KRITIK", "UYARI", "BILGI")).select("event_id", "slot", F.concat(F.lit("MODEL_"), F.upper("baslik")).alias("code"), severity.alias("severity"))


def _row(column: str) -> Column:
    kind = F.when(F.col("event_type") == "error", "kritik").when(F.col("event_type") == "view", "Uyari").when(F.col("event_type") == "click", "??").otherwise("BILGI")
    return F.concat(F.lit('{"baslik": " '), F.col(column), F.lit('", "aciklama": "a", "onem": "'), kind, F.lit('"}'))


SQL = {
    "json_repair": f"{_SQL} SELECT event_id, {_REPAIRED} AS object FROM a",
    "json_repair_part": f"{_SQL} SELECT event_id, {_REPAIRED} AS object FROM a",
    "json_first_object": f"{_SQL} SELECT event_id, {_FIRST} AS object FROM a",
    "json_updated_objects": f"{_SQL} SELECT event_id, {_UPDATED} AS object FROM a",
    "json_findings": f"""{_SQL} SELECT event_id, slot, 'MODEL_' || upper(title) AS code, CASE event_type WHEN 'error' THEN 'KRITIK' WHEN 'view' THEN 'UYARI' ELSE 'BILGI' END AS severity
        FROM (SELECT event_id, event_type, 0 AS slot, event_type AS title FROM a UNION ALL SELECT event_id, event_type, 1, k FROM a) x WHERE event_type <> 'click'""",
    "json_fence_and_span": f"""{_SQL} SELECT event_id, CASE {_ID} WHEN 1 THEN '{{"v": ' || k || ', "t": "' || event_type || '"}}' WHEN 9 THEN substr(answer, 5) ELSE answer END AS inside,
        regexp_extract(answer, '(?s)(\\{{.*\\}})', 1) AS span FROM a""",
    "json_repair_typed": f"""{_SQL} SELECT event_type, count(o) AS n_read, count(*) - count(o) AS n_lost, CAST(sum(CASE WHEN {_ID} <> 6 AND o IS NOT NULL THEN CAST(k AS BIGINT) END) AS BIGINT) AS total
        FROM (SELECT *, {_REPAIRED} AS o FROM a) x GROUP BY event_type""",
}
