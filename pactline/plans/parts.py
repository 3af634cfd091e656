"""Contracts of orders that a model answers in four parts, training targets of them, and findings of rules and model together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions.bind import spread
from pactline.operators import audit
from pactline.operators import parts as a
from pactline.plans import contracts as c
from pactline.plans.grounding import K, N, texts
from pactline.sources.tables import load

#: SQL: what a model answers on a part in a round; null where it is not asked or the call fails
_ASKED = {
    ("A", 0): f"""CASE WHEN {K} % 5 = 0 THEN 'bozuk' ELSE '{{"donem": {{"baslangic": "2026-09-30", "bitis": "2026-05-01", "not": 1}}, "oda_kontenjanlari": [{{"oda_tipi": "Standard", "adet": ' || CASE WHEN {K} % 3 = 0 THEN CAST(o_custkey + 1000 AS STRING) ELSE {N} END || '}}, {{"oda_tipi": "teras", "adet": 4}}]}}' END""",
    ("A", 1): f"""CASE WHEN {K} % 5 = 0 THEN '{{"donem": {{}}, "alt_donemler": [{{"ad": "yaz", "baslangic": "2026-06-01", "bitis": "2026-06-30"}}], "oda_kontenjanlari": [{{"oda_tipi": "standart", "adet": "' || {N} || ' oda"}}]}}' END""",
    ("B", 0): f"""CASE WHEN {K} % 4 = 0 THEN '{{"fiyatlar": {{}}}}' ELSE '{{"fiyatlar": [{{"oda_tipi": "suite", "tutar": ' || {N} || ', "pansiyon": "hb"}}, {{"oda_tipi": "Suit", "tutar": "' || {N} || '", "pansiyon": "HB", "alt_donem_ad": "null"}}, {{"oda_tipi": "teras", "tutar": 5}}, {{"oda_tipi": "suit"}}]}}' END""",
    ("B", 1): f"""CASE WHEN {K} % 8 = 0 THEN '{{"fiyatlar": []}}' END""",
    ("C", 0): f"""CASE WHEN {K} % 6 = 3 THEN '{{"stop_sale": []}}' ELSE '{{"release": [{{"gun": 7}}], "stop_sale": [{{"baslangic": "2026-07-05", "bitis": "2026-07-10"}}, {{"baslangic": "2026-07-05", "kapsam": "Junior Suite"}}, null]}}' END""",
    ("D", 0): f"""CASE WHEN {K} % 2 = 0 THEN '{{"otel_adi": "deniz otel AŞ"}}' ELSE '{{"meta": {{"otel_adi": "deniz otel AŞ", "sezon": 4}}}}' END""",
}
_AGAIN = {"A": f"{K} % 5 = 0", "B": f"{K} % 4 = 0"}


def _answers(s: SparkSession, p: str) -> DataFrame:
    asked = [f"CASE WHEN {_AGAIN[part] if attempt else 'true'} THEN named_struct('part', '{part}', 'attempt', {attempt}, 'answer', {sql}) END" for (part, attempt), sql in _ASKED.items()]
    orders = spread(load(s, p, "orders").select(K, "o_custkey"), K)
    return orders.selectExpr(f"{K} AS doc_id", f"inline(array_compact(array({', '.join(asked)})))")


def _answered(s: SparkSession, p: str) -> DataFrame:
    got = a.answered(texts(s, p).withColumnRenamed(K, "doc_id"), _answers(s, p))
    shape = "donem struct<bitis string, alt_donemler array<struct<ad string>>>, oda_kontenjanlari array<struct<oda_tipi string, adet bigint>>, fiyatlar array<struct<oda_tipi string, tutar double, birim string, pansiyon string>>, release struct<gun bigint>, stop_sale array<struct<kapsam string>>, meta struct<otel_adi string>"
    x = got.withColumn("x", F.from_json("contract", shape))
    listed = lambda rows, *ks: F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", *(k(r) for k in ks))), ";")
    name, whole = lambda r: r["oda_tipi"], lambda k: lambda r: r[k].cast("bigint").cast("string")
    return x.select(
        "doc_id", "parts", "retries", F.col("x.donem.bitis").alias("ends"), F.size("x.donem.alt_donemler").cast("long").alias("n_sub"), listed(F.col("x.oda_kontenjanlari"), name, whole("adet")).alias("rooms"),
        listed(F.col("x.fiyatlar"), name, whole("tutar"), lambda r: r["birim"], lambda r: r["pansiyon"]).alias("prices"), F.col("x.release.gun").alias("release_days"), listed(F.col("x.stop_sale"), lambda r: F.coalesce(r["kapsam"], F.lit("-"))).alias("stops"), F.col("x.meta.otel_adi").alias("hotel"),
    )


#: a quantity or a price of 0 is none
_A = f"(o_custkey > 0 OR ({K} % 3 = 0 AND {K} % 5 <> 0))"
_B, _C = f"({K} % 4 <> 0 OR {K} % 8 = 0)", f"({K} % 6 <> 3)"
_D = f"({K} % 3 < 2 OR {K} % 4 IN (0, 2) OR {K} % 5 < 3)"
_ANSWERED = f"""SELECT {K} AS doc_id, CASE WHEN {_A} THEN 'A' ELSE '' END || CASE WHEN {_B} THEN 'B' ELSE '' END || CASE WHEN {_C} THEN 'C' ELSE '' END || CASE WHEN {_D} THEN 'D' ELSE '' END AS parts, CASE WHEN {K} % 5 = 0 OR {K} % 4 = 0 THEN 1 ELSE 0 END AS retries,
  CASE WHEN {_A} AND {K} % 5 <> 0 THEN '2026-05-01' END AS ends, CASE WHEN {_A} THEN CASE WHEN {K} % 5 = 0 THEN 1::BIGINT ELSE 0::BIGINT END END AS n_sub,
  CASE WHEN {_A} THEN 'standart ' || CASE WHEN {K} % 3 = 0 AND {K} % 5 <> 0 AND o_custkey NOT BETWEEN 1 AND 9999 THEN o_custkey + 1000 ELSE o_custkey END END AS rooms,
  CASE WHEN {_B} THEN CASE WHEN {K} % 4 <> 0 THEN 'suit ' || {N} || ' oda_gecelik HB;' ELSE '' END || CASE WHEN o_custkey > 0 THEN 'suit ' || {N} || ' oda_gecelik belirtilmemis;' ELSE '' END || 'aile 90 oda_gecelik belirtilmemis' END AS prices,
  CASE WHEN {_C} THEN 7::BIGINT END AS release_days, CASE WHEN {_C} THEN CASE {K} % 6 WHEN 0 THEN '-;suit' WHEN 1 THEN 'suit' ELSE '' END END AS stops,
  -- the root's particulars count only where the text gives none
  CASE {K} % 3 WHEN 0 THEN CASE WHEN {K} % 2 = 0 THEN 'Deniz Otel A.Ş' ELSE 'deniz otel AŞ' END WHEN 1 THEN 'Kum Otel ' || {N} END AS hotel FROM orders"""

_ROOM = f"""'[{{"adet":' || {N} || ',"oda_tipi":"suit"}}]'"""
#: SQL, the same for both engines: a contract's tree, its keys in order
_TREE = f"""'{{"donem":{{"bitis":"2026-05-01"}},"meta":{{"acente_adi":"","otel_adi":"' || {N} || '","sezon":"belirtilmemis"}},"oda_kontenjanlari":' || {_ROOM} || CASE WHEN {K} % 2 = 0 THEN ',"release":{{"gun":7}}' ELSE '' END || '}}'"""


def _targets(s: SparkSession, p: str) -> DataFrame:
    trees = load(s, p, "orders").selectExpr(f"{K} AS doc_id", f"{_TREE} AS tree")
    return trees.select("doc_id", F.explode(a.training_targets(F.try_parse_json("tree"))).alias("x")).select("doc_id", "x.part", "x.target")


_TARGETS = f"""SELECT {K} AS doc_id, part, CASE part WHEN 'FULL' THEN {_TREE} WHEN 'A' THEN '{{"donem":{{"bitis":"2026-05-01"}},"oda_kontenjanlari":[{{"oda_tipi":"suit","adet":' || {N} || '}}]}}' WHEN 'B' THEN '{{"fiyatlar":[]}}'
  WHEN 'C' THEN '{{"release":' || CASE WHEN {K} % 2 = 0 THEN '{{"gun":7}}' ELSE '{{"gun":null,"kapsam":"belirtilmemis"}}' END || ',"stop_sale":[]}}' ELSE '{{"meta":{{"otel_adi":"' || {N} || '"}}}}' END AS target FROM orders, (VALUES ('FULL'), ('A'), ('B'), ('C'), ('D')) v(part)"""

#: SQL: a model's findings on a contract; every third answer has a number for a title
_FOUND = f"""'Bulgular: [{{"baslik": " Tarih: ' || {N} || '! ", "aciklama": "a", "onem": "kritik", "alan": " donem "}}, {{"baslik": "--", "aciklama": "b", "onem": "Bilgi"}}, {{"baslik": ' || CASE WHEN {K} % 3 = 0 THEN '7' ELSE '"x"' END || ', "aciklama": "", "onem": "BILGI"}}, {{"baslik": "y", "aciklama": "c", "onem": "acil"}}] son'"""


def _audited(s: SparkSession, p: str) -> DataFrame:
    answers = load(s, p, "orders").selectExpr(f"{K} AS doc_id", f"{_FOUND} AS answer")
    return audit.audited(c.findings(s, p), audit.model_findings(answers)).select("doc_id", "rank", "code", "severity", "source", "path", "title")


_AUDITED = f"""WITH {c._F}, f AS (SELECT doc_id, code, severity, 'KURAL' AS source, path, NULL AS title FROM findings
    UNION ALL SELECT {K}, 'MODEL_TARIH_' || o_custkey, 0, 'MODEL', 'donem', 'Tarih: ' || o_custkey || '!' FROM orders WHERE {K} % 3 <> 0 UNION ALL SELECT {K}, 'MODEL_2', 2, 'MODEL', '', '--' FROM orders WHERE {K} % 3 <> 0)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY severity, source, code, path)::INT AS rank, code, ['KRITIK', 'UYARI', 'BILGI'][severity + 1] AS severity, source, path, title FROM f"""

QUERIES = {"answered_parts": _answered, "training_targets": _targets, "audited_findings": _audited}
SQL = {"answered_parts": _ANSWERED, "training_targets": _TARGETS, "audited_findings": _AUDITED}
