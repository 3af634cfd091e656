"""Contract JSON of each order: normalisation, typed documents, schema validation, required fields and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions.bind import spread
from pactline.operators import normalize as n
from pactline.operators import schema as v
from pactline.sources.tables import load

K = "o_orderkey"
_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_Y, _M, _D = f"substr({_ISO}, 1, 4)", f"substr({_ISO}, 6, 2)", f"substr({_ISO}, 9, 2)"
_NUM = "CAST({} AS STRING)".format
#: SQL, the same for both engines: a contract of each order, with a fault that its key says
_JSON = f"""'{{"donem": {{"baslangic": "' ||
  CASE {K} % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN {_D} || '.' || {_M} || '.' || {_Y} WHEN 2 THEN {_D} || '/' || {_M} || '/' || {_Y} ELSE 'yakında' END || '"' ||
  CASE WHEN {K} % 6 = 0 THEN '' ELSE ', "bitis": "2030-01-31"' END || CASE WHEN {K} % 5 = 0 THEN ', "not": 1' ELSE '' END || CASE WHEN {K} % 7 = 0 THEN ', "stop_sale": {{"baslangic": "1.5.2030"}}' ELSE '' END || '}}' ||
  CASE WHEN {K} % 11 = 0 THEN '' ELSE ', "oda_kontenjanlari": [{{"oda_tipi": "standart", "adet": ' || CASE {K} % 3 WHEN 0 THEN '"' || {_NUM('o_custkey')} || ' oda"' WHEN 1 THEN {_NUM('o_custkey')} ELSE '2.5' END || '}}]' END ||
  ', "fiyatlar": [{{"oda_tipi": "suit", "tutar": ' || CASE {K} % 4 WHEN 0 THEN '"' || {_NUM('o_custkey')} || ',50 EUR"' WHEN 1 THEN {_NUM('o_custkey')} WHEN 2 THEN '"USD 1,' || substr({_NUM('1000 + o_custkey % 1000')}, 2) || '.25"' ELSE '"sorunuz"' END ||
  ', "birim": "' || CASE {K} % 3 WHEN 0 THEN 'oda_gecelik' WHEN 1 THEN 'Kişi/Gece' ELSE 'gece' END || '", "pansiyon": ' || CASE {K} % 5 WHEN 0 THEN '"hb"' WHEN 1 THEN '3' WHEN 2 THEN '"AI"' ELSE '"tam pansiyon"' END || '}}]' ||
  CASE {K} % 8 WHEN 0 THEN '' WHEN 1 THEN ', "release": [{{}}, {{"gun": 14}}]' WHEN 2 THEN ', "release": {{"gun": -3}}' ELSE ', "release": {{"gun": 7}}' END ||
  CASE WHEN {K} % 7 = 1 THEN '' WHEN {K} % 7 = 0 THEN '' ELSE ', "stop_sale": []' END || '}}'"""


def contract_json(s: SparkSession, p: str) -> DataFrame:
    o = spread(load(s, p, "orders").select(K, "o_custkey", "o_orderdate"), K)
    return o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).selectExpr(f"{K} AS doc_id", f"{_JSON} AS contract")


def _normal(s: SparkSession, p: str) -> DataFrame:
    return n.normalized(contract_json(s, p), "contract")


def _documents(s: SparkSession, p: str) -> DataFrame:
    return typed(_normal(s, p))


def typed(normal: DataFrame) -> DataFrame:
    """The typed fields of each contract."""
    room, price = F.get("doc.oda_kontenjanlari", 0), F.get("doc.fiyatlar", 0)
    return normal.select(
        "doc_id", F.col("doc.donem.baslangic").alias("begins"), F.col("doc.donem.bitis").alias("ends"), room["adet"].cast("long").alias("rooms"), price["tutar"].alias("amount"), price["birim"].alias("unit"),
        price["pansiyon"].alias("board"), F.col("doc.release.gun").cast("long").alias("release_days"), F.get("doc.stop_sale", 0)["baslangic"].alias("stop_from"), F.size("doc.stop_sale").cast("long").alias("n_stops"),
    )


def _checked(s: SparkSession, p: str) -> DataFrame:
    return contract_json(s, p).select("doc_id", F.array_join(F.array_sort(v.violations(F.try_parse_json("contract"), v.CONTRACT)), ";").alias("messages"))


def _conforming(s: SparkSession, p: str) -> DataFrame:
    """How many contracts conform to the schema as given, and how many once they are normalised."""
    given = F.try_parse_json("contract")
    typed = F.try_parse_json(F.to_json("doc", {"ignoreNullFields": "true"}))
    return _normal(s, p).select(v.conforms(given, v.CONTRACT).alias("a"), v.conforms(typed, v.CONTRACT).alias("b")).agg(F.count(F.when(F.col("a"), True)).alias("n_given"), F.count(F.when(F.col("b"), True)).alias("n_normalised"), F.count("*").alias("n"))


def _empty(doc: Column) -> dict[str, Column]:
    """Which of the five core fields have nothing in them."""
    period, release = doc["donem"], doc["release"]
    return {
        "donem": period["baslangic"].isNull() & period["bitis"].isNull(), "oda_kontenjanlari": F.size(doc["oda_kontenjanlari"]) == 0, "fiyatlar": F.size(doc["fiyatlar"]) == 0,
        "release": release["gun"].isNull(), "stop_sale": F.size(doc["stop_sale"]) == 0,
    }


def _core(s: SparkSession, p: str) -> DataFrame:
    """A row for each contract and core field: its confidence, whether it is missing, and the finding that follows."""
    from pactline.operators.contracts import note_roots, root_confidence

    empty = _empty(F.col("doc"))
    rows = F.array(*(F.struct(F.lit(k).alias("field"), F.round(root_confidence(F.col("roots"), k), 1).alias("confidence"), F.col(f"no_{k}").alias("empty")) for k in empty))
    noted = _normal(s, p).select("doc_id", note_roots(F.col("notes")).alias("roots"), *(is_empty.alias(f"no_{k}") for k, is_empty in empty.items()))
    each = noted.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    missing = F.col("empty") | (F.col("confidence") == 0.2)
    code = F.when(missing, "KURAL_ZORUNLU_ALAN_EKSIK").when(F.col("confidence") < 0.75, "KURAL_DUSUK_GUVEN")
    return each.select("doc_id", "field", "confidence", F.coalesce("empty", F.lit(False)).alias("empty"), code.alias("code"))


_NOTES = f"""WITH x AS (SELECT {K} AS k FROM orders), e AS (SELECT k, unnest([
  CASE WHEN k % 7 = 0 THEN '01 stop_sale donem içinden üst düzeye taşındı' END, CASE WHEN k % 5 = 0 THEN '02 bilinmeyen alan atıldı: donem.not' END, CASE WHEN k % 6 = 0 THEN '03 zorunlu alan dolduruldu: donem.bitis' END,
  CASE WHEN k % 11 = 0 THEN '04 zorunlu alan dolduruldu: oda_kontenjanlari' END, CASE WHEN k % 8 = 1 THEN '05 release dizi yerine nesne yapıldı' END, CASE WHEN k % 8 = 0 THEN '06 zorunlu alan dolduruldu: release' END,
  CASE WHEN k % 7 = 1 THEN '07 zorunlu alan dolduruldu: stop_sale' END, CASE WHEN k % 4 IN (1, 2) THEN '08 tarih ISO-8601 yapıldı: donem.baslangic' END,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN '09 sayı temizlendi: oda_kontenjanlari[0].adet' WHEN k % 3 = 2 THEN '09 oda_kontenjanlari[0].adet metinden çıkarıldı' END,
  CASE WHEN k % 4 IN (0, 2) THEN '10 sayı temizlendi: fiyatlar[0].tutar' WHEN k % 4 = 3 THEN '10 fiyatlar[0].tutar metinden çıkarıldı' END,
  CASE WHEN k % 3 > 0 THEN '11 enum normalize edildi: fiyatlar[0].birim' END, CASE WHEN k % 5 <> 2 THEN '12 enum normalize edildi: fiyatlar[0].pansiyon' END, CASE WHEN k % 7 = 0 THEN '13 tarih ISO-8601 yapıldı: stop_sale[0].baslangic' END]) AS note FROM x)"""
_ROOMS = f"CASE WHEN {K} % 11 = 0 THEN NULL WHEN {K} % 3 = 2 THEN 0 ELSE o_custkey END"
_RELEASE = f"CASE {K} % 8 WHEN 0 THEN NULL WHEN 1 THEN 14 WHEN 2 THEN -3 ELSE 7 END"
_MESSAGES = f"""WITH x AS (SELECT {K} AS k FROM orders), e AS (SELECT k, unnest([
  CASE WHEN k % 11 = 0 OR k % 8 = 0 OR k % 7 < 2 THEN 'alan=(kök) kisit=required' END, CASE WHEN k % 6 = 0 THEN 'alan=donem kisit=required' END,
  CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'alan=donem kisit=additionalProperties' END, CASE WHEN k % 4 > 0 THEN 'alan=donem/baslangic kisit=format' END, CASE WHEN k % 11 > 0 AND k % 3 <> 1 THEN 'alan=oda_kontenjanlari/0/adet kisit=type' END,
  CASE WHEN k % 4 <> 1 THEN 'alan=fiyatlar/0/tutar kisit=type' END, CASE WHEN k % 3 > 0 THEN 'alan=fiyatlar/0/birim kisit=enum' END, CASE WHEN k % 5 <> 2 THEN 'alan=fiyatlar/0/pansiyon kisit=enum' END,
  CASE WHEN k % 5 = 1 THEN 'alan=fiyatlar/0/pansiyon kisit=type' END, CASE WHEN k % 8 = 1 THEN 'alan=release kisit=type' END, CASE WHEN k % 8 = 2 THEN 'alan=release/gun kisit=minimum' END]) AS m FROM x)"""
_CONFIDENCE = f"""SELECT k AS doc_id, field, CASE WHEN filled THEN 0.2 WHEN touched THEN 0.6 ELSE 0.9 END AS confidence, nothing AS empty, CASE WHEN nothing OR filled THEN 'KURAL_ZORUNLU_ALAN_EKSIK' WHEN touched THEN 'KURAL_DUSUK_GUVEN' END AS code FROM (
  SELECT {K} AS k, 'donem' AS field, {K} % 6 = 0 AS filled, {K} % 5 = 0 OR {K} % 4 IN (1, 2) AS touched, false AS nothing FROM orders
  UNION ALL SELECT {K}, 'oda_kontenjanlari', {K} % 11 = 0, {K} % 3 = 0, {K} % 11 = 0 FROM orders
  UNION ALL SELECT {K}, 'fiyatlar', false, {K} % 4 IN (0, 2) OR {K} % 3 > 0 OR {K} % 5 <> 2, false FROM orders
  UNION ALL SELECT {K}, 'release', {K} % 8 = 0, false, {K} % 8 = 0 FROM orders
  UNION ALL SELECT {K}, 'stop_sale', {K} % 7 = 1, {K} % 7 = 0, {K} % 7 > 0 FROM orders) x"""

QUERIES = {
    "normalize_notes": lambda s, p: _normal(s, p).select("doc_id", F.array_join("notes", "; ").alias("notes")),
    # outer: an inner explode would have its column computed again, in a filter below it
    "normalize_note_counts": lambda s, p: _normal(s, p).select(F.explode_outer("notes").alias("note")).where("note is not null").groupBy("note").agg(F.count("*").alias("n")),
    "normalize_documents": _documents,
    "schema_violations": _checked,
    "schema_conformance": _conforming,
    "core_fields": _core,
}
SQL = {
    "normalize_notes": f"{_NOTES} SELECT k AS doc_id, coalesce(string_agg(substr(note, 4), '; ' ORDER BY note), '') AS notes FROM (SELECT k, note FROM e) y GROUP BY k",
    "normalize_note_counts": f"{_NOTES} SELECT substr(note, 4) AS note, count(*) AS n FROM e WHERE note IS NOT NULL GROUP BY note",
    "normalize_documents": f"""SELECT {K} AS doc_id, CASE WHEN {K} % 4 = 3 THEN 'yakında' ELSE {_ISO} END AS begins, CASE WHEN {K} % 6 > 0 THEN '2030-01-31' END AS ends, CAST({_ROOMS} AS BIGINT) AS rooms,
        CAST(CASE {K} % 4 WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN o_custkey WHEN 2 THEN 1000 + o_custkey % 1000 + 0.25 ELSE 0 END AS DOUBLE) AS amount, CASE WHEN {K} % 3 = 1 THEN 'kisi_gecelik' ELSE 'oda_gecelik' END AS unit,
        CASE {K} % 5 WHEN 0 THEN 'HB' WHEN 2 THEN 'AI' ELSE 'belirtilmemis' END AS board, CAST({_RELEASE} AS BIGINT) AS release_days, CASE WHEN {K} % 7 = 0 THEN '2030-05-01' END AS stop_from, CAST(CASE WHEN {K} % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_stops FROM orders""",
    "schema_violations": f"{_MESSAGES} SELECT k AS doc_id, coalesce(string_agg(m, ';' ORDER BY m), '') AS messages FROM e GROUP BY k",
    "schema_conformance": f"""{_MESSAGES} SELECT (SELECT count(*) FROM (SELECT k FROM e GROUP BY k HAVING count(m) = 0) y) AS n_given,
        (SELECT count(*) FROM orders WHERE {K} % 4 < 3 AND {K} % 6 > 0 AND {K} % 11 > 0 AND {K} % 8 NOT IN (0, 2)) AS n_normalised, (SELECT count(*) FROM orders) AS n""",
    "core_fields": _CONFIDENCE,
}
