"""Edits of contracts by path: what becomes of each edit, of the contracts, of their findings and audit trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import contracts as c
from pactline.operators import field_update as u
from pactline.operators import normalize as n
from pactline.plans import tree
from pactline.sources.tables import load

#: SQL, the same for both engines: the path that a line item edits, and the value, which may be wrong for it
_PATH = "CASE l_partkey % 9 WHEN 0 THEN 'meta.otelAdi' WHEN 1 THEN ' donem.baslangic ' WHEN 2 THEN 'donem' WHEN 3 THEN 'oda_kontenjanlari' WHEN 4 THEN 'release' WHEN 5 THEN 'meta.sezon' WHEN 6 THEN 'meta.otel' WHEN 7 THEN 'stopSale' ELSE 'meta.otel_adi' END"
_VALUE = """CASE l_partkey % 9 WHEN 0 THEN '" Otel ' || CAST(l_suppkey AS STRING) || '"' WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN '5' ELSE '"2031-01-' || CAST(10 + l_suppkey % 20 AS STRING) || '"' END
  WHEN 2 THEN CASE l_suppkey % 3 WHEN 0 THEN '"2031-02-01 – 2031-03-01"' WHEN 1 THEN '{"start": "2031-02-02", "bitis": ""}' ELSE '"şubat"' END
  WHEN 3 THEN CASE l_suppkey % 3 WHEN 0 THEN '"suit: 5' || chr(92) || 'naile: 7 (not)"' WHEN 1 THEN '[{"odaTipi": "suit", "adet": 3}, {"adet": 1}, 4]' ELSE '"suit beş"' END
  WHEN 4 THEN CASE l_suppkey % 3 WHEN 0 THEN '"14 gün · HER_IKISI"' WHEN 1 THEN '{"gun": 121}' ELSE '"yakında"' END WHEN 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN '"YAZ"' ELSE '"bahar"' END WHEN 7 THEN '[]' ELSE 'null' END"""
_SEQ = "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000"


def _contracts(s: SparkSession, p: str) -> DataFrame:
    status = load(s, p, "orders").selectExpr("o_orderkey AS doc_id", "CASE WHEN o_orderstatus = 'P' THEN 'ONAYLANDI' ELSE 'INCELENMEYI_BEKLIYOR' END AS status")
    mark = lambda path, score: F.struct(F.lit(path).alias("path"), F.lit(score).alias("confidence"), F.lit(False).alias("manual"))
    return tree._normal(s, p).select("doc_id", "doc").join(status, "doc_id").select("doc_id", "status", "doc", F.array(mark("donem", 0.6), mark("release", 0.9)).alias("provenance"))


def _judged(s: SparkSession, p: str) -> DataFrame:
    edits = load(s, p, "lineitem").selectExpr("l_orderkey AS doc_id", f"CAST({_SEQ} AS BIGINT) AS seq", f"{_PATH} AS path", f"try_parse_json({_VALUE}) AS value")
    return u.judged(_contracts(s, p), edits)


def _applied(s: SparkSession, p: str) -> DataFrame:
    return u.applied(_contracts(s, p), _judged(s, p))


def _shown(s: SparkSession, p: str) -> DataFrame:
    doc = F.col("doc")
    marks = F.array_join(F.array_sort(F.transform("provenance", lambda m: F.concat_ws(" ", m["path"], m["confidence"].cast("string"), m["manual"].cast("string")))), ",")
    return _applied(s, p).select("doc_id", doc["meta"]["otel_adi"].alias("hotel"), doc["meta"]["sezon"].alias("season"), F.get(doc["oda_kontenjanlari"], 0)["oda_tipi"].alias("room"), doc["donem"]["bitis"].alias("ends"), doc["release"]["gun"].cast("bigint").alias("release_days"), doc["release"]["kapsam"].alias("scope"), marks.alias("marks"), "changed")


def _findings(df: DataFrame) -> DataFrame:
    return c.release_unreasonable(df.select("doc_id", F.col("doc.release.gun").alias("release_days")), 90)


def _audited(s: SparkSession, p: str) -> DataFrame:
    """Findings on release days: an old one on each third contract, and new ones on those that were edited."""
    old = load(s, p, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS doc_id", "'ESKI' AS code", "'BILGI' AS severity", "'KURAL' AS source", "'release' AS path")
    return u.audited_again(old, _applied(s, p), _findings).select("doc_id", "code")


def _trees(s: SparkSession, p: str) -> DataFrame:
    """Each contract's audit tree, normalised again, gives the contract."""
    none = F.array().cast("array<struct<path:string,confidence:double,manual:boolean>>")
    trees = tree._normal(s, p).select("doc_id", u.audit_tree(F.col("doc"), none).alias("contract"))
    return tree.typed(n.normalized(trees, "contract"))


def _whole(s: SparkSession, p: str) -> DataFrame:
    """Every second order is sent whole: some without notes, name or status, which then stay."""
    lists = F.split(F.repeat(F.lit("n,"), (F.col("o_custkey") % 3).cast("int")), ",")
    stored = load(s, p, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("CASE WHEN o_orderstatus = 'P' THEN 'ONAYLANDI' ELSE 'HATA' END").alias("status"), F.lit("eski.pdf").alias("file"), F.array(F.lit("a"), F.lit("b")).alias("notes"), F.col("o_custkey").alias("owner"))
    new = load(s, p, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 4 == 0, "").otherwise("INCELENMEYI_BEKLIYOR").alias("status"), F.when(F.col("o_custkey") % 5 == 0, None).otherwise("yeni.pdf").alias("file"), F.filter(lists, lambda x: x != "").alias("notes"), F.lit(0).cast("bigint").alias("owner"))
    out = u.replaced_whole(stored, new, ["status", "file", "notes"], ["owner"])
    return out.select("doc_id", "status", "file", F.size("notes").cast("bigint").alias("n_notes"), "owner", "outcome")


_EDITS = f"""e AS (SELECT l_orderkey AS doc_id, {_SEQ} AS seq, l_partkey % 9 AS k, l_suppkey AS x, CASE WHEN o_orderstatus = 'P' THEN 'onayli' WHEN l_partkey % 9 = 6 THEN 'bilinmeyen_alan'
    WHEN (l_partkey % 9 = 1 AND l_suppkey % 4 = 0) OR (l_partkey % 9 IN (2, 3, 4) AND l_suppkey % 3 = 2) OR (l_partkey % 9 = 5 AND l_suppkey % 2 = 1) THEN 'gecersiz_deger' ELSE 'yazildi' END AS outcome
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  w AS (SELECT doc_id, arg_max({{v: CASE WHEN k = 0 THEN 'Otel ' || x END}}, seq) FILTER (k IN (0, 8)) AS hotel, arg_max('yaz', seq) FILTER (k = 5) AS season, arg_max('suit', seq) FILTER (k = 3) AS room,
    arg_max({{v: CASE WHEN x % 3 = 0 THEN '2031-03-01' END}}, seq) FILTER (k = 2) AS ends, arg_max(CASE WHEN x % 3 = 0 THEN 14 ELSE 121 END, seq) FILTER (k = 4) AS days, arg_max({{v: CASE WHEN x % 3 = 0 THEN 'her_ikisi' END}}, seq) FILTER (k = 4) AS scope,
    list(DISTINCT CASE k WHEN 0 THEN 'meta.otelAdi' WHEN 8 THEN 'meta.otelAdi' WHEN 1 THEN 'donem.baslangic' WHEN 2 THEN 'donem' WHEN 3 THEN 'odaKontenjanlari' WHEN 4 THEN 'release' WHEN 5 THEN 'meta.sezon' ELSE 'stopSale' END) AS paths
    FROM e WHERE outcome = 'yazildi' GROUP BY doc_id)"""
_K, _DAYS = "o_orderkey", "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 14 WHEN 2 THEN -3 ELSE 7 END"
_EDITED = f"""WITH {_EDITS}, d AS (SELECT o_orderkey AS doc_id, CASE WHEN {_K} % 11 = 0 OR {_K} % 3 IS NULL THEN NULL ELSE 'standart' END AS room, CASE WHEN {_K} % 6 = 0 THEN NULL ELSE '2030-01-31' END AS ends, {_DAYS} AS days FROM orders)
  SELECT doc_id, hotel.v AS hotel, season, coalesce(w.room, d.room) AS room, CASE WHEN w.ends IS NULL THEN d.ends ELSE w.ends.v END AS ends, coalesce(w.days, d.days)::BIGINT AS release_days, scope.v AS scope,
    array_to_string(list_sort(list_concat(list_transform(coalesce(paths, []), lambda q: q || ' 1.0 true'), list_filter(['donem 0.6 false', 'release 0.9 false'], lambda m: NOT list_contains(coalesce(paths, []), split_part(m, ' ', 1))))), ',') AS marks, w.doc_id IS NOT NULL AS changed
  FROM d LEFT JOIN w USING (doc_id)"""

QUERIES = {
    "field_edits": lambda s, p: _judged(s, p).select("doc_id", "seq", "outcome"), "edited_contracts": _shown, "audited_again": _audited, "audit_trees": _trees, "contracts_replaced": _whole,
}
SQL = {
    "field_edits": f"WITH {_EDITS} SELECT doc_id, seq, outcome FROM e",
    "edited_contracts": _EDITED,
    "audited_again": f"WITH x AS ({_EDITED}) SELECT doc_id, 'ESKI' AS code FROM x WHERE NOT changed AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'KURAL_RELEASE_MAKUL_DEGIL' FROM x WHERE changed AND (release_days = 0 OR release_days > 90)",
    "audit_trees": f"SELECT * REPLACE (coalesce(board, CASE WHEN amount IS NOT NULL THEN 'belirtilmemis' END) AS board) FROM ({tree.SQL['normalize_documents']}) z",
    "contracts_replaced": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'ONAYLANDI' WHEN o_orderkey % 2 = 0 AND o_custkey % 4 > 0 THEN 'INCELENMEYI_BEKLIYOR' ELSE 'HATA' END AS status, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND o_custkey % 5 > 0 THEN 'yeni.pdf' ELSE 'eski.pdf' END AS file, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND o_custkey % 3 > 0 THEN o_custkey % 3 ELSE 2 END AS n_notes, o_custkey AS owner, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'onayli' ELSE 'yazildi' END END AS outcome FROM orders",
}
