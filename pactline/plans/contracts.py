"""Rules, confidence, validation and evaluation: orders stand for contracts, line items for prices and sub-periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import contracts as c
from pactline.sources.tables import load

_DAYS = 30


def contracts(s: SparkSession, p: str) -> DataFrame:
    """A contract of each order: 30 days from its date, or back from it where the status is P; part of the key is the release."""
    o = load(s, p, "orders")
    day = F.to_date("o_orderdate")
    length = F.when(F.col("o_orderstatus") == "P", -_DAYS).otherwise(_DAYS)
    return o.select(F.col("o_orderkey").alias("doc_id"), day.alias("begins"), F.date_add(day, length).alias("ends"), (F.col("o_orderkey") % 120).cast("int").alias("release_days"), (F.col("o_custkey") % 4).cast("int").alias("n_stop_sale"))


def subperiods(s: SparkSession, p: str) -> DataFrame:
    x = load(s, p, "lineitem")
    day = F.to_date("l_shipdate")
    return x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), day.alias("begins"), F.date_add(day, 7).alias("ends"))


def prices(s: SparkSession, p: str) -> DataFrame:
    x = load(s, p, "lineitem")
    return x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit(" Room "), (F.col("l_partkey") % 7).cast("string")).alias("room"))


def rooms(s: SparkSession, p: str) -> DataFrame:
    x = load(s, p, "orders")
    return x.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), (F.col("o_custkey") % 7).cast("int"))).alias("pos")).withColumn("room", F.concat(F.lit("ROOM "), F.col("pos").cast("string")))


def scores(s: SparkSession, p: str) -> DataFrame:
    x = load(s, p, "labels")
    return x.select("doc_id", F.when(F.col("quality") == 0, 0.2).when(F.col("toxic") == 1, 0.6).otherwise(0.9).alias("confidence"), F.lit("donem").alias("path"))


def notes(s: SparkSession, p: str) -> DataFrame:
    """Repair notes of each labelled document."""
    x = load(s, p, "labels")
    filled = F.when(F.col("quality") == 0, F.lit("zorunlu alan dolduruldu: release"))
    touched = F.when(F.col("toxic") == 1, F.lit("tarih ISO-8601 yapıldı: donem.baslangic"))
    odd = F.when(F.col("doc_id") % 5 == 0, F.lit("release dizi yerine nesne"))
    return x.select("doc_id", F.array_compact(F.array(filled, touched, odd)).alias("notes"))


def findings(s: SparkSession, p: str) -> DataFrame:
    k, n = contracts(s, p), prices(s, p)
    parts = [c.date_conflict(k), c.subperiod_overflow(k, subperiods(s, p)), c.price_without_room(n, rooms(s, p)), c.stop_sale_missing(k), c.release_unreasonable(k)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _orders_checked(s: SparkSession, p: str) -> DataFrame:
    x = load(s, p, "lineitem")
    broken = c.violations(x, [
        ("l_quantity", "maximum", F.col("l_quantity") > 45),
        ("l_discount", "minimum", F.col("l_discount") < 0.02),
        ("l_returnflag", "enum", ~F.col("l_returnflag").isin("A", "N")),
        ("l_tax", "required", F.col("l_tax").isNull()),
    ])
    return x.select("l_orderkey", "l_linenumber", F.array_join(broken, ";").alias("messages"), F.size(broken).alias("n"))


def _source_pages(s: SparkSession, p: str) -> DataFrame:
    """Pages: the documents of a source in order; needles: the whole test items."""
    d = load(s, p, "documents").withColumn("source", F.substring("source", 4, 4).cast("long"))
    pages = d.select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page"), "text")
    needles = load(s, p, "benchmark").select(F.col("text").alias("needle"))
    return c.source_page(pages, needles)


def _missing(s: SparkSession, p: str) -> DataFrame:
    d, x = load(s, p, "documents").select("doc_id", "lang", "n_chars"), load(s, p, "labels")
    missing = F.array_compact(F.array(F.when(F.col("quality").isNull(), "quality"), F.when(F.col("n_chars") < 200, "text"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "toxic")))
    return d.join(x, "doc_id", "left").select("doc_id", F.array_join(missing, ",").alias("missing"))


def _accuracy(s: SparkSession, p: str) -> DataFrame:
    """The labels against a guess from the text's length and language."""
    d = load(s, p, "documents").select("doc_id", "lang", "n_chars").join(load(s, p, "labels"), "doc_id")
    d = d.withColumn("guess_quality", (F.col("n_chars") > 400).cast("int")).withColumn("guess_toxic", F.when(F.col("lang") != "es", 0))
    return d.agg(F.count("*").alias("n"), *(F.round(a, 9).alias(n) for a, n in zip(c.accuracy(d, [("quality", "quality", "guess_quality"), ("toxic", "toxic", "guess_toxic")]), ("quality", "toxic"))))


def _tags(s: SparkSession, p: str) -> DataFrame:
    """How many documents have each kind of noise; those without one count under (yok)."""
    d = load(s, p, "documents")
    tags = F.array_compact(F.array(F.when(F.col("text").contains("@"), "eposta"), F.when(F.col("text").contains("|"), "tablo"), F.when(F.col("text").contains("!!"), "bagiran")))
    return d.select(F.explode_outer(tags).alias("tag")).groupBy(F.coalesce("tag", F.lit("(yok)")).alias("tag")).agg(F.count("*").alias("n"))


QUERIES = {
    "date_conflict": lambda s, p: c.date_conflict(contracts(s, p)).select("doc_id", "code", "severity"),
    "subperiod_overflow": lambda s, p: c.subperiod_overflow(contracts(s, p), subperiods(s, p)).select("doc_id", "path"),
    "price_allotment_mismatch": lambda s, p: c.price_without_room(prices(s, p), rooms(s, p)).select("doc_id", "path"),
    "missing_stop_sale": lambda s, p: c.stop_sale_missing(contracts(s, p)).select("doc_id", "code"),
    "release_unreasonable": lambda s, p: c.release_unreasonable(contracts(s, p)).select("doc_id", "code"),
    "low_confidence": lambda s, p: c.low_confidence(scores(s, p)).select("doc_id", "path"),
    "findings_ranked": lambda s, p: c.ranked(findings(s, p)).select("doc_id", "code", "path", "rank"),
    "worst_severity_rollup": lambda s, p: c.worst(findings(s, p)),
    "missing_required": _missing,
    "confidence_from_notes": lambda s, p: notes(s, p).select("doc_id", c.confidence(F.col("notes"), "donem").alias("donem"), c.confidence(F.col("notes"), "release").alias("release")),
    "validate_constraints": _orders_checked,
    "dataset_validation": lambda s, p: _orders_checked(s, p).groupBy((F.col("l_orderkey") % 10).alias("part")).agg(F.count("*").alias("n_rows"), F.sum("n").alias("errors"), F.count_if(F.col("n") == 0).alias("n_valid")),
    "source_page_first": _source_pages,
    "field_accuracy": _accuracy,
    "dataset_stats": lambda s, p: load(s, p, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg((F.col("n_chars") >= 1000).cast("int")), 9).alias("long_share")),
    "noise_multilabel": _tags,
    "group_max_min_special": lambda s, p: load(s, p, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("least_returned")),
    "dedupe_first": lambda s, p: load(s, p, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("x")).select("l_orderkey", "l_returnflag", "l_linestatus", F.col("x.l_linenumber").alias("l_linenumber"), F.col("x.l_partkey").alias("l_partkey")),
    "infer_unique_currency": lambda s, p: load(s, p, "part").select("p_partkey", _only_one(["small", "ring", "red", "widget"], F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("currency")),
}


def _only_one(tokens: list[str], text):
    """The token that a text has if it has exactly one of them."""
    found = F.array_compact(F.array(*(F.when(text.contains(t), t) for t in tokens)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


_C = "contracts AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS begins, CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN -30 ELSE 30 END AS ends, o_orderkey % 120 AS release_days, o_custkey % 4 AS n_stop_sale FROM orders)"
_F = f"""{_C}, prices AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 7 AS room FROM lineitem),
  findings AS (
    SELECT doc_id, 'KURAL_TARIH_CELISKISI' AS code, 0 AS severity, 'donem' AS path FROM contracts WHERE ends < begins
    UNION ALL SELECT c.doc_id, 'KURAL_ALT_DONEM_TASMA', 1, 'donem.alt_donemler[' || l_linenumber || ']' FROM lineitem JOIN contracts c ON c.doc_id = l_orderkey WHERE CAST(l_shipdate AS DATE) < begins OR CAST(l_shipdate AS DATE) + 7 > ends
    UNION ALL SELECT doc_id, 'KURAL_FIYAT_KONTENJAN_UYUSMAZLIGI', 0, 'fiyatlar[' || min(pos) || ']' FROM prices JOIN orders ON o_orderkey = doc_id WHERE room > o_custkey % 7 GROUP BY doc_id, room
    UNION ALL SELECT doc_id, 'KURAL_STOP_SALE_YOK', 1, 'stop_sale' FROM contracts WHERE n_stop_sale = 0
    UNION ALL SELECT doc_id, 'KURAL_RELEASE_MAKUL_DEGIL', 1, 'release' FROM contracts WHERE release_days = 0 OR release_days > 90)"""
_V = """checked AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 45 THEN 'alan=l_quantity kisit=maximum' END, CASE WHEN l_discount < 0.02 THEN 'alan=l_discount kisit=minimum' END,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'alan=l_returnflag kisit=enum' END, CASE WHEN l_tax IS NULL THEN 'alan=l_tax kisit=required' END], lambda x: x IS NOT NULL) AS m FROM lineitem)"""
SQL = {
    "date_conflict": f"WITH {_C} SELECT doc_id, 'KURAL_TARIH_CELISKISI' AS code, 'KRITIK' AS severity FROM contracts WHERE ends < begins",
    "subperiod_overflow": f"WITH {_F} SELECT doc_id, path FROM findings WHERE code = 'KURAL_ALT_DONEM_TASMA'",
    "price_allotment_mismatch": f"WITH {_F} SELECT doc_id, path FROM findings WHERE code = 'KURAL_FIYAT_KONTENJAN_UYUSMAZLIGI'",
    "missing_stop_sale": f"WITH {_F} SELECT doc_id, code FROM findings WHERE code = 'KURAL_STOP_SALE_YOK'",
    "release_unreasonable": f"WITH {_F} SELECT doc_id, code FROM findings WHERE code = 'KURAL_RELEASE_MAKUL_DEGIL'",
    "low_confidence": "SELECT doc_id, 'donem' AS path FROM labels WHERE quality = 0 OR toxic = 1",
    "findings_ranked": f"WITH {_F} SELECT doc_id, code, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity, code, path) AS INTEGER) AS rank FROM findings",
    "worst_severity_rollup": f"WITH {_F} SELECT doc_id, count(*) AS n, CASE min(severity) WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'muted' END AS tone FROM findings GROUP BY doc_id",
    "missing_required": "SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN n_chars < 200 THEN 'text' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS missing FROM documents LEFT JOIN labels USING (doc_id)",
    "confidence_from_notes": "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS donem, CASE WHEN quality = 0 THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END AS release FROM labels",
    "validate_constraints": f"WITH {_V} SELECT l_orderkey, l_linenumber, coalesce(array_to_string(m, ';'), '') AS messages, CAST(len(m) AS INTEGER) AS n FROM checked",
    "dataset_validation": f"WITH {_V} SELECT l_orderkey % 10 AS part, count(*) AS n_rows, CAST(sum(len(m)) AS BIGINT) AS errors, count(*) FILTER (len(m) = 0) AS n_valid FROM checked GROUP BY part",
    "source_page_first": r"SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, min(d.doc_id) + 1 AS page FROM documents d JOIN (SELECT text AS needle FROM benchmark) b ON contains(lower(d.text), lower(b.needle)) WHERE length(regexp_replace(needle, '\s', '', 'g')) >= 3 GROUP BY source",
    "field_accuracy": "SELECT count(*) AS n, round(avg(CAST(quality IS NOT DISTINCT FROM CAST(n_chars > 400 AS INTEGER) AS INTEGER)), 9) AS quality, round(avg(CAST(toxic IS NOT DISTINCT FROM CASE WHEN lang <> 'es' THEN 0 END AS INTEGER)), 9) AS toxic FROM documents JOIN labels USING (doc_id)",
    "dataset_stats": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CAST(n_chars >= 1000 AS INTEGER)), 9) AS long_share FROM documents GROUP BY lang, source",
    "noise_multilabel": "WITH t AS (SELECT list_filter([CASE WHEN contains(text, '@') THEN 'eposta' END, CASE WHEN contains(text, '|') THEN 'tablo' END, CASE WHEN contains(text, '!!') THEN 'bagiran' END], lambda x: x IS NOT NULL) AS tags FROM documents) SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN len(tags) = 0 THEN ['(yok)'] ELSE tags END) AS tag FROM t) GROUP BY tag",
    "group_max_min_special": "SELECT l_orderkey, max(l_quantity) AS most, min(l_quantity) FILTER (l_returnflag = 'R') AS least_returned FROM lineitem GROUP BY l_orderkey",
    "dedupe_first": "SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) = 1",
    "infer_unique_currency": "WITH t AS (SELECT p_partkey, list_filter(list_transform(['small', 'ring', 'red', 'widget'], lambda w: CASE WHEN contains(lower(concat_ws(' ', p_type, p_name)), w) THEN w END), lambda x: x IS NOT NULL) AS f FROM part) SELECT p_partkey, CASE WHEN len(f) = 1 THEN f[1] END AS currency FROM t",
}
