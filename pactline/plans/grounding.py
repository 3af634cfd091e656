"""Extracted values held against contract texts; each order has a text and values that its key decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions import grounding as g
from pactline.functions.bind import spread
from pactline.sources.tables import load

K, N = "o_orderkey", "CAST(o_custkey AS STRING)"
_NL = "' || chr(10) || '"
#: SQL, the same for both engines: a contract's text
_TEXT = f"""'HİZMET SÖZLEŞMESİ{_NL}' || CASE {K} % 3 WHEN 0 THEN 'Taraflar: Acme Tur ' || {N} || ' (Acente) — Deniz Otel A.Ş. (Otel)' WHEN 1 THEN 'Mavi Tur ile Kum Otel ' || {N} || ' arasında' ELSE 'taraflar ekte' END ||
  '{_NL}Madde 2 oda kontenjanları ve tahsis edilen oda sayıları şöyledir:{_NL}standart: ' || {N} || '{_NL}Madde 4 oda fiyatları gecelik olarak aşağıdaki tabloda verilmiştir:{_NL}Junior Suite ' || {N} || ' gece{_NL}Family room 90,50{_NL}açıklama 7{_NL}Madde 5 ödeme' ||
  CASE {K} % 4 WHEN 0 THEN ' EUR ile yapılır' WHEN 1 THEN ' 5 TL ve pound ile' WHEN 2 THEN ' türk lirası ile' ELSE ' nakit' END ||
  CASE {K} % 5 WHEN 0 THEN '. TCMB kuru, giriş günü' WHEN 1 THEN '. TCMB kuru, çıkış günü' WHEN 2 THEN '. Sabit kur' ELSE '' END ||
  CASE {K} % 6 WHEN 0 THEN '. Stop-sale 5.7.2026 ve 10/07/2026' WHEN 1 THEN '. Stop sale 2026-07-05' ELSE '. 05.07.2026' END ||
  CASE {K} % 7 WHEN 0 THEN '. yaz sezonu, tamamen garantili' WHEN 1 THEN '. kış sezonu' ELSE '. free sale' END || '. antalya mahkemeleri yetkilidir.'"""


def texts(s: SparkSession, p: str) -> DataFrame:
    return spread(load(s, p, "orders").select(K, "o_custkey"), K).selectExpr(K, "o_custkey", f"{_TEXT} AS text")


def _meta(s: SparkSession, p: str) -> DataFrame:
    """Values that a model gave, the same for each contract, and what its text leaves of them."""
    given = {"otel_adi": F.lit("deniz otel AŞ"), "acente_adi": F.lit("Uydurma Tur"), "para_birimi": F.lit(" eur "), "kur_esasi": F.lit("giris-gunu tcmb"), "yetkili_mahkeme": F.lit("Antalya mahkemeleri"), "sozlesme_tipi": F.lit("Serbest Satis"), "sezon": F.lit("yaz")}
    return texts(s, p).select(K, g.told(F.col("text")).alias("told")).select(K, *(v.alias(k) for k, v in g.meta(given, F.col("told")).items()))


def _stops(s: SparkSession, p: str) -> DataFrame:
    row = lambda a, b, c: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("scope"))
    rows = F.array(row("2026-07-05", "2026-07-10", "ALL_ROOMS"), row("2026-07-05", "", "Junior Suite"), row("", " ", "x"), row("2026-08-01", None, "teras"))
    kept = texts(s, p).select(K, F.explode(g.stop_sales(rows, F.col("text"))).alias("x"))
    return kept.select(K, "x.start", F.col("x.end").alias("till"), "x.scope")


def _prices(s: SparkSession, p: str) -> DataFrame:
    return texts(s, p).select(K, F.explode(g.priced_lines(F.col("text"))).alias("x")).select(K, "x.room", "x.amount")


def _sections(s: SparkSession, p: str) -> DataFrame:
    t = F.col("text")
    return texts(s, p).select(K, F.md5(g.price_section(t)).alias("prices"), F.md5(g.allotment_section(t)).alias("rooms"))


#: fixed values: names of rooms, units and boards as models give them, and what they stand for
ROOMS = (("Junior_Suite", "suit"), (" NORMAL  ODA ", "standart"), ("Balayı Odası", "balayi"), ("teras", ""), ("ozurlu oda", "engelli"), ("family", "aile"), ("deluxe deniz manzaralı", "deluxe"))
UNITS = (("per-room", "", "oda_gecelik"), ("kisi başı", "", "kisi_gecelik"), ("kisi_gecelik", "oda_gecelik", "oda_gecelik"), ("x", "", "oda_gecelik"))
BOARDS = (("ro", "AI", "AI"), ("HB", "AI", "HB"), ("Her şey dahil", "", "AI"), ("", "BB", "BB"), ("null", "", "belirtilmemis"), ("bed and breakfast", "AI", "BB"))
LINES = (("junior suite 65,00", "suit"), ("penthouse suite", "suit"), ("iki kişilik oda", "standart"), ("honeymoon suite", "balayi"), ("toplam", ""), ("özürlü standart", "engelli"))


def _cases(rows: tuple, column, names: str):
    """Each order takes one of the cases; the value is computed for the order, not for the case."""

    def run(s: SparkSession, p: str) -> DataFrame:
        table = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, names.split()))) for row in rows))
        given = load(s, p, "orders").select(K, F.get(table, (F.col(K) % len(rows)).cast("int")).alias("x")).select(K, "x.*")
        return given.select(K, column(*(F.col(n) for n in names.split()[:-1])).alias("value"))

    wanted = " ".join(f"WHEN {k} THEN '{row[-1]}'" for k, row in enumerate(rows))
    return run, f"SELECT {K}, CASE {K} % {len(rows)} {wanted} END AS value FROM orders"


_CASES = {
    "room_type": _cases(ROOMS, g.room_type, "raw want"), "rate_line_type": _cases(LINES, g.rate_line_type, "raw want"),
    "price_unit": _cases(UNITS, g.unit, "raw stated want"), "price_board": _cases(BOARDS, g.board, "raw stated want"),
}


def _sub_periods(s: SparkSession, p: str) -> DataFrame:
    """Line items as sub-periods of their order; one without an end takes all with it."""
    x = load(s, p, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("name"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("start"), F.when(F.col("l_quantity") < 48, F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")).alias("end")).alias("x"))
    return x.groupBy("l_orderkey").agg(F.size(g.sub_periods(F.collect_list("x"))).cast("long").alias("n"))


def _expanded(s: SparkSession, p: str) -> DataFrame:
    """Training rows: each contract gives one whole and four part examples."""
    parts = F.array(*map(F.lit, ("FULL", "A", "B", "C", "D")))
    return texts(s, p).select(K, F.explode(parts).alias("part"), F.length("text").cast("long").alias("chars"))


_PRICE_SECTION = f"substr(low, strpos(low, 'oda fiyat'), strpos(low, 'madde 5') - strpos(low, 'oda fiyat'))"
_ROOM_SECTION = f"substr(low, strpos(low, 'madde 2'), strpos(low, 'madde 4') - strpos(low, 'madde 2'))"
QUERIES = {
    "grounded_meta": _meta, "grounded_stop_sale": _stops, "grounded_price_lines": _prices, "contract_sections": _sections, "whole_sub_periods": _sub_periods, "training_expansion": _expanded,
    **{f"grounded_{k}": run for k, (run, _) in _CASES.items()},
}
SQL = {
    "grounded_meta": f"""SELECT {K}, CASE {K} % 3 WHEN 0 THEN 'deniz otel AŞ' WHEN 1 THEN 'Kum Otel ' || {N} END AS otel_adi, CASE {K} % 3 WHEN 0 THEN 'Acme Tur ' || {N} WHEN 1 THEN 'Mavi Tur' END AS acente_adi,
        CASE {K} % 4 WHEN 0 THEN 'EUR' WHEN 2 THEN 'TRY' END AS para_birimi, CASE {K} % 5 WHEN 0 THEN 'giris_gunu_tcmb' WHEN 1 THEN 'cikis_gunu_tcmb' WHEN 2 THEN 'sabit_kur' END AS kur_esasi, 'Antalya' AS yetkili_mahkeme,
        CASE WHEN {K} % 7 > 1 THEN 'serbest_satis' END AS sozlesme_tipi, CASE WHEN {K} % 7 = 0 THEN 'yaz' END AS sezon FROM orders""",
    "grounded_stop_sale": f"SELECT {K}, '2026-07-05' AS start, '2026-07-10' AS till, 'tüm oda tipleri' AS scope FROM orders WHERE {K} % 6 = 0 UNION ALL SELECT {K}, '2026-07-05', NULL, 'suit' FROM orders WHERE {K} % 6 < 2",
    "grounded_price_lines": f"SELECT {K}, 'suit' AS room, CAST(o_custkey AS DOUBLE) AS amount FROM orders WHERE o_custkey > 0 UNION ALL SELECT {K}, 'aile', CAST(90 AS DOUBLE) FROM orders",
    "contract_sections": f"SELECT {K}, md5({_PRICE_SECTION}) AS prices, md5({_ROOM_SECTION}) AS rooms FROM (SELECT {K}, lower(replace({_TEXT}, 'İ', 'i')) AS low FROM orders) x",
    "whole_sub_periods": "SELECT l_orderkey, CASE WHEN max(l_quantity) >= 48 THEN CAST(0 AS BIGINT) ELSE count(*) END AS n FROM lineitem GROUP BY l_orderkey",
    "training_expansion": f"SELECT {K}, part, CAST(length({_TEXT}) AS BIGINT) AS chars FROM orders CROSS JOIN (VALUES ('FULL'), ('A'), ('B'), ('C'), ('D')) v(part)",
    **{f"grounded_{k}": sql for k, (_, sql) in _CASES.items()},
}
