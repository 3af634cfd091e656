"""Answers in parts: what is left of each, which attempt counts, and the tree they give."""

import json

from pyspark.sql import functions as F

from pactline.functions import grounding, text
from pactline.operators import parts

TEXT = """Taraflar: Acme Tur (Acente) — Deniz Otel (Otel)
Madde 2 oda kontenjanları ve tahsis edilen oda sayıları şöyledir:
standart: 240
suit 12
Madde 4 oda fiyatları gecelik olarak aşağıdaki tabloda verilmiştir:
Family room 90
Madde 5 ödeme EUR ile yapılır. Kahvaltı: bb. Stop-sale 2026-07-05."""
A = '{"donem": {"baslangic": "2026-05-01", "bitis": "2026-04-01", "x": 1}, "alt_donemler": [{"alt_donem_ad": "yaz", "baslangic": "a", "bitis": "b"}], "oda_kontenjanlari": [{"oda_tipi": "Standard", "adet": "240"}, 5]}'
B = '{"fiyatlar": [{"oda_tipi": "suite", "tutar": 65, "pansiyon": "RO"}, {"oda_tipi": "suit", "tutar": "65", "alt_donem_ad": "NULL"}, {"oda_tipi": "teras", "tutar": 1}, {"oda_tipi": "suit"}, 3, {"oda_tipi": "aile", "tutar": 90.5, "pansiyon": "hb", "alt_donem_ad": " yaz "}]}'
C = '{"release": [{"gun": 7}], "stop_sale": [{"baslangic": "2026-07-05"}, {"baslangic": "2026-08-05"}, null]}'
D = '{"otel_adi": "Deniz Otel", "acente_adi": "Uydurma"}'
WANT = {
    "donem": {"baslangic": "2026-05-01", "bitis": "2026-04-01", "alt_donemler": [{"ad": "yaz", "baslangic": "a", "bitis": "b"}]},
    "oda_kontenjanlari": [{"oda_tipi": "standart", "adet": 240}, {"oda_tipi": "suit", "adet": 12}],
    "fiyatlar": [
        {"oda_tipi": "suit", "tutar": 65, "birim": "oda_gecelik", "pansiyon": "BB"},
        {"oda_tipi": "aile", "tutar": 90.5, "birim": "oda_gecelik", "pansiyon": "HB", "alt_donem_ad": "yaz"},
        {"oda_tipi": "aile", "tutar": 90, "birim": "oda_gecelik", "pansiyon": "BB"},
    ],
    "release": {"gun": 7},
    "stop_sale": [{"baslangic": "2026-07-05"}],
    "meta": {"otel_adi": "Deniz Otel", "acente_adi": "Acme Tur", "para_birimi": "EUR"},
}


def run(spark, contracts, answers):
    a = spark.createDataFrame(answers, "doc_id long, part string, attempt int, answer string").withColumn("text", F.lit("clash"))
    return {r.doc_id: (json.loads(r.contract), r.parts, r.retries) for r in parts.answered(spark.createDataFrame(contracts, "doc_id long, text string"), a).collect()}


def test_answered(spark):
    got = run(spark, [(1, TEXT), (2, TEXT), (3, TEXT), (4, None), (5, "")], [
        (1, "A", 0, A), (1, "B", 0, B), (1, "C", 0, C), (1, "D", 0, D),
        (2, "B", 0, "bozuk"), (2, "B", 1, B), (2, "B", 2, "{}"), (2, "C", 0, '{"release": []}'), (2, "C", 1, None), (2, "E", 0, A), (2, "C", 2, C),
        (3, "A", 0, '{"donem": {}}'), (3, "C", 0, '{"release": {}}'), (3, "C", 1, C), (3, "B", 0, '{"fiyatlar": {"oda_tipi": "suit"}}'), (3, None, 0, A),
        (4, "A", 0, A), (4, "B", 0, B), (4, "C", 0, C), (4, "D", 0, D), (5, "A", 0, A), (None, "A", 0, A), (9, "A", 0, A),
    ])
    assert got[1] == (WANT, "ABCD", 0)
    assert got[2] == ({"fiyatlar": WANT["fiyatlar"]}, "B", 1)
    assert got[3] == ({"release": {}, "stop_sale": []}, "C", 0)
    assert got[4][1] == "ABC" and got[4][0]["stop_sale"] == [] and [x["pansiyon"] for x in got[4][0]["fiyatlar"]] == ["RO", "belirtilmemis", "HB"]
    assert got[5][0]["oda_kontenjanlari"] == [{"oda_tipi": "standart", "adet": 240}]
    assert set(got) == {1, 2, 3, 4, 5}


def test_empty_and_repeated(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, TEXT)], []) == {1: ({}, "", 0)}
    assert run(spark, [(1, TEXT)], [(1, "A", 0, A)] * 3)[1][0]["oda_kontenjanlari"] == WANT["oda_kontenjanlari"]


def test_sub_periods_are_all_or_none(spark):
    cases = [('[{"ad":"x","baslangic":"a","bitis":"b"},7]', 0), ('[{"ad":"","alt_donem_ad":"y","baslangic":"a","bitis":"b"}]', 1), ('[{"ad":"x","baslangic":"a","bitis":""}]', 0), ("{}", 0), ("[]", 0), (None, 0)]
    got = spark.createDataFrame(cases, "j string, n int").select("n", F.size(parts.sub_periods(F.parse_json("j"))).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_stated(spark):
    cases = [("fiyatlar kişi başı, bb", "kisi_gecelik", "BB"), ("Hepsi AI!", "oda_gecelik", "AI"), ("maid abba", "oda_gecelik", ""), ("iyi kahvaltı ve all inclusive", "oda_gecelik", "AI"), (None, "oda_gecelik", "")]
    got = spark.createDataFrame(cases, "t string, u string, b string").select("u", "b", grounding.stated_unit(F.col("t")).alias("x"), grounding.stated_board(F.col("t")).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(r.u, r.b) for r in got]


def test_training_targets(spark):
    cases = ['{"donem":{"bitis":"x"},"oda_kontenjanlari":[{"oda_tipi":"suit","adet":3,"aciklama":"k"},4],"meta":{"sezon":"belirtilmemis","otel_adi":"O","acente_adi":"","x":null}}', "{}"]
    rows = spark.createDataFrame([(c,) for c in cases], "j string").select(F.explode(parts.training_targets(F.parse_json("j"))).alias("x")).select("x.*").collect()
    got = [json.loads(r.target) for r in rows]
    assert [r.part for r in rows] == ["FULL", "A", "B", "C", "D"] * 2
    assert got[0] == json.loads(cases[0]) and got[1] == {"donem": {"bitis": "x"}, "oda_kontenjanlari": [{"oda_tipi": "suit", "adet": 3}]} and got[2] == {"fiyatlar": []}
    assert got[3] == {"release": {"gun": None, "kapsam": "belirtilmemis"}, "stop_sale": []} and got[4] == {"meta": {"otel_adi": "O"}}
    assert got[9] == {"meta": {}}


def test_slug(spark):
    cases = [("  Tarih: çelişki! ", "TARIH_ÇELIŞKI"), ("--", ""), ("a-" * 60, "_".join("A" * 40)), ("x" * 50, "X" * 40), (None, None)]
    got = spark.createDataFrame(cases, "t string, want string").select("want", text.slug(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_answers_are_dealt_to_all_cores_and_texts_lowered_once(spark):
    from pactline.functions import bind
    from pactline.plans import parts as plans

    least = 4 * spark.sparkContext.defaultParallelism
    assert plans._answers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= least
    assert bind.spread(spark.range(1000), "id").rdd.getNumPartitions() == least  # few rows need no more tasks
    df = spark.createDataFrame([("x",)], "text string").select(F.col("text"), F.try_parse_json(F.lit("{}")).alias("tree"))
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("lower(text")
    assert plan(parts.particulars(F.col("tree"), F.col("text"))) == 1
    stops = F.array(F.struct(F.lit("2026-07-05").alias("start"), F.lit("").alias("end"), F.lit("x").alias("scope")))
    assert plan(grounding.stop_sales(stops, F.col("text"))) == 1
