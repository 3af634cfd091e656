"""Values that are used more than once are computed once."""

from pyspark.sql import functions as F

from pactline.functions.bind import let, spread
from pactline.operators import contracts as c
from pactline.operators import field_update as u
from pactline.operators import normalize as n
from pactline.operators import schema as v
from pactline.operators import scoring


def test_let(spark):
    row = spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("a"), let(F.when(F.col("id") < 0, 1), lambda x: x.isNull()).alias("b")).collect()
    assert [tuple(r) for r in row] == [(1, True), (4, True), (9, True)]


def times(df, word):
    return df._jdf.queryExecution().analyzed().toString().count(word)


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([("1.5.2030",)], "t string")
    assert times(df.select(n.iso_date(F.trim(F.upper("t"))).alias("x")), "upper(") == 1
    assert times(df.select(n.loose_number(F.upper("t")).alias("x")), "upper(") == 1
    assert times(df.select(n.canonical_enum(F.upper("t"), "pansiyon").alias("x")), "upper(") <= 3


def test_schema_reads_each_value_once(spark):
    df = spark.createDataFrame([('{"release": null, "fiyatlar": [{"tutar": -1, "x": 2}]}',), ("[]",), (None,)], "t string")
    out = df.select(v.violations(F.try_parse_json("t"), v.CONTRACT).alias("m"), v.conforms(F.try_parse_json("t"), v.CONTRACT).alias("ok"))
    assert times(out, "try_parse_json(") <= 4
    rows = out.collect()
    assert "alan=release kisit=type" in rows[0].m and "alan=fiyatlar/0/tutar kisit=minimum" in rows[0].m and "alan=fiyatlar/0 kisit=additionalProperties" in rows[0].m
    assert rows[1].m == ["alan=(kök) kisit=type"] and [r.ok for r in rows] == [False, False, False]


def test_spread(spark):
    got = spread(spark.range(0, 1000, 1, 1), "id")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and got.count() == 1000


def test_kinds_of_objects_are_seen_from_their_fields(spark):
    df = n.normalized(spark.createDataFrame([("{}",)], "t string"), "t")
    assert times(df, "schema_of_variant(__") == 0
    assert times(df, "try_parse_json(") == 1


def test_confidence_from_the_roots_of_notes(spark):
    notes = [["zorunlu alan dolduruldu: donem.bitis", "tarih ISO-8601 yapıldı: release"], ["sayı temizlendi: fiyatlar[0].tutar", "zorunlu alan dolduruldu"], ["fiyatlar[2].tutar metinden çıkarıldı", "x: donemler.a"], []]
    df = spark.createDataFrame([(k,) for k in notes], "notes array<string>").withColumn("roots", c.note_roots(F.col("notes")))
    names = ("donem", "fiyatlar", "release")
    got = df.select(*(c.root_confidence(F.col("roots"), k).alias(k) for k in names)).collect()
    assert [tuple(r) for r in got] == [(0.2, 0.9, 0.6), (0.9, 0.6, 0.9), (0.9, 0.9, 0.9), (0.9, 0.9, 0.9)]
    assert got == df.select(*(c.confidence(F.col("notes"), k).alias(k) for k in names)).collect()


def test_canonical_texts_read_each_value_once(spark):
    df = spark.createDataFrame([('{"baslangic": "a", "alt_donemler": [{"ad": 1.0}, 2]}', '[{"oda_tipi": "x", "tutar": 2}]')], "d string, f string")
    out = df.select(scoring.canonical(F.try_parse_json(F.trim("d")), "donem").alias("d"), scoring.canonical(F.try_parse_json(F.trim("f")), "fiyatlar").alias("f"))
    assert times(out, "try_parse_json(") <= 4
    assert out.first().d == '="a",null|1.0,null,null' and out.first().f == '="x",2.0,null,"belirtilmemis",null'


def test_edited_fields_are_read_without_the_others(spark):
    room = "array<struct<oda_tipi:string,adet:int,aciklama:string>>"
    price = "array<struct<oda_tipi:string,tutar:double,birim:string,pansiyon:string,alt_donem_ad:string>>"
    meta = ",".join(f"{k}:string" for k in n.KEYS["meta"])
    stop = "array<struct<" + ",".join(f"{k}:string" for k in n.KEYS["stop_sale"]) + ">>"
    doc = f"struct<meta:struct<{meta}>,donem:struct<baslangic:string,bitis:string>,oda_kontenjanlari:{room},fiyatlar:{price},release:struct<gun:int,kapsam:string,kaynak_ifade:string>,stop_sale:{stop}>"
    stored = spark.createDataFrame([(1, "HATA", None), (2, "HATA", None)], f"doc_id long, status string, doc {doc}").withColumn("provenance", F.lit(None).cast("array<struct<path:string,confidence:double,manual:boolean>>"))
    made = stored.withColumn("doc", F.struct(*(F.col(f"doc.{k}").alias(k) for k in ("meta", "donem", "oda_kontenjanlari")), F.transform(F.array(F.col("status")), lambda s: F.struct(s.alias("oda_tipi"), F.lit(1.0).alias("tutar"), s.alias("birim"), s.alias("pansiyon"), F.lit("isaret").alias("alt_donem_ad"))).alias("fiyatlar"), F.col("doc.release").alias("release"), F.col("doc.stop_sale").alias("stop_sale")))
    edits = spark.createDataFrame([(1, 1, "release", '{"gun": 3}')], "doc_id long, seq long, path string, v string").select("doc_id", "seq", "path", F.try_parse_json("v").alias("value"))
    out = u.applied(made, u.judged(made, edits))
    days = out.select("doc_id", "doc.release.gun")
    assert {tuple(r) for r in days.collect()} == {(1, 3), (2, None)}
    assert "isaret" not in days._jdf.queryExecution().optimizedPlan().toString()
    none = u.applied(stored, u.judged(stored, edits))
    assert [r.doc for r in none.collect()] == [None, None]
