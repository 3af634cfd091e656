"""Edits of contracts by path: spellings, values, provenance, and contracts that nothing names."""

import json

from pyspark.sql import functions as F

from pactline.operators import field_update as u
from pactline.operators import normalize as n

CONTRACT = {
    "meta": {"otel_adi": "Deniz"}, "donem": {"baslangic": "2030-01-01", "bitis": "2030-12-31", "alt_donemler": [{"ad": "A", "baslangic": "2030-01-01", "bitis": "2030-02-01"}]},
    "oda_kontenjanlari": [{"oda_tipi": "suit", "adet": 4, "aciklama": "deniz"}], "fiyatlar": [{"oda_tipi": "suit", "tutar": 90.5, "birim": "oda_gecelik", "pansiyon": "HB"}],
    "release": {"gun": 7, "kapsam": "her_ikisi"}, "stop_sale": [{"baslangic": "2030-05-01", "bitis": "2030-05-02", "kapsam": "suit"}],
}


def contracts(spark, rows):
    df = n.normalized(spark.createDataFrame([(i, s, json.dumps(c)) for i, s, c in rows], "doc_id long, status string, contract string"), "contract")
    mark = F.struct(F.lit("release").alias("path"), F.lit(0.6).alias("confidence"), F.lit(False).alias("manual"))
    return df.select("doc_id", "status", "doc", F.when(F.col("doc_id") < 90, F.array(mark)).alias("provenance"))


def edit(spark, rows):
    return spark.createDataFrame([(i, k, p, json.dumps(v)) for k, (i, p, v) in enumerate(rows)], "doc_id long, seq long, path string, j string").select("doc_id", "seq", "path", F.parse_json("j").alias("value")).repartition(3)


def test_every_spelling_and_value(spark):
    edits = [
        (1, "meta.otel_adi", " Kum "), (1, "meta.sezon", "KIŞ"), (1, "meta.kurEsasi", "Sabit Kur"), (1, "meta.sozlesme_tipi", "kral"), (1, "meta.paraBirimi", 5), (1, "meta.yetkiliMahkeme", None),
        (2, "donem", "2031-01-01 – 2031-02-01"), (2, "donem.bitis", "2031-03-01"), (2, "donem", {"x": 1, "end": "2031-04-01"}), (2, "donem.baslangic", "2031-01-05"), (2, "donem", "bozuk"), (2, "donem.baslangic", [1]),
        (3, "odaKontenjanlari", "aile: 2\n\n suit : 3 (yan)"), (3, "fiyatlar", "suit · AI · 10,5 (oda_gecelik)"), (3, "release", "21 gün"), (3, "stop_sale", "2031-05-01 - 2031-05-02 · aile"),
        (4, "oda_kontenjanlari", [{"odaTipi": "x", "adet": 5}, {"oda_tipi": "y"}, 3]), (4, "fiyatlar", [{"odaTipi": "x", "tutar": 5, "birim": "KISI_GECELIK", "pansiyon": "yarım"}, {"tutar": 1}]), (4, "release", {"gun": 3, "kapsam": "x"}), (4, "stopSale", []),
        (5, "odaKontenjanlari", "aile: iki"), (5, "fiyatlar", "suit · 5"), (5, "release", "yakında"), (5, "stopSale", "kapalı"), (5, "meta.otel", "x"), (5, None, "x"),
        (6, "release", "1 gün"), (77, "release", "1 gün"), (8, "odaKontenjanlari", None), (8, "release", {}),
    ]
    stored = contracts(spark, [(i, "ONAYLANDI" if i == 6 else "HATA", CONTRACT) for i in (1, 2, 3, 4, 5, 6, 8)] + [(90, None, {})])
    judged = u.judged(stored, edit(spark, edits))
    assert [r.outcome for r in judged.orderBy("seq").collect()] == ["yazildi"] * 3 + ["gecersiz_deger"] * 2 + ["yazildi"] * 5 + ["gecersiz_deger"] * 2 + ["yazildi"] * 8 + ["gecersiz_deger"] * 4 + ["bilinmeyen_alan"] * 2 + ["onayli", "yok"] + ["yazildi"] * 2
    after = {r.doc_id: r.asDict(recursive=True) for r in u.applied(stored, judged).collect()}
    before = {r.doc_id: r.asDict(recursive=True) for r in stored.collect()}
    assert all({k: after[i][k] for k in before[i]} == before[i] and not after[i]["changed"] for i in (5, 6, 90))
    doc = {i: r["doc"] for i, r in after.items()}
    assert {k: v for k, v in doc[1]["meta"].items() if v} == {"otel_adi": "Kum", "sezon": "kis", "kur_esasi": "sabit_kur"} and doc[1]["donem"] == before[1]["doc"]["donem"]
    assert (doc[2]["donem"]["baslangic"], doc[2]["donem"]["bitis"]) == ("2031-01-05", "2031-04-01") and doc[2]["donem"]["alt_donemler"] == before[2]["doc"]["donem"]["alt_donemler"]
    assert doc[3]["oda_kontenjanlari"] == [{"oda_tipi": "aile", "adet": 2, "aciklama": None}, {"oda_tipi": "suit", "adet": 3, "aciklama": "yan"}]
    assert doc[3]["fiyatlar"] == [{"oda_tipi": "suit", "tutar": 10.5, "birim": "oda_gecelik", "pansiyon": "AI", "alt_donem_ad": None}]
    assert doc[3]["release"] == {"gun": 21, "kapsam": None, "kaynak_ifade": None} and doc[3]["stop_sale"][0]["kapsam"] == "aile" and len(doc[3]["stop_sale"]) == 1
    assert doc[4]["oda_kontenjanlari"] == [{"oda_tipi": "x", "adet": 5, "aciklama": None}] and doc[4]["fiyatlar"] == [{"oda_tipi": "x", "tutar": 5.0, "birim": "kisi_gecelik", "pansiyon": "yarım", "alt_donem_ad": None}]
    assert doc[4]["release"]["gun"] == 3 and doc[4]["stop_sale"] == [] and doc[8]["oda_kontenjanlari"] == [] and doc[8]["release"] is None
    marks = {i: [(m["path"], m["confidence"], m["manual"]) for m in r["provenance"] or ()] for i, r in after.items()}
    assert marks[3][0] == ("release", 1.0, True) and [m[0] for m in marks[3]] == ["release", "odaKontenjanlari", "fiyatlar", "stopSale"]
    assert marks[2] == [("release", 0.6, False), ("donem", 1.0, True), ("donem.bitis", 1.0, True), ("donem.baslangic", 1.0, True)]


def test_findings_of_other_contracts_stay(spark):
    stored = contracts(spark, [(1, "HATA", CONTRACT), (2, "HATA", CONTRACT)])
    after = u.applied(stored, u.judged(stored, edit(spark, [(1, "release", {"gun": 0})])))
    old = spark.createDataFrame([(1, "ESKI"), (2, "ESKI")], "doc_id long, code string")
    got = u.audited_again(old, after, lambda df: df.where("doc.release.gun = 0").select("doc_id", F.lit("YENI").alias("code")))
    assert {(r.doc_id, r.code) for r in got.collect()} == {(1, "YENI"), (2, "ESKI")}
    assert u.applied(stored.limit(0), u.judged(stored.limit(0), edit(spark, [(1, "release", {"gun": 0})]))).count() == 0


def test_audit_tree_round_trip(spark):
    rows = contracts(spark, [(1, None, CONTRACT), (90, None, {})])
    trees = {r.doc_id: json.loads(r.tree) for r in rows.select("doc_id", u.audit_tree(F.col("doc"), F.col("provenance")).alias("tree")).collect()}
    assert trees[1]["meta"]["acente_adi"] == "" and trees[1]["oda_kontenjanlari"] == CONTRACT["oda_kontenjanlari"] and trees[1]["donem"] == CONTRACT["donem"]
    assert trees[1]["cikarim_meta"] == {"release": {"guven": 0.6}} and trees[1]["release"] == {"gun": 7, "kapsam": "her_ikisi", "kaynak_ifade": ""}
    assert "meta" not in trees[90] and "release" not in trees[90] and trees[90]["fiyatlar"] == []
    again = n.normalized(spark.createDataFrame([(1, json.dumps(trees[1]))], "doc_id long, contract string"), "contract").first().asDict(recursive=True)["doc"]
    assert again["oda_kontenjanlari"] == CONTRACT["oda_kontenjanlari"] and again["donem"] == CONTRACT["donem"] and again["meta"]["otel_adi"] == "Deniz"
