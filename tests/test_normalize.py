"""Contract JSON against the canonical schema and the notes of what was changed."""

import json

import pytest

from pactline.operators import normalize as n

FULL = {
    "bilinmeyen": 1, "aaa": 2,
    "meta": {"otel_adi": "Otel", "sezon": "Yaz", "kur_esasi": 5, "para_birimi": " eur", "imza_tarihi": "1 Mart 2026", "x": 0},
    "donem": {"baslangic": "01.04.2026", "bitis": "2026-10-31", "stop_sale": {"baslangic": "5/8/2026"}, "alt_donemler": [{"ad": "A", "baslangic": "1.4.2026", "bitis": "31.05.2026", "z": 1}, 7, {"ad": "B"}]},
    "oda_kontenjanlari": [{"oda_tipi": "standart", "adet": "12 oda"}, {"oda_tipi": "suit", "adet": 3.0}, {"oda_tipi": "aile", "adet": 2.5}, {"adet": 1}, "x", {"oda_tipi": "tek", "adet": True}],
    "fiyatlar": [{"oda_tipi": "standart", "tutar": "1.500,25 EUR", "birim": "kişi başı", "pansiyon": "ai"}, {"oda_tipi": "suit", "tutar": 90, "birim": "oda/gece", "pansiyon": "tam"}, {"oda_tipi": "aile", "tutar": "yok", "birim": "x"}],
    "release": [3, {}, {"gun": "7 gün", "kapsam": "İsim Listesi"}],
    "opsiyonel": {"no_show": {"sorumlu_taraf": "Acente"}, "odeme": {"fatura_sonrasi_gun": 30, "avans_var": False}, "q": 1, "cocuk_politikasi": [{"yas_min": 0, "ucretsiz": True}]},
    "cikarim_meta": {"donem": {"guven": 1, "w": 2}},
}
NOTES = [
    "stop_sale donem içinden üst düzeye taşındı",
    "bilinmeyen alan atıldı: aaa", "bilinmeyen alan atıldı: bilinmeyen", "bilinmeyen alan atıldı: meta.x", "bilinmeyen alan atıldı: donem.alt_donemler[0].z", "bilinmeyen alan atıldı: opsiyonel.q", "bilinmeyen alan atıldı: cikarim_meta.donem.w",
    "release dizi yerine nesne yapıldı",
    "enum normalize edildi: meta.sezon", "enum normalize edildi: meta.kur_esasi", "tarih ISO-8601 yapıldı: meta.imza_tarihi", "para birimi normalize edildi: meta.para_birimi",
    "tarih ISO-8601 yapıldı: donem.baslangic", "tarih ISO-8601 yapıldı: donem.alt_donemler[0].baslangic", "tarih ISO-8601 yapıldı: donem.alt_donemler[0].bitis",
    "sayı temizlendi: oda_kontenjanlari[0].adet", "oda_kontenjanlari[2].adet metinden çıkarıldı", "oda_kontenjanlari[5].adet metinden çıkarıldı",
    "sayı temizlendi: fiyatlar[0].tutar", "enum normalize edildi: fiyatlar[0].birim", "enum normalize edildi: fiyatlar[0].pansiyon", "enum normalize edildi: fiyatlar[1].birim", "enum normalize edildi: fiyatlar[1].pansiyon",
    "fiyatlar[2].tutar metinden çıkarıldı", "enum normalize edildi: fiyatlar[2].birim",
    "sayı temizlendi: release.gun", "enum normalize edildi: release.kapsam", "tarih ISO-8601 yapıldı: stop_sale[0].baslangic", "enum normalize edildi: opsiyonel.no_show.sorumlu_taraf",
]
REQUIRED = [f"zorunlu alan dolduruldu: {k}" for k in ("donem", "oda_kontenjanlari", "fiyatlar", "release", "stop_sale")]


@pytest.fixture(scope="module")
def found(spark):
    texts = {"full": json.dumps(FULL), "empty": "{}", "null": None, "list": "[1]", "part": '{"donem": {"bitis": null}, "oda_kontenjanlari": [], "fiyatlar": [], "release": {"kapsam": "x"}, "stop_sale": [{"bildirim_yontemi": "E-Posta"}]}'}
    df = n.normalized(spark.createDataFrame(list(texts.items()), "id string, text string"), "text")
    return {r.id: r for r in df.collect()}


def test_notes(found):
    assert found["full"].notes == NOTES
    for k in ("empty", "null", "list"):
        assert found[k].notes == REQUIRED
    assert found["part"].notes == ["zorunlu alan dolduruldu: donem.baslangic", "zorunlu alan dolduruldu: release.gun", "enum normalize edildi: release.kapsam", "enum normalize edildi: stop_sale[0].bildirim_yontemi"]


def test_document(found):
    d = found["full"].doc.asDict(True)
    assert d["meta"] == {"otel_adi": "Otel", "acente_adi": None, "sozlesme_tipi": None, "sezon": "yaz", "para_birimi": "EUR", "kur_esasi": "belirtilmemis", "yetkili_mahkeme": None, "imza_tarihi": "2026-03-01"}
    assert d["donem"] == {"baslangic": "2026-04-01", "bitis": "2026-10-31", "alt_donemler": [{"ad": "A", "baslangic": "2026-04-01", "bitis": "2026-05-31"}]}
    assert [(x["oda_tipi"], x["adet"]) for x in d["oda_kontenjanlari"]] == [("standart", 12), ("suit", 3), ("aile", 0), ("tek", 0)]
    assert [(x["oda_tipi"], x["tutar"], x["birim"], x["pansiyon"]) for x in d["fiyatlar"]] == [("standart", 1500.25, "kisi_gecelik", "AI"), ("suit", 90.0, "oda_gecelik", "belirtilmemis"), ("aile", 0.0, "oda_gecelik", None)]
    assert d["release"] == {"gun": 7, "kapsam": "isim_listesi", "kaynak_ifade": None} and d["stop_sale"][0]["baslangic"] == "2026-08-05"
    assert d["opsiyonel"]["no_show"]["sorumlu_taraf"] == "acente" and d["opsiyonel"]["odeme"] == {"fatura_sonrasi_gun": 30, "avans_var": False, "avans_aciklama": None}
    assert d["opsiyonel"]["cocuk_politikasi"] == [{"yas_min": 0.0, "yas_max": None, "indirim_yuzde": None, "ucretsiz": True, "kosul": None}]
    e = found["empty"].doc.asDict(True)
    assert e["meta"] is None and e["release"] is None and e["oda_kontenjanlari"] == []


def test_dates_and_numbers(spark):
    dates = {"2026-04-01": "2026-04-01", "01.04.2026": "2026-04-01", "1.4.2026": "2026-04-01", "01.4.2026": "2026-04-01", "1.04.2026": "2026-04-01", "01/04/2026": "2026-04-01", "1/4/2026": "2026-04-01", "1-4-2026": "2026-04-01", "2026.04.01": "2026-04-01", "2026/04/01": "2026-04-01", " 5 Şubat 2026 ": "2026-02-05", "3 Sept 2026": "2026-09-03", "31.02.2026": None, "2026-4-1": None, "1 Foo 2026": None, "": None}
    numbers = {"1.500,25": 1500.25, "1,500.25": 1500.25, "48,5": 48.5, "48,500": 48500.0, "161GBP": 161.0, "€ 12": 12.0, "": None, "1.500": 1500.0, "-3": -3.0, "1 200 TL": 1200.0, "abc": None, "1e2": 100.0}
    from pyspark.sql import functions as F

    got = {r.t: r.d for r in spark.createDataFrame([(k,) for k in dates], "t string").select("t", n.iso_date(F.col("t")).alias("d")).collect()}
    assert got == dates
    got = {r.t: r.d for r in spark.createDataFrame([(k,) for k in numbers], "t string").select("t", n.loose_number(F.col("t")).alias("d")).collect()}
    assert got == numbers
