"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from pactline.functions import text as x
from pactline.operators import contracts as c


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,want", [("1.500,25", 1500.25), ("1,500.25", 1500.25), ("48,00", 48.0), ("161GBP", 161.0), ("€ 12", 12.0), ("", None), (None, None), ("1.500", 1500.0), ("12d", None)])
def test_loose_number(spark, raw, want):
    assert one(spark, x.loose_number, raw) == want


@pytest.mark.parametrize("raw,want", [("1 Nisan 2026", "2026-04-01"), ("1 ŞUBAT 2026", "2026-02-01"), ("31.10.2026", "2026-10-31"), ("2026-04-01", "2026-04-01"), ("3/9/2026", "2026-09-03"), ("31.02.2026", None), ("soon", None), (None, None)])
def test_parse_date(spark, raw, want):
    got = one(spark, x.parse_date, raw)
    assert (got and str(got)) == want


@pytest.mark.parametrize("raw,n", [("İletişim: rezervasyon@otel-ornek.com ve Ali", 1), ("Tel: 0532 123 45 67", 1), ("Tel: 0532 123 45\n67", 1), ("Tel: +90 242 813 45 67", 1), ("Kimlik no 12345678901", 1), ("a@b.co 05321234567 12345678901", 3), ("ç12345678901", 1), ("x12345678901", 0), ("", 0)])
def test_masked(spark, raw, n):
    text, count = x.masked(F.col("v"))
    got = spark.createDataFrame([(raw,)], "v string").select(text, count).first()
    assert got[1] == n
    assert got[0].count("[") == n


def test_section(spark):
    text = "x KONTENJAN " + "a" * 50 + " FİYAT b"
    assert one(spark, lambda v: x.section_between(v, ["kontenjan"], ["fiyat"]), text) == "kontenjan " + "a" * 50 + " "
    assert one(spark, lambda v: x.section_between(v, ["nothing"], ["fiyat"]), text) == ""


def test_first_and_last_int(spark):
    assert one(spark, x.first_int, "approximately 10 of 20 days") == 10
    assert one(spark, x.last_int, "approximately 10 of 20 days") == 20
    assert one(spark, x.first_int, "none 99999999999") is None


def test_emails(spark):
    assert one(spark, x.mask_email, "lale@otel.com") == "l***@otel.com"
    assert one(spark, x.mask_email, "lale") == "***"
    assert one(spark, x.normalize_email, "  A@B.Co ") == "a@b.co"
    assert one(spark, x.normalize_email, "a b@c.d") is None


def test_confidence(spark):
    notes = spark.createDataFrame([(["tarih ISO-8601 yapıldı: donem.baslangic", "zorunlu alan dolduruldu: release", "release dizi yerine nesne"],), ([],)], "n array<string>")
    got = notes.select(*(c.confidence(F.col("n"), f) for f in ("donem", "release", "stop_sale"))).collect()
    assert [tuple(r) for r in got] == [(0.6, 0.2, 0.9), (0.9, 0.9, 0.9)]


def test_release_rule_lets_negative_numbers_pass(spark):
    k = spark.createDataFrame([(1, 0), (2, 91), (3, 90), (4, -1), (5, None)], "doc_id long, release_days int")
    assert sorted(r.doc_id for r in c.release_unreasonable(k).collect()) == [1, 2]
