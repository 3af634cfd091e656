"""Contracts as documents: layouts, styles, missing values, and prose."""

import datetime as dt

from pyspark.sql import functions as F

from pactline.operators import documents_text as t
from pactline.operators import synthesis as y

SHAPE = """id int, begins date, ends date, parts array<struct<name:string,begins:date,ends:date>>, rooms array<struct<room:string,quantity:int>>,
 prices array<struct<room:string,board:string,amount:double,unit:string,part:string>>, stop_sale array<struct<begins:date,ends:date,scope:string>>,
 release_days int, hotel string, agent string, currency string, city string, rate_basis string, no_show string, overbooking string"""
FULL = (1, dt.date(2026, 5, 1), dt.date(2026, 10, 5), [("Erken", dt.date(2026, 5, 1), dt.date(2026, 10, 5))], [("suit", 1001), ("deluxe", 8)], [("suit", "HB", 1250.5, "oda_gecelik", "Erken"), ("aile", None, 90.0, "kisi_gecelik", None)], [(dt.date(2026, 7, 5), dt.date(2026, 7, 9), "tüm tesis")], 14, "Kum Otel", "Deniz Turizm", "EUR", "Aydın", "giris_gunu_tcmb", "Bir gece.", "")
NONE = (2, *[None] * 14)
EMPTY = (3, None, dt.date(2026, 1, 1), [], [], [], [], 0, "", "", "", "", "", "", "")


def table(spark):
    return spark.createDataFrame([FULL, NONE, EMPTY], SHAPE)


def test_articles_are_numbered_without_gaps(spark):
    full, none, empty = (r[0] for r in table(spark).orderBy("id").select(t.document("tr", 1, "nokta", "tr")).collect())
    assert full == (
        "KONTENJAN SÖZLEŞMESİ\nDeniz Turizm – Kum Otel\n\n\nİşbu sözleşme, Deniz Turizm ile Kum Otel arasında aşağıda belirtilen koşullarla akdedilmiştir.\n\n\n"
        "MADDE 1 — SÖZLEŞME SÜRESİ\nİşbu sözleşme 01.05.2026 tarihinde başlar ve 05.10.2026 tarihinde sona erer.\n\nSezon içi fiyat dönemleri:\nErken: 01.05.2026 – 05.10.2026\n\n"
        "MADDE 2 — ODA KONTENJANI\nOtel, acenteye şu oda kontenjanını tahsis eder: 1.001 suit, 8 deluxe.\n\n"
        "MADDE 3 — İSİM LİSTESİ\nAcente, oda kontenjanı ile ilgili son durumu müşterilerin otele girişini 14 gün önce belirler ve isim listesi ile birlikte otele bildirir.\n\n"
        "MADDE 4 — STOP-SALE\nOtel, aşağıdaki tarih aralıklarında stop-sale uygulayabilir; bildirim yazılı veya e-posta ile yapılır:\n- 05.07.2026 – 09.07.2026 (tüm tesis)\n\n"
        "MADDE 5 — FİYATLAR\nFiyatlar: suit, yarım pansiyon (Erken) için 1.250,50 EUR oda / gece; aile için 90 EUR kişi / gece.\n"
    )
    for x in (none, empty):
        assert "Acente – Otel" in x and "MADDE 1 — ODA KONTENJANI" in x and "MADDE 3 — FİYATLAR\nFiyatlar: .\n" in x and "MADDE 4" not in x and "SÖZLEŞME SÜRESİ" not in x


def test_english_tables(spark):
    full, none, empty = (r[0] for r in table(spark).orderBy("id").select(t.document("en", 3, "uzun", "en", glued=True)).collect())
    assert "junior suite | 1,001\npenthouse | 8\n" in full and "junior suite | HB | 1,250.50EUR | per room per night | Erken\nfamily | unspecified | 90EUR | per person per night | -\n" in full
    assert "Validity: This contract runs from 1 May 2026 to 5 October 2026." in full and "- 5 July 2026 – 9 July 2026 (entire property)\n" in full
    assert "the Hotel / the Agent\nValidity: as stated in the main agreement\n" in none and none.count("Room type | Board") == 1 and "Stop-sale periods (" not in empty


def test_every_layout_is_defined_for_missing_values_and_equals_the_drawn_form(spark):
    cases = [(x, k) for x, layouts in t.LAYOUTS.items() for k in range(1, len(layouts) + 1)]
    one = table(spark).select("id", *(t.document(x, k, "iso", "duz", extra=True).alias(f"{x}{k}") for x, k in cases))
    want = {(r.id, x, k): r[f"{x}{k}"] for r in one.collect() for x, k in cases}
    styles = spark.createDataFrame(cases, "language string, layout int").withColumns({"dates": F.lit("iso"), "numbers": F.lit("duz"), "glued": F.lit(False), "extra": F.lit(True)})
    drawn = table(spark).join(styles, F.lit(True))
    assert {(r.id, r.language, r.layout): r.text for r in t.with_documents(drawn).collect()} == want
    assert all(text and text.endswith("\n") for text in want.values()) and len(set(want.values())) > 30
    assert t.with_documents(drawn.withColumn("layout", F.lit(77))).where("text is not null").isEmpty()
    # sums of code points: 701 for Aydın, 714 for Antalya
    assert (sum(map(ord, "Aydın")), sum(map(ord, "Antalya"))) == (701, 714)
    assert "15 gün içinde" in want[2, "tr", 1] and "30 gün içinde" in want[1, "tr", 1] and "Aydın Mahkemeleri" in want[1, "tr", 1]


def test_drawn_documents_do_not_depend_on_partitions(spark):
    made = lambda n: t.with_documents(t.with_styles(y.contracts(spark.range(120).repartition(n), "id", 7), "id", 8))
    rows = {r.id: r for r in made(2).collect()}
    assert rows == {r.id: r for r in made(13).collect()}
    assert {(r.language, r.layout) for r in rows.values()} == {("tr", k) for k in range(1, 7)} | {("en", k) for k in range(1, 4)}
    assert all(r.hotel in r.text and r.agent in r.text for r in rows.values())


def test_prose(spark):
    full, none, _ = (r[0] for r in table(spark).orderBy("id").select(t.prose()).collect())
    assert full.startswith("KONTENJAN SÖZLEŞMESİ\nDeniz Turizm – Kum Otel\n\nMADDE 1") and "\n- suit: 1001 adet\n- deluxe: 8 adet\n\nMADDE 3" in full and "MADDE 4 — NO SHOW\nBir gece.\n\nMADDE 6" in full
    assert "T.C. Merkez Bankası" in full and full.endswith("\n- suit: 1250.5 EUR\n- aile: 90 EUR\n")
    assert "Side Turizm – Argos Otel" in none and "10 gün önce" in none and "MADDE 7" not in none and none.endswith("Oda fiyatları (oda / gece, GBP):\n")
