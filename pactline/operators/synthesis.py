"""Seeded contracts and planted faults, for training and for tests of the rules.

Every random choice is a draw of its own: a number from (seed, row, step), so that a row is the
same whatever rows stand beside it and however many partitions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what contracts are made of
ROOMS = ("standart", "suit", "aile", "deluxe", "balayi", "engelli")
DEAR = ("suit", "deluxe", "balayi")
ORPHANS = ("tek_kisilik", "iki_kisilik", "uc_kisilik")
BOARDS = ("RO", "BB", "HB", "FB", "AI")
UNITS = ("oda_gecelik", "kisi_gecelik")
NOTICES = ("yazili", "faks", "eposta", "sistem", "belirtilmemis")
SCOPES = ("tüm tesis", "standart", "suit")
PARTS = ("Erken sezon", "Orta sezon", "Yüksek sezon", "Geç sezon")
MONTHS = {
    "tr": ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}
KINDS = ("eksik", "tarih", "oda")
EDGE = 8  # days at either end of a period in which no part ends


class Draws:
    """Draws of one table: ``seed`` and the column that numbers its rows."""

    def __init__(self, seed: int, row: Column):
        self.seed, self.row = seed, row

    def real(self, step: str, *at: Column) -> Column:
        """A number from 0 to under 1."""
        key = F.concat_ws(":", F.lit(f"{self.seed}"), self.row.cast("string"), F.lit(step), *(a.cast("string") for a in at))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2**32

    def whole(self, low, high, step: str, *at: Column) -> Column:
        """A whole number from ``low`` to ``high``, both included."""
        low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
        return (low + F.floor(self.real(step, *at) * (high - low + 1))).cast("int")

    def one(self, values: tuple, step: str, *at: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.whole(0, len(values) - 1, step, *at))

    def some(self, values: tuple, n: Column, step: str, *at: Column) -> Column:
        """``n`` of the values without replacement, in a drawn order."""
        drawn = F.array(*(F.struct(self.real(f"{step}{k}", *at).alias("d"), F.lit(v).alias("v")) for k, v in enumerate(values)))
        return F.transform(F.slice(F.array_sort(drawn), 1, n), lambda x: x["v"])


def _season(d: Draws) -> Column:
    """struct<season, begins, ends>: a summer from April to October, or a winter from November to March."""
    year = d.whole(2024, 2027, "yil")
    summer = F.struct(F.lit("yaz").alias("season"), F.make_date(year, F.lit(4), d.one((1, 5, 10, 15), "bas")).alias("begins"), F.make_date(year, F.lit(10), d.one((15, 20, 25, 31), "bit")).alias("ends"))
    month = d.one((1, 2, 3), "ay")
    winter = F.struct(F.lit("kis").alias("season"), F.make_date(year, F.lit(11), d.one((1, 10, 15), "bas")).alias("begins"), F.make_date(year + 1, month, F.when(month == 2, 28).otherwise(d.one((15, 20, 28), "bit"))).alias("ends"))
    return F.when(d.real("sezon") < 0.5, summer).otherwise(winter)


def sub_periods(d: Draws, begins: Column, ends: Column) -> Column:
    """Two to four parts of a period, one after the other without a gap; none if it has fewer than ten days for each, or if a part would be a single day.

    Of so many places for a cut, k different ones are k draws from k - 1 fewer places, sorted and moved up by their rank.
    """
    n, days = d.whole(2, 4, "parca"), F.datediff(ends, begins)
    places = days - 2 * EDGE - (n - 2)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(1), n - 1), lambda k: d.whole(0, places - 1, "kesik", k)))
    starts = F.concat(F.array(F.lit(0)), F.transform(drawn, lambda x, k: (x + k + EDGE).cast("int")))
    part = lambda s, k: F.struct(F.get(F.array(*map(F.lit, PARTS)), k).alias("name"), F.date_add(begins, s).alias("begins"), F.date_add(begins, F.coalesce(F.get(starts, k + 1), days + 1) - 1).alias("ends"))
    none = F.array().cast("array<struct<name:string,begins:date,ends:date>>")
    parts = F.when(days >= 10 * n, F.transform(starts, part)).otherwise(none)
    return F.get(F.transform(F.array(parts), lambda ps: F.when(F.forall(ps, lambda p: p["ends"] > p["begins"]), ps).otherwise(none)), 0)


def stop_sales(d: Draws, begins: Column, ends: Column) -> Column:
    """Up to three closed ranges within a period of two weeks or more; half of the contracts have none."""
    days = F.datediff(ends, begins)
    n = F.when((d.real("kapali") < 0.5) | (days < 14), 0).otherwise(d.whole(0, 3, "kapali_n"))

    def row(k: Column) -> Column:
        offset = d.whole(0, F.greatest(F.lit(1), days - 7), "kapali_bas", k)
        long = d.whole(2, F.least(F.lit(14), days - offset), "kapali_sure", k)
        first = F.date_add(begins, offset)
        return F.struct(first.alias("begins"), F.least(F.date_add(first, long), ends).alias("ends"), d.one(SCOPES, "kapali_kapsam", k).alias("scope"), d.one(NOTICES, "bildirim", k).alias("notice"))

    return F.filter(F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k <= n), row), lambda r: r["ends"] > r["begins"])


def contracts(rows: DataFrame, row: str, seed: int) -> DataFrame:
    """``rows`` with a contract for each: season, begins, ends, parts, rooms, prices, release_days, stop_sale."""
    d = Draws(seed, F.col(row))
    out = rows.withColumn("__s", _season(d)).select(*rows.columns, "__s.*")
    out = out.withColumn("parts", F.when(d.real("parcali") < 0.4, sub_periods(d, F.col("begins"), F.col("ends"))).otherwise(F.array().cast("array<struct<name:string,begins:date,ends:date>>")))
    out = out.withColumn("rooms", F.transform(d.some(ROOMS, d.whole(2, 5, "oda_n"), "oda"), lambda r: F.struct(r.alias("room"), d.whole(1, 300, "adet", r).alias("quantity"))))
    # a price for each board of a room, and for each part where there are some
    when = F.when(F.size("parts") > 0, F.transform("parts", lambda p: p["name"])).otherwise(F.array(F.lit(None).cast("string")))
    base = lambda r, b: d.whole(45, 280, "taban", r, b) + F.when(r.isin(*DEAR), d.whole(40, 220, "ek", r, b)).otherwise(0)
    price = lambda r, b, p: F.struct(r.alias("room"), b.alias("board"), (base(r, b) + F.when(p.isNull(), 0).otherwise(d.whole(-15, 40, "fark", r, b, p)) + F.when(d.real("yarim", r, b, F.coalesce(p, F.lit(""))) < 0.25, 0.5).otherwise(0.0)).cast("double").alias("amount"), d.one(UNITS, "birim").alias("unit"), p.alias("part"))
    each = F.transform("rooms", lambda x: F.flatten(F.transform(d.some(BOARDS, d.whole(1, 3, "pansiyon_n", x["room"]), "pansiyon", x["room"]), lambda b: F.transform(when, lambda p: price(x["room"], b, p)))))
    return out.withColumns({"prices": F.flatten(each), "release_days": d.whole(3, 30, "gun"), "stop_sale": stop_sales(d, F.col("begins"), F.col("ends"))})


def with_faults(made: DataFrame, row: str, seed: int) -> DataFrame:
    """Contracts with up to two of three kinds of faults, and ``labels``, which name them.

    A field is left out; the period ends before it begins, or a part begins before it; a price is
    for a room without an allotment. A date fault needs dates, so one that follows missing dates is left out.
    """
    d = Draws(seed, F.col(row))
    out = made.withColumn("__kinds", d.some(KINDS, d.whole(0, 2, "hata_n"), "hata"))
    has = lambda kind: F.array_contains("__kinds", kind)
    gone = F.when(has("eksik"), d.one(("donem", "stop_sale", "pansiyon"), "eksik_alan"))
    conflict = has("tarih") & ~gone.eqNullSafe(F.lit("donem"))
    inner = conflict & (F.size("parts") > 0) & (d.real("disarida") < 0.5)
    swapped = conflict & ~inner
    out = out.withColumns({"__gone": gone, "__inner": inner, "__swapped": swapped})
    dates = lambda c, other: F.when(F.col("__gone").eqNullSafe(F.lit("donem")), F.lit(None).cast("date")).when(F.col("__swapped"), F.col(other)).otherwise(F.col(c))
    target = d.whole(0, F.size("parts") - 1, "parca_hata")
    parts = F.when(F.col("__gone").eqNullSafe(F.lit("donem")), F.slice("parts", 1, 0)).when(F.col("__inner"), F.transform("parts", lambda p, k: F.when(k == target, p.withField("begins", F.date_sub(F.col("begins"), d.whole(10, 25, "once")))).otherwise(p))).otherwise(F.col("parts"))
    bare = lambda p: F.when(F.col("__gone").eqNullSafe(F.lit("pansiyon")), p.withField("board", F.lit(None).cast("string"))).when(F.col("__gone").eqNullSafe(F.lit("donem")), p.withField("part", F.lit(None).cast("string"))).otherwise(p)
    orphan = F.struct(d.one(ORPHANS, "yetim").alias("room"), d.one(BOARDS, "yetim_pansiyon").alias("board"), d.whole(50, 120, "yetim_tutar").cast("double").alias("amount"), F.get("prices", 0)["unit"].alias("unit"), F.lit(None).cast("string").alias("part"))
    prices = F.concat(F.transform("prices", bare), F.when(has("oda"), F.array(orphan)).otherwise(F.slice("prices", 1, 0)))
    labels = F.array_compact(F.array(
        F.when(F.col("__gone").isNotNull(), F.concat(F.lit("eksik_alan:"), F.col("__gone"))), F.when(F.col("__inner"), "tarih_celiskisi:alt_donem_disarida"),
        F.when(F.col("__swapped"), "tarih_celiskisi:bitis_baslangictan_once"), F.when(has("oda"), "oda_uyumsuz"),
    ))
    stops = F.when(F.col("__gone").eqNullSafe(F.lit("stop_sale")), F.slice("stop_sale", 1, 0)).otherwise(F.col("stop_sale"))
    new = {"begins": dates("begins", "ends"), "ends": dates("ends", "begins"), "parts": parts, "prices": prices, "stop_sale": stops}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in made.columns), labels.alias("labels"))


def date_text(day: Column, style: str, language: str = "tr") -> Column:
    """A date as ``iso``, ``nokta`` (dd.MM.yyyy) or in words; empty for none."""
    if style == "iso":
        shown = F.date_format(day, "yyyy-MM-dd")
    elif style == "nokta":
        shown = F.date_format(day, "dd.MM.yyyy")
    else:
        shown = F.concat_ws(" ", F.day(day).cast("string"), F.get(F.array(*map(F.lit, MONTHS[language])), F.month(day) - 1), F.year(day).cast("string"))
    return F.when(day.isNull(), "").otherwise(shown)


def number_text(n: Column, style: str) -> Column:
    """A number as ``duz``, ``tr`` (1.234,50) or ``en`` (1,234.50); whole ones have no decimals."""
    english = F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.format_number(n, 2))
    return english if style == "en" else F.translate(english, ",.", ".,") if style == "tr" else F.replace(english, F.lit(","))


def money_text(amount: Column, currency: Column, glued: bool = False) -> Column:
    """An amount and its currency, apart or glued together; the amount alone without one."""
    return F.when(F.coalesce(currency, F.lit("")) == "", amount).otherwise(F.concat_ws("" if glued else " ", amount, currency))
