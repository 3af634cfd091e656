"""Column functions that hold extracted values against the contract's text.

A value that the text does not bear out is dropped; some values that the text states alone are
filled in. Texts are compared in lower case, which is made once for all that is looked up in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline.functions.bind import let
from pactline.functions.text import section_between

#: fixed values: spellings of each room type in extracted fields
ROOM_NAMES = {
    "standart": ("standart", "standard", "normal", "normal oda", "single", "double", "triple", "single room", "double room", "triple room", "standard room"),
    "suit": ("suit", "suite", "junior suite", "penthouse", "junior suit"),
    "balayi": ("balayi", "balayı", "balayı odası", "balayi odasi", "honeymoon", "honeymoon suite", "honeymoon room"),
    "engelli": ("engelli", "özürlü", "ozurlu", "özürlü oda", "ozurlu oda", "accessible", "accessible room", "disabled"),
    "aile": ("aile", "aile odası", "aile odasi", "family", "family room"),
    "deluxe": ("deluxe", "deluxe room", "deluxe deniz manzaralı", "deluxe deniz manzarali"),
}
#: fixed values: what names each room type in running text
ROOM_WORDS = {
    "standart": ("normal oda", "normal room", "standard room", "standart", "standard"), "suit": ("junior suite", "suit oda", "penthouse", "suite", "suit"), "balayi": ("balayı odası", "balayi odasi", "honeymoon", "balayı", "balayi"),
    "engelli": ("özürlü oda", "ozurlu oda", "accessible", "engelli", "özürlü", "ozurlu"), "aile": ("aile odası", "aile odasi", "family room", "family", "aile"), "deluxe": ("deluxe deniz manzaralı", "deluxe deniz manzarali", "deluxe deniz", "deluxe room", "deluxe"),
}
#: fixed values: the room type of a price line, the first that occurs
RATE_WORDS = (
    ("junior suite", "suit"), ("penthouse", "suit"), ("honeymoon", "balayi"), ("balayı", "balayi"), ("balayi", "balayi"), ("özürlü", "engelli"), ("ozurlu", "engelli"), ("accessible", "engelli"), ("engelli", "engelli"),
    ("family", "aile"), ("aile", "aile"), ("deluxe", "deluxe"), ("suite", "suit"), ("suit", "suit"), ("standard", "standart"), ("standart", "standart"), ("tek kişilik", "standart"), ("iki kişilik", "standart"),
    ("üç kişilik", "standart"), ("tek kisilik", "standart"), ("iki kisilik", "standart"), ("uc kisilik", "standart"), ("normal oda", "standart"),
)
#: fixed values: words of a line that is about rooms
ROOM_HINTS = ("standart", "standard", "normal oda", "suit", "suite", "penthouse", "aile", "family", "deluxe", "balayi", "balayı", "honeymoon", "engelli", "özürlü", "accessible", "tek kişilik", "iki kişilik", "üç kişilik", "tek kisilik", "iki kisilik", "uc kisilik")
#: fixed values: where the sections on prices and on allotments begin and end
PRICE_STARTS = ("oda fiyat", "gecelik ücret", "gecelik ucret", "rates", "fiyatlar", "madde 8", "article 4", "4. fiyat")
PRICE_ENDS = ("madde 5", "article 5", "madde 6", "article 6", "ödeme", "odeme", "payment", "iptal", "cancel", "stop-sale", "stop sale", "satış durdur", "yetkili mahkeme", "jurisdiction", "çocuk", "cocuk", "child")
ROOM_STARTS = ("oda kontenjan", "room allotment", "oda tahsis", "madde 2", "article 2", "2. oda kontenjan")
ROOM_ENDS = ("madde 3", "article 3", "madde 4", "article 4", "oda fiyat", "gecelik ücret", "gecelik ucret", "rates", "fiyatlar", "name list", "isim listesi", "release", "ödeme", "odeme", "payment", "3. release")
#: fixed values: words for stop-sale, and for all rooms
STOP_SALE = ("stop-sale", "stop sale", "stopsale", "satış durdur", "satis durdur", "satışı durdur", "satisi durdur", "satışa kapat", "satisa kapat")
ALL_ROOMS = ("tüm oda", "tum oda", "all room", "tüm tesis", "tum tesis")
#: fixed values: phrases that bear out a contract type, a season, a currency
CONTRACT_TYPES = {
    "tamamen_garantili": ("tamamen garantili", "full guarantee", "fully guaranteed"), "kismen_garantili": ("kısmen garantili", "kismen garantili", "partial guarantee", "partially guaranteed"),
    "garantisiz": ("garantisiz", "non-guaranteed", "non guaranteed", "unguaranteed"), "istege_bagli": ("isteğe bağlı", "istege bagli", "on request"), "serbest_satis": ("serbest satış", "serbest satis", "free sale"),
    "blok_rezervasyon": ("blok rezervasyon", "block reservation", "block booking"), "blok_satin_alma": ("blok satın alma", "blok satin alma", "block purchase"),
}
SEASONS = {"yaz": ("yaz sezon", "yazlık", "yazlik", "summer season", "summer period"), "kis": ("kış sezon", "kis sezon", "kışlık", "kislik", "winter season", "winter period"), "yillik": ("yıllık", "yillik", "year-round", "year round", "all year")}
CURRENCIES = {"EUR": ("eur", "€"), "GBP": ("gbp", "sterlin", "pound", "£"), "USD": ("usd", "dollar", "$"), "TRY": ("türk lirası", "turk lirasi", "₺", "try")}
#: fixed values: words for the central bank, the days of exchange, a fixed rate; sentences that name both parties
CENTRAL_BANK = ("tcmb", "merkez bankası", "merkez bankasi", "central bank")
FX_DAYS = {"giris_gunu_tcmb": ("giriş", "giris", "check-in", "check in", "arrival"), "cikis_gunu_tcmb": ("çıkış", "cikis", "check-out", "check out", "departure")}
FIXED_RATE = ("sabit kur", "fixed rate", "fixed exchange")
PARTIES = r"(?is)Taraflar\s*:\s*(.+?)\s*\((?:Operatör|Operator|Acente|Tour\s*Operator)\)\s*[—\-–]\s*(.+?)\s*\((?:Tesis|Otel|Hotel|Property)\)"
BETWEEN = r"(?is)([^\n.]{3,80}?)\s+ile\s+([^\n.]{3,80}?)\s+arasında"
UNKNOWN = "belirtilmemis"
#: fixed values: what says in a text that prices are a person's, that all is included, that breakfast is
PER_PERSON = ("kişi başı", "kisi basi", "per person")
ALL_INCLUSIVE = (" her şey dahil", "her sey dahil", "(ai)", " all inclusive")
BREAKFAST = ("bed and breakfast", " kahvaltı")


def mentions(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | low.contains(phrase)
    return out


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def room_type(raw: Column) -> Column:
    """The room type that an extracted name stands for; empty for none."""

    def known(s: Column) -> Column:
        out = F.lit("")
        for kind, names in ROOM_NAMES.items():
            out = F.when(s.isin(*names), kind).otherwise(out)
        return F.coalesce(out, F.lit(""))

    return let(F.regexp_replace(F.replace(F.lower(stripped(raw)), F.lit("_"), F.lit(" ")), r"\s+", " "), known)


def room_key(raw: Column) -> Column:
    """What rooms are compared by: their type, else the name in lower case."""
    return F.coalesce(F.nullif(room_type(raw), F.lit("")), F.lower(stripped(raw)))


def rate_line_type(low: Column) -> Column:
    """The room type that a line of prices is about; empty for none."""
    out = F.lit("")
    for word, kind in reversed(RATE_WORDS):
        out = F.when(low.contains(word), kind).otherwise(out)
    return out


def price_section(text: Column) -> Column:
    return section_between(text, list(PRICE_STARTS), list(PRICE_ENDS))


def allotment_section(text: Column) -> Column:
    return section_between(text, list(ROOM_STARTS), list(ROOM_ENDS))


def priced_lines(text: Column) -> Column:
    """array<struct<room, amount>> of the price section's lines that name a room and a number."""
    each = F.transform(F.split(price_section(text), "\n"), lambda line: F.struct(F.when(mentions(line, ROOM_HINTS), rate_line_type(line)).otherwise("").alias("room"), F.regexp_extract(line, r"(\d+)", 1).try_cast("double").alias("amount")))
    return F.array_distinct(F.filter(each, lambda x: (x["room"] != "") & (x["amount"] > 0)))


def stated_unit(text: Column, low: Column | None = None) -> Column:
    """The unit of prices that a text (and its lower case) states: by room unless it speaks of persons."""
    return F.when(mentions(F.lower(text) if low is None else low, PER_PERSON), "kisi_gecelik").otherwise("oda_gecelik")


def stated_board(text: Column, low: Column | None = None) -> Column:
    """The board that a text (and its lower case) states, ``AI`` before ``BB``; empty for neither."""
    alone = lambda code: text.rlike(f"(?i)(?<![0-9A-Za-z_]){code}(?![0-9A-Za-z_])")
    stated = lambda low: F.when(mentions(low, ALL_INCLUSIVE) | alone("ai"), "AI").when(mentions(low, BREAKFAST) | alone("bb"), "BB").otherwise("")
    return let(F.lower(text), stated) if low is None else stated(low)


def unit(raw: Column, stated: Column) -> Column:
    """What the contract states about the unit of prices holds; else what the value says."""
    s = F.replace(F.lower(stripped(raw)), F.lit("-"), F.lit("_"))
    room = s.contains("oda_gecelik") | s.contains("per_room") | s.contains("room_night")
    return F.coalesce(F.nullif(stated, F.lit("")), F.when(room, "oda_gecelik").when(s.contains("kisi") | s.contains("person"), "kisi_gecelik").otherwise("oda_gecelik"))


def board(raw: Column, stated: Column) -> Column:
    """The board's code; one that the text states overrides ``RO`` and everything unclear."""
    known = F.nullif(stated, F.lit(""))

    def judged(s: Column) -> Column:
        code, low = F.upper(s), F.lower(s)
        plain = F.when(known.isNotNull() & (known != code) & (code == "RO"), known).otherwise(code)
        return F.when(code.isin("RO", "BB", "HB", "FB", "AI"), plain).when(low.contains("all inclusive") | low.contains("her şey"), "AI").when(low.contains("bed and breakfast"), "BB").otherwise(F.coalesce(known, F.lit(UNKNOWN)))

    return let(stripped(F.coalesce(raw, F.lit(""))), judged)


def date_mentioned(low: Column, raw: Column) -> Column:
    """Whether a date stands in the text as it is, or an ISO date in one of the usual forms."""
    bare = lambda x: F.regexp_replace(x, "^0+", "")

    def judged(s: Column) -> Column:
        y, m, d = F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)
        found = F.lit(False)
        for form in (s, F.concat_ws(".", d, m, y), F.concat_ws(".", bare(d), bare(m), y), F.concat_ws("/", d, m, y)):
            found = found | F.contains(low, F.lower(form))
        return F.when(s == "", False).when(s.rlike(r"^.{4}-.{2}-.{2}"), found).otherwise(F.contains(low, F.lower(s)))

    return let(stripped(raw), judged)


def scope(raw: Column) -> Column:
    """All rooms, a room type, or the words as they are; null for nothing."""
    judged = lambda s: F.when(mentions(F.replace(F.lower(s), F.lit("_"), F.lit(" ")), ALL_ROOMS), "tüm oda tipleri").otherwise(F.coalesce(F.nullif(room_type(s), F.lit("")), s))
    return let(F.nullif(stripped(raw), F.lit("")), judged)


def stop_sales(rows: Column, text: Column) -> Column:
    """Of array<struct<start, end, scope>>, the rows with a date whose dates the text holds; none if it does not speak of stop-sale."""

    def kept(low: Column) -> Column:
        there = lambda day: F.coalesce(F.nullif(stripped(day), F.lit("")).isNull() | date_mentioned(low, day), F.lit(True))
        kept = F.filter(rows, lambda x: (F.concat_ws("", stripped(x["start"]), stripped(x["end"])) != "") & there(x["start"]) & there(x["end"]))
        typed = F.transform(kept, lambda x: F.struct(F.nullif(stripped(x["start"]), F.lit("")).alias("start"), F.nullif(stripped(x["end"]), F.lit("")).alias("end"), scope(x["scope"]).alias("scope")))
        none = F.array().cast("array<struct<start:string,end:string,scope:string>>")
        return F.when(mentions(low, STOP_SALE), typed).otherwise(F.when(rows.isNotNull(), none))

    return let(F.lower(text), kept)


def currency_mentioned(low: Column, code: str) -> Column:
    out = mentions(low, CURRENCIES[code])
    return out | low.rlike("(?<![a-z0-9])tl(?![a-z0-9])") if code == "TRY" else out


def fx_mentioned(low: Column, basis: str) -> Column:
    return mentions(low, FIXED_RATE) if basis == "sabit_kur" else mentions(low, CENTRAL_BANK) & mentions(low, FX_DAYS[basis])


def borne_out(value: Column, evidence: dict[str, Column]) -> Column:
    """An enumeration's value if the evidence for it holds."""
    out = F.lit(None).cast("string")
    for name, holds in evidence.items():
        out = F.when((value == name) & holds, name).otherwise(out)
    return out


def only(evidence: dict[str, Column]) -> Column:
    """The one value for which there is evidence; null for none or several."""
    found = F.array_compact(F.array(*(F.when(holds, name) for name, holds in evidence.items())))
    return F.when(F.size(found) == 1, F.get(found, 0))


def first(evidence: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(holds, name) for name, holds in evidence.items()))


def enum_text(raw: Column) -> Column:
    """An enumeration's spelling: lower case, underscores for blanks and hyphens."""
    return F.regexp_replace(F.replace(F.lower(stripped(raw)), F.lit("-"), F.lit("_")), r"\s+", "_")


def party_present(low: Column, name: Column) -> Column:
    """Whether a party's name stands in the text (in lower case), if need be without punctuation (four characters or more)."""
    bare = lambda t: stripped(F.regexp_replace(F.regexp_replace(t, r"[.,;:·()\"']", ""), r"\s+", " "))
    present = lambda own: (own != "") & (F.contains(low, own) | let(bare(own), lambda plain: (F.length(plain) >= 4) & F.contains(bare(low), plain)))
    return let(F.lower(stripped(name)), present)


def party_name(raw: Column) -> Column:
    """The last line of what was found, without dashes around it; null unless of 3 to 80 characters."""
    s = stripped(F.regexp_extract(F.regexp_replace(stripped(raw), r"^[ \t.—–·\-]+|[ \t.—–·\-]+$", ""), r"([^\n]*)$", 1))
    return F.when(F.length(s).between(3, 80), s)


def parties(text: Column) -> Column:
    """struct<agency, hotel> of the first sentence that names both."""

    def pair(pattern: str, sign: str) -> Column:
        """The sentence is searched once, and only where a word of it stands; its names are then read from it."""
        found = F.when(text.rlike(sign), F.regexp_substr(text, F.lit(pattern)))
        name = lambda m, k: party_name(F.regexp_extract(m, pattern, k))
        both = F.transform(F.array(found), lambda m: F.struct(name(m, 1).alias("agency"), name(m, 2).alias("hotel")))
        return F.get(F.filter(both, lambda p: p["agency"].isNotNull() & p["hotel"].isNotNull()), 0)

    return F.coalesce(pair(PARTIES, "(?i)Taraflar"), pair(BETWEEN, "(?i)arasında"))


def court(raw: Column) -> Column:
    """The city of a court: the first word of a sentence about courts; null for more than 40 characters."""
    s = F.nullif(stripped(raw), F.lit(""))
    city = F.regexp_replace(F.regexp_extract(s, r"^(\S+)", 1), r"^[.,;:]+|[.,;:]+$", "")
    out = F.when(mentions(F.lower(s), ("mahkeme", "court", "icra")), F.nullif(city, F.lit(""))).otherwise(s)
    return let(out, lambda own: F.when(F.length(own) <= 40, own))


def told(text: Column) -> Column:
    """struct<low, named>: what ``meta`` reads from a text more than once, its lower case and the parties that it names."""
    return F.struct(F.lower(text).alias("low"), parties(text).alias("named"))


def meta(values: dict[str, Column], told: Column) -> dict[str, Column]:
    """The contract's particulars that the text (``told`` of it) bears out, with currency, exchange basis and parties filled in from it."""
    low, named = told["low"], told["named"]
    money, fx = {c: currency_mentioned(low, c) for c in CURRENCIES}, {b: fx_mentioned(low, b) for b in (*FX_DAYS, "sabit_kur")}
    present = lambda k: F.when(party_present(low, values[k]), stripped(values[k]))
    return {
        "otel_adi": F.coalesce(present("otel_adi"), named["hotel"]), "acente_adi": F.coalesce(present("acente_adi"), named["agency"]),
        "para_birimi": let(F.upper(stripped(values["para_birimi"])), lambda code: F.coalesce(borne_out(code, money), only(money))), "kur_esasi": let(enum_text(values["kur_esasi"]), lambda basis: F.coalesce(borne_out(basis, fx), first(fx))),
        "yetkili_mahkeme": let(court(values["yetkili_mahkeme"]), lambda city: F.when(F.contains(low, F.lower(city)), city)),
        "sozlesme_tipi": let(enum_text(values["sozlesme_tipi"]), lambda kind: borne_out(kind, {k: mentions(low, v) for k, v in CONTRACT_TYPES.items()})),
        "sezon": let(enum_text(values["sezon"]), lambda season: borne_out(season, {k: mentions(low, v) for k, v in SEASONS.items()})),
    }


def sub_periods(rows: Column) -> Column:
    """Sub-periods (name, start, end) if all of them are whole, else none."""
    whole = lambda x: (F.coalesce(stripped(x["name"]), F.lit("")) != "") & x["start"].rlike(r"^\d{4}-\d{2}-\d{2}$") & x["end"].rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(F.forall(rows, lambda x: F.coalesce(whole(x), F.lit(False))), rows).otherwise(F.filter(rows, lambda x: F.lit(False)))
