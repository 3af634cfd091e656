"""Contracts as documents: nine layouts in two languages, extra clauses, and prose of checked values.

A document is a column: blocks that hold nothing are null and leave no trace, and numbered
sections get their numbers after the empty ones are gone. Contracts have the columns of
``synthesis.contracts`` and hotel, agent, currency and city; a null or empty name stands as the
language's general word, a null list as an empty one, and prices without a currency are bare.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.operators.synthesis import Draws, date_text, money_text, number_text

#: fixed values: words and sentences of contracts, by language
CITIES = {"tr": ("Antalya", "Muğla", "İzmir", "İstanbul", "Ankara", "Aydın", "Mersin"), "en": ("Antalya", "London", "Manchester", "Amsterdam", "Berlin")}
DATES, NUMBERS = ("nokta", "iso", "uzun"), ("duz", "tr", "en")
#: family names for made-up parties
FAMILIES = ("Yılmaz", "Aydın", "Şahin", "Kaya", "Güneş", "Whitfield", "Harlow", "Marsden")
CURRENCIES = ("EUR", "GBP", "USD", "TRY")
ROOMS_EN = {"standart": "standard", "suit": "suite", "aile": "family", "deluxe": "penthouse", "balayi": "honeymoon", "engelli": "accessible", "tek_kisilik": "single", "iki_kisilik": "double", "uc_kisilik": "triple"}
ROOMS_PROSE = {"tek_kisilik": "tek kişilik", "iki_kisilik": "iki kişilik", "uc_kisilik": "üç kişilik", "suit": "suit", "balayi": "balayı", "engelli": "özürlü odası", "standart": "normal oda", "aile": "aile", "deluxe": "deluxe"}
SCOPES_EN = {"tüm tesis": "entire property", "standart": "standard", "suit": "suite"}
BOARDS = {
    "tr": {"RO": "sadece oda", "BB": "oda kahvaltı", "HB": "yarım pansiyon", "FB": "tam pansiyon", "AI": "her şey dahil"},
    "en": {"RO": "room only", "BB": "bed and breakfast", "HB": "half board", "FB": "full board", "AI": "all inclusive"},
}
UNITS = {"tr": {"oda_gecelik": "oda / gece", "kisi_gecelik": "kişi / gece"}, "en": {"oda_gecelik": "per room per night", "kisi_gecelik": "per person per night"}}
WORDS = {
    "tr": {
        "hotel": "Otel", "agent": "Acente", "title": "KONTENJAN SÖZLEŞMESİ", "article": "MADDE", "unspecified": "belirtilmemiş",
        "between": "İşbu sözleşme, {agent} ile {hotel} arasında aşağıda belirtilen koşullarla akdedilmiştir.",
        "term": "İşbu sözleşme {begins} tarihinde başlar ve {ends} tarihinde sona erer.", "parts": "Sezon içi fiyat dönemleri:",
        "rooms": "Otel, acenteye şu oda kontenjanını tahsis eder: {list}.", "rooms_head": "Oda tipi | Adet\n---------|-----",
        "prices_head": "Oda tipi | Pansiyon | Tutar | Birim | Dönem\n---------|----------|-------|-------|------", "price": "{what} için {amount} {unit}", "prices": "Fiyatlar: {list}.",
        "release": "Acente, oda kontenjanı ile ilgili son durumu müşterilerin otele girişini {days} gün önce belirler ve isim listesi ile birlikte otele bildirir.",
        "stops": "Otel, aşağıdaki tarih aralıklarında stop-sale uygulayabilir; bildirim yazılı veya e-posta ile yapılır:",
        "headings": ("SÖZLEŞME SÜRESİ", "ODA KONTENJANI", "İSİM LİSTESİ", "STOP-SALE", "FİYATLAR"), "tables": ("Kontenjan tablosu", "Fiyat tablosu"),
        "agreed": "{agent}, {hotel} işletmesi ile kontenjan esasına göre çalışmayı kararlaştırmıştır.", "annex": "EK — FİYAT VE KONTENJAN TABLOLARI",
        "annexes": ("Kontenjan sözleşmesi ekleri", "EK-1 KONTENJAN", "EK-2 FİYATLAR", "EK-3 RELEASE"),
        "letter": ("Sayın yetkili,", "{hotel} olarak {agent} ile yapılacak kontenjan çalışmasının koşulları aşağıdadır.", "Acente, tahsis edilen odaları kendi müşterisine pazarlar; otel, kapasite dahilinde oda bulundurmayı taahhüt eder.", "Saygılarımızla,"),
        "extra": "ÖDEME: Faturalar düzenlenme tarihinden itibaren {days} gün içinde ödenir. Avans bu sözleşmede öngörülmemiştir.\nTEBLİGAT: Taraflar tebligatlarını yazılı olarak veya e-posta yoluyla yapar.\nYETKİLİ MAHKEME: İşbu sözleşmeden doğacak uyuşmazlıklarda {city} Mahkemeleri ve İcra Daireleri yetkilidir.",
    },
    "en": {
        "hotel": "the Hotel", "agent": "the Agent", "title": "ALLOTMENT CONTRACT", "article": "ARTICLE", "unspecified": "unspecified",
        "between": "This contract is entered into by {agent} and {hotel} on the terms below.",
        "term": "This contract runs from {begins} to {ends}.", "parts": "Seasonal rate periods:",
        "rooms": "The Hotel allocates the following allotment to the Agent: {list}.", "rooms_head": "Room type | Allotment\n----------|----------",
        "prices_head": "Room type | Board | Rate | Unit | Period\n----------|-------|------|------|--------", "price": "{what} at {amount} {unit}", "prices": "Rates are {unit}. {list}.",
        "release": "The release period is {days} days prior to arrival. Unsold allotment reverts to the Hotel unless covered by a name list.",
        "stops": "Stop-sale periods (the Hotel may close sales on the dates below; notice in writing or by e-mail):",
        "headings": ("TERM", "ALLOTMENT", "NAME LIST", "STOP-SALE", "RATES"), "tables": ("Allotment table", "Rate table"),
        "agreed": "{agent} and {hotel} agree to cooperate on an allotment basis.", "annex": "ANNEX — RATE AND ALLOTMENT TABLES",
        "annexes": ("Allotment contract annexes", "ANNEX-1 ALLOTMENT", "ANNEX-2 RATES", "ANNEX-3 RELEASE"),
        "letter": ("Dear Sir/Madam,", "Please find below the allotment terms agreed between {hotel} and {agent}.", "The Agent markets the allocated rooms; the Hotel undertakes to hold the inventory.", "Yours faithfully,"),
        "extra": "PAYMENT: Invoices are payable within {days} days of issue. No advance payment is required under this contract.\nNOTICES: Notices shall be given in writing or by e-mail.\nJURISDICTION: The courts of {city} shall have exclusive jurisdiction.",
    },
}
AGREEMENT = {
    "title": "ALLOTMENT AGREEMENT\nbetween {agent} (the Agent) and {hotel} (the Hotel)", "agreed": "The Parties agree the allotment of rooms, the release period, contracted rates and stop-sale periods as follows.",
    "headings": ("CONTRACT PERIOD", "ALLOTMENT", "RELEASE PERIOD", "RATES", "STOP-SALE PERIODS"), "rooms": "The Hotel allocates the following rooms to the Agent:", "rates": "Rates are {unit}. All rates are quoted in {currency}.",
}
CONFIRMATION = {
    "title": "CONFIDENTIAL — ALLOTMENT AND RATE CONFIRMATION", "parties": "Hotel: {hotel}\nTour operator: {agent}\nCurrency: {currency}", "term": "Season / validity: {term}",
    "rooms": "1. Inventory commitment\nThe Hotel allocates the inventory below. These rooms are held for the Agent until the release period lapses.", "rates": "2. Selling rates\nRates are {unit} unless a line states otherwise.",
    "release": "3. Release period", "stops": "4. Stop-sale periods", "end": "Please sign and return one copy of this confirmation.",
}
SCHEDULES = {
    "title": "CONTRACTING SCHEDULES — {hotel} / {agent}\nValidity: {term}\n", "no_term": "as stated in the main agreement", "rooms": "SCHEDULE A — ROOM ALLOTMENT\nRoom category | Units committed\n----------------|------------------",
    "rates": "\nSCHEDULE B — RATES\nRates are per room per night unless a row is marked per person per night.", "release": "\nSCHEDULE C — RELEASE PERIOD AND STOP-SALE PERIODS\nRelease period: {days} days before check-in. {release}", "parts": "\nSeasonal rate periods (for Schedule B):",
}
PROSE = {
    "hotel": "Argos Otel", "agent": "Side Turizm", "currency": "GBP", "no_term": "Sözleşme süresi bu belgede tarih olarak belirtilmemiştir.", "rooms": "Otelin acenteye tahsis ettiği kontenjan:",
    "rate": "Faturalamada döviz kuru esas alınır.", "bank": "Faturalamada müşterinin otele giriş günündeki T.C. Merkez Bankası döviz satış kuru esas alınır.", "currency_line": "Fiyatlar {currency} cinsindendir. {rate}",
    "court": "İşbu sözleşmeden doğacak uyuşmazlıklarda {city} mahkemeleri yetkilidir.", "prices": "Oda fiyatları (oda / gece, {currency}):",
    "headings": ("MADDE 1 — SÖZLEŞME SÜRESİ", "MADDE 2 — ODA KONTENJANI", "MADDE 3 — İSİM LİSTESİ", "MADDE 4 — NO SHOW", "MADDE 5 — KAPASİTE AŞIMI", "MADDE 6 — ÖDEME VE KUR", "MADDE 7 — YETKİLİ MAHKEME", "MADDE 8 — FİYATLAR"),
}


def _looked_up(value: Column, words: dict[str, str]) -> Column:
    """The word for a value, or the value itself."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), value), value)


def _filled(pattern: str, **values: Column) -> Column:
    """A pattern with its {names} filled; null if a value is null."""
    out, rest = [], pattern
    while rest:
        before, brace, rest = rest.partition("{")
        name, _, rest = rest.partition("}") if brace else ("", "", rest)
        out += [F.lit(before)] * bool(before) + ([values[name]] if name else [])
    return F.concat(*out)


def _joined(separator: str, *blocks: Column) -> Column:
    """Blocks in order without the null ones."""
    return F.concat_ws(separator, *blocks)


def _under(heading: str, body: Column, gap: str = "\n") -> Column:
    return F.concat(F.lit(heading + gap), body)


def _lines(rows: Column, line: Callable[[Column], Column], separator: str = "\n") -> Column:
    return F.coalesce(F.array_join(F.transform(rows, line), separator), F.lit(""))


def _styled(style: Column | str, styles: tuple[str, ...], text: Callable[[str], Column]) -> Column:
    """A text in a given style, or in the one that a column names (the last one for any other name)."""
    if isinstance(style, str):
        return text(style)
    *some, last = styles
    return F.coalesce(*(F.when(style == x, text(x)) for x in some), text(last))


def room_label(room: Column, quantity: Column, language: str) -> Column:
    """A room's name in a text; in English a suite with an odd quantity is a junior suite."""
    if language == "tr":
        return room
    return F.when((room == "suit") & (F.pmod(quantity, F.lit(2)) == 1), "junior suite").otherwise(_looked_up(room, ROOMS_EN))


@dataclass(frozen=True)
class Blocks:
    """The parts of one contract's document in one language and one way to write dates and numbers."""

    language: str
    dates: Column | str
    numbers: Column | str
    glued: Column | bool = False

    def words(self, key: str, at: int | None = None) -> str:
        found = WORDS[self.language][key]
        return found if at is None else found[at]

    def _name(self, column: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(self.words(column)))

    @property
    def parties(self) -> dict[str, Column]:
        return {"hotel": self._name("hotel"), "agent": self._name("agent")}

    @property
    def currency(self) -> Column:
        return F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("EUR"))

    def day(self, day: Column) -> Column:
        return _styled(self.dates, DATES, lambda style: date_text(day, style, self.language))

    def number(self, n: Column) -> Column:
        return _styled(self.numbers, NUMBERS, lambda style: number_text(n, style))

    def span(self, row: Column) -> Column:
        return F.concat_ws(" – ", self.day(row["begins"]), self.day(row["ends"]))

    def title(self) -> Column:
        return _filled("{title}\n{agent} – {hotel}\n", title=F.lit(self.words("title")), **self.parties)

    def term(self) -> Column:
        """Null unless both days are known."""
        known = F.col("begins").isNotNull() & F.col("ends").isNotNull()
        return F.when(known, _filled(self.words("term"), begins=self.day(F.col("begins")), ends=self.day(F.col("ends"))))

    def parts(self) -> Column:
        return F.when(F.size("parts") > 0, _under(self.words("parts"), _lines(F.col("parts"), lambda p: F.concat(p["name"], F.lit(": "), self.span(p)))))

    def room(self, row: Column) -> Column:
        return room_label(row["room"], row["quantity"], self.language)

    def rooms_list(self) -> Column:
        each = _lines(F.col("rooms"), lambda r: F.concat_ws(" ", self.number(r["quantity"]), self.room(r)), ", ")
        return _filled(self.words("rooms"), list=each)

    def room_rows(self) -> Column:
        return _lines(F.col("rooms"), lambda r: F.concat_ws(" | ", self.room(r), self.number(r["quantity"])))

    def rooms_bullets(self) -> Column:
        return _lines(F.col("rooms"), lambda r: F.concat(F.lit("- "), self.number(r["quantity"]), F.lit(" "), self.room(r), F.lit(" rooms")))

    def rooms_table(self) -> Column:
        return self._table("rooms_head", "rooms", self.room_rows())

    def _table(self, head: str, column: str, rows: Column) -> Column:
        """A table without rows is its head."""
        return F.when(F.size(F.col(column)) > 0, _under(self.words(head), rows)).otherwise(self.words(head))

    def _priced(self, row: Column) -> tuple[Column, Column, Column]:
        """A price's room as its allotment names it, its amount and its unit."""
        of = F.get(F.filter(F.col("rooms"), lambda r: r["room"] == row["room"]), 0)["quantity"]
        amount = self.number(row["amount"])
        return room_label(row["room"], of, self.language), F.when(F.lit(self.glued), money_text(amount, F.col("currency"), True)).otherwise(money_text(amount, F.col("currency"))), _looked_up(row["unit"], UNITS[self.language])

    def prices_table(self) -> Column:
        def line(row: Column) -> Column:
            room, amount, unit = self._priced(row)
            return F.concat_ws(" | ", room, F.coalesce(F.nullif(row["board"], F.lit("")), F.lit(self.words("unspecified"))), amount, unit, F.coalesce(F.nullif(row["part"], F.lit("")), F.lit("-")))

        return self._table("prices_head", "prices", _lines(F.col("prices"), line))

    def unit(self) -> Column:
        """The first price's unit, per room where there is none."""
        return F.coalesce(_looked_up(F.get(F.col("prices"), 0)["unit"], UNITS["en"]), F.lit(UNITS["en"]["oda_gecelik"]))

    def prices_list(self) -> Column:
        def sentence(row: Column) -> Column:
            room, amount, unit = self._priced(row)
            board = F.when(F.nullif(row["board"], F.lit("")) != "belirtilmemis", F.concat(F.lit(", "), _looked_up(row["board"], BOARDS[self.language])))
            part = F.when(row["part"] != "", F.concat(F.lit(" ("), row["part"], F.lit(")")))
            return _filled(self.words("price"), what=F.concat_ws("", room, board, part), amount=amount, unit=unit)

        return _filled(self.words("prices"), unit=self.unit(), list=_lines(F.col("prices"), sentence, "; "))

    def release(self) -> Column:
        return _filled(self.words("release"), days=F.coalesce(F.col("release_days").cast("string"), F.lit("")))

    def stops(self) -> Column:
        def line(row: Column) -> Column:
            scope = row["scope"] if self.language == "tr" else _looked_up(row["scope"], SCOPES_EN)
            return F.concat_ws("", F.lit("- "), self.span(row), F.when(scope != "", F.concat(F.lit(" ("), scope, F.lit(")"))))

        return F.when(F.size("stop_sale") > 0, _under(self.words("stops"), _lines(F.col("stop_sale"), line)))

    def numbered(self, *sections: tuple[str, Column]) -> Column:
        """Sections that hold something, with their numbers."""
        some = F.array_compact(F.array(*(F.when(body.isNotNull(), F.struct(F.lit(h).alias("h"), body.alias("b"))) for h, body in sections)))
        article = F.lit(self.words("article") + " ")
        return F.array_join(F.transform(some, lambda s, k: F.concat(article, (k + 1).cast("string"), F.lit(" — "), s["h"], F.lit("\n"), s["b"])), "\n\n")

    def dated(self) -> Column:
        """The term and, below it, its parts; null without a term."""
        return F.when(self.term().isNotNull(), _joined("\n\n", self.term(), self.parts()))


class Ready(Blocks):
    """Blocks that stand in a column of structs for each language, for layouts that are chosen by row."""

    NAMES = ("term", "parts", "rooms_list", "room_rows", "rooms_bullets", "rooms_table", "prices_table", "prices_list", "unit", "release", "stops")

    @staticmethod
    def column(language: str) -> str:
        return f"__blocks_{language}"


for _name in Ready.NAMES:
    setattr(Ready, _name, lambda self, name=_name: F.col(self.column(self.language))[name])


def _articles(b: Blocks) -> Column:
    h = b.words("headings")
    body = b.numbered((h[0], b.dated()), (h[1], b.rooms_list()), (h[2], b.release()), (h[3], b.stops()), (h[4], b.prices_list()))
    return _joined("\n\n", b.title(), F.concat(_filled(b.words("between"), **b.parties), F.lit("\n")), body)


def _tables(b: Blocks) -> Column:
    rooms, prices = b.words("tables")
    return _joined("\n\n", b.title(), b.dated(), _under(rooms, b.rooms_table()), _under(prices, b.prices_table()), b.release(), b.stops())


def _paragraphs(b: Blocks) -> Column:
    return _joined("\n\n", _joined(" ", _filled(b.words("agreed"), **b.parties), b.term(), b.rooms_list(), b.release()), b.parts(), b.prices_list(), b.stops())


def _mixed(b: Blocks) -> Column:
    return _joined("\n\n", _articles(b), F.lit(b.words("annex")), b.rooms_table(), b.prices_table())


def _annexes(b: Blocks) -> Column:
    head, *names = b.words("annexes")
    top = _filled("{agent} / {hotel}\n{head}\n{term}", head=F.lit(head), term=F.coalesce(b.term(), F.lit("")), **b.parties)
    return _joined("\n\n", top, *(_under(n, body) for n, body in zip(names, (b.rooms_table(), b.prices_table(), b.release()))), b.stops())


def _letter(b: Blocks) -> Column:
    dear, about, sells, end = b.words("letter")
    # without closed ranges the greeting has an empty line more before it
    close = F.coalesce(F.concat(b.stops(), F.lit(f"\n\n{end}")), F.lit(f"\n{end}"))
    return _joined("\n\n", F.lit(dear), _joined(" ", _filled(about, **b.parties), b.term(), F.lit(sells)), b.rooms_list(), b.prices_table(), b.release(), close)


def _agreement(b: Blocks) -> Column:
    h, t = AGREEMENT["headings"], AGREEMENT
    rooms = _under(t["rooms"], b.rooms_bullets())
    rates = F.concat(_filled(t["rates"], unit=b.unit(), currency=b.currency), F.lit("\n"), b.prices_table())
    body = b.numbered((h[0], b.dated()), (h[1], rooms), (h[2], b.release()), (h[3], rates), (h[4], b.stops()))
    return _joined("\n\n", F.concat(_filled(t["title"], **b.parties), F.lit("\n")), F.lit(t["agreed"] + "\n"), body)


def _confirmation(b: Blocks) -> Column:
    t = CONFIRMATION
    rates = F.concat(_filled(t["rates"], unit=b.unit()), F.lit("\n"), b.prices_list())
    dated = F.when(b.term().isNotNull(), _joined("\n\n", _filled(t["term"], term=b.term()), b.parts()))
    return _joined("\n\n", F.lit(t["title"] + "\n"), F.concat(_filled(t["parties"], currency=b.currency, **b.parties), F.lit("\n")), dated, _under(t["rooms"], b.rooms_table()), rates, _under(t["release"], b.release()), _under(t["stops"], b.stops()), F.lit(t["end"]))


def _schedules(b: Blocks) -> Column:
    t, days = SCHEDULES, F.coalesce(F.col("release_days").cast("string"), F.lit(""))
    title = _filled(t["title"], term=F.coalesce(b.term(), F.lit(t["no_term"])), **b.parties)
    return _joined("\n", title, F.lit(t["rooms"]), F.nullif(b.room_rows(), F.lit("")), _under(t["rates"], b.prices_table()), _filled(t["release"], days=days, release=b.release()), b.stops(), _under(t["parts"], b.parts()))


_COMMON = (_articles, _tables, _paragraphs, _mixed, _annexes, _letter)
#: layouts by language and number; the first three English ones are drawn, the common ones follow
LAYOUTS: dict[str, tuple[Callable[[Blocks], Column], ...]] = {"tr": _COMMON, "en": (_agreement, _confirmation, _schedules, *_COMMON)}


def extra_clauses(language: str) -> Column:
    """Payment, notices and jurisdiction; 15 days where the sum of the city's code points is even, else 30."""
    city = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("Antalya"))
    total = F.aggregate(F.split(city, ""), F.lit(0), lambda n, c: n + F.ascii(c))
    days = F.when(total % 2 == 0, "15").otherwise("30")  # the same in all ways to write numbers
    return F.concat(F.lit("\n"), _filled(WORDS[language]["extra"], days=days, city=city), F.lit("\n"))


def document(language: str, layout: int, dates: Column | str, numbers: Column | str, glued: Column | bool = False, extra: bool = False) -> Column:
    """One layout (numbered from 1) as a column that ends with a line break; styles are given or read from columns."""
    text = LAYOUTS[language][layout - 1](Blocks(language, dates, numbers, glued))
    return F.concat(text, F.lit("\n"), *([extra_clauses(language)] if extra else []))


def with_styles(made: DataFrame, row: str, seed: int) -> DataFrame:
    """``made`` with what is drawn for each document: language, layout, dates, numbers, glued, extra, hotel, agent, currency, city."""
    d = Draws(seed, F.col(row))
    turkish = F.col("language") == "tr"
    name = lambda step, tr, en: F.concat_ws(" ", d.one(FAMILIES, step), F.when(turkish, tr).otherwise(en))
    return made.withColumn("language", F.when(d.real("dil") < 0.5, "tr").otherwise("en")).withColumns({
        "layout": F.when(turkish, d.whole(1, 6, "sablon")).otherwise(d.whole(1, 3, "sablon")), "dates": d.one(DATES, "tarih"), "numbers": d.one(NUMBERS, "sayi"), "glued": d.real("yapisik") < 0.1, "extra": d.real("fazladan") < 0.2,
        "hotel": name("otel", "Otel", "Hotel"), "agent": name("acente", "Turizm", "Travel"), "currency": d.one(CURRENCIES, "para"), "city": F.when(turkish, d.one(CITIES["tr"], "sehir")).otherwise(d.one(CITIES["en"], "sehir")),
    })


def with_documents(styled: DataFrame) -> DataFrame:
    """``styled`` with the column text: each contract in the language, layout and styles of its row; null for a layout there is not."""
    styles = F.col("dates"), F.col("numbers"), F.col("glued")
    # each block is written once for a row, in the row's language, whatever the number of layouts
    blocks = {Ready.column(x): F.when(F.col("language") == x, F.struct(*(getattr(Blocks(x, *styles), n)().alias(n) for n in Ready.NAMES))) for x in LAYOUTS}
    at = lambda x, k: (F.col("language") == x) & (F.col("layout") == k)
    each = [F.when(at(x, k), write(Ready(x, *styles))) for x, layouts in LAYOUTS.items() for k, write in enumerate(layouts, 1)]
    clauses = F.coalesce(*(F.when(F.col("extra") & (F.col("language") == x), extra_clauses(x)) for x in LAYOUTS), F.lit(""))
    return styled.withColumns(blocks).withColumn("text", F.concat(F.coalesce(*each), F.lit("\n"), clauses)).drop(*blocks)


def prose() -> Column:
    """Text of checked values, which gives a scored model its input: rooms, release, penalties, currency, court and prices.

    Besides the columns of contracts: rate_basis, no_show and overbooking; each may be null, and the paragraph of a null or empty one is left out.
    """
    t, h = PROSE, PROSE["headings"]
    of = lambda c: F.nullif(F.col(c), F.lit(""))
    or_default = lambda c: F.coalesce(of(c), F.lit(t[c]))
    currency = or_default("currency")
    plain = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    label = lambda r: _looked_up(r["room"], ROOMS_PROSE)
    rooms = _lines(F.col("rooms"), lambda r: F.concat(F.lit("\n- "), label(r), F.lit(": "), r["quantity"].cast("string"), F.lit(" adet")), "")
    prices = _lines(F.col("prices"), lambda r: F.concat(F.lit("\n- "), label(r), F.lit(": "), plain(r["amount"]), F.lit(" "), currency), "")
    release = _filled(WORDS["tr"]["release"], days=F.coalesce(F.col("release_days"), F.lit(10)).cast("string"))
    rate = F.when(F.col("rate_basis") == "giris_gunu_tcmb", t["bank"]).otherwise(t["rate"])
    bodies = (F.lit(t["no_term"]), F.concat(F.lit(t["rooms"]), rooms), release, of("no_show"), of("overbooking"), _filled(t["currency_line"], currency=currency, rate=rate), _filled(t["court"], city=of("city")), F.concat(_filled(t["prices"], currency=currency), prices))
    head = F.concat(F.lit(WORDS["tr"]["title"] + "\n"), or_default("agent"), F.lit(" – "), or_default("hotel"))
    return F.concat(_joined("\n\n", head, *(_under(x, body) for x, body in zip(h, bodies))), F.lit("\n"))
