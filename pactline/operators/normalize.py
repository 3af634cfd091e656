"""Contract JSON to the canonical schema: notes of what was changed, and typed fields.

The tree is a VARIANT column; its parts are taken out by path, judged by kind, and put
together as structs. Each rule gives a value and, if it changed something, a note with the
field's path. All of it is columns, so it runs where the scan runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions import text as x
from pactline.functions.bind import filled, let

#: fixed values: the keys that each object may have
KEYS = {
    "": ("meta", "donem", "oda_kontenjanlari", "fiyatlar", "release", "stop_sale", "opsiyonel", "cikarim_meta"),
    "meta": ("otel_adi", "acente_adi", "sozlesme_tipi", "sezon", "para_birimi", "kur_esasi", "yetkili_mahkeme", "imza_tarihi"),
    "donem": ("baslangic", "bitis", "alt_donemler"),
    "alt_donemler": ("ad", "baslangic", "bitis"),
    "oda_kontenjanlari": ("oda_tipi", "adet", "aciklama"),
    "fiyatlar": ("oda_tipi", "tutar", "birim", "pansiyon", "alt_donem_ad"),
    "release": ("gun", "kapsam", "kaynak_ifade"),
    "stop_sale": ("baslangic", "bitis", "kapsam", "bildirim_yontemi", "kaynak_ifade"),
    "opsiyonel": ("cocuk_politikasi", "iptal_kosullari", "no_show", "overbooking", "odeme"),
    "cikarim_meta": ("guven", "kaynak_sayfa", "kaynak_madde"),
}
#: fixed values: the values that each enumeration may have
DOMAINS = {
    "sozlesme_tipi": ("tamamen_garantili", "kismen_garantili", "garantisiz", "istege_bagli", "serbest_satis", "blok_rezervasyon", "blok_satin_alma", "belirtilmemis"),
    "sezon": ("yaz", "kis", "yillik", "belirtilmemis"),
    "kur_esasi": ("giris_gunu_tcmb", "cikis_gunu_tcmb", "sabit_kur", "belirtilmemis"),
    "pansiyon": ("RO", "BB", "HB", "FB", "AI", "belirtilmemis"),
    "birim": ("oda_gecelik", "kisi_gecelik"),
    "kapsam": ("isim_listesi", "kontenjan_iadesi", "her_ikisi", "belirtilmemis"),
    "bildirim_yontemi": ("yazili", "faks", "eposta", "sistem", "belirtilmemis"),
    "sorumlu_taraf": ("otel", "acente", "belirtilmemis"),
}
#: fixed values: other spellings of them, folded
ALIASES = {"summer": "yaz", "winter": "kis", "oda/gece": "oda_gecelik", "kisi/gece": "kisi_gecelik", "oda gece": "oda_gecelik", "kisi gece": "kisi_gecelik", "e_posta": "eposta", "email": "eposta"}
#: fixed values: date patterns and the order of their parts, day first but for years of four digits in front
LAYOUTS = {r"^\d{4}([-./])\d{2}\1\d{2}$": "yyyy-MM-dd", r"^\d{1,2}([-./])\d{1,2}\1\d{4}$": "d-M-yyyy"}
MONTHS = x.MONTHS | {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
UNSET = "belirtilmemis"


def part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def is_of(kind: Column, *kinds: str) -> Column:
    """Whether a variant's schema (null: no variant) is of one of the kinds (OBJECT, ARRAY, STRING, BIGINT, ...)."""
    out = F.lit(False)
    for name in kinds:
        out = out | kind.startswith(name)
    return F.coalesce(out, F.lit(False))


def is_kind(v: Column, *kinds: str) -> Column:
    """Whether a variant is there and of one of the kinds."""
    return is_of(F.schema_of_variant(v), *kinds) if len(kinds) == 1 else let(F.schema_of_variant(v), lambda kind: is_of(kind, *kinds))


def is_missing(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def fields(v: Column) -> Column:
    """The fields of an object, null for anything else; a look-up by path costs an exception for each field that is not there."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The elements of an array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def string(v: Column) -> Column:
    """A scalar's text; null for nothing and for an empty text."""
    return filled(F.try_variant_get(v, "$", "string"))


def iso_date(raw: Column) -> Column:
    """``yyyy-MM-dd`` of a date in one of eleven layouts or with a month's name; null if it is none."""
    return let(F.trim(raw), _iso_date)


def _iso_date(s: Column) -> Column:
    out = F.when(s.isNull(), F.lit(None).cast("date"))
    for layout, order in LAYOUTS.items():
        out = out.when(s.rlike(layout), F.try_to_date(F.translate(s, "./", "--"), order))
    named = r"(?i)^(\d{1,2})\s+([A-Za-zÇĞİÖŞÜçğıöşü]+)\s+(\d{4})$"
    table = F.create_map(*(F.lit(y) for kv in MONTHS.items() for y in kv))
    spelled = lambda month: F.concat_ws("-", F.regexp_extract(s, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, named, 1), 2, "0"))
    own = let(F.try_element_at(table, x.fold_turkish(F.regexp_extract(s, named, 2))), lambda month: F.when(month.isNotNull(), F.try_to_date(spelled(month), "yyyy-MM-dd")))
    return F.date_format(out.when(s.rlike(named), own), "yyyy-MM-dd")


def canonical_enum(raw: Column, name: str) -> Column:
    """The value of the enumeration that a text stands for: as it is, folded, by an alias, or the rule of the enumeration."""
    domain = DOMAINS[name]
    alias = F.create_map(*(F.lit(y) for kv in ALIASES.items() for y in kv))
    values = F.create_map(*(F.lit(y) for value in domain for y in (value.lower(), value)))
    low = x.fold_turkish(raw)

    def known(folded: Column) -> Column:
        under = F.replace(F.coalesce(F.try_element_at(alias, folded), folded), F.lit(" "), F.lit("_"))
        return F.try_element_at(values, under)

    own = let(F.regexp_replace(F.replace(low, F.lit("-"), F.lit("_")), r"\s+", " "), known)
    if name == "birim":
        other = F.when(low.contains("kisi") | low.contains("person"), "kisi_gecelik").otherwise("oda_gecelik")
    else:
        other = F.lit(UNSET)
    return F.when(raw.isin(*domain), raw).otherwise(F.coalesce(own, other))


#: struct<value, note> of a value (VARIANT) and its path
Rule = Callable[[Column, Column], Column]
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _pair(value: Column, note: Column) -> Column:
    return F.struct(value.alias("value"), note.alias("note"))


def _known(v: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a value's kind and its text, both read once."""
    return let(F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), lambda b: use(b["kind"], b["text"]))


def _nothing(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def enum(name: str) -> Rule:
    def rule(v: Column, path: Column) -> Column:
        def judged(kind: Column, raw: Column) -> Column:
            value = F.when(_nothing(kind), None).when(kind != "STRING", UNSET).otherwise(canonical_enum(raw, name))
            return let(value, lambda own: _pair(own, F.when(~_nothing(kind) & ((kind != "STRING") | (own != raw)), F.concat(F.lit("enum normalize edildi: "), path))))

        return _known(v, judged)

    return rule


def date(v: Column, path: Column) -> Column:
    """A text that is no date stays as it is."""

    def judged(kind: Column, raw: Column) -> Column:
        day = F.when(kind == "STRING", iso_date(raw))
        return let(day, lambda own: _pair(F.coalesce(own, F.when(raw != "", raw)), F.when(own != raw, F.concat(F.lit("tarih ISO-8601 yapıldı: "), path))))

    return _known(v, judged)


def loose_number(raw: Column) -> Column:
    """Numbers as people write them: a currency at either end, blanks, European and US separators."""
    sign = r"(?:EUR|GBP|USD|TRY|TL|€|£|\$|₺)"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, rf"(?i)^\s*{sign}\s*", ""), rf"(?i){sign}\s*$", ""), r"\s", "")
    plain = lambda t: t.try_cast("double")
    return let(bare, lambda s: (
        F.when(s.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), plain(F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
        .when(s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), plain(F.replace(s, F.lit(","), F.lit(""))))
        .when(s.rlike(r"^\d+,\d{1,2}$"), plain(F.replace(s, F.lit(","), F.lit("."))))
        .when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain(s))
    ))


_CLEANED = "sayı temizlendi: "


def integer(v: Column, path: Column) -> Column:
    """Whole numbers, from text if need be; what cannot be read, and a fraction, becomes 0 with a note."""

    def judged(kind: Column, text: Column) -> Column:
        whole = let(loose_number(text), lambda loose: F.coalesce(F.when(loose == F.floor(loose), loose), F.regexp_extract(text, r"(-?\d+)", 1).try_cast("double")))
        number = F.when(is_of(kind, *_NUMBERS), F.try_variant_get(v, "$", "double"))

        def pair(b: Column) -> Column:
            found = F.coalesce(b["text"], F.when(b["number"] == F.floor(b["number"]), b["number"]))
            note = F.when(found.isNull(), F.concat(path, F.lit(" metinden çıkarıldı"))).when(kind == "STRING", F.concat(F.lit(_CLEANED), path))
            return _pair(F.when(~_nothing(kind), F.coalesce(found, F.lit(0.0))).cast("int"), F.when(~_nothing(kind), note))

        return let(F.struct(F.when(kind == "STRING", whole).alias("text"), number.alias("number")), pair)

    return _known(v, judged)


def number(v: Column, path: Column) -> Column:
    def judged(kind: Column, text: Column) -> Column:
        loose = F.coalesce(loose_number(text), loose_number(filled(F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)", 1))))

        def pair(read: Column) -> Column:
            numeric = is_of(kind, *_NUMBERS)
            value = F.when(_nothing(kind), None).when(numeric, F.try_variant_get(v, "$", "double")).otherwise(F.coalesce(read, F.lit(0.0)))
            note = F.when(read.isNotNull(), F.concat(F.lit(_CLEANED), path)).when(~_nothing(kind) & ~numeric, F.concat(path, F.lit(" metinden çıkarıldı")))
            return _pair(value, note)

        return let(F.when(kind == "STRING", loose), pair)

    return _known(v, judged)


def currency(v: Column, path: Column) -> Column:
    def judged(kind: Column, raw: Column) -> Column:
        def pair(code: Column) -> Column:
            changed = (kind == "STRING") & (F.length(code) == 3) & (code != raw)
            return _pair(F.when(changed, code).otherwise(F.when(raw != "", raw)), F.when(changed, F.concat(F.lit("para birimi normalize edildi: "), path)))

        return let(F.upper(F.trim(raw)), pair)

    return _known(v, judged)


#: rules of the fields that are not plain text
RULES: dict[str, dict[str, Rule]] = {
    "meta": {"sozlesme_tipi": enum("sozlesme_tipi"), "sezon": enum("sezon"), "kur_esasi": enum("kur_esasi"), "imza_tarihi": date, "para_birimi": currency},
    "donem": {"baslangic": date, "bitis": date},
    "alt_donemler": {"baslangic": date, "bitis": date},
    "oda_kontenjanlari": {"adet": integer},
    "fiyatlar": {"tutar": number, "birim": enum("birim"), "pansiyon": enum("pansiyon")},
    "release": {"gun": integer, "kapsam": enum("kapsam")},
    "stop_sale": {"baslangic": date, "bitis": date, "bildirim_yontemi": enum("bildirim_yontemi")},
}


def _object(m: Column, name: str, path: Column) -> Column:
    """struct<value: struct of the object's known fields, notes: array<string>> of the fields of one object."""
    rules = RULES[name]
    names = [k for k in KEYS[name] if k != "alt_donemler"]
    ruled = lambda k: lambda e: rules[k](e, F.concat(path, F.lit(f".{k}")))
    field = lambda k: F.try_element_at(m, F.lit(k))
    found = F.struct(*((let(field(k), ruled(k)) if k in rules else string(field(k))).alias(k) for k in names))
    value = lambda b: F.struct(*((b[k]["value"] if k in rules else b[k]).alias(k) for k in names))
    return let(found, lambda b: F.struct(value(b).alias("value"), F.array_compact(F.array(*(b[k]["note"] for k in rules))).alias("notes")))


def _objects(rows: Column, name: str, path: str) -> Column:
    """``_object`` of each element's fields; elements that are no objects are null."""
    at = lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
    return F.transform(F.coalesce(rows, F.array().cast("array<map<string,variant>>")), lambda m, i: F.when(m.isNotNull(), _object(m, name, at(i))))


def _unknown(m: Column, name: str, path: Column | None) -> Column:
    """Notes of the keys that an object may not have, given its fields; none for anything else."""
    prefix = F.lit("") if path is None else F.concat(path, F.lit("."))
    none = F.array().cast("array<string>")
    noted = lambda extra: F.when(F.size(extra) > 0, F.transform(F.sort_array(extra), lambda k: F.concat(F.lit("bilinmeyen alan atıldı: "), prefix, k))).otherwise(none)
    return let(F.coalesce(F.array_except(F.map_keys(m), F.array(*map(F.lit, KEYS[name]))), none), noted)


def _unknown_each(rows: Column, name: str, path: str) -> Column:
    at = lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
    return F.coalesce(F.flatten(F.transform(rows, lambda m, i: _unknown(m, name, at(i)))), F.array().cast("array<string>"))


def normalized(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``doc`` (the canonical struct) and ``notes`` (array<string>) of the contract JSON in a column.

    What is no JSON object counts as an empty one. A stop_sale inside the period moves to the
    root; unknown keys go; required roots of a wrong kind become empty; a release given as an
    array becomes its first object with anything in it; then each field has its rule. Rooms
    without a type or number, prices without type, amount or unit, and sub-periods without
    name or dates are left out of ``doc``.
    """
    df = df.withColumn("__f", fields(F.try_parse_json(text)))
    root = lambda k: F.try_element_at("__f", F.lit(k))
    df = df.withColumns({f"__{k}": fields(root(k)) for k in ("donem", "meta")} | {f"__{k}": root(k) for k in ("release", "opsiyonel", "cikarim_meta")} | {"__own": items(root("stop_sale")), "__stop": root("stop_sale").isNotNull()})
    donem, meta, release, own = (F.col(f"__{k}") for k in ("donem", "meta", "release", "own"))
    df = df.withColumns({"__nested": F.try_element_at(donem, F.lit("stop_sale")), "__release_fields": fields(release)})
    nested, lifted, is_donem, is_release = F.col("__nested"), F.col("__nested").isNotNull(), donem.isNotNull(), F.col("__release_fields").isNotNull()
    both = let(items(nested), lambda more: F.when(more.isNotNull(), F.when(own.isNotNull(), F.concat(own, more)).otherwise(more)).when(~F.col("__stop"), F.array(nested)).otherwise(own))
    usable = F.get(F.filter(_each(items(release)), lambda m: m.isNotNull() & (F.size(m) > 0)), 0)
    # arrays as those of their elements' fields, which are read once
    df = df.withColumns({
        "__rooms": _each(items(root("oda_kontenjanlari"))), "__prices": _each(items(root("fiyatlar"))), "__stops": _each(F.when(lifted, both).otherwise(own)), "__alts": _each(items(F.try_element_at(donem, F.lit("alt_donemler")))),
        "__rel": F.when(is_release, F.col("__release_fields")).otherwise(usable),
    })
    rel = F.col("__rel")
    none = F.array().cast("array<string>")
    filled = lambda wrong, path: F.when(wrong, F.lit(f"zorunlu alan dolduruldu: {path}"))
    lacks = lambda m, k: m.isNotNull() & F.try_element_at(m, F.lit(k)).isNull()
    required = F.array_compact(F.array(
        filled(~is_donem, "donem"), filled(lacks(donem, "baslangic"), "donem.baslangic"), filled(lacks(donem, "bitis"), "donem.bitis"),
        filled(F.col("__rooms").isNull(), "oda_kontenjanlari"), filled(F.col("__prices").isNull(), "fiyatlar"),
        F.when(~is_release & rel.isNotNull(), F.lit("release dizi yerine nesne yapıldı")),
        filled(rel.isNull(), "release"), filled(lacks(rel, "gun"), "release.gun"), filled(F.col("__stops").isNull(), "stop_sale"),
    ))
    pruned = F.concat(
        _unknown(F.col("__f"), "", None), _unknown(meta, "meta", F.lit("meta")),
        F.filter(_unknown(donem, "donem", F.lit("donem")), lambda n: n != "bilinmeyen alan atıldı: donem.stop_sale"),
        _unknown_each(F.col("__alts"), "alt_donemler", "donem.alt_donemler"),
        _unknown_each(F.col("__rooms"), "oda_kontenjanlari", "oda_kontenjanlari"), _unknown_each(F.col("__prices"), "fiyatlar", "fiyatlar"),
        _unknown(F.col("__release_fields"), "release", F.lit("release")),
        _unknown_each(F.col("__stops"), "stop_sale", "stop_sale"), F.when(F.col("__opsiyonel").isNull(), none).otherwise(_unknown(fields(F.col("__opsiyonel")), "opsiyonel", F.lit("opsiyonel"))),
        F.when(F.col("__cikarim_meta").isNull(), none).otherwise(cikarim_notes(F.col("__cikarim_meta"))),
    )
    df = df.withColumns({
        "__m": F.when(meta.isNotNull(), _object(meta, "meta", F.lit("meta"))), "__d": F.when(is_donem, _object(donem, "donem", F.lit("donem"))),
        "__a": _objects(F.col("__alts"), "alt_donemler", "donem.alt_donemler"), "__r": _objects(F.col("__rooms"), "oda_kontenjanlari", "oda_kontenjanlari"),
        "__p": _objects(F.col("__prices"), "fiyatlar", "fiyatlar"), "__l": F.when(rel.isNotNull(), _object(rel, "release", F.lit("release"))), "__s": _objects(F.col("__stops"), "stop_sale", "stop_sale"),
        "__fixed": F.concat(F.when(lifted, F.array(F.lit("stop_sale donem içinden üst düzeye taşındı"))).otherwise(none), pruned, required),
        "__o": F.when(F.col("__opsiyonel").isNotNull(), optional_blocks(F.col("__opsiyonel"))),
    })
    one = lambda c: F.coalesce(F.col(f"{c}.notes"), none)
    each = lambda c: F.coalesce(F.flatten(F.array_compact(F.col(f"{c}.notes"))), none)
    rows = lambda c, *there: F.filter(F.col(f"{c}.value"), lambda e: _all(e.isNotNull(), *(e[k].isNotNull() for k in there)))
    notes = F.concat(F.col("__fixed"), one("__m"), one("__d"), each("__a"), each("__r"), each("__p"), one("__l"), each("__s"), one("__o"))
    period = F.struct(F.col("__d.value.baslangic").alias("baslangic"), F.col("__d.value.bitis").alias("bitis"), rows("__a", "ad", "baslangic", "bitis").alias("alt_donemler"))
    doc = F.struct(
        F.col("__m.value").alias("meta"), period.alias("donem"), rows("__r", "oda_tipi", "adet").alias("oda_kontenjanlari"), rows("__p", "oda_tipi", "tutar", "birim").alias("fiyatlar"),
        F.when(F.col("__l.value.gun").isNotNull(), F.col("__l.value")).alias("release"), rows("__s").alias("stop_sale"), F.col("__o.value").alias("opsiyonel"),
    )
    out = df.withColumns({"doc": doc, "notes": notes})
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def _each(rows: Column) -> Column:
    """The fields of each element, null for elements that are no objects."""
    return F.transform(rows, fields)


def _all(first: Column, *more: Column) -> Column:
    for c in more:
        first = first & c
    return first


def cikarim_notes(v: Column) -> Column:
    """Notes of unknown keys in each entry of the extraction's own metadata."""
    noted = lambda own: F.transform(F.sort_array(F.map_keys(own)), lambda k: _unknown(fields(F.try_element_at(own, k)), "cikarim_meta", F.concat(F.lit("cikarim_meta."), k)))
    return F.coalesce(F.flatten(let(fields(v), noted)), F.array().cast("array<string>"))


def optional_blocks(v: Column) -> Column:
    """struct<value, notes> of the optional blocks; the responsible party follows its enumeration."""
    return let(v, _optional_blocks)


def _optional_blocks(v: Column) -> Column:
    party, real = enum("sorumlu_taraf"), lambda e, k: F.when(is_kind(part(e, k), "BIGINT", "DECIMAL", "DOUBLE"), part(e, k, "double"))
    whole = lambda e, k: let(real(e, k), lambda n: F.when(n == F.floor(n), n.cast("int")))
    flag = lambda e, k: F.when(is_kind(part(e, k), "BOOLEAN"), part(e, k, "boolean"))
    text = lambda e, k: string(part(e, k)).alias(k)
    each = lambda k, make: F.transform(F.filter(items(part(v, k)), lambda e: is_kind(e, "OBJECT")), make)
    show, over, pay = (part(v, k) for k in ("no_show", "overbooking", "odeme"))
    shown = party(part(show, "sorumlu_taraf"), F.lit("opsiyonel.no_show.sorumlu_taraf"))
    overed = party(part(over, "sorumlu_taraf"), F.lit("opsiyonel.overbooking.sorumlu_taraf"))
    value = F.struct(
        each("cocuk_politikasi", lambda e: F.struct(*(real(e, k).alias(k) for k in ("yas_min", "yas_max", "indirim_yuzde")), flag(e, "ucretsiz").alias("ucretsiz"), text(e, "kosul"))).alias("cocuk_politikasi"),
        each("iptal_kosullari", lambda e: F.struct(text(e, "kapsam"), whole(e, "gun").alias("gun"), text(e, "tazminat_aciklama"))).alias("iptal_kosullari"),
        F.when(is_kind(show, "OBJECT"), F.struct(shown["value"].alias("sorumlu_taraf"), text(show, "tazminat_aciklama"))).alias("no_show"),
        F.when(is_kind(over, "OBJECT"), F.struct(overed["value"].alias("sorumlu_taraf"), text(over, "aciklama"))).alias("overbooking"),
        F.when(is_kind(pay, "OBJECT"), F.struct(whole(pay, "fatura_sonrasi_gun").alias("fatura_sonrasi_gun"), flag(pay, "avans_var").alias("avans_var"), text(pay, "avans_aciklama"))).alias("odeme"),
    )
    return F.struct(F.when(is_kind(v, "OBJECT"), value).alias("value"), F.array_compact(F.array(shown["note"], overed["note"])).alias("notes"))
