"""Validation of JSON against a schema: the schema is turned into one column of messages.

Types, enumerations, required and additional keys, bounds, numbers of items and dates are
understood, for objects, their properties and the items of arrays at every depth. A message is
``alan=<path> kisit=<keyword>``; the root's path is ``(kök)``, parts are joined by ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline.functions.bind import let
from pactline.operators.normalize import DOMAINS, fields, is_of, items

_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
_NONE = "array<string>"


def _is_type(v: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(v, "$", "double")
        return is_of(kind, *_KINDS["number"]) & (number == F.floor(number))
    return is_of(kind, *_KINDS[name])


def _message(path: Column, keyword: str) -> Column:
    return F.concat(F.lit("alan="), F.when(path == "", "(kök)").otherwise(path), F.lit(f" kisit={keyword}"))


def _child(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def violations(v: Column, schema: dict, path: Column | None = None) -> Column:
    """The messages of one value that is there; an array in the order of the schema's keys. The value, its kind and its fields are read once."""
    path = F.lit("") if path is None else path
    read = {"v": v, "kind": F.schema_of_variant(v)} | ({"fields": fields(v)} if "required" in schema or "properties" in schema else {})
    return let(F.struct(*(c.alias(k) for k, c in read.items())), lambda b: _violations(b, schema, path))


def _violations(b: Column, schema: dict, path: Column) -> Column:
    v, kind = b["v"], b["kind"]
    none = F.array().cast(_NONE)
    names_ = lambda: F.coalesce(F.map_keys(b["fields"]), none)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_number, is_object, is_array = is_of(kind, *_KINDS["number"]), is_of(kind, "OBJECT"), is_of(kind, "ARRAY")
    broken: list[tuple[str, Column]] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        broken.append(("type", ~F.greatest(*(_is_type(v, kind, n) for n in names), F.lit(False))))
    if "enum" in schema:
        broken.append(("enum", ~(is_of(kind, "STRING") & text.isin(*schema["enum"]))))
    if schema.get("format") == "date":
        broken.append(("format", is_of(kind, "STRING") & (~text.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(text, "yyyy-MM-dd").isNull())))
    if "minimum" in schema:
        broken.append(("minimum", is_number & (number < schema["minimum"])))
    if "maximum" in schema:
        broken.append(("maximum", is_number & (number > schema["maximum"])))
    if "minItems" in schema:
        broken.append(("minItems", is_array & (F.size(items(v)) < schema["minItems"])))
    if "required" in schema:
        broken.append(("required", is_object & (F.size(F.array_except(F.array(*map(F.lit, schema["required"])), names_())) > 0)))
    own = list(schema.get("properties", {}))
    if schema.get("additionalProperties") is False:
        broken.append(("additionalProperties", is_object & (F.size(F.array_except(names_(), F.array(*map(F.lit, own)))) > 0)))
    parts = [F.array_compact(F.array(*(F.when(wrong, _message(path, keyword)) for keyword, wrong in broken)))] if broken else []
    inner = lambda k: lambda x: F.when(x.isNotNull(), violations(x, schema["properties"][k], _child(path, F.lit(k)))).otherwise(none)
    for k in own:
        parts.append(let(F.try_element_at(b["fields"], F.lit(k)), inner(k)))
    if "items" in schema:
        each = F.transform(items(v), lambda e, i: violations(e, schema["items"], _child(path, i.cast("string"))))
        parts.append(F.coalesce(F.flatten(each), none))
    if isinstance(schema.get("additionalProperties"), dict):
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        each = F.transform(entries, lambda e: violations(e["value"], schema["additionalProperties"], _child(path, e["key"])))
        parts.append(F.coalesce(F.flatten(each), none))
    return F.flatten(F.array(*parts)) if parts else none


#: keywords that ``_fits`` understands, by type
_PLAIN = {"object": {"type", "properties", "required", "additionalProperties"}, "array": {"type", "items", "minItems"}, "": {"type", "enum", "format", "minimum", "maximum"}}


def _fits(v: Column, schema: dict) -> Column:
    """Whether a value that is there breaks nothing: stops at the first fault, looks only at fields that are there, and makes no messages."""
    name = schema.get("type")
    names = name if isinstance(name, list) else [name]
    plain = "" if all(n in _KINDS and n not in ("object", "array") or n == "integer" for n in names) else name
    if not isinstance(plain, str) or not set(schema) <= _PLAIN.get(plain, set()):
        return F.size(violations(v, schema)) == 0
    if plain == "object":
        more, own = schema.get("additionalProperties", True), schema.get("properties", {})

        def field(e: Column) -> Column:
            others, out = F.lit(more is not False), None
            for k, inner in own.items():
                out = (F if out is None else out).when(e["key"] == k, _fits(e["value"], inner))
            known = others if out is None else out.otherwise(others)
            return known & _fits(e["value"], more) if isinstance(more, dict) else known

        def whole(m: Column) -> Column:
            out = m.isNotNull()
            if schema.get("required"):
                out = out & (F.size(F.array_except(F.array(*map(F.lit, schema["required"])), F.map_keys(m))) == 0)
            return out & F.forall(F.map_entries(m), field)

        return let(fields(v), whole)
    if plain == "array":
        each = lambda rows: F.forall(rows, lambda e: _fits(e, schema["items"])) if "items" in schema else F.lit(True)
        return let(items(v), lambda rows: rows.isNotNull() & (F.size(rows) >= schema.get("minItems", 0)) & each(rows))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")

    def scalar(kind: Column) -> Column:
        is_text, is_number = is_of(kind, "STRING"), is_of(kind, *_KINDS["number"])
        out = F.lit(False)
        for n in names:
            out = out | _is_type(v, kind, n)
        if "enum" in schema:
            out = out & is_text & text.isin(*schema["enum"])
        if schema.get("format") == "date":
            out = out & (~is_text | let(text, lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()))
        for keyword, apart in (("minimum", lambda limit: number < limit), ("maximum", lambda limit: number > limit)):
            if keyword in schema:
                out = out & ~(is_number & F.coalesce(apart(schema[keyword]), F.lit(False)))
        return F.coalesce(out, F.lit(False))

    return let(F.schema_of_variant(v), scalar)


def conforms(v: Column, schema: dict) -> Column:
    """A value that is there and breaks nothing."""
    return let(v, lambda x: x.isNotNull() & _fits(x, schema))


def _record(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties} | ({"required": list(required)} if required else {})


def _list(item: dict, **more: int) -> dict:
    return {"type": "array", "items": item} | more


_STRING, _FLAG, _DAY, _NO_DAY = {"type": "string"}, {"type": "boolean"}, {"type": "string", "format": "date"}, {"type": ["string", "null"], "format": "date"}
_COUNT, _AMOUNT = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}
_ENUM = {k: {"type": "string", "enum": list(v)} for k, v in DOMAINS.items()}
#: the contract's schema
CONTRACT = _record(
    ("donem", "oda_kontenjanlari", "fiyatlar", "release", "stop_sale"),
    meta=_record(otel_adi=_STRING, acente_adi=_STRING, sozlesme_tipi=_ENUM["sozlesme_tipi"], sezon=_ENUM["sezon"], para_birimi=_STRING, kur_esasi=_ENUM["kur_esasi"], yetkili_mahkeme=_STRING, imza_tarihi=_NO_DAY),
    donem=_record(("baslangic", "bitis"), baslangic=_NO_DAY, bitis=_NO_DAY, alt_donemler=_list(_record(("ad", "baslangic", "bitis"), ad=_STRING, baslangic=_DAY, bitis=_DAY))),
    oda_kontenjanlari=_list(_record(("oda_tipi", "adet"), oda_tipi=_STRING, adet=_COUNT, aciklama=_STRING), minItems=1),
    fiyatlar=_list(_record(("oda_tipi", "tutar", "birim"), oda_tipi=_STRING, pansiyon=_ENUM["pansiyon"], tutar=_AMOUNT, birim=_ENUM["birim"], alt_donem_ad=_STRING), minItems=1),
    release=_record(("gun",), gun=_COUNT, kapsam=_ENUM["kapsam"], kaynak_ifade=_STRING),
    stop_sale=_list(_record(baslangic=_DAY, bitis=_DAY, kapsam=_STRING, bildirim_yontemi=_ENUM["bildirim_yontemi"], kaynak_ifade=_STRING)),
    opsiyonel=_record(
        cocuk_politikasi=_list(_record(yas_min=_AMOUNT, yas_max=_AMOUNT, indirim_yuzde=_AMOUNT | {"maximum": 100}, ucretsiz=_FLAG, kosul=_STRING)),
        iptal_kosullari=_list(_record(kapsam=_STRING, gun=_COUNT, tazminat_aciklama=_STRING)), no_show=_record(sorumlu_taraf=_ENUM["sorumlu_taraf"], tazminat_aciklama=_STRING),
        overbooking=_record(sorumlu_taraf=_ENUM["sorumlu_taraf"], aciklama=_STRING), odeme=_record(fatura_sonrasi_gun=_COUNT, avans_var=_FLAG, avans_aciklama=_STRING),
    ),
    cikarim_meta={"type": "object", "additionalProperties": _record(guven=_AMOUNT | {"maximum": 1}, kaynak_sayfa={"type": "integer", "minimum": 1}, kaynak_madde=_STRING)},
)
