"""Edits of contracts by path, with the provenance of what was edited, and contracts as audit trees.

A contract's fields are the struct ``doc`` of ``normalize.normalized``. Edits (doc_id, seq, path,
value: VARIANT) come as a table and hold in the order of seq; each is accepted or refused by
itself, and of the accepted ones the last for each part of a contract stands. Contracts that no
accepted edit names keep their rows as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions import fields as f
from pactline.operators.normalize import is_kind, is_missing, items, part

#: fixed values: the state in which contracts are closed to edits
APPROVED = "ONAYLANDI"
#: fixed values: names of the fields in paths, and their parts of a contract
META = {"otelAdi": "otel_adi", "acenteAdi": "acente_adi", "sozlesmeTipi": "sozlesme_tipi", "sezon": "sezon", "paraBirimi": "para_birimi", "kurEsasi": "kur_esasi", "yetkiliMahkeme": "yetkili_mahkeme", "imzaTarihi": "imza_tarihi"}
ROOTS = {"donem": "donem", "donem.baslangic": "donem.baslangic", "donem.bitis": "donem.bitis", "odaKontenjanlari": "oda_kontenjanlari", "fiyatlar": "fiyatlar", "release": "release", "stopSale": "stop_sale"}
#: fixed values: spellings of enumerations besides those with underscores
SPELLED = {
    "sozlesme_tipi": {
        "tamamen_garantili": ("tamamen garantili",), "kismen_garantili": ("kısmen garantili",), "garantisiz": (), "istege_bagli": ("isteğe bağlı", "istege bagli"), "serbest_satis": ("serbest satış", "serbest satis"),
        "blok_rezervasyon": ("blok rezervasyon",), "blok_satin_alma": ("blok satın alma", "blok satin alma"), "belirtilmemis": ("belirtilmemiş",),
    },
    "sezon": {"yaz": (), "kis": ("kış",), "yillik": ("yıllık",), "belirtilmemis": ("belirtilmemiş",)},
    "kur_esasi": {"giris_gunu_tcmb": ("giriş günü tcmb", "giris gunu tcmb"), "cikis_gunu_tcmb": ("çıkış günü tcmb", "cikis gunu tcmb"), "sabit_kur": ("sabit kur",), "belirtilmemis": ("belirtilmemiş",)},
}
#: the parts of a contract that an edit can set
PARTS = {**{f"meta_{k}": "string" for k in META.values()}, "begins": "string", "ends": "string"}


def spellings() -> dict[str, str]:
    """Every spelling of a path, and the path that it stands for."""
    paths = {f"meta.{k}": v for k, v in META.items()}
    return {**{k: k for k in (*paths, *ROOTS)}, **{f"meta.{v}": k for k, v in paths.items()}, **{v: k for k, v in ROOTS.items()}}


def canonical_path(path: Column) -> Column:
    """The path that a spelling stands for; null for none."""
    table = F.create_map(*(F.lit(x) for kv in spellings().items() for x in kv))
    return F.try_element_at(table, f.stripped(path))


def schema_path(path: Column) -> Column:
    """A canonical path as the schema names it."""
    table = F.create_map(*(F.lit(x) for kv in {"odaKontenjanlari": "oda_kontenjanlari", "stopSale": "stop_sale"}.items() for x in kv))
    return F.coalesce(F.try_element_at(table, path), path)


def _first(v: Column, *names: str) -> Column:
    """The value of the first of the names that an object has."""
    return F.coalesce(*(part(v, k) for k in names))


def _text(v: Column) -> Column:
    return F.when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _spelled(text: Column, name: str) -> Column:
    known = {y: value for value, more in SPELLED[name].items() for x in (value, *more) for y in (x, x.upper())}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    s = f.stripped(text)
    return F.coalesce(F.try_element_at(table, F.upper(s)), F.try_element_at(table, F.lower(s)))


def _number(v: Column, kind: str) -> Column:
    real = F.when(is_kind(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))
    return F.when(real == F.floor(real), real.cast("int")) if kind == "int" else real


def _listed(v: Column, row, whole) -> Column:
    """The objects of an array as rows, without those that lack something."""
    return F.filter(F.transform(F.filter(items(v), lambda e: is_kind(e, "OBJECT")), row), whole)


def _rooms(v: Column) -> Column:
    row = lambda e: F.struct(f.filled(_text(_first(e, "oda_tipi", "odaTipi"))).alias("oda_tipi"), _number(part(e, "adet"), "int").alias("adet"), f.filled(_text(part(e, "aciklama"))).alias("aciklama"))
    typed = F.transform(f.all_lines(F.coalesce(_text(v), F.lit("")), f.room), lambda r: F.struct(r["room"].alias("oda_tipi"), r["quantity"].alias("adet"), r["note"].alias("aciklama")))
    return F.when(is_kind(v, "ARRAY"), _listed(v, row, lambda r: r["oda_tipi"].isNotNull() & r["adet"].isNotNull())).when(is_missing(v) | is_kind(v, "STRING"), typed)


def _prices(v: Column) -> Column:
    board = lambda e: F.coalesce(f.mapped(_text(part(e, "pansiyon")), f.BOARDS), f.filled(_text(part(e, "pansiyon"))))
    unit = lambda e: F.coalesce(f.mapped(_text(part(e, "birim")), f.UNITS), f.filled(_text(part(e, "birim"))))
    row = lambda e: F.struct(f.filled(_text(_first(e, "oda_tipi", "odaTipi"))).alias("oda_tipi"), _number(part(e, "tutar"), "double").alias("tutar"), unit(e).alias("birim"), board(e).alias("pansiyon"), f.filled(_text(_first(e, "alt_donem_ad", "altDonemAd"))).alias("alt_donem_ad"))
    typed = F.transform(f.all_lines(F.coalesce(_text(v), F.lit("")), f.price), lambda r: F.struct(r["room"].alias("oda_tipi"), r["amount"].alias("tutar"), r["unit"].alias("birim"), r["board"].alias("pansiyon"), F.lit(None).cast("string").alias("alt_donem_ad")))
    return F.when(is_kind(v, "ARRAY"), _listed(v, row, lambda r: r["oda_tipi"].isNotNull() & r["tutar"].isNotNull() & r["birim"].isNotNull())).when(is_missing(v) | is_kind(v, "STRING"), typed)


def _stops(v: Column) -> Column:
    row = lambda e: F.struct(*(f.filled(_text(part(e, k))).alias(k) for k in ("baslangic", "bitis", "kapsam", "bildirim_yontemi", "kaynak_ifade")))
    none = F.lit(None).cast("string")
    typed = F.transform(f.all_lines(F.coalesce(_text(v), F.lit("")), f.stop_sale), lambda r: F.struct(r["start"].alias("baslangic"), r["end"].alias("bitis"), r["scope"].alias("kapsam"), none.alias("bildirim_yontemi"), none.alias("kaynak_ifade")))
    return F.when(is_kind(v, "ARRAY"), _listed(v, row, lambda r: F.lit(True))).when(is_missing(v) | is_kind(v, "STRING"), typed)


def _release(v: Column) -> Column:
    own = F.struct(_number(part(v, "gun"), "int").alias("gun"), f.filled(_text(part(v, "kapsam"))).alias("kapsam"), f.filled(_text(part(v, "kaynak_ifade"))).alias("kaynak_ifade"))
    typed = f.release(_text(v))
    return F.when(is_kind(v, "OBJECT"), F.when(own["gun"].isNotNull(), own)).when(typed.isNotNull(), F.struct(typed["days"].alias("gun"), typed["scope"].alias("kapsam"), F.lit(None).cast("string").alias("kaynak_ifade")))


def read_edits(edits: DataFrame) -> DataFrame:
    """``edits`` with the canonical ``path`` (null for an unknown one), ``valid``, and what the value sets, one column for each part."""
    v, p = F.col("value"), F.col("path")
    rows = edits.select("doc_id", "seq", canonical_path(F.col("path")).alias("path"), "value")
    text = F.when(is_missing(v), F.lit("")).otherwise(f.stripped(_text(v)))  # null for what is no text
    both = F.when(is_kind(v, "OBJECT"), F.struct(f.filled(_text(_first(v, "baslangic", "start"))).alias("start"), f.filled(_text(_first(v, "bitis", "end"))).alias("end"))).otherwise(f.period(_text(v)))
    rows = rows.withColumns({"__text": text, "__both": F.when(p == "donem", both), "oda_kontenjanlari": F.when(p == "odaKontenjanlari", _rooms(v)), "fiyatlar": F.when(p == "fiyatlar", _prices(v)), "release": F.when(p == "release", _release(v)), "stop_sale": F.when(p == "stopSale", _stops(v))})
    meta, fine = {}, F.col("__text").isNotNull()
    for name, key in META.items():
        value = F.col("__text") if key not in SPELLED else F.when(F.col("__text") == "", "").otherwise(_spelled(F.col("__text"), key))
        meta[f"meta.{name}"] = (f"meta_{key}", value)
    valid = F.when(p.isin("donem.baslangic", "donem.bitis"), fine).when(p == "donem", F.col("__both").isNotNull()).when(p == "release", is_kind(v, "OBJECT") | F.col("release").isNotNull())
    for name, column in {"odaKontenjanlari": "oda_kontenjanlari", "fiyatlar": "fiyatlar", "stopSale": "stop_sale"}.items():
        valid = valid.when(p == name, F.col(column).isNotNull())
    for path, (_, value) in meta.items():
        valid = valid.when(p == path, value.isNotNull())
    set_ = {column: F.when(p == path, f.filled(value)) for path, (column, value) in meta.items()}
    set_ |= {"begins": F.when(p == "donem", F.col("__both.start")).when(p == "donem.baslangic", f.filled(F.col("__text"))), "ends": F.when(p == "donem", F.col("__both.end")).when(p == "donem.bitis", f.filled(F.col("__text")))}
    return rows.withColumns({"valid": F.coalesce(valid, F.lit(False)), **set_}).drop("__text", "__both", "value")


#: the paths that set each part
_SETS = {**{f"meta_{v}": (f"meta.{k}",) for k, v in META.items()}, "begins": ("donem", "donem.baslangic"), "ends": ("donem", "donem.bitis"), "oda_kontenjanlari": ("odaKontenjanlari",), "fiyatlar": ("fiyatlar",), "release": ("release",), "stop_sale": ("stopSale",)}


def judged(contracts: DataFrame, edits: DataFrame) -> DataFrame:
    """The read edits with ``outcome``: ``yazildi``, ``bilinmeyen_alan``, ``gecersiz_deger``, ``onayli``, or ``yok`` where there is no such contract."""
    status = contracts.select("doc_id", "status", F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "yok").when(F.col("status").eqNullSafe(F.lit(APPROVED)), "onayli").when(F.col("path").isNull(), "bilinmeyen_alan").when(~F.col("valid"), "gecersiz_deger").otherwise("yazildi")
    return read_edits(edits).join(status, "doc_id", "left").withColumn("outcome", outcome).drop("status", "there")


def applied(contracts: DataFrame, judgements: DataFrame) -> DataFrame:
    """``contracts`` (doc_id, status, doc, provenance: array<struct<path, confidence, manual>>) after the accepted edits of ``judged``, and ``changed``.

    An edited path gets confidence 1.0 and the manual flag, at its place or at the end.
    """
    done = judgements.where("outcome = 'yazildi'")
    # the last edit of each part; a value of null is one too, so it is wrapped
    last = {c: F.max_by(F.when(F.col("path").isin(*paths), F.struct(F.col(c).alias("v"))), F.when(F.col("path").isin(*paths), F.col("seq"))).alias(f"__{c}") for c, paths in _SETS.items()}
    paths = F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("__paths")  # of one contract's edits
    both = contracts.join(done.groupBy("doc_id").agg(*last.values(), paths), "doc_id", "left")
    new = lambda c, old: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(old)
    doc = F.col("doc")
    meta = F.struct(*(new(f"meta_{k}", doc["meta"][k]).alias(k) for k in META.values()))
    any_meta = doc["meta"].isNotNull()
    for k in META.values():
        any_meta = any_meta | F.col(f"__meta_{k}").isNotNull()
    period = doc["donem"].withField("baslangic", new("begins", doc["donem"]["baslangic"])).withField("bitis", new("ends", doc["donem"]["bitis"]))
    edited = {"meta": F.when(any_meta, meta), "donem": period} | {k: new(k, doc[k]) for k in ("oda_kontenjanlari", "fiyatlar", "release", "stop_sale")}
    named = F.array_distinct(F.transform("__paths", lambda x: x["path"]))
    kept = F.transform(F.coalesce("provenance", F.array().cast("array<struct<path:string,confidence:double,manual:boolean>>")), lambda m: F.when(F.array_contains(named, m["path"]), F.struct(m["path"].alias("path"), F.lit(1.0).alias("confidence"), F.lit(True).alias("manual"))).otherwise(m))
    more = F.transform(F.filter(named, lambda p: ~F.exists(kept, lambda m: m["path"] == p)), lambda p: F.struct(p.alias("path"), F.lit(1.0).alias("confidence"), F.lit(True).alias("manual")))
    changed = F.col("__paths").isNotNull()
    rest = [c for c in contracts.columns if c not in ("doc", "provenance")]
    # field by field, so that what is read of few fields does not make the others be computed
    names = contracts.schema["doc"].dataType.names
    own = F.struct(*((F.when(changed, edited[k]).otherwise(doc[k]) if k in edited else doc[k]).alias(k) for k in names))
    return both.select(*rest, F.when(doc.isNotNull(), own).alias("doc"), F.when(changed, F.concat(kept, more)).otherwise(F.col("provenance")).alias("provenance"), changed.alias("changed"))


def audited_again(findings: DataFrame, contracts: DataFrame, audit) -> DataFrame:
    """``findings`` once the changed contracts are audited anew by ``audit`` (contracts to findings); those of the others stay."""
    changed = contracts.where("changed")
    return findings.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(audit(changed))


def replaced_whole(stored: DataFrame, new: DataFrame, kept_if_empty: list[str], fixed: list[str]) -> DataFrame:
    """``stored`` contracts with ``new`` ones in their place, and ``outcome`` (``yazildi``, ``onayli``, null where nothing was sent).

    A new contract takes over its ``fixed`` columns, and those of ``kept_if_empty`` that it leaves
    null or without elements; one that is approved stays as it is; new ones of unknown ids are no contracts.
    """
    sent = new.select("doc_id", F.struct(*(c for c in stored.columns if c != "doc_id")).alias("new"))
    both = stored.join(sent, "doc_id", "left")
    outcome = F.when(F.col("new").isNull(), F.lit(None)).when(F.col("status").eqNullSafe(F.lit(APPROVED)), "onayli").otherwise("yazildi")
    write = F.coalesce(outcome == "yazildi", F.lit(False))

    def value(c: str) -> Column:
        if c in ("doc_id", *fixed):
            return F.col(c)
        mine = F.col(f"new.{c}")
        empty = mine.isNull() | (F.size(mine) == 0) if dict(stored.dtypes)[c].startswith("array") else mine.isNull() | (mine.cast("string") == "")
        return F.when(write & ~(empty if c in kept_if_empty else F.lit(False)), mine).otherwise(F.col(c)).alias(c)

    return both.select(*(value(c) for c in stored.columns), outcome.alias("outcome"))


def audit_tree(doc: Column, provenance: Column) -> Column:
    """A contract as the JSON text that audits read: texts that are missing are empty, numbers and rows as they are.

    Blocks that are missing are left out; ``cikarim_meta`` maps schema paths to their confidence.
    """
    text = lambda v: F.coalesce(v, F.lit(""))
    texts = lambda v, *names: [text(v[k]).alias(k) for k in names]
    period = doc["donem"]
    subs = F.when(F.size(period["alt_donemler"]) > 0, period["alt_donemler"])
    rows = lambda v, make: F.transform(F.coalesce(v, F.array()), make)
    meta = F.map_from_entries(F.transform(F.coalesce(provenance, F.array().cast("array<struct<path:string,confidence:double,manual:boolean>>")), lambda m: F.struct(schema_path(m["path"]), F.struct(m["confidence"].alias("guven")))))
    return F.to_json(
        F.struct(
            F.when(doc["meta"].isNotNull(), F.struct(*texts(doc["meta"], *META.values()))).alias("meta"), F.when(period.isNotNull(), F.struct(*texts(period, "baslangic", "bitis"), subs.alias("alt_donemler"))).alias("donem"),
            rows(doc["oda_kontenjanlari"], lambda r: F.struct(r["oda_tipi"].alias("oda_tipi"), r["adet"].alias("adet"), *texts(r, "aciklama"))).alias("oda_kontenjanlari"),
            rows(doc["fiyatlar"], lambda r: F.struct(r["oda_tipi"].alias("oda_tipi"), *texts(r, "pansiyon"), r["tutar"].alias("tutar"), r["birim"].alias("birim"), *texts(r, "alt_donem_ad"))).alias("fiyatlar"),
            F.when(doc["release"].isNotNull(), F.struct(doc["release"]["gun"].alias("gun"), *texts(doc["release"], "kapsam", "kaynak_ifade"))).alias("release"),
            rows(doc["stop_sale"], lambda r: F.struct(*texts(r, "baslangic", "bitis", "kapsam", "bildirim_yontemi", "kaynak_ifade"))).alias("stop_sale"), meta.alias("cikarim_meta"),
        ),
        {"ignoreNullFields": "true"},
    )
