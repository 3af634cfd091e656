"""Rules, confidence and validation over contracts, as rows of findings.

Inputs are exploded tables: ``contracts`` (doc_id, begins, ends, release_days, n_stop_sale),
``subperiods`` (doc_id, pos, begins, ends), ``prices`` and ``rooms`` (doc_id, pos, room).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILLED, TOUCHED, UNTOUCHED = 0.2, 0.6, 0.9
DEFAULT_THRESHOLD = 0.75
#: fixed values: severities in their order
SEVERITIES = ("KRITIK", "UYARI", "BILGI")
_FILLED_NOTE = "zorunlu alan dolduruldu"


def _finding(df: DataFrame, code: str, severity: str, path: Column) -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("KURAL").alias("source"), path.alias("path"))


def date_conflict(contracts: DataFrame) -> DataFrame:
    return _finding(contracts.where("ends < begins"), "KURAL_TARIH_CELISKISI", "KRITIK", F.lit("donem"))


def subperiod_overflow(contracts: DataFrame, subperiods: DataFrame) -> DataFrame:
    outer = contracts.select("doc_id", F.col("begins").alias("b"), F.col("ends").alias("e"))
    out = subperiods.join(outer, "doc_id").where("begins < b or ends > e")
    return _finding(out, "KURAL_ALT_DONEM_TASMA", "UYARI", F.concat(F.lit("donem.alt_donemler["), F.col("pos").cast("string"), F.lit("]")))


def price_without_room(prices: DataFrame, rooms: DataFrame, room_key=lambda c: F.lower(F.trim(c))) -> DataFrame:
    """Price rooms that no allotment names, once for each room key, at their first position."""
    keyed = prices.withColumn("room_key", room_key(F.col("room"))).where("room_key <> ''")
    known = rooms.select("doc_id", room_key(F.col("room")).alias("room_key"))
    first = keyed.join(known, ["doc_id", "room_key"], "left_anti").groupBy("doc_id", "room_key").agg(F.min(F.struct("pos", "room")).alias("x"))
    out = first.select("doc_id", F.col("x.pos").alias("pos"), F.col("x.room").alias("room"))
    return _finding(out, "KURAL_FIYAT_KONTENJAN_UYUSMAZLIGI", "KRITIK", F.concat(F.lit("fiyatlar["), F.col("pos").cast("string"), F.lit("]")))


def stop_sale_missing(contracts: DataFrame) -> DataFrame:
    return _finding(contracts.where("coalesce(n_stop_sale, 0) = 0"), "KURAL_STOP_SALE_YOK", "UYARI", F.lit("stop_sale"))


def release_unreasonable(contracts: DataFrame, most: int = 90) -> DataFrame:
    """0 or more than ``most`` days; negative numbers are left to validation."""
    return _finding(contracts.where((F.col("release_days") == 0) | (F.col("release_days") > most)), "KURAL_RELEASE_MAKUL_DEGIL", "UYARI", F.lit("release"))


def low_confidence(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Paths (doc_id, path, confidence) below the threshold; one of 0 or less means the default."""
    t = threshold if threshold > 0 else DEFAULT_THRESHOLD
    return _finding(scores.where(F.col("confidence") < t), "KURAL_DUSUK_GUVEN", "UYARI", F.col("path"))


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 0)
    for k, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, k)
    return out.otherwise(len(SEVERITIES))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with their rank in the contract: severity, rules before model findings, code, path."""
    w = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), F.when(F.col("source") == "KURAL", 0).otherwise(1), "code", "path")
    return findings.withColumn("rank", F.row_number().over(w))


def worst(findings: DataFrame) -> DataFrame:
    """(doc_id, n, tone): the number of findings and the colour of the worst."""
    least = F.min(severity_rank(F.col("severity")))
    return findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.when(least == 0, "red").when(least == 1, "yellow").otherwise("muted").alias("tone"))


def note_mentions(note: Column, field: str) -> Column:
    path = F.substring_index(note, ": ", -1)
    return note.contains(": ") & ((path == field) | path.startswith(f"{field}.") | path.startswith(f"{field}["))


def confidence(notes: Column, field: str) -> Column:
    """0.2 if a note says that the field was filled in, 0.6 if one mentions it, else 0.9."""
    filled = F.exists(notes, lambda n: note_mentions(n, field) & n.startswith(_FILLED_NOTE))
    return F.when(filled, FILLED).when(F.exists(notes, lambda n: note_mentions(n, field)), TOUCHED).otherwise(UNTOUCHED)


def note_roots(notes: Column) -> Column:
    """struct<filled, all>: the core fields that notes of filling, and all notes, are about, read once for every field."""
    about = F.filter(notes, lambda n: n.contains(": "))
    root = lambda n: F.substring_index(F.substring_index(F.substring_index(n, ": ", -1), ".", 1), "[", 1)
    return F.struct(F.transform(F.filter(about, lambda n: n.startswith(_FILLED_NOTE)), root).alias("filled"), F.transform(about, root).alias("all"))


def root_confidence(roots: Column, field: str) -> Column:
    """``confidence`` of a core field from ``note_roots``."""
    return F.when(F.array_contains(roots["filled"], field), FILLED).when(F.array_contains(roots["all"], field), TOUCHED).otherwise(UNTOUCHED)


def source_page(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, page): the first page (from 1) that holds a needle, for each document with one.

    Needles (needle) of at least three characters count in any document. Pages and needles meet by
    a key: a needle's longest inner word, which stands between white space in any page that holds
    it, or, where it has none, its first three characters, looked up among those of each page.
    Keys alone are joined; the texts of the pages that met are fetched afterwards.
    """
    usable = needles.where(F.length(F.regexp_replace("needle", r"\s", "")) >= 3).select(F.lower("needle").alias("needle")).distinct()
    inner = F.filter(F.slice(F.split("needle", r"\s+"), 2, F.greatest(F.size(F.split("needle", r"\s+")) - 2, F.lit(0))), lambda w: w != "")
    usable = usable.withColumn("key", F.get(F.reverse(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), 0)["w"])
    low = pages.select("doc_id", "page", F.lower("text").alias("text")).where("text is not null")
    words = low.select("doc_id", "page", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key"))
    met = words.join(usable.where("key is not null"), "key").select("doc_id", "page", "needle")
    short = usable.where("key is null").withColumn("key", F.substring("needle", 1, 3))
    threes = low.select("doc_id", "page", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda k: F.substr("text", k, F.lit(3))))).alias("key"))
    met = met.unionByName(threes.join(short, "key").select("doc_id", "page", "needle"))
    return met.join(low, ["doc_id", "page"]).where(F.contains("text", F.col("needle"))).groupBy("doc_id").agg(F.min("page").alias("page"))


def violations(df: DataFrame, constraints: list[tuple[str, str, Column]]) -> Column:
    """Messages ``alan=<path> kisit=<keyword>`` of the constraints (path, keyword, broken) that a row breaks."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(f"alan={path} kisit={keyword}")) for path, keyword, broken in constraints)))


def accuracy(df: DataFrame, pairs: list[tuple[str, str, str]]) -> list[Column]:
    """For (name, gold, predicted): the share of rows where both are the same, NULLs being equal; 0 without rows."""
    return [F.coalesce(F.avg(F.col(gold).eqNullSafe(F.col(predicted)).cast("int")), F.lit(0.0)).alias(name) for name, gold, predicted in pairs]
