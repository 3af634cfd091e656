"""Contracts that a model answers in four parts: each answer rid of what the text does not bear out, judged, and joined to one tree.

Part A gives the period and the allotments, B the prices, C release and stop-sale, D the
particulars. A part may be asked again ``ROUNDS`` times; its first usable answer counts, and a
contract's tree holds the parts that have one. A contract and all its answers are rows keyed by
doc_id, so that work is spread by contract and a text is joined to its answers once.

Defined cases: an answer that cannot be read, or is null (the call failed), is not usable; a
contract without usable answers has an empty tree; of two answers of the same round the smaller
tree counts; parts of other names and answers without a contract are left out; rows with a null
doc_id belong to no contract; a null or empty text bears nothing out, and its stop-sale rows go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions import grounding as g
from pactline.functions.bind import let
from pactline.operators import json_repair as j
from pactline.operators import normalize as n
from pactline.operators import rooms as r

PARTS = ("A", "B", "C", "D")
ROUNDS = 1  # of correction
#: the particulars of part D
META = ("otel_adi", "acente_adi", "para_birimi", "kur_esasi", "yetkili_mahkeme", "sozlesme_tipi", "sezon")


def text_of(v: Column, path: str) -> Column:
    """The text at a path; null where there is something else."""
    return let(n.part(v, path), lambda own: F.when(n.is_kind(own, "STRING"), F.try_variant_get(own, "$", "string")))


def objects(v: Column) -> Column:
    """The objects of an array; nothing of anything else."""
    return F.filter(F.coalesce(n.items(v), F.array().cast("array<variant>")), lambda x: n.is_kind(x, "OBJECT"))


def _filled(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(text_of(v, p), F.lit("")) for p in paths))


def sub_periods(v: Column) -> Column:
    """array<struct<ad, baslangic, bitis>> of an array whose elements all have the three; empty if one has not."""
    rows = F.transform(objects(v), lambda x: F.struct(_filled(x, "ad", "alt_donem_ad").alias("ad"), _filled(x, "baslangic").alias("baslangic"), _filled(x, "bitis").alias("bitis")))
    filled = lambda x: x["ad"].isNotNull() & x["baslangic"].isNotNull() & x["bitis"].isNotNull()
    return let(rows, lambda own: F.when((F.size(own) == F.size(n.items(v))) & F.forall(own, filled), own).otherwise(F.slice(own, 1, 0)))


def period(tree: Column) -> Column:
    """The period's known keys as they are (an end before the start is the auditor's to find), with sub-periods from the root where it has none."""
    own = F.when(n.is_kind(n.part(tree, "donem"), "OBJECT"), n.part(tree, "donem"))
    inner = n.part(own, "alt_donemler")
    rows = F.when(n.is_missing(inner), n.part(tree, "alt_donemler")).otherwise(inner)
    return F.struct(n.part(own, "baslangic").alias("baslangic"), n.part(own, "bitis").alias("bitis"), sub_periods(rows).alias("alt_donemler"))


def prices(v: Column, text: Column) -> Column:
    """array<struct<oda_tipi, tutar, birim, pansiyon, alt_donem_ad>>: an answer's rows with a known room and an amount, each once, then those that the price section's lines state.

    The unit is that of the text, and so is the board where the answer leaves it open. A row is
    looked up among those before it: answers are as long as a model's token limit allows.
    """
    season = lambda x: F.nullif(g.stripped(text_of(x, "alt_donem_ad")), F.lit(""))
    amount = lambda a: F.coalesce(F.try_variant_get(a, "$", "double").cast("string"), F.try_variant_get(a, "$", "string"))
    key = lambda x: F.concat_ws("|", x["oda_tipi"], amount(x["tutar"]), F.coalesce(x["alt_donem_ad"], F.lit("<nil>")), x["pansiyon"])

    def rows(told: Column) -> Column:
        row = lambda x: F.struct(g.room_type(text_of(x, "oda_tipi")).alias("oda_tipi"), n.part(x, "tutar").alias("tutar"), told["unit"].alias("birim"), g.board(text_of(x, "pansiyon"), told["board"]).alias("pansiyon"), let(season(x), lambda own: F.when(F.lower(own) != "null", own)).alias("alt_donem_ad"))
        given = F.filter(F.transform(objects(v), row), lambda x: (x["oda_tipi"] != "") & ~n.is_missing(x["tutar"]))
        once = let(given, lambda own: let(F.transform(own, key), lambda keys: F.filter(own, lambda _, k: F.array_position(keys, F.get(keys, k)) == k + 1)))
        stated = F.coalesce(F.nullif(told["board"], F.lit("")), F.lit(g.UNKNOWN))
        lines = F.transform(g.priced_lines(text), lambda x: F.struct(x["room"].alias("oda_tipi"), x["amount"].cast("variant").alias("tutar"), told["unit"].alias("birim"), stated.alias("pansiyon"), F.lit(None).cast("string").alias("alt_donem_ad")))
        return let(once, lambda own: F.concat(own, F.coalesce(lines, F.slice(own, 1, 0))))

    return let(let(F.lower(text), lambda low: F.struct(g.stated_unit(text, low).alias("unit"), g.stated_board(text, low).alias("board"))), rows)


def release(v: Column) -> Column:
    """An array's first object in place of the array; anything else as it is."""
    first = F.get(n.items(v), 0)
    return F.when(n.is_kind(first, "OBJECT"), first).otherwise(v)


def stop_sales(v: Column, text: Column) -> Column:
    rows = F.transform(objects(v), lambda x: F.struct(F.coalesce(text_of(x, "baslangic"), F.lit("")).alias("start"), F.coalesce(text_of(x, "bitis"), F.lit("")).alias("end"), text_of(x, "kapsam").alias("scope")))
    kept = F.coalesce(g.stop_sales(rows, text), F.array())
    return F.transform(kept, lambda x: F.struct(x["start"].alias("baslangic"), x["end"].alias("bitis"), x["scope"].alias("kapsam")))


def particulars(tree: Column, text: Column) -> Column:
    """The particulars under ``meta`` that the text bears out; where none is left, those that stand at the root."""
    given = lambda v: let(v, lambda own: F.struct(*(text_of(own, k).alias(k) for k in META)))
    none = F.lit(None).cast(f"struct<{','.join(f'{k}:string' for k in META)}>")

    def borne(x: Column, told: Column) -> Column:
        own = g.meta({k: x[k] for k in META}, told)
        kept = F.struct(*(own[k].alias(k) for k in META))
        return let(kept, lambda own: F.when(F.coalesce(*(own[k] for k in META)).isNotNull(), own))

    # the second is looked at only where the first gives nothing
    first = lambda told: F.aggregate(F.array(given(n.part(tree, "meta")), given(tree)), none, lambda found, x: F.when(found.isNotNull(), found).otherwise(borne(x, told)))
    return let(g.told(text), first)


def _allotments(answers: DataFrame) -> DataFrame:
    """(key, rooms): the allotments of each answer on part A, at most six."""
    asked = answers.where((F.col("part") == "A") & n.part(F.col("tree"), "oda_kontenjanlari").isNotNull()).select(F.col("key").alias("doc_id"), "text", "tree")
    each = asked.select("doc_id", F.explode(objects(n.part(F.col("tree"), "oda_kontenjanlari"))).alias("x"))
    rows = each.select("doc_id", text_of(F.col("x"), "oda_tipi").alias("room"), r.json_int(n.part(F.col("x"), "adet")).alias("quantity"))
    found = r.grounded_rooms(asked.select("doc_id", "text"), rows)
    list_ = F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("room").alias("oda_tipi"), F.col("quantity").alias("adet")).alias("x"))))
    return found.groupBy(F.col("doc_id").alias("key")).agg(F.transform(list_, lambda x: x["x"]).alias("rooms"))


def sanitised(contracts: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, part, attempt, tree): of each answer (doc_id, part, attempt, answer) the JSON of what is left of it; null unless usable."""
    read = answers.where(F.col("part").isin(*PARTS)).select("doc_id", "part", "attempt", F.try_parse_json(j.part_repaired(F.col("answer"))).alias("tree"))
    rows = contracts.select("doc_id", "text").join(read, "doc_id").withColumn("key", F.struct("doc_id", "attempt", F.xxhash64(F.to_json("tree")).alias("h")))
    tree, text, part = F.col("tree"), F.col("text"), F.col("part")
    rows = rows.join(_allotments(rows), "key", "left")
    release_, amounts = n.part(tree, "release"), n.part(tree, "fiyatlar")
    a = F.when(F.size("rooms") > 0, F.to_json(F.struct(period(tree).alias("donem"), F.col("rooms").alias("oda_kontenjanlari"))))
    b = F.when(n.is_kind(amounts, "ARRAY"), let(prices(amounts, text), lambda p: F.when(F.size(p) > 0, F.to_json(F.struct(p.alias("fiyatlar"))))))
    c = F.when(n.is_kind(release_, "OBJECT") | (F.size(n.items(release_)) > 0), F.to_json(F.struct(release(release_).alias("release"), stop_sales(n.part(tree, "stop_sale"), text).alias("stop_sale"))))
    d = let(particulars(tree, text), lambda m: F.when(m.isNotNull(), F.to_json(F.struct(m.alias("meta")))))
    own = F.when(tree.isNotNull(), F.when(part == "A", a).when(part == "B", b).when(part == "C", c).when(part == "D", d))
    return rows.select("doc_id", "part", "attempt", own.alias("tree"))


def merged(contracts: DataFrame, judged: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, contract, parts, retries): the tree of each contract's first usable answers, in the parts' order.

    ``retries`` is the largest number of times that one of the parts was asked again.
    """
    made = judged.where(F.col("attempt").between(0, rounds))
    best = lambda p: F.min(F.when((F.col("part") == p) & F.col("tree").isNotNull(), F.struct("attempt", "tree")))
    asked = lambda p: F.max(F.when(F.col("part") == p, F.col("attempt")))
    each = made.groupBy("doc_id").agg(*(best(p).alias(p) for p in PARTS), *(asked(p).alias(f"n{p}") for p in PARTS))
    rows = contracts.select("doc_id").join(each, "doc_id", "left")
    body = F.concat_ws(",", *(F.expr(f"substr({p}.tree, 2, length({p}.tree) - 2)") for p in PARTS))
    times = F.greatest(F.lit(0), *(F.coalesce(F.col(f"{p}.attempt"), F.col(f"n{p}"), F.lit(0)) for p in PARTS))
    return rows.select("doc_id", F.concat(F.lit("{"), body, F.lit("}")).alias("contract"), F.concat_ws("", *(F.when(F.col(p).isNotNull(), p) for p in PARTS)).alias("parts"), times.cast("int").alias("retries"))


def answered(contracts: DataFrame, answers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``merged`` of the answers; ``normalize.normalized`` takes its column ``contract`` further."""
    return merged(contracts, sanitised(contracts, answers), rounds)


def training_targets(tree: Column) -> Column:
    """array<struct<part, target>>: what a model should answer for the whole contract and for each part, as JSON.

    Allotments keep room and quantity, particulars what is known; without a release its place is held by an unknown one.
    """
    rooms = F.transform(objects(n.part(tree, "oda_kontenjanlari")), lambda x: F.struct(n.part(x, "oda_tipi").alias("oda_tipi"), n.part(x, "adet").alias("adet")))
    known = F.map_filter(F.try_variant_get(tree, "$.meta", "map<string,variant>"), lambda _, v: ~n.is_missing(v) & ~F.coalesce(F.try_variant_get(v, "$", "string").isin("", g.UNKNOWN), F.lit(False)))
    default = F.parse_json(F.lit(f'{{"gun":null,"kapsam":"{g.UNKNOWN}"}}'))
    own = F.when(~n.is_missing(n.part(tree, "release")), n.part(tree, "release")).otherwise(default)
    array = lambda k: F.coalesce(n.items(n.part(tree, k)), F.array().cast("array<variant>"))
    targets = {
        "FULL": F.to_json(tree), "A": F.to_json(F.struct(n.part(tree, "donem").alias("donem"), rooms.alias("oda_kontenjanlari"))), "B": F.to_json(F.struct(array("fiyatlar").alias("fiyatlar"))),
        "C": F.to_json(F.struct(own.alias("release"), array("stop_sale").alias("stop_sale"))), "D": F.to_json(F.struct(F.coalesce(known, F.create_map().cast("map<string,variant>")).alias("meta"))),
    }
    return F.array(*(F.struct(F.lit(k).alias("part"), v.alias("target")) for k, v in targets.items()))
