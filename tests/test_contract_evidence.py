"""Allotments near room names, glyph layout, scoring and source pages on small hard cases."""

import json
import random

from pyspark.sql import functions as F

from pactline.operators import contracts, evidence, layout, rooms, scoring

SECTION = "MADDE 2 – Oda kontenjanları taraflarca aşağıdaki gibi belirlenmiştir\n{}\nMADDE 4 – Oda fiyatları\n99 standart"


ROOMS = [
        (SECTION.format("Standart   240\n5 balayı odası"), [("standart", 240), ("balayi", 5), ("suit", 9)], [("standart", 240), ("balayi", 5)]),
        (SECTION.format("Standart 240 oda, Family room: 12\ndeluxe: 6"), [("standard", 7)], [("standart", 240), ("aile", 240), ("deluxe", 6)]),  # what a model left out is read
        (SECTION.format("aile 3\naile odası 8"), [("aile", 3), ("family", 8)], [("aile", 8)]),  # the largest
        (SECTION.format("engelli 3\nözürlü oda 2"), [("engelli", 3), ("disabled", 2)], [("engelli", 2)]),  # of accessible rooms the smallest
        (SECTION.format("12 " + "ş" * 12 + "suit"), [("suit", 12)], [("suit", 12)]),  # 25 bytes: not near, but nothing else is either
        (SECTION.format("12 " + "s" * 20 + " suit\ndeluxe 4"), [("suit", 12)], [("suit", 12), ("deluxe", 4)]),
        (SECTION.format("12 " + "ş" * 12 + "suit\ndeluxe 4"), [("suit", 12)], [("deluxe", 4)]),
        (SECTION.format("12\nsuit\n13"), [("suit", 12)], [("suit", 12)]),  # numbers of other lines are not near
        (SECTION.format("5 ve 6 suite 7"), [("junior suite", 6)], [("suit", 6)]),
        (SECTION.format("99999999999999999999 suit 7"), [], [("suit", 7)]),  # a number beyond a long is none
        (SECTION.format("suit 10000\ndeluxe 0"), [], []),
        ("30 penthouse var", [("penthouse", 30), ("suit", 31), ("teras", 30), ("suit", 0)], [("suit", 30)]),  # no section: the whole text, nothing is read from it
        ("30 penthouse var", [("aile", 4), ("aile", 5)], [("aile", 5)]),
        (None, [("aile", 4)], [("aile", 4)]),
        ("", [], []),
]


def test_grounded_rooms(spark):
    contracts = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(ROOMS)], "doc_id long, text string")
    rows = spark.createDataFrame([(k, r, q) for k, (_, given, _) in enumerate(ROOMS) for r, q in [*given, (None, 3)]], "doc_id long, room string, quantity long")
    got = rooms.grounded_rooms(contracts, rows).orderBy("doc_id", "rank").collect()
    assert [[(r.room, r.quantity) for r in got if r.doc_id == k] for k in range(len(ROOMS))] == [want for _, _, want in ROOMS]
    assert rooms.grounded_rooms(contracts.limit(0), rows.limit(0)).count() == 0


def test_json_int(spark):
    cases = [("5", 5), ("5.9", 5), ("-5.9", -5), ('"7"', 7), ('" 12 oda"', 12), ('"oda"', 0), ("null", 0), ("true", 0), ("[1]", 0), ("1e3", 1000)]
    got = spark.createDataFrame(cases, "j string, want long").select("want", rooms.json_int(F.parse_json("j")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_hint_lines_and_mentions(spark):
    r = spark.createDataFrame([("suit oda\nSuit 5\ntoplam 9\n\nFamily room 12 (90)", "Junior  Suite", "Accessible")], "t string, a string, b string")
    got = r.select(rooms.hint_lines(F.col("t")), rooms.mentioned_types(F.col("t"), F.col("a")), rooms.mentioned_types(F.col("t"), F.col("b"))).first()
    assert tuple(got) == (2, True, False)


PAGES = [
        ([("b", 20, 700, 5, 10), ("a", 10, 701, 5, 10), ("c", 10, 688, 5, 10)], "a b\nc"),
        ([("a", 0, 9, 5, 10), ("b", 7.4, 9, 5, 10), ("c", 15, 9, 5, 10)], "ab c"),  # a gap under a quarter of the size is none
        ([("a", 0, 9, 5, 10), ("b", 500, 9, 5, 10)], "a" + " " * 24 + "b"),
        ([("ab", 0, 9, 0, 10), ("c", 12.5, 9, 5, 10)], "ab c"),  # no width: half the size for each character
        ([("a", 0, 9, 5, 0), ("b", 8, 9, 5, 0), ("c", 16.1, 9, 5, 0)], "a b c"),  # no size counts as 12
        ([("a", 0, 9, 5, 10), (" ", 30, 9, 5, 10), ("b", 90, 9, 5, 10), ("c ", 120, 9, 5, 10), ("d", 190, 9, 5, 10)], "a b" + " " * 5 + "c d"),
        ([("", 0, 9, 5, 10)], ""),
        ([("x", 5, 9, 1, 10), ("y", 5, 9, 1, 10), ("z", 5, 9, 1, 10)], "xyz"),  # one place: the file's order
        ([("a", 0, 10, 5, 10), ("b", 10, 7, 5, 10), ("c", 20, 4, 5, 10)], "a b\n" + "c"),  # a chain of baselines: the highest leads
        ([("ş", None, None, None, None)], "ş"),
    ]


def test_page_text(spark):
    number = lambda v: None if v is None else float(v)
    rows = [(k, 1, pos, s, *map(number, rest)) for k, (glyphs, _) in enumerate(PAGES) for pos, (s, *rest) in enumerate(glyphs)]
    df = spark.createDataFrame(rows, "doc_id long, page long, pos long, s string, x double, y double, width double, font double").repartition(3)
    assert [r.text for r in layout.page_text(df).orderBy("doc_id").collect()] == [want for _, want in PAGES]


def test_page_text_keeps_pages_apart_and_takes_none(spark):
    df = spark.createDataFrame([(d, p, 0, f"{d}{p}", 0.0, 9.0, 5.0, 10.0) for d in (1, 2, None) for p in (1, 2)], "doc_id long, page long, pos long, s string, x double, y double, width double, font double")
    assert {(r.doc_id, r.page): r.text for r in layout.page_text(df.where("doc_id is not null")).collect()} == {(d, p): f"{d}{p}" for d in (1, 2) for p in (1, 2)}
    assert layout.page_text(df.limit(0)).count() == 0


GOLD = {
    "donem": {"baslangic": "2026-05-01", "bitis": "2026-10-31", "alt_donemler": [{"ad": "A", "baslangic": "x", "bitis": "y"}, {"ad": "B", "baslangic": "x", "bitis": "y"}]},
    "oda_kontenjanlari": [{"oda_tipi": "suit", "adet": 4, "aciklama": "deniz"}, {"oda_tipi": "aile", "adet": 2}],
    "fiyatlar": [{"oda_tipi": "suit", "tutar": 90, "birim": "oda_gecelik"}, {"oda_tipi": "suit", "tutar": 80.5, "birim": "oda_gecelik", "pansiyon": "HB"}],
    "release": {"gun": 7},
}


def changed(**fields):
    return json.dumps(GOLD | fields)


ANSWERS = [
        (json.dumps(GOLD), set()),
        ("Şöyle:\n```JSON\n" + json.dumps({k: v[::-1] if isinstance(v, list) else v for k, v in GOLD.items()}) + "\n```", set()),
        (changed(oda_kontenjanlari=[{"adet": 2.0, "oda_tipi": "aile"}, {"oda_tipi": "suit", "adet": 4}, "x"]), set()),
        (changed(oda_kontenjanlari=[{"oda_tipi": "aile", "adet": "2"}, {"oda_tipi": "suit", "adet": 4}]), {"oda_kontenjanlari"}),
        (changed(oda_kontenjanlari=GOLD["oda_kontenjanlari"] * 2), {"oda_kontenjanlari"}),  # rows are counted
        (changed(release={"gun": 7, "kapsam": "", "not": 1}), set()),
        (changed(release={"gun": 7, "kapsam": "her_ikisi"}), {"release"}),
        (changed(release=[{"gun": 7}]), {"release"}),
        (changed(stop_sale=[]), {"stop_sale"}),  # an empty list is not the same as none
        (changed(stop_sale=None), set()),
        (changed(donem={**GOLD["donem"], "alt_donemler": GOLD["donem"]["alt_donemler"][:1]}), {"donem"}),
        ("{bozuk", {"donem", "oda_kontenjanlari", "fiyatlar", "release"}),
        (None, {"donem", "oda_kontenjanlari", "fiyatlar", "release"}),
        ("[1]", {"donem", "oda_kontenjanlari", "fiyatlar", "release"}),
    ]


def test_scores(spark):
    gold = spark.createDataFrame([(k, json.dumps(GOLD)) for k in range(len(ANSWERS))], "doc_id long, contract string")
    predictions = spark.createDataFrame([(k, answer, None) for k, (answer, _) in enumerate(ANSWERS)], "doc_id long, answer string, error string")
    rows = scoring.scored(gold, predictions).orderBy("doc_id").collect()
    assert [{k for k in scoring.CORE if not r[k]} for r in rows] == [wrong for _, wrong in ANSWERS]
    assert not any(r.error for r in rows)


def test_scores_of_errors_and_missing_predictions(spark):
    gold = spark.createDataFrame([(1, json.dumps(GOLD)), (2, "{}")], "doc_id long, contract string")
    scores = scoring.scored(gold, spark.createDataFrame([(1, json.dumps(GOLD), "HTTP 500")], "doc_id long, answer string, error string"))
    got, missing = scores.orderBy("doc_id").collect()
    assert not any(r[k] for r in (got, missing) for k in (*scoring.CORE, "valid_json", "schema_ok")) and got.error == "HTTP 500" and missing.error
    total = scoring.summary(scores.limit(0)).first()
    assert total.n == 0 and total.donem == 0.0 and total.errors == 0
    assert spark.range(1).select(scoring.percent(F.lit(0.5))).first()[0] == " 50.0%"


def test_needles_reach_every_depth(spark):
    r, values, tree = random.Random(1), [], {"a": None, "b": "  Ab ", "c": True}
    for depth in range(12):
        values.append(f"değer{depth}")
        tree = r.choice([lambda t, v: [t, v, [], {}], lambda t, v: {"x": t, "y": f" {v.upper()} "}])(tree, values[-1])
    tree = [tree, 1234, 500.0, 12.5, -3, "ab", "a b c"]
    df = spark.createDataFrame([(1, "f", json.dumps(tree)), (2, "f", "null"), (3, "f", "77777")], "doc_id long, field string, j string").select("doc_id", "field", F.parse_json("j").alias("value"))
    got = {x.needle for x in evidence.needles(df).where("doc_id = 1").collect()}
    assert got == {"değer" + str(k) for k in range(12)} | {"1234", "500", "12.5", "true", "a b c"}
    pages = spark.createDataFrame([(1, 1, "12.50"), (1, 2, "DEĞER3 x"), (2, 1, "null"), (4, 1, "77777")], "doc_id long, page long, text string")
    assert {x.doc_id: x.page for x in evidence.field_pages(df, pages).collect()} == {1: 1, 2: None, 3: None}


def test_source_page_finds_needles_of_any_length(spark):
    pages = spark.createDataFrame([(1, 1, "Bir iki\n üç dört beş"), (1, 2, "x abc y"), (2, 1, "altı"), (2, 2, "  BİR  iki "), (3, 1, None), (4, 1, "ab"), (5, 3, "üç dört beş altı")], "doc_id long, page long, text string")
    find = lambda *n: {r.doc_id: r.page for r in contracts.source_page(pages, spark.createDataFrame([(x,) for x in n], "needle string")).collect()}
    assert find("ÜÇ dört beş", "a b", None) == {1: 1, 5: 3}
    assert find("abc", "ab", " tı") == {1: 2} and find("ltı") == {2: 1, 5: 3}
    assert find(" üç dört") == {1: 1} and find() == {}


def test_scalars_of_a_deep_tree_come_without_a_job_for_each_level(spark):
    deep = '{"a":[' * 12 + '{"x":"leaf","y":[1,null,{}]}' + "]}" * 12
    trees = spark.createDataFrame([(1, deep), (2, "7"), (3, None), (4, "null")], "k long, j string").select("k", F.expr("parse_json(j)").alias("v"))
    spark.sparkContext.setJobGroup("scalars", "")
    out = evidence.scalars(trees, "v")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("scalars")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 0
    assert sorted(tuple(r) for r in out.select("k", F.expr("v::string")).collect()) == [(1, "1"), (1, "leaf"), (2, "7")]


def test_allotments_are_grouped_by_hashing(spark):
    contracts = spark.createDataFrame([(1, "Madde 2 oda kontenjanları\nsuit: 5\nsuite: 4")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "aile", 3)], "doc_id long, room string, quantity long")
    out = rooms.grounded_rooms(contracts, rows)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.room, r.quantity) for r in out.collect()] == [("suit", 4)]
