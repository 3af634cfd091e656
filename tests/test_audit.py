"""Findings of a model's answers beside those of the rules, and what the model is given."""

import json

from pyspark.sql import functions as F

from pactline.operators import audit


def found(spark, rows):
    out = audit.model_findings(spark.createDataFrame(rows, "doc_id long, answer string").withColumn("code", F.lit("clash")))
    return sorted((r.doc_id, r.code, r.severity, r.path, r.title, r.description) for r in out.collect())


def test_model_findings(spark):
    row = lambda t, d="a", s="uyari", **more: {"baslik": t, "aciklama": d, "onem": s, **more}
    answers = {
        1: json.dumps([row(" Oda farkı ", alan=" oda[0] "), row("??", s=" BILGI "), None, row("x", ""), row("y", s="acil"), row("altinci")]),
        2: "```json\n" + json.dumps([row("a-b")]) + "\n```", 3: json.dumps([row(5)]), 4: json.dumps([row("a"), 5]), 5: "[]", 6: "yok", 7: None, 8: json.dumps([row(None), row("ok", alan=None)]),
    }
    got = found(spark, list(answers.items()))
    assert got == [(1, "MODEL_2", "BILGI", "", "??", "a"), (1, "MODEL_ODA_FARKI", "UYARI", "oda[0]", "Oda farkı", "a"), (2, "MODEL_A_B", "UYARI", "", "a-b", "a"), (8, "MODEL_OK", "UYARI", "", "ok", "a")]
    assert found(spark, []) == []


def test_audited_ranks_rules_before_the_model(spark):
    rules = spark.createDataFrame([(1, "R", "UYARI", "KURAL", "b"), (1, "R", "UYARI", "KURAL", "a")], "doc_id long, code string, severity string, source string, path string")
    model = spark.createDataFrame([(1, "A", "UYARI", "MODEL", "a", "t", "d"), (1, "Z", "KRITIK", "MODEL", "a", "t", "d"), (2, "A", "BILGI", "MODEL", "", "t", "d")], "doc_id long, code string, severity string, source string, path string, title string, description string")
    got = audit.audited(rules, model).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.rank, r.code, r.path, r.title) for r in got] == [(1, 1, "Z", "a", "t"), (1, 2, "R", "a", None), (1, 3, "R", "b", None), (1, 4, "A", "a", "t"), (2, 1, "A", "", "t")]


def test_for_prompt(spark):
    cases = [('{"a":1,"cikarim_meta":{"guven":1},"b":{"cikarim_meta":2}}', {"a": 1, "b": {"cikarim_meta": 2}}), ("{}", {}), ("[1]", {}), (None, {})]
    got = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(cases)], "k int, j string").select("k", audit.for_prompt(F.parse_json("j")).alias("x")).orderBy("k").collect()
    assert [json.loads(r.x) for r in got] == [want for _, want in cases]
