"""Whether a value conforms to a schema, against the messages of its faults."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pactline.operators import schema as v

WHOLE = {
    "meta": {"otel_adi": "d", "sezon": "yaz", "imza_tarihi": None}, "donem": {"baslangic": "2026-05-01", "bitis": None, "alt_donemler": [{"ad": "a", "baslangic": "2026-05-01", "bitis": "2026-05-03"}]},
    "oda_kontenjanlari": [{"oda_tipi": "suit", "adet": 3.0}], "fiyatlar": [{"oda_tipi": "suit", "tutar": 1.5, "birim": "oda_gecelik", "pansiyon": "HB"}], "release": {"gun": 7, "kapsam": "her_ikisi"},
    "stop_sale": [{"baslangic": "2026-05-01", "bildirim_yontemi": "faks"}], "opsiyonel": {"cocuk_politikasi": [{"yas_min": 1, "indirim_yuzde": 100, "ucretsiz": True}], "odeme": {"avans_var": False}},
    "cikarim_meta": {"x": {"guven": 0.5, "kaynak_sayfa": 1}},
}
VALUES = (None, True, 0, -1, 7, 2.5, 1e20, 101, "", "2026-02-30", "2026-05-01", "HB", "yaz", [], {}, [None], [{}], {"x": 1}, 123456789012345678901234567890)


def _places(x, path=()):
    yield path
    for k, e in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from _places(e, (*path, k))


def _changed(r):
    x = json.loads(json.dumps(WHOLE))
    for _ in range(r.choice((0, 1, 1, 2))):
        *path, last = r.choice([p for p in _places(x) if p])
        into = x
        for k in path:
            into = into[k]
        if r.random() < 0.3:
            del into[last]
        elif r.random() < 0.2 and isinstance(into, dict):
            into[r.choice(("y", "gun", "ad"))] = r.choice(VALUES)
        else:
            into[last] = r.choice(VALUES)
    return json.dumps(x)


def test_conforming_is_being_without_faults(spark):
    r = random.Random(6)
    texts = [*(_changed(r) for _ in range(1500)), "null", "5", "[]", "{}", '"x"', "{"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", F.try_parse_json("t").alias("v"))
    got = df.select("t", v.conforms(F.col("v"), v.CONTRACT).alias("a"), (F.col("v").isNotNull() & (F.size(v.violations(F.col("v"), v.CONTRACT)) == 0)).alias("b")).collect()
    assert [x.t for x in got if x.a is not x.b] == [] and 50 < sum(x.a for x in got) < 1400


@pytest.mark.parametrize("schema", [{}, {"type": ["string", "object"]}, {"enum": ["a"]}, {"type": "object", "properties": {"a": {"type": "boolean"}}, "additionalProperties": {"type": ["integer", "null"], "maximum": 3}}, {"type": "array"}])
def test_other_schemas(spark, schema):
    df = spark.createDataFrame([(t,) for t in ("1", '"a"', "{}", '{"a": true, "b": 3}', '{"a": 1}', '{"b": 4}', '{"b": null}', "[]", "[1]", "null", "true")], "t string").select("t", F.try_parse_json("t").alias("v"))
    got = df.select("t", v.conforms(F.col("v"), schema).alias("a"), (F.size(v.violations(F.col("v"), schema)) == 0).alias("b")).collect()
    assert [x.t for x in got if x.a is not x.b] == []


def test_conforming_makes_no_messages(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(F.try_parse_json("t").alias("v"))
    assert "kisit=" not in df.select(v.conforms(F.col("v"), v.CONTRACT))._jdf.queryExecution().analyzed().toString()
