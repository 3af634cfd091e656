"""Broken model answers and the objects they stand for."""

import json

import pytest

from pactline.operators import json_repair as j

CASES = [
    ('{"a": 1}', {"a": 1}),
    ('  sonuç:\n```json\n{"a": 1.50, "b": [1, 2,]}\n``` son', {"a": 1.5, "b": [1, 2]}),
    ("```\nyok\n``` {\"a\": 1}", {"a": 1}),
    ('```json\n{"a": 1', {"a": 1}),
    ('{"a": {"b": 1}}, "c": 2}', {"a": {"b": 1}, "c": 2}),
    ('{"a": "}"}} , "c": "{"}', {"a": "}", "c": "{"}),
    ('{"a": {"x": 1, "l": [1]}} {"a": {"y": 2, "l": [2]}, "b": 3}', {"a": {"x": 1, "l": [1, 2], "y": 2}, "b": 3}),
    ('{"a": 1} metin {"b": [1, {"c": "ya', {"a": 1}),  # what stands up to the last brace is whole
    ('{"a": 1} metin {"b": [1, {"c": {}, "d": "ya', {"a": 1, "b": [1, {"c": {}}]}),
    ('{"a": [1, 2, {"b": "x"', {"a": [1, 2, {"b": "x"}]}),
    ('{"a": 1, "b": tr', {"a": 1}),
    ('{"a": 01}', {"a": 0}),
    ('{"a": 1.}', None),
    ('{"a": "\\u0131\\q", "b', {"a": "ıq"}),
    ('{"n": 12345678901234567890, "e": 1e3, "m": -0', {"n": 1.2345678901234567e19, "e": 1000.0, "m": 0}),
    ("", None), (None, None), ("metin", None), ("{}", None), ("[1]", None), ("{" * 5000, None),
]


@pytest.mark.parametrize("raw, want", CASES)
def test_repair(raw, want):
    assert j.repair(raw) == want


def test_every_cut_of_an_object_keeps_complete_entries():
    whole = {"a": {"b": [1, {"c": "d"}], "e": None}, "f": "g\\\"h", "i": [True, -2.5]}
    text = json.dumps(whole)

    def holds(part, of):
        if isinstance(part, dict):
            return isinstance(of, dict) and all(k in of and holds(v, of[k]) for k, v in part.items())
        if isinstance(part, list):
            return isinstance(of, list) and len(part) <= len(of) and all(holds(x, y) for x, y in zip(part, of))
        return part == of or (isinstance(part, (int, float)) and isinstance(of, float))  # a number may be cut

    for n in range(len(text)):
        assert holds(j.repair(text[:n]) or {}, whole)
    assert j.repair(text) == whole


def test_merge_depth():
    assert j.merged({"a": {"x": 1}, "l": [1], "s": 1}, {"a": {"y": 2}, "l": [2], "s": [3]}) == {"a": {"x": 1, "y": 2}, "l": [1, 2], "s": [3]}


def test_parts_and_other_readings():
    assert j.repair_part('{"oda_kontenjanlari": []}, "donem": {"baslangic": "2026-01-01"}, "release": {"gun": 7') == {"oda_kontenjanlari": [], "donem": {"baslangic": "2026-01-01"}, "release": {"gun": 7}, "baslangic": "2026-01-01", "gun": 7}
    assert j.repair_part('metin "fiyatlar": [{"tutar": 5}, {"tu') == {"tutar": 5, "fiyatlar": [{"tutar": 5}, {}]}
    assert j.repair_findings('```json\n[{"baslik": "x"}]\n```') == [{"baslik": "x"}] and j.repair_findings("[1] ve [2]") is None and j.repair_findings("[1] ve [2") == [1]
    assert j.first_object('x {"a": 1} y') == {"a": 1} and j.first_object('{"a": 1} {"b": 2}') is None
    assert j.updated_objects('{"a": {"x": 1}} {bozuk} {"a": {"y": 2}, "b": 1}') == {"a": {"y": 2}, "b": 1}
    assert j.without_early_closers('{"a":1},"b":{"c":2}}}') == '{"a":1,"b":{"c":2}}'


@pytest.mark.parametrize("depth", [200, 900, 20_000])
def test_depth_has_no_limit(depth):
    for opened in ('{"a":', '{"a":[', '{"b": 1, "a":'):
        found = j.repair(opened * depth)
        levels = 0
        while isinstance(found, (dict, list)) and found:
            found = found["a"] if isinstance(found, dict) and "a" in found else found[0] if isinstance(found, list) else None
            levels += 1
        assert levels >= depth - 1
    assert j.repair('{"a":' * depth + '{"a":' + "}" * 3) is not None


def test_deep_answers_do_not_end_a_job(spark):
    rows = [(k, '{"a":' * n + '{"x":1') for k, n in enumerate((3, 400, 30_000))] + [(9, None)]
    got = {r.k: r.j for r in spark.createDataFrame(rows, "k long, t string").select("k", j.repaired("t").alias("j")).collect()}
    assert got[0] == '{"a":{"a":{"a":{"x":1}}}}' and got[1].count("{") == 401 and got[2] is None and got[9] is None


def test_a_break_in_an_inner_container_is_taken_up_by_the_outer_one():
    assert j._container('{"a": {"b": 1, x, "c": 2}', 0, "{") == ({"a": {"b": 1}}, 15)
    assert j._container('{"a": [1, }, "c": 2}', 0, "{") == ({"a": [1]}, 11)
    assert j._container('[[1, {"a": 2 ], 3]', 0, "[") == ([[1, {"a": 2}], 3], 18)


def test_orphans_that_can_be_read_as_they_are():
    from pactline.operators import json_repair as j

    whole = '{"release": {"gun": 7}}, "stop_sale": [{"b": "}]"}, null], "meta": {"x": 123456789012345678901234567890}'
    assert j.orphans(whole) == {"release": {"gun": 7}, "stop_sale": [{"b": "}]"}, None], "meta": {"x": 1.2345678901234568e29}}
    assert j.orphans('"release": {"gun": 1e999}') == {"release": {"gun": "1e999"}}
