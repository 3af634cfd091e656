"""Names, ids and labels on edge cases."""

from pyspark.sql import functions as F

from pactline.functions import labels as n


def values(spark, rows, *rules):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} {'double' if any(isinstance(r[i], float) for r in rows) else 'long' if any(isinstance(r[i], int) for r in rows) else 'string'}" for i in range(len(rows[0]))))
    cols = [F.col(c) for c in df.columns[1:]]
    return [tuple(r)[1:] for r in df.select("k", *(rule(*cols) for rule in rules)).orderBy("k").collect()]


def test_names_and_ids(spark):
    assert values(spark, [("a/b.tar.gz",), ("",), (None,), ("a//",), ("x",), (".pdf",)], n.file_name, lambda c: n.export_name(n.file_name(c))) == [
        ("b.tar.gz", "b.tar-cikarim.json"), ("sozlesme.pdf", "sozlesme-cikarim.json"), ("sozlesme.pdf", "sozlesme-cikarim.json"), ("a", "a-cikarim.json"), ("x", "x-cikarim.json"), (".pdf", "-cikarim.json"),
    ]
    assert values(spark, [("a b-Ç9",), (" ",), (None,)], n.dump_id) == [("ab-9",), ("bilinmeyen",), ("bilinmeyen",)]
    assert values(spark, [("0" * 32,), ("0" * 32 + "\n",), ("A" * 32,), (None,)], n.is_file_id) == [(True,), (False,), (False,), (False,)]
    assert values(spark, [(" a \n b ",), ("ş" * 513,), ("",)], n.snippet) == [("a b",), ("ş" * 512 + "…",), ("",)]


def test_numbers_and_states(spark):
    assert values(spark, [(0.2,), (0.0,), (1.9,), (None,)], n.whole_seconds) == [(1,), (0,), (1,), (None,)]
    assert values(spark, [(2, 0.285), (None, 0.5), (3, None), (None, None)], n.confidence_label) == [("s.2 · %28",), ("%50",), ("s.3",), (None,)]
    assert values(spark, [("HATA",), ("x",), (None,)], n.status_label, n.status_tone, n.is_pending) == [("Hata", "red", False), ("x", "muted", False), (None, "muted", False)]
    assert values(spark, [("a", "b"), (None, "b"), (None, None)], n.period_text) == [("a – b",), ("— – b",), ("—",)]
    assert values(spark, [(0.5, 1.0), (1.5, 1.0), (0.5, 0.0), (None, 5.0)], n.settings_accepted) == [(True,), (False,), (False,), (False,)]
