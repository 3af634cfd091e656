from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pactline.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and docs.count() == len(after)
        assert docs.columns[: len(columns)] == columns
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        before = after
    assert before


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_null_and_repeated_doc_ids(spark, monkeypatch, name):
    """A stage gives the rows that it gives where the same rows, in the same order, have ids of their own."""
    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity.Model(("idiot",), np.array([5.0, 5.0]), -5.0, 1.0, 0.0))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    prose = lambda tag: " ".join(f"{tag}word{i}" for i in range(40))
    line = "a line of more than thirty characters that is repeated"
    texts = [prose("a"), prose("a"), prose("b"), f"{line}\nx", f"other\n{line}", "you idiot", "", None, f"so {item} it is", prose("c"), prose("a"), "an idiot", f"{item} once more", f"{line}\nend", prose("c"), None]
    ids = [3, 3, 3, 7, 7, 7, 8, 8, 8, None, None, None, None, None, None, None]
    rows = [(i, t, k % 3) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id long, text string, other long"
    stage = dict(corpus_pipeline.STAGES)[name]
    # one partition: rows of equal ids keep their order
    got = stage(spark, spark.createDataFrame(rows, schema).coalesce(1), SF)
    want = stage(spark, spark.createDataFrame([(k, *row[1:]) for k, row in enumerate(rows)], schema), SF)
    plain = lambda r, i: (i, *(tuple(v) if isinstance(v, list) else v for v in r[1:]))
    assert got.columns == want.columns
    assert Counter(plain(r, r.doc_id) for r in got.collect()) == Counter(plain(r, ids[r.doc_id]) for r in want.collect())
