"""Columns of the input that are named like the columns an operator adds."""

from pyspark.sql import functions as F

from pactline.llm import line_dedup, pii_surrogates, sentencepiece_codec

LINE = "a line that is long enough to be compared with others"
SPOTTED = "a line that is long enough to be compared with others!"


def test_lines_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, LINE, 77, "x"), (2, f"own\n{LINE}", 88, None), (3, None, None, "z")], "doc_id long, text string, N_Lines long, gone string")
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == ["doc_id", "N_Lines", "gone", "text", "_n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, 77, "x", LINE, 1, 0), (2, 88, None, "own", 2, 1), (3, None, "z", None, 0, 0)]
    stage = line_dedup.without_line_copies(spark, docs, "")
    assert stage.columns == docs.columns and {(r.doc_id, r.N_Lines, r.text) for r in stage.collect()} == {(1, 77, LINE), (2, 88, "own"), (3, None, None)}


def test_lines_of_a_long_text_go_and_stay_by_their_places(spark):
    many = [LINE if k % 3 == 0 else SPOTTED if k % 3 == 1 else f"s{k}" for k in range(30_000)]
    docs = spark.createDataFrame([(5, "\n".join(many)), (6, LINE), (7, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {5: ("\n".join([LINE, *many[2::3]]), 30_000, 19_999), 6: ("", 1, 1), 7: ("", 1, 0)}


def test_surrogates_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "write to ann@example.org", 5), (2, "nothing", None)], "doc_id long, text string, N_Entities long")
    got = {r.doc_id: r for r in pii_surrogates.with_surrogates(docs, "k").collect()}
    assert [(got[k].N_Entities, got[k]["_n_entities"]) for k in (1, 2)] == [(5, 1), (None, 0)] and "ann@example.org" not in got[1].text


def test_token_ids_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "plain words", "mine"), (2, None, None)], "doc_id long, text string, Token_Ids string")
    got = {r.doc_id: r for r in sentencepiece_codec.with_token_counts(spark, docs, "").collect()}
    assert got[1].Token_Ids == "mine" and len(got[1]["_token_ids"]) >= 2 and got[2].Token_Ids is None and not got[2]["_token_ids"]


def test_lines_meet_once_for_each_line_that_stands_for_their_lists(spark, monkeypatch):
    """Lines that share two segments share several lists; all of these have the same head."""
    seen = []
    near = line_dedup._near_in_lists
    monkeypatch.setattr(line_dedup, "_near_in_lists", lambda lists, edits: seen.append(lists.select("key", "id").collect()) or near(lists, edits))
    tails = [chr(97 + k % 26) * 5 + chr(97 + k // 26) * 5 + chr(97 + k * 7 % 26) * 5 for k in range(60)]
    docs = spark.createDataFrame([(k, f"the quick brown fox jumps over the lazy dog {t}") for k, t in enumerate(tails)], "doc_id long, text string")
    assert line_dedup.repeated_lines(docs).count() == 0
    rows = seen[0]
    assert len({r.id for r in rows}) == 60 and len(rows) == len(set(rows)) == 60


def test_lines_of_other_letters_meet_no_edit_distance(spark, monkeypatch):
    half = "one half of all these lines is the same text "
    lines = [half + letters * 5 for letters in ("eta", "oin", "srh", "ldc", "umf", "pgb")]
    monkeypatch.setattr(line_dedup, "within", lambda a, b, edits: F.raise_error(F.lit("compared")).cast("boolean"))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.repeated_lines(docs).count() == 0


def test_lines_share_keys_whatever_the_width_of_their_characters(spark):
    plain = "a resume of what is written in the first of these lines"
    other = "строка из многих букв, которые занимают по два байта"
    lines = [plain, plain.replace("resume", "résumé"), other, "x" + other, other[:-1] + "ё", plain.replace("resume", "résümé")[:-1]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.repeated_lines(docs).collect()} == {1, 3, 4, 5}
