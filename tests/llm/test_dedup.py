"""Deduplication operators against brute force on small, hard fixtures."""

import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactline.llm import _spark, embedding_dedup, line_dedup, minhash_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, id long, key string, n long"  # with names that the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "k", 2) for i, t in rows], DOCS).repartition(3)


def components(ids, linked):
    parent = {i: i for i in ids}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in ids}


def near_copies(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(80)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(n + k, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for k in range(30)]
    return [*rows, (9000, None), (9001, ""), (9002, "One"), (9003, "one "), (9004, " \n\t"), (9005, "one two"), (9006, rows[0][1])]


@pytest.mark.parametrize("block", [16, 512])
def test_minhash_components(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = near_copies(120)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    want = components(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert {i: got[i].component_id for i in want} == want
    assert {i: got[i].n_shingles for i in want} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_empty_table_and_stage(spark):
    assert minhash_dedup.near_duplicates(frame(spark, []).limit(0)).count() == 0
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None)])
    out = minhash_dedup.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_substring_windows(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(57)]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        if i % 3:
            a = r.randint(0, 30)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + r.randint(15, 57)]
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, "x " * 100), (93, rows[1][1]), (94, "\n".join(passage))]
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = substring_dedup.substring_factors(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert any(r.factors for r in got)
    assert substring_dedup.substring_factors(frame(spark, []).limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    g = np.random.default_rng(0)
    base = g.normal(size=(4, 8))
    x = np.concatenate([np.repeat(base, 20, 0) + g.normal(size=(80, 8)) * 0.3, g.normal(size=(40, 8))]).astype(np.float32)
    x = np.concatenate([x, x[:6]]).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(600, None, 0), (601, [0.0] * 8, 0), (602, [float("nan")] + [1.0] * 7, 0), (603, [], 0), (604, [1.0, None] + [0.0] * 6, 0), (605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0)]
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    link = unit @ unit.T >= 0.9
    want = components(range(len(x)), lambda a, b: link[a, b]) | {i: i for i in (600, 601, 602, 603, 604, 605)} | {606: 605}
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rep long").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_links == link[i].sum() - 1 for i in range(len(x)))
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, edits):
    out = list(text)
    for _ in range(edits):
        k = r.randrange(len(out))
        match r.randrange(3):
            case 0:
                out.insert(k, r.choice("abcé🙂"))
            case 1:
                out.pop(k)
            case _:
                out[k] = r.choice("abcé🙂")
    return "".join(out)


def test_banded_distance(spark):
    r = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(r.choices("abé🙂", k=r.randint(5, 14)))
        rows.append((a, edited(r, a, r.randint(0, 4))))
    for edits in (1, 2, 3):
        df = spark.createDataFrame([p for p in rows if abs(len(p[0]) - len(p[1])) <= edits and p[1]], "a string, b string")
        for x in df.select("a", "b", line_dedup.banded_edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
            true = distance(x.a, x.b)
            assert (x.d <= edits) == (true <= edits) and (true > edits or x.d == true)


def test_lines(spark):
    r = random.Random(2)
    bases = ["".join(r.choices("abcde é🙂", k=r.randint(28, 45))) for _ in range(12)]
    rows = [(i, "\n".join([*(edited(r, r.choice(bases), r.randint(0, 4)) for _ in range(4)), "short", ""])) for i in range(50)]
    rows += [(90, None), (91, ""), (92, rows[3][1]), (93, "\n" * 3)]
    every, want = [], {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            if len(line) >= 30:
                if any(abs(len(line) - len(o)) <= 2 and distance(line, o) <= 2 for o in every):
                    every.append(line)
                    continue
                every.append(line)
            kept.append(line)
        want[i] = None if t is None else "\n".join(kept)
    docs = frame(spark, rows)
    assert {x.doc_id: x.text for x in line_dedup.without_repeated_lines(docs).collect()} == want
    assert line_dedup.without_line_copies(spark, docs, "").columns == docs.columns
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_lines_in_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "FIRST", 6)
    r = random.Random(5)
    base = "".join(r.choices("abcdefghi klmnop", k=90))
    lines = []
    for _ in range(220):  # copies with some words replaced share a segment with most others
        own = base
        for _ in range(r.randint(1, 3)):
            k = r.randrange(0, 80)
            own = own[:k] + "".join(r.choices("uvwxyz", k=r.randint(4, 7))) + own[k + 6 :]
        lines.append(own)
        if r.random() < 0.3:
            lines.append(edited(r, own, r.randint(0, 3)))
    r.shuffle(lines)
    want = {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in lines[:i])}
    got = {x.doc_id for x in line_dedup.repeated_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert len(want) > 20 and got == want


def test_embeddings_of_a_dense_cluster_and_at_the_border(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 150)
    monkeypatch.setattr(embedding_dedup, "FEWEST", 4)
    g = np.random.default_rng(3)
    dense = g.normal(size=8) + g.normal(size=(300, 8)) * 0.02
    chain = np.stack([np.append([np.cos(t), np.sin(t)], np.zeros(6)) for t in np.arange(0, 3, 0.3)])
    border = []
    for e in (1e-9, -1e-9, 3e-9, -3e-9, 1e-12, -1e-12):
        a, b = np.linalg.qr(g.normal(size=(8, 2)))[0].T
        border += [a, (0.9 + e) * a + np.sqrt(1 - (0.9 + e) ** 2) * b]
    x = np.concatenate([dense, chain, border, g.normal(size=(100, 8))])
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
    cosine = unit @ unit.T
    clear = np.abs(cosine - 0.9) > 1e-13  # nearer to the border the last bit may fall either way
    link = cosine >= 0.9
    assert clear.all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == components(range(len(x)), lambda a, b: link[a, b])
    assert all(got[i].n_links == link[i].sum() - 1 for i in range(len(x)))


def test_dual_traversal_prunes_and_loses_nothing():
    g = np.random.default_rng(5)
    x = np.concatenate([c + g.normal(size=(60, 16)) * 0.02 for c in g.normal(size=(12, 16))])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    a, b, reach = embedding_dedup._Tree(x[::2], 0.45), embedding_dedup._Tree(x[1::2], 0.45), 0.45
    assert all((np.sort(t.points) == np.arange(360)).all() for t in (a, b))
    met = np.zeros((360, 360), bool)
    for i, j in embedding_dedup._links(a, b, reach):
        assert not met[np.ix_(i, j)].any()
        met[np.ix_(i, j)] = True
    assert met[x[::2] @ x[1::2].T >= 0.9].all() and met.mean() < 0.3


def keyed(rows):
    """Rows with keys in the order in which operators put them: by id, nulls last, equal ids as they stand."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_minhash_rows_that_share_an_id_or_have_none(spark):
    long = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    a, b, c = long("a"), long("b"), long("c")
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} x"), (None, c), (7, f"{c} x"), (None, None), (None, long("d")), (8, ""), (8, a)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id long").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, 2).collect()), key=repr)
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (7, 7, True), (None, None, True), (None, None, True), (8, 8, True), (8, 1, False)]
    assert got == sorted(want, key=repr)
    nameless = minhash_dedup.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long")), 2).collect()
    assert len(nameless) == len(rows) and all(r.doc_id is None and r.component_id is None and r.kept for r in nameless)


def test_minhash_names_do_not_join_unlike_rows(spark):
    """Documents 2 and 3 are copies of two unlike rows that share an id: both keep the links of their own texts alone."""
    long = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(5, long("a")), (5, long("b")), (2, f"{long('a')} x"), (3, f"{long('b')} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs, 2).collect())
    assert got == [(2, 2), (3, 3), (5, 2), (5, 3)]


def test_embeddings_that_share_an_id_or_have_none(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x), (5, y), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (None, z), (None, z), (7, None), (7, x), (None, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()), key=repr)
    want = [(5, 2, 2, False), (5, 1, 3, False), (2, 2, 2, True), (3, 1, 3, True), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True), (7, 2, 2, False), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_substring_rows_that_share_an_id_or_have_none(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:40])), (1, " ".join(words[:40])), (2, "x " + " ".join(words[5:38])), (None, " ".join(words[30:])), (None, " ".join(words[30:])), (4, None), (4, "")]
    seen, want = set(), []
    for i, t in keyed(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # one copy of every passage is left
    assert sum(n for _, n, _, _ in got) - sum(g for _, _, g, _ in got) >= 60


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Rows are taken out by ids that are sent to them, a slice at a time, without a shuffle of the rows."""
    monkeypatch.setattr(_spark, "IDS", 3)
    docs = frame(spark, [(i, f"text {i}") for i in range(40)])
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 21, 99)], "doc_id long")
    out = _spark.rows_of(docs, ids, "doc_id")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 5, 8, 13, 21]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = minhash_dedup._item_sets(docs, ids, 2)
        assert "hashpartitioning" not in sets._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_with_their_job(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())) if f.getName().startswith("shuffle")}
    old, setting = files(), spark.conf.get(_spark.FREED)
    assert len(_spark.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    for _ in range(100):  # files are removed in the background
        left = [f for f in files() - old if f.endswith(".data")]
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(_spark.FREED) == setting


@pytest.mark.parametrize("few", [0, 1000])
def test_minhash_long_lists_meet_as_sketches(spark, monkeypatch, few):
    for name, value in {"SHORT": 2, "BLOCK": 8, "WIDER": 2, "FEW": few}.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    rows = near_copies(90, seed=8)
    sets = {i: set(zip((t or "").lower().split(), (t or "").lower().split()[1:])) or set((t or "").lower().split()) for i, t in rows}
    want = components(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == want


def test_agreeing_sketches(spark):
    g = np.random.default_rng(2)
    a = g.integers(0, 256, (300, 32), dtype=np.uint8)
    b = np.where(g.random((300, 32)) < 0.5, a, g.integers(0, 256, (300, 32), dtype=np.uint8)).astype(np.uint8)
    rows = [(*map(int, x.view(np.int64)), *map(int, y.view(np.int64)), int((x == y).sum())) for x, y in zip(a, b)]
    names = [f"{s}{x}" for x in "ab" for s in minhash_dedup.SKETCH]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", want long")
    assert df.where(minhash_dedup._agreeing(names[:4], names[4:]) != F.col("want")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_in_many_rounds(spark, monkeypatch, kind):
    """However many pairs of groups there are, a round moves a bounded number of copies of the points."""
    for name, value in {"BLOCK": 20, "GROUP": 3, "ROUND": 1, "FOLD": 2, "FEWEST": 4}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    g = np.random.default_rng(4)
    x = np.concatenate([np.repeat(g.normal(size=(5, 6)), 30, 0) + g.normal(size=(150, 6)) * 0.25, g.normal(size=(100, 6))])
    x = np.concatenate([x, x[:9] * 2]).astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    link = unit @ unit.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(3)
    moved = []
    rounds = embedding_dedup._rounds
    monkeypatch.setattr(embedding_dedup, "_rounds", lambda pairs, weights, most: (moved.append((len(p), weights[np.unique(p)].sum(), most)) or p for p in rounds(pairs, weights, most)))
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == components(range(len(x)), lambda a, b: link[a, b])
    assert all(got[i].n_links == link[i].sum() - 1 for i in range(len(x)))
    assert len(moved) > 3 and all(n == 1 or w <= most for n, w, most in moved)
