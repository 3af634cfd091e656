"""Filter audit, conversation trie and top-k search: against brute force on hard fixtures, and whole tables against SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pactline.llm import filter_audit, prefix_trie, queries, topk_search

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_tables_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want_rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[c] for c in columns) for r in want_rows)


# filters


def test_swaps_visit_every_order_once():
    order, seen = list("ABCDE"), [tuple("ABCDE")]
    for k in filter_audit.swaps(5):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == 120 and set(seen) == set(itertools.permutations("ABCDE"))


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                before = set(order[: step - 1])
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    r = random.Random(1)
    long = lambda n, k: " ".join(r.choice([f"wörd{j}" for j in range(k)]) for _ in range(n))
    texts = [None, "", " \n", "A B", "a#b", *(long(n, k) + e for n in (199, 200, 230) for k in (60, 400) for e in ("", " $", " " + "AB" * 60))]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(90)]
    docs += [(None, "a#b", "en"), (None, None, None), (3, docs[3][1], "en"), (3, docs[3][1], "en"), (3, "other", "fr"), (-1, docs[9][1], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (1000, 1, 1)]
    # names that the operator uses inside
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n long").repartition(3)
    marks = spark.createDataFrame([(*x, True) for x in labels], "doc_id long, quality int, toxic int, good boolean")
    got = {(x.part, x.filter_order, x.step): [x[c] for c in filter_audit.COUNTS] for x in filter_audit.filter_audit(frame, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.filter_audit(frame.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(frame.limit(3), marks.limit(0)).count() % 600 == 0


# conversations


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    out = {}
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(members) if full[c] == list(node))
        children = sum(len(m) == len(node) + 1 and m[: len(node)] == node for m in nodes)
        out[min(members), len(node)] = (min(nodes[node[:-1]]) if node else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_conversation_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    r = random.Random(2)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["", None, "é🙂", "hello", "a:b"]))
    turns = []
    for c in [*range(14), *range(100, 112), 350, 351, -7, -103]:
        turns += [(c, t, *say()) for t in range(r.randint(1, 7))]
    line = [say() for _ in range(30)]
    turns += [(400 + k, t, *line[t]) for k in range(25) for t in range(k + 1)]  # each extends the one before
    turns += [(600 + k, t, "user", "same") for k in range(20) for t in range(3)]  # equal conversations
    turns += [(5, None, "user", "first"), (5, 2, "user", "again"), (5, 2, "assistant", "again"), (None, 1, "user", "x"), (6, -4, None, None)]
    frame = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, pos long, path string").repartition(3)
    rows = prefix_trie.prefix_trie(frame).collect()
    got = {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in rows}
    assert len(got) == len(rows) and got == brute_trie(turns)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0


# search


def brute_search(rows, every, k):
    part = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((n, i, [math.floor(1024 * x) if abs(x) < 1e300 else int(np.nan_to_num(1024 * x)) for x in v]))
    out = []
    for n, i, q in part:
        if i is not None and i % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -(2**63)), 2**63 - 1), j is None, j or 0) for m, j, c in part if m != n and len(c) == len(q))
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [4, 128])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "SHARD", 5 * block)
    monkeypatch.setattr(topk_search, "CHUNK", 7)
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(g.normal(size=(8, 6)), 30, 0) + g.normal(size=(240, 6)) * 0.05)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # equal vectors: ties by id
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (2040, []), (2050, []), (2060, [1.0, 2.0]), (2061, [1.0, -2.0])]
    rows += [(1000, [0.5] * 6), (1000, [0.4] * 6), (None, [0.5] * 6), (None, [9.0] * 6), (-20, [0.1] * 6)]
    wide = [(3000 + 5 * i, [float(x) for x in g.normal(size=3) * s]) for i, s in enumerate([1e3, 1e5, 1e9, 1e12, 1e3, 1e200, 1e307])]
    for data in (rows, [*rows, *wide]):
        frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<double>, row long, score double").repartition(3)
        got = Counter((x.query_id, x.rank, x.vec_id, x.score) for x in topk_search.top_k(frame, 10, 5).collect())
        assert got == brute_search(data, 10, 5)
    assert topk_search.top_k(frame.limit(0)).count() == 0


def test_blocks_below_the_kth_score_are_not_visited():
    g = np.random.default_rng(4)
    x = np.floor(1024 * (np.repeat(np.eye(8), 128, 0) + g.normal(size=(1024, 8)) * 0.02))
    row = {"ids": list(range(1024)), "rows": list(range(1024)), "terms": [v.astype(np.int32).tobytes() for v in x], "wide": [False] * 1024, "size": 8, "starts": list(range(0, 1024, 128))}
    shard, seen = topk_search._Shard(row), []
    best = topk_search._Best(np.full(8, np.iinfo(np.int64).min), np.full(8, topk_search.LAST), 10)
    offer = best.offer
    best.offer = lambda who, *rest: (seen.extend(who), offer(who, *rest))
    shard.search(x[::128], np.arange(0, 1024, 128), best)
    assert Counter(seen) == Counter(range(8))  # each query needs its own block alone
