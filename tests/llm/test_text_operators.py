"""Scanning, scoring, tokenising and encoding operators against plain implementations."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pactline.llm import decontamination, pii_surrogates, secret_scan, sentencepiece_codec, token_output, toxicity
from pactline.llm._text import buffers

DOCS = "doc_id long, text string, kind string, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(2)


def base_spans(x):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], secret_scan.BASE.index(s[2])))


def test_secrets(spark):
    r = random.Random(1)
    bits = ["password", "ToKen", "api_key", "APIKEY", "secret", "  ", "=", ":", "'", '"', "abc", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef", "0123456789abcdef" * 2, "\n", ",", "xyz.12", "é", "🙂", "ſecret"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 25)))) for i in range(1500)] + [(2000, None), (2001, "x" * 50_000 + " token: abcdefgh1 "), (2002, "ghp_" + "a1" * 20)]
    got = {x.doc_id: x.spans for x in secret_scan.find_secrets(frame(spark, rows)).collect()}
    for i, t in rows:
        assert [(s.start, s.end, s.kind) for s in got[i] if s.kind in secret_scan.BASE] == base_spans(t or "")
    assert [s.kind for s in got[2002]] == ["github", "hex"]  # the 40 characters of the token are a base hex span too


def test_secret_automaton_is_minimal():
    auto, _ = secret_scan.compile_rules((("a", "ab|cb", 1), ("b", "x{2,3}y?", 1)))
    assert len({(tuple(auto.next[k]), auto.ends[k]) for k in range(len(auto.next))}) == len(auto.next)
    data, offsets = buffers(pa.array(["abxx\ncb", None, ""]))
    assert secret_scan.secret_spans(data, offsets, (("a", "ab|cb", 1), ("b", "x{2,3}y?", 1))) == [[(0, 2, 0), (2, 4, 1), (5, 7, 0)], [], []]


TEXTS = ["", " ", "  a  b ", "\n\nx\n y", "é🙂\0z", "<s>hi</s>", "▁ x▁", "a\t \xa0 b", "don't we'll 12 3²½", "漢字 かな", "<|endoftext|> x", "the " * 300, "x" * 3000]


def fuzz(n):
    r = random.Random(4)
    letters = [*"abcdeéñß  \n\t▁.,<>s/🙂漢\0①\xa0", "  ", "the", "ing", "'s"]
    return TEXTS + ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(n)]


def test_sentencepiece(spark):
    import sentencepiece

    path = sentencepiece_codec.vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(fuzz(800))) + [(9999, None)]
    got = {x.doc_id: x for x in sentencepiece_codec.encode_ids(frame(spark, rows), path).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i].ids == ids
        assert got[i].decoded == sp.decode(ids)
    own = sentencepiece_codec.codec(open(path, "rb").read())
    assert own._merged_long("▁" + "the" * 9) == own._merged("▁" + "the" * 9)
    assert own.decode(sp.encode("a ▁b é①")) == sp.decode(sp.encode("a ▁b é①"))


def test_token_files(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "SHARD_IDS", 500)
    path = sentencepiece_codec.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(7 * i, t) for i, t in enumerate(fuzz(500))] + [(99999, None)]
    token_output.write_tokens(frame(spark, rows), str(tmp_path / "ids"), path)
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_output.read_tokens(spark, str(tmp_path / "ids"), library.get_vocab_size()).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_output.write_tokens(frame(spark, []).limit(0), str(tmp_path / "none"), path)
    assert token_output.read_tokens(spark, str(tmp_path / "none"), library.get_vocab_size()).count() == 0


def test_repair_round_trip():
    g = np.random.default_rng(0)
    docs = [np.append(g.integers(0, 12, n), 0).astype(np.uint16) for n in (0, 1, 5, 400, 3000)]
    raw = token_output.write_block(list(range(5)), docs, 50257)
    block = token_output.Block(raw, 50257)
    assert np.array_equal(block.all(), np.concatenate(docs))
    assert all(np.array_equal(block.ids(k), d) for k, d in enumerate(docs))
    assert len(block.symbols.low) < sum(map(len, docs))


def test_grammar_goes_on_until_no_pair_is_frequent():
    g = np.random.default_rng(1)
    copy = g.integers(0, 50_000, 700)
    docs = [np.append(copy, 0) for _ in range(40)] + [np.append(g.integers(0, 40, 2000), 0), np.zeros(300, np.int64)]
    seq, own, rules = token_output.compress(docs, 50257)
    pairs = {}
    at = 0
    for n in own.tolist():
        part = seq[at : at + n].tolist()
        at += n
        previous = None
        for k, p in enumerate(zip(part, part[1:])):  # occurrences that do not overlap
            if previous != (p, k - 1):
                pairs[p] = pairs.get(p, 0) + 1
                previous = (p, k)
            else:
                previous = None
    assert max(pairs.values()) <= 2 * token_output.LEAST and own[:40].max() <= 2  # copies become a symbol or two
    block = token_output.Block(token_output.write_block([None, *range(41)], docs, 50257), 50257)
    assert block.doc_ids.to_pylist() == [None, *range(41)] and all(np.array_equal(block.ids(k), d) for k, d in enumerate(docs))


def test_shards_write_each_rule_out_once(monkeypatch):
    g = np.random.default_rng(2)
    copy = g.integers(0, 50_000, 500)
    docs = [np.append(copy, 0) for _ in range(30)] + [np.append(g.integers(0, 30, 3000), 0), np.zeros(200, np.int64)]
    raw = token_output.write_block(list(range(32)), docs, 50257)
    calls = []
    levels = token_output.Block._levels
    monkeypatch.setattr(token_output.Block, "_levels", lambda self, symbols: calls.append(len(symbols)) or levels(self, symbols))
    block = token_output.Block(raw, 50257)
    assert np.array_equal(block.all(), np.concatenate(docs)) and all(np.array_equal(block.ids(k), d) for k, d in enumerate(docs))
    assert calls == [len(block.rules)]
    monkeypatch.setattr(token_output, "MOST_RULE_IDS", 0)
    assert np.array_equal(token_output.Block(raw, 50257).all(), np.concatenate(docs)) and len(calls) == 2


def test_pairs_are_numbered_as_in_order():
    g = np.random.default_rng(3)
    for top, n in ((40, 5000), (90_000, 5000), (1 << 32, 50), (5, 0)):
        pairs = (g.integers(0, top, n).astype(np.uint64) << np.uint64(32)) | g.integers(0, top, n).astype(np.uint64)
        want = np.unique(pairs, return_inverse=True, return_counts=True)
        assert all(np.array_equal(x, y) for x, y in zip(token_output._numbered(pairs), want))


def test_token_files_of_repeated_and_null_ids(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "SHARD_IDS", 50)
    path = sentencepiece_codec.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    long_ = "some words that are long " * 40
    rows = [(5, long_), (5, long_), (5, "x"), (None, "n"), (None, None), (1, ""), (9, long_)]
    token_output.write_tokens(frame(spark, rows), str(tmp_path / "ids"), path)
    got = token_output.read_tokens(spark, str(tmp_path / "ids"), library.get_vocab_size()).collect()
    assert sorted((x.doc_id or -1, x.n_tokens) for x in got) == sorted((i or -1, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    in_order = sorted(got, key=lambda x: x.start)
    assert [x.start for x in in_order] == [sum(y.n_tokens for y in in_order[:k]) for k in range(len(got))]
    assert [x.doc_id or -1 for x in in_order] == [-1, -1, 1, 5, 5, 5, 9]


def test_decontamination(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(20)] + [(50, None), (51, "alpha beta"), (52, items_punct := "Zeta, eta; theta! iota kappa lambda mu nu xi omicron")]
    rows, want = [], set()
    for i in range(120):
        w = [r.choice(words) for _ in range(60)]
        if i % 3 == 0:
            k = i % 20
            leak = items[k][1].split()
            if i % 2:  # an edited copy: every sixth word another one
                leak = [x if j % 6 else "edited" for j, x in enumerate(leak)]
            w[20:20] = leak
            want.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "say alpha beta now"), (903, items_punct.upper())]
    want |= {(902, 51), (903, 52)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(frame(spark, rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert decontamination.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, []).limit(0), bench).count() == 0


def test_decontamination_finds_every_alignment(spark):
    r = random.Random(11)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    draw = lambda n: [r.choice(common if r.random() < 0.3 else rare) for _ in range(n)]
    items = [(k, draw(r.choice([3, 7, 15, 30, 41]))) for k in range(60)]
    docs = []
    for k, x in items:  # each kind of lone, edited copy; no other document holds the item
        h = len(x) // 2
        copies = [x[:h], x[h:], x[: h + 1], [y for y in x for y in (y, "ins")]]
        copies += [[y if j % step else "edit" for j, y in enumerate(x)] for step in (3, 4, 5)]
        copies += [[y if r.random() > share else "edit" for y in x] for share in (0.2, 0.25)]
        docs += [draw(r.randint(0, 40)) + copies[k % len(copies)] + draw(r.randint(0, 40))]
    docs += [draw(100) for _ in range(20)]
    code = {w: np.uint64(i + 2) for i, w in enumerate(sorted({w for d in docs for w in d} | {w for _, x in items for w in x}))}
    coded = lambda xs: np.array([code[w] for w in xs], np.uint64)
    pairs = [(d, k) for d in range(len(docs)) for k in range(len(items))]
    scores, _ = decontamination.align([coded(docs[d]) for d, _ in pairs], [coded(items[k][1]) for _, k in pairs])
    want = {p: s for p, s in zip(pairs, scores.tolist()) if s >= decontamination.THRESHOLD}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = decontamination.contaminated(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench).collect()
    assert len(want) > 50 and {(x.doc_id, x.item_id): x.score for x in got} == pytest.approx(want)


def test_decontamination_in_small_blocks(spark, monkeypatch):
    r = random.Random(12)
    item = [f"x{i}" for i in range(30)]
    docs = [[r.choice(item) if r.random() < 0.2 else "o" for _ in range(300)] for _ in range(5)]
    docs[2][150:150] = [y if j % 4 else "edit" for j, y in enumerate(item)]
    monkeypatch.setattr(decontamination, "ENTRIES", 1)
    found = decontamination._found(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), decontamination._items(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")), 0.45)
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(2, 1)}


def test_alignment_scores():
    a = np.arange(10, 30, dtype=np.uint64)
    b = a.copy()
    b[7] = 99
    gap = np.concatenate([a[:8], [np.uint64(77)], a[8:]]).astype(np.uint64)
    scores, _ = decontamination.align([a, b, gap, a[:10], np.array([5], np.uint64)], [a, a, a, a, a])
    assert scores.tolist() == pytest.approx([1.0, 37 / 40, 39 / 40, 0.5, 0.0])


def test_subsequence_kernel():
    def brute(s, t, n, d):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), n):
            for j in combinations(range(len(t)), n):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += d ** (i[-1] - i[0] + j[-1] - j[0] + 2)
        return total

    words = ["idiot", "idxiot", "abcd", "diot", "toidi"]
    codes = toxicity._codes(words, 24)
    for k, w in enumerate(words):
        got = toxicity.subsequence_kernel(codes, np.repeat(codes[k : k + 1], len(words), 0), 3, 0.6)
        assert got.tolist() == pytest.approx([brute(f"^{v}$", f"^{w}$", 3, 0.6) for v in words], rel=1e-4)


def test_toxicity_held_out(spark):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "sor") for b in ("va", "ne", "ku", "pil", "dam", "gos")]
    rude = ["idiot", "moron", "scum", "clown"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                x = r.choice(rude)
                w.insert(r.randrange(40), x if i % 8 else x[:2] + "-" + x[2:])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "i d i o t s are"), (903, "x" * 5000)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(docs, marks.limit(0))
    assert all(x.score == pytest.approx(0.0, abs=1e-6) for x in toxicity.toxicity_scores(docs, none).collect())
    kept = toxicity.toxicity_scores(docs.limit(0), model)
    assert kept.count() == 0


def test_surrogates(spark):
    rows = [
        (1, "Mail Und.34@mail7.example.com or und.34@mail7.example.com, +1 (017) 555-7713 and +1-017-555-7713; 4111 1111 1111 1111, 4111111111111111!"),
        (2, None), (3, ""), (4, "Mrs. Anna Schmidt met Herr Weber; Госпожа Анна Иванова. 97.51.17.173"), (5, "clean 12, v1.2.3.4.5"),
    ]
    rows += [(100 + i, f"u{i}@a.b") for i in range(60)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in pii_surrogates.with_surrogates(docs, "k").collect()}
    assert got[2].text is None and got[3].text == "" and got[5].text == rows[4][1]
    one = re.fullmatch(r"Mail ([A-Z][a-z]{2}\.\d\d)@\S+\.example or (\S+)@\S+\.example, \+1 (\(\d{3}\) \d{3}-\d{4}) and \+1-(\S+); ([\d ]{19}), (\d{16})!", got[1].text)
    assert one and one[1].lower() == one[2] and re.sub(r"\D", "", one[3]) == re.sub(r"\D", "", one[4]) and one[5].replace(" ", "") == one[6]
    assert "34@mail7" not in got[1].text and "555-7713" not in got[1].text and "4111111111111111" not in got[1].text
    four = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+); Госпожа (\w+) ([А-Яа-я]+)\. (\S+)", got[4].text)
    assert four and four[1] in pii_surrogates.GIVEN["f", "latin"] and four[4] in pii_surrogates.GIVEN["f", "cyrillic"]
    assert len({got[100 + i].text for i in range(60)}) == 60
    assert not {got[100 + i].text for i in range(60)} & {t for _, t in rows}
    assert pii_surrogates.with_surrogates(docs.limit(0), "k").count() == 0


def test_surrogates_of_full_shapes(spark):
    """More entities than half a shape has room for, and every entity of a shape: distinct, none of them real, and it ends."""
    forms = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}.{b}.1.2" for a in range(10) for b in range(10)] + [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(2) for c in range(10) for d in range(10)]
    got = pii_surrogates.surrogates(spark.createDataFrame([(x,) for x in forms], "entity string"), "k").collect()
    real = set(forms)
    assert len(got) == len(real) == len({x.surrogate for x in got}) and not real & {x.surrogate for x in got}
    domains = {}
    for x in got:
        if x.kind == "email":
            assert domains.setdefault(x.entity.split("@")[1], x.surrogate.split("@")[1]) == x.surrogate.split("@")[1]
        else:
            assert all(int(p) < 256 for p in x.surrogate.split("."))


def test_surrogates_keep_references_together(spark):
    names = ["Mr Smith", "Mr. Smith", "Mr John Smith", "Mr. Paul Smith", "Mrs Smith", "Mrs Ann Smith", "Mr Jones", "Herr Schmidt"]
    got = {x.entity: x.surrogate for x in pii_surrogates.surrogates(spark.createDataFrame([(x,) for x in names], "entity string"), "k").collect()}
    family = {x: y.split()[-1] for x, y in got.items()}
    assert len({family[x] for x in names[:6]}) == 1 and len({family[x] for x in names[5:]}) == 3
    assert got["Mr John Smith"].split()[1] != got["Mr. Paul Smith"].split()[1] and got["Mrs Ann Smith"].split()[1] in pii_surrogates.GIVEN["f", "latin"]
    assert got["Mr Smith"].startswith("Mr ") and got["Mr. Smith"].startswith("Mr. ")
    again = {x.entity: x.surrogate for x in pii_surrogates.surrogates(spark.createDataFrame([(x,) for x in names], "entity string"), "other").collect()}
    assert again != got
    with pytest.raises(ValueError):
        pii_surrogates.surrogates(spark.createDataFrame([("Mr X",)], "entity string"), "")


def test_surrogates_of_cards_and_repeated_ids(spark):
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10
    cards = ["4111111111111111", "4111111111111112", "5500000000000004", "4012888888881881"]
    rows = [(1, "card " + cards[0]), (1, "nothing here"), (None, "mail a.b@c.de"), (None, cards[1] + " and " + cards[2]), (2, cards[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, new string")
    got = sorted(((x.doc_id or 0, x.n_entities, x.text, x.new) for x in pii_surrogates.with_surrogates(docs, "k").collect()))
    assert [x[:2] for x in got] == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 1)] and got[2][2] == "nothing here"
    assert {x[3] for x in got} == {"x"}
    found = re.findall(r"\d{16}", " ".join(x[2] for x in got))
    assert len(set(found)) == 4 and not set(found) & set(cards) and sorted(luhn(x) == 0 for x in found) == [False, True, True, True]
