"""Substring deduplication by relative Lempel-Ziv factors.

Every document is a reference block. Its index entries are anchors: in each window of
``WINDOW`` words the least of the hashes of its 5-word runs; equal windows have equal
anchors, and an anchor serves a short range of consecutive windows. A document is
factored against all blocks at once by bringing equal anchors together (one shuffle;
copies within a batch are combined first):

* an anchor whose whole range of words occurs earlier is a factor piece that points to
  the first occurrence (reference document and word);
* where ranges around equal anchors differ, a factor may begin or end inside the range;
  at such factor boundaries each window of the first occurrence of a range is compared
  by itself with all others.

Consecutive pieces that point on through one reference are one factor, the greedy
longest parse relative to first occurrences. Words covered by a factor of ``WINDOW``
words or more go; the first occurrence in order of (doc_id, position) stays.

Defined cases: a null text has no words; texts shorter than a window have no factor;
rows that share a doc_id, or have none, are documents of their own: they come one after the
other in the order of doc_id, nulls last, so of equal rows one keeps its words (the ``ref_doc`` of
a factor is then the row's number in that order); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import WIDE, grouped_by_row, in_batches, saved, table
from pactline.llm._text import U, Words, _table, buffers, chunks, grams, mix, pack, unpack

WINDOW = 20
GRAM = 5
_Q = U(0xBF58476D1CE4E5B9)
_Q_INVERSE = U(pow(int(_Q), -1, 1 << 64))
_LOW = U(0xFFFFFFFF)
_POSTS = "seed long, full long, doc long, at long, ref_doc long, ref_at long"
PACKED = "doc_id long, size long, packed binary"
_MARKS = "doc long, at long, ref_doc long, ref_at long, boundary boolean"


def _spans(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of words[a:b] for each pair."""
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * _table("q", _Q, len(words) + 1)[: len(words)], out=sums[1:])
    return (sums[b] - sums[a]) * _table("q-", _Q_INVERSE, len(words) + 1)[a]


def _anchors(w: Words):
    """(seed, full, row, at) of each anchor; at: the first window's word in the row * 256 + the number of windows."""
    n = len(w.hash)
    if n < WINDOW:
        return [np.zeros(0, U)] * 2 + [np.zeros(0, np.int64)] * 2
    g = grams(w.hash, GRAM)
    key = (g & ~_LOW) | np.arange(len(g), dtype=U)
    span, have = WINDOW - GRAM + 1, 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    counts = np.diff(w.first)
    p = np.arange(len(key))
    row = np.repeat(np.arange(len(counts)), counts)[: len(key)]
    valid = p + WINDOW <= w.first[row + 1]
    p, row, s = p[valid], row[valid], (key[valid] & _LOW).astype(np.int64)
    if len(p) == 0:
        return [np.zeros(0, U)] * 2 + [np.zeros(0, np.int64)] * 2
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(p)]]) - 1
    a, b, s, row = p[new], p[last], s[new], row[new]
    full = mix(_spans(w.hash, a, b + WINDOW) + (s - a).astype(U) * U(0x9E3779B97F4A7C15) + (b - a).astype(U))
    return g[s], full, row, ((a - w.first[row]) << 8) | (b - a + 1)


def _post(batches):
    """Anchors of each batch; a copy within the batch goes straight on as a factor piece."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for i, j in chunks(offsets):
            seed, full, row, at = _anchors(Words(data, offsets[i : j + 1], fold=False))
            parts.append((seed, full, ids[i + row], at))
        seed, full, doc, at = (np.concatenate(x) for x in zip(*parts)) if parts else _anchors(Words(data, offsets[:1], False))
        order = np.lexsort((at, doc, full))
        seed, full, doc, at = seed[order], full[order], doc[order], at[order]
        first = np.ones(len(full), bool)
        first[1:] = full[1:] != full[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(full)), 0)) if len(full) else np.zeros(0, np.int64)
        seed = np.where(first, seed, mix(doc.astype(U)))
        for lo in range(0, len(seed), 100_000):
            cut = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(seed[cut].view(np.int64)), pa.array(full[cut].view(np.int64)), pa.array(doc[cut]), pa.array(at[cut]), pa.array(doc[head[cut]], mask=first[cut]), pa.array(at[head[cut]], mask=first[cut])], ["seed", "full", "doc", "at", "ref_doc", "ref_at"])


def _match(batches):
    """Rows sorted by (seed, full, doc, at), in constant memory: copies point to the first row of
    their class; the first rows of a seed with several classes are factor boundaries."""
    names = ["doc", "at", "ref_doc", "ref_at", "boundary"]
    held = np.zeros((1, 4), np.int64)  # seed, full, doc, at of the class that was open when the batch ended
    open_, several = False, False  # whether there is one, and whether its seed had a class before

    def out(doc, at, ref_doc, ref_at, boundary):
        none = np.full(len(doc), boundary)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(ref_doc, mask=none), pa.array(ref_at, mask=none), pa.array(none)], names)

    for batch in batches:
        passed = batch.column("ref_doc").is_valid().to_numpy(zero_copy_only=False)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "full", "doc", "at")]
        refs = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("ref_doc", "ref_at")]
        if passed.any():
            yield out(cols[2][passed], cols[3][passed], refs[0][passed], refs[1][passed], False)
        rows = np.stack([c[~passed] for c in cols], axis=1)
        if len(rows) == 0:
            continue
        base = 1 if open_ else 0
        rows = np.concatenate([held, rows]) if open_ else rows
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        copies = np.flatnonzero(~first)
        if len(copies):
            yield out(rows[copies, 2], rows[copies, 3], rows[head[copies], 2], rows[head[copies], 3], False)
        heads = rows[first]
        same = heads[1:, 0] == heads[:-1, 0]
        many = np.concatenate([[several and base == 1], same]) | np.concatenate([same, [False]])
        if many[:-1].any():
            own = heads[:-1][many[:-1]]
            yield out(own[:, 2], own[:, 3], own[:, 2], own[:, 3], True)
        held, open_, several = heads[-1:], True, bool(many[-1])
    if open_ and several:
        yield out(held[:, 2], held[:, 3], held[:, 2], held[:, 3], True)


def _windows(batches):
    """The hash of each window of the boundary ranges of a document."""
    for batch in batches:
        data, offsets = buffers(pa.array(unpack(batch.column("size"), batch.column("packed")), pa.large_binary()).view(pa.large_string()))
        ids, lists = batch.column("doc_id").to_pylist(), batch.column("ranges")
        for i, j in chunks(offsets):
            w = Words(data, offsets[i : j + 1], fold=False)
            hashes, docs, starts = [], [], []
            sums = grams(w.hash, WINDOW)
            for r in range(i, j):
                at = lists[r].values.to_numpy()
                a, n = at >> 8, at & 255
                p = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                hashes.append(sums[w.first[r - i] + p])
                starts.append(p)
                docs.append(np.full(len(p), ids[r], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(docs)), pa.array((np.concatenate(starts) << 8) | 1)], ["window", "doc", "at"])


def _factors(pieces) -> list[tuple[int, int, int, int]]:
    """(start, words, ref_doc, ref_start) of the greedy parse: pieces that point on through one reference are joined."""
    out: list[tuple[int, int, int, int]] = []
    for at, ref_doc, ref_at in sorted(pieces):
        start, n, ref = at >> 8, (at & 255) - 1 + WINDOW, ref_at >> 8
        if out and ref_doc == out[-1][2] and ref - start == out[-1][3] - out[-1][0] and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]), *out[-1][2:])
        else:
            out.append((start, n, ref_doc, ref))
    return out


def _digest(batches):
    for batch in batches:
        pieces = batch.column("pieces")
        sizes, gone, digests, factors = [], [], [], []
        for text, own in zip(unpack(batch.column("size"), batch.column("packed")), pieces):
            words = text.split()
            found = _factors((x["at"], x["ref_doc"], x["ref_at"]) for x in own.as_py() or ())
            covered = np.zeros(len(words), bool)
            for start, n, *_ in found:
                covered[start : start + n] = True
            sizes.append(len(words))
            gone.append(int(covered.sum()))
            if found:
                words = [w for w, c in zip(words, covered.tolist()) if not c]
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            factors.append([{"start": a, "n_words": n, "ref_doc": d, "ref_start": r} for a, n, d, r in found])
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n_words", "ref_doc", "ref_start")]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(factors, kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def factor_pieces(docs: DataFrame) -> DataFrame:
    """(doc, at, ref_doc, ref_at): ranges of windows that occur earlier; at and ref_at are word * 256 + windows."""
    docs = docs.select("doc_id", "text")
    posts = in_batches(docs, _post, _POSTS, WIDE).repartition("seed").sortWithinPartitions("seed", "full", "doc", "at")
    marks = saved(in_batches(posts, _match, _MARKS, WIDE))
    ranges = marks.where("boundary").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("at").alias("ranges"))
    windows = saved(in_batches(in_batches(docs, pack, PACKED).join(ranges, "doc_id"), _windows, "window long, doc long, at long"))
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("ref"), F.count("*").alias("n")).where("n > 1")
    single = windows.join(firsts, "window").where("doc <> ref.doc or at <> ref.at").select("doc", "at", F.col("ref.doc").alias("ref_doc"), F.col("ref.at").alias("ref_at"))
    return marks.where("not boundary").drop("boundary").unionByName(single)


def substring_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, factors) for every row of ``docs`` (doc_id, text)."""
    return grouped_by_row(docs.select("doc_id", "text"), "doc_id", None, _substring_factors)


def _substring_factors(docs: DataFrame) -> DataFrame:
    """The same where each row has a doc_id of its own."""
    pieces = factor_pieces(docs).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("at", "ref_doc", "ref_at")).alias("pieces"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,n_words:long,ref_doc:long,ref_start:long>>"
    return in_batches(in_batches(docs.select("doc_id", "text"), pack, PACKED).join(pieces, "doc_id", "left"), _digest, kind)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_factors(table(spark, sf_dir, "documents")).drop("factors")
