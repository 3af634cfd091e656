"""Benchmark decontamination: an exact bound on shared words, then Smith-Waterman alignment.

Words are runs of letters and digits of the lower-cased text. The score of a document and an
item is their best local alignment over words (match 2, mismatch and gap -1) over the perfect
one (2 a word), so an exact copy has 1, a copy with a fifth of its words replaced about 0.7,
half an item 0.5. Pairs of at least ``THRESHOLD`` are contaminated.

No such pair is missed: an alignment of m matches and e errors over W document words has
2m - e >= s and W <= m + e, so m >= s / 2 and W <= 3m - s, where s is the least sum that
reaches the threshold. An item's most frequent words, by their count in the documents, are
left out as long as they hold at most half of the m that is needed; of the others at least
the other half must lie within 3 * (words of the item) - s words of the document. Where they
do, all the words that such an alignment could reach are aligned, unless even the best run of
them, counting 2 for every word that the item has anywhere and -1 for every other, is below s.
The choice of the words left out changes the work only, never the result.

At most ``SLICE`` item words are sent to the tasks at once; a larger test set is worked
through slice by slice, each over all documents.

Defined cases: null or blank texts, of documents or items, match nothing; an item of fewer
words than ``WHOLE`` counts only where it occurs as a whole; repeated items give a row each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import in_batches, table
from pactline.llm._text import U, Words, buffers, chunks

WHOLE = 3
THRESHOLD = 0.45
SLICE = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
ENTRIES = 2_000_000  # word hits that a task looks at together


def _words(column: pa.Array):
    """(first row, words) of consecutive rows of a text column."""
    data, offsets = buffers(pc.utf8_lower(column))
    for i, j in chunks(offsets):
        yield i, Words(data, offsets[i : j + 1], fold=False, punctuation=True)


class _Lookup:
    """Which of many hashes are in a small sorted set: a bitmap first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> U(42)).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g, positions in keys) of the hits."""
        at = np.flatnonzero(self.bits[(g >> U(42)).astype(np.int64)])
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == g[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], k[hit]


def _items(benchmark: DataFrame):
    """(item_id, word hashes) of one slice, on the driver; its size is bounded by SLICE."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id").toArrow()
    out = []
    for i, w in _words(rows["text"]):
        for r in range(len(w.first) - 1):
            if w.first[r + 1] > w.first[r]:
                out.append((rows["item_id"][i + r].as_py(), w.hash[w.first[r] : w.first[r + 1]].copy()))
    return out


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score, words up to the end of the best alignment) of each window of words with its item."""
    scores, ends = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    for lo in range(0, len(order), 256):
        own = order[lo : lo + 256]
        high, wide = max(len(items[k]) for k in own), max(len(windows[k]) for k in own)
        a, b = np.zeros((len(own), high), U), np.full((len(own), wide), U(1))
        there = np.zeros((len(own), high), bool)
        for r, k in enumerate(own):
            a[r, : len(items[k])], b[r, : len(windows[k])], there[r, : len(items[k])] = items[k], windows[k], True
        ramp = np.arange(wide, dtype=np.int32) * -GAP
        row = np.zeros((len(own), wide + 1), np.int32)
        best, end = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        for i in range(high):
            step = np.where((a[:, i, None] == b) & there[:, i, None], MATCH, MISMATCH).astype(np.int32)
            now = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
            row[:, 1:] = np.maximum.accumulate(now + ramp, axis=1) - ramp
            top = row[:, 1:].argmax(axis=1)
            value = row[np.arange(len(own)), top + 1]
            better = value > best
            best, end = np.where(better, value, best), np.where(better, top + 1, end)
        for r, k in enumerate(own):
            scores[k], ends[k] = best[r] / (MATCH * len(items[k])), end[r]
    return scores, ends


def _counted(docs: DataFrame, keys: np.ndarray) -> dict[int, int]:
    """How often each item word occurs; a row for each word comes back, and their number is bounded."""

    def run(batches):
        lookup = _Lookup(keys)
        for batch in batches:
            counts = np.zeros(len(lookup.keys), np.int64)
            for _, w in _words(batch.column("text")):
                counts += np.bincount(lookup(w.hash)[1], minlength=len(counts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(lookup.keys[some].view(np.int64)), pa.array(counts[some])], ["word", "n"])

    rows = in_batches(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["word"].to_numpy().view(np.uint64).tolist(), rows["n"].to_pylist()))


def _least_sum(words: int, threshold: float) -> int:
    """The least alignment sum of an item of so many words that counts; at least 1, as a sum of 0 aligns nothing."""
    if words < WHOLE:
        threshold = max(threshold, 1.0)
    s = max(1, math.floor(threshold * MATCH * words) - 1)
    while s / (MATCH * words) < threshold:
        s += 1
    return s


def _kept_words(words: np.ndarray, often: dict[int, int], least: int) -> tuple[list[int], int]:
    """(words looked for, how many of them an alignment must match at least)."""
    need = -(-least // MATCH)
    unique, counts = np.unique(words, return_counts=True)
    spare, kept = need // 2, []
    for n, w, c in sorted(((often.get(w, 0), w, c) for w, c in zip(unique.tolist(), counts.tolist())), reverse=True):
        if n and c <= spare:
            spare -= c
        else:
            kept.append(w)
    return kept, need - need // 2 + spare


def _upper_bounds(windows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """An upper bound of each window's alignment sum with an item: words that the item has count 2, in any order, others -1."""
    sizes = np.array([len(x) for x in windows], np.int64)
    heads = np.cumsum(sizes + 1) - sizes - 1
    every, own = np.concatenate([y for x in windows for y in (x[:1], x)]), np.unique(words)
    steps = np.where(own[np.searchsorted(own, every).clip(max=len(own) - 1)] == every, MATCH, -1)
    steps[heads] = -MATCH * (int(sizes.max()) + 1) * 2  # sums begin anew with each window
    sums = np.cumsum(steps)
    return np.maximum.reduceat(sums - np.minimum.accumulate(sums), heads)


def _scorer(docs: DataFrame, items: list, threshold: float):
    """A function over Arrow batches that aligns their texts with the items."""
    every = np.unique(np.concatenate([x[1] for x in items])) if items else np.zeros(0, U)
    often = _counted(docs, every) if len(every) else {}
    seeds: list[tuple[int, int]] = []
    lengths = np.array([len(x[1]) for x in items], np.int64)
    least = [_least_sum(n, threshold) for n in lengths.tolist()]
    reach = 3 * lengths - np.array(least, np.int64)  # so many document words an alignment has at most
    needed = np.zeros(len(items), np.int64)
    for k, (_, words) in enumerate(items):
        kept, needed[k] = _kept_words(words, often, least[k])
        seeds += [(w, k) for w in kept]
    seeds.sort()
    keys_ = np.array([w for w, _ in seeds], U)
    item_of = np.array([k for _, k in seeds], np.uint16 if len(items) < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    longest = int(reach.max()) if len(items) else 0

    def blocks(hit, n):
        """Ranges of hits of about ENTRIES entries; any two hits within reach of each other share one."""
        i, total = 0, np.append(0, np.cumsum(n))
        while i < len(hit):
            j = max(int(np.searchsorted(total, total[i] + ENTRIES, side="right")) - 1, int(np.searchsorted(hit, hit[i] + longest)))
            yield i, min(j, len(hit))
            i = int(np.searchsorted(hit, hit[j] - longest + 1)) if j < len(hit) else len(hit)

    def spans(w, lookup, first, many):
        """(row, item, first word, end) of the parts of rows to be aligned."""
        owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        hit, key = lookup(w.hash)
        n, parts = many[key], []
        for i, j in blocks(hit, n):
            m, k = n[i:j], key[i:j]
            item = item_of[np.repeat(first[k] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            order = np.argsort(item, kind="stable")  # hits come in the order of words
            item, at = item[order], np.repeat(hit[i:j], m)[order]
            last = np.arange(len(item)) + needed[item] - 1
            there = np.flatnonzero(last < len(item))
            last = last[there]
            near = (item[last] == item[there]) & (at[last] - at[there] < reach[item[there]])
            near &= owner[at[last]] == owner[at[there]]
            there, last = there[near], last[near]
            k, row = item[there].astype(np.int64), owner[at[there]]
            parts.append(np.stack([row, k, np.maximum(at[last] - reach[k] + 1, w.first[row]), np.minimum(at[there] + reach[k], w.first[row + 1])]))
        row, item, lo, hi = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
        order = np.lexsort((lo, item, row))
        row, item, lo, hi = row[order], item[order], lo[order], hi[order]
        fresh = np.ones(len(row), bool)  # overlapping parts for one item are one; of one item, ends rise with beginnings
        fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        heads = np.flatnonzero(fresh)
        return row[heads], item[heads], lo[heads], hi[np.append(heads[1:], len(row)) - 1] if len(row) else hi

    def scored(batches):
        """(batch, {(row, item): (score, last word)}) of each batch."""
        lookup = _Lookup(keys_)
        first = np.searchsorted(keys_, lookup.keys, side="left")
        many = np.searchsorted(keys_, lookup.keys, side="right") - first
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for i, w in _words(batch.column("text")):
                row, item, lo, hi = spans(w, lookup, first, many)
                windows = [w.hash[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                by_item, chosen = np.argsort(item, kind="stable"), np.zeros(0, np.int64)
                for own in np.split(by_item, np.flatnonzero(np.diff(item[by_item])) + 1) if len(item) else []:
                    k = int(item[own[0]])
                    chosen = np.append(chosen, own[_upper_bounds([windows[x] for x in own], items[k][1]) >= least[k]])
                scores, ends = align([windows[x] for x in chosen], [items[item[x]][1] for x in chosen])
                for k, r, s, score, end in zip(item[chosen].tolist(), row[chosen].tolist(), (lo - w.first[row])[chosen].tolist(), scores.tolist(), ends.tolist()):
                    if score >= least[k] / (MATCH * lengths[k]) and score > best.get((i + r, k), (0.0, 0))[0]:
                        best[i + r, k] = (score, s + end)
            yield batch, best

    return scored


def _found(docs: DataFrame, items: list, threshold: float) -> DataFrame:
    scored = _scorer(docs, items, threshold)

    def run(batches):
        for batch, best in scored(batches):
            keys = sorted(best)
            ids = batch.column("doc_id").take(pa.array([r for r, _ in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([items[k][0] for _, k in keys], pa.int64()), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][1] for x in keys], pa.int64())], ["doc_id", "item_id", "score", "end_word"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, item_id long, score double, end_word long")


def _clean(docs: DataFrame, counted: DataFrame, items: list, threshold: float) -> DataFrame:
    """The rows of ``docs`` that hold a copy of no item; words are counted in ``counted``."""
    scored = _scorer(counted, items, threshold)

    def run(batches):
        for batch, best in scored(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in best]] = False
            yield batch.filter(pa.array(keep))

    return in_batches(docs, run, docs.schema)


def _slices(benchmark: DataFrame) -> list[DataFrame]:
    words = benchmark.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # at most so many words
    slices = max(1, math.ceil(words / SLICE))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else benchmark for k in range(slices)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word) of each document and test item that it holds a copy of."""
    return reduce(DataFrame.unionByName, (_found(docs, _items(part), threshold) for part in _slices(benchmark)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a copy of a test item, with their columns.

    Rows are judged where they stand, so null and repeated doc_ids keep their rows.
    """
    return reduce(lambda d, part: _clean(d, docs, _items(part), THRESHOLD), _slices(table(spark, sf_dir, "benchmark")), docs)
