"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of ``COORDINATES`` minima. Sets are posted
under their (coordinate, value) pairs; two sets that agree on at least ``MATCHES``
coordinates must meet in the rarest ``COORDINATES - MATCHES + 1`` postings of each
(prefix merging), so values that many sets share are skipped unless a set has little
else. The collisions of the pairs that met are counted on whole signatures; pairs at or
above ``MATCHES`` are confirmed on full shingle sets. Collisions are counted on sketches of a
byte for each coordinate, which agree wherever the signatures do, so that texts and full sets
move only for the pairs that are left.

At Jaccard 0.8 a coordinate agrees with probability 0.8: fewer than 13 agreements of 32
have a probability below 3e-7, so practically no link is lost, and none is wrong.

A group of near copies is not expanded into all pairs: each posting list first links its
members to its least member (a star), then only members that are still in different
components are compared: in short lists as pairs, in long ones in blocks of bounded size
whose tasks return a spanning forest of the links found. Members of a list's largest
component are not compared with each other again. Long lists meet as sketches first, and only
members with a partner there as full sets. Sets that occur more than once are one
row from the start.

Defined cases: a null or blank text has an empty set and links with nothing; a text of
fewer words than a shingle has its whole word sequence as one shingle; equal sets are
always in one component; rows that share a doc_id, or have none, are rows of their own, linked by
their own texts (a component is named by its least doc_id, null only if it has no other, and a row
is kept if its doc_id is that name); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import by_row, components, grouped_by_row, in_batches, rows_of, saved, table
from pactline.llm._text import U, Words, buffers, chunks, mix

COORDINATES = 32
MATCHES = 13
SHORT = 16  # members of a posting list that meet as pairs
BLOCK = 512  # members of a longer list in one block of full sets
WIDER = 32  # blocks of full sets in one block of sketches
FEW = 4  # pairs for each member that move as pairs
SKETCH = ("s0", "s1", "s2", "s3")  # the low bytes of a signature, eight to a long
_rng = np.random.default_rng(7)
_XOR = _rng.integers(1, 1 << 62, (COORDINATES, 1), dtype=np.int64).astype(U)
_MUL = _rng.integers(1, 1 << 62, (COORDINATES, 1), dtype=np.int64).astype(U) * U(2) + U(1)


def shingle_sets(column: pa.Array, words: int):
    """The sorted distinct shingle hashes of each row of a text column."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        w = Words(data, offsets[i : j + 1], fold=True)
        for r in range(j - i):
            own = w.hash[w.first[r] : w.first[r + 1]]
            if len(own) == 0:
                yield own
                continue
            n = min(words, len(own))
            g = own[: len(own) - n + 1].copy()
            for k in range(1, n):
                g = g * U(0xD6E8FEB86659FD93) + own[k : len(own) - n + 1 + k]
            yield np.unique(mix(g + U(n)))


def _signatures(words: int):
    def run(batches):
        for batch in batches:
            sizes, sums, xors, signs = [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                sizes.append(len(s))
                sums.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                xors.append(int(np.bitwise_xor.reduce(s * U(0x9E3779B97F4A7C15)).view(np.int64)) if len(s) else 0)
                best = np.full(COORDINATES, ~U(0), U)
                for at in range(0, len(s), 4096):
                    np.minimum(best, ((s[None, at : at + 4096] ^ _XOR) * _MUL).min(axis=1), out=best)
                signs.append((best >> U(33)).astype(np.int32) if len(s) else np.zeros(0, np.int32))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in signs])]).astype(np.int32)
            values = np.concatenate(signs) if signs else np.zeros(0, np.int32)
            sketch = np.zeros((len(signs), len(SKETCH)), np.int64)
            for r, x in enumerate(signs):
                if len(x):
                    sketch[r] = x.astype(np.uint8).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), *(pa.array(sketch[:, k]) for k in range(len(SKETCH)))],
                ["doc_id", "n_shingles", "f1", "f2", "sign", *SKETCH],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), words)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["id", "items"])

    return run


def _item_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, items) of the documents whose ids are given."""
    return in_batches(rows_of(docs, ids, "doc_id"), _sets(words), "id long, items array<long>")


def _agreeing(a: list[str], b: list[str]) -> Column:
    """How many bytes of two sketches are equal."""

    def unequal(x: Column) -> Column:
        for by in (4, 2, 1):  # the lowest bit of each byte says whether a bit of it is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return COORDINATES - reduce(Column.__add__, [unequal(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)])


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sets of such sizes can be linked."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _sketches(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), *(F.col(x).alias(f"{x}{side}") for x in SKETCH))


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): the pairs (a, b) whose signatures agree often enough."""
    met = pairs.join(_sketches(classes, "a"), "a").join(_sketches(classes, "b"), "b")
    return saved(met.where(_alike("na", "nb", percent) & (_agreeing([f"{x}a" for x in SKETCH], [f"{x}b" for x in SKETCH]) >= MATCHES)).select("a", "b", "na", "nb"))


def _confirmed(close: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``close`` whose full sets are similar enough."""
    sets = _item_sets(docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")), words)
    both = close.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _partnered(percent: int):
    """Partners among the members of one or two blocks of sketches: as pairs (a, b, na, nb), or, if these are more than ``FEW`` for each member, as the members that have one (key, x, y, rep, comp), x and y the blocks of full sets in which they meet."""

    def run(group: pa.Table) -> pa.Table:
        reps, comps, own, sizes, wide = (group[c].to_numpy() for c in ("rep", "comp", "own", "n", "wide"))
        order = np.argsort(sizes, kind="stable")
        reps, comps, own, sizes, wide = reps[order], comps[order], own[order], sizes[order], wide[order]
        sketch = np.stack([group[c].to_numpy() for c in SKETCH], axis=1)[order].view(np.uint8)
        left, right = np.flatnonzero(wide == wide.min()), np.flatnonzero(wide == wide.max())
        columns, pairs, met, n = np.ascontiguousarray(sketch[right].T), [], [], 0
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            lo, hi = np.searchsorted(100 * sizes[right], percent * sizes[i[0]]), np.searchsorted(percent * sizes[right], 100 * sizes[i[-1]], side="right")
            agree = np.zeros((len(i), hi - lo), np.uint8)
            for k in range(COORDINATES):
                agree += sketch[i, k][:, None] == columns[k, lo:hi][None, :]
            p, q = np.nonzero(agree >= MATCHES)
            p, q = i[p], right[lo + q]
            fits = (comps[p] != comps[q]) & (100 * np.minimum(sizes[p], sizes[q]) >= percent * np.maximum(sizes[p], sizes[q]))
            p, q = p[fits], q[fits]
            n += len(p)
            if n <= FEW * len(reps):
                pairs.append(np.where(reps[p] < reps[q], [p, q], [q, p]))
            x, y = np.minimum(own[p], own[q]), np.maximum(own[p], own[q])
            met.append(np.unique(np.stack([np.concatenate([x, x]), np.concatenate([y, y]), np.concatenate([p, q])]), axis=1))
        p, q = np.unique(np.concatenate(pairs, axis=1), axis=1) if n <= FEW * len(reps) else np.zeros((2, 0), np.int64)
        x, y, r = np.unique(np.concatenate(met, axis=1), axis=1) if n > FEW * len(reps) else np.zeros((3, 0), np.int64)
        blocks = {"key": np.full(len(r), group["key"][0].as_py(), np.int64), "x": x, "y": y, "rep": reps[r], "comp": comps[r]}
        both = {"a": reps[p], "b": reps[q], "na": sizes[p], "nb": sizes[q]}
        none = lambda size: pa.nulls(size, pa.int64())
        columns = {k: pa.concat_arrays([pa.array(v, pa.int64()), none(len(p))]) for k, v in blocks.items()} | {k: pa.concat_arrays([none(len(r)), pa.array(v, pa.int64())]) for k, v in both.items()}
        return pa.table(columns)

    return run


def _linked(percent: int):
    """Exact links between members of two blocks, as a spanning forest over their components."""

    def run(group: pa.Table) -> pa.Table:
        items = group["items"].combine_chunks()
        sizes = np.diff(items.offsets.to_numpy())
        value, column = np.unique(items.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        shared = np.bincount(column, minlength=len(value)) > 1
        dense = np.cumsum(shared) - 1
        keep = shared[column]
        common = np.zeros((len(sizes), len(sizes)), np.float32)
        order = np.argsort(dense[column[keep]], kind="stable")
        row, column = row[keep][order], dense[column[keep]][order]
        for lo in range(0, int(shared.sum()), 2048):  # a slice of the vocabulary at a time
            cut = slice(*np.searchsorted(column, [lo, lo + 2048]))
            has = np.zeros((len(sizes), 2048), np.float32)
            has[row[cut], column[cut] - lo] = 1
            common += has @ has.T
        link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        reps, comps = group["rep"].to_numpy(), group["comp"].to_numpy()
        root = {int(c): int(c) for c in comps}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(link & (comps[:, None] != comps[None, :]), 1))):
            x, y = top(int(comps[i])), top(int(comps[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(reps[i]))
                b.append(int(reps[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _partners(members: DataFrame, percent: int) -> DataFrame:
    """``_partnered`` of the members (key, rep, comp, n: size, and a sketch) of long lists that are in different components."""
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"))
    blocks = lambda n: F.ceil(n / BLOCK)
    counts = counts.select("key", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("c") - F.col("most")).alias("others"))
    placed = members.join(counts, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    # blocks of the main component are numbered -1, -2, ...; they meet the others only
    placed = placed.withColumn("own", F.when(F.col("is_main"), -1 - F.col("own")).otherwise(F.col("own"))).withColumn("wide", F.floor(F.col("own") / WIDER))
    last = F.floor((F.col("others") - 1) / WIDER)
    met = placed.withColumn("with", F.explode(F.when(F.col("is_main"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.sequence(F.floor(-F.col("mains") / WIDER), last))))
    met = met.select("key", F.least("wide", "with").alias("u"), F.greatest("wide", "with").alias("v"), "wide", "own", "rep", "comp", "n", *SKETCH)
    return saved(met.groupBy("key", "u", "v").applyInArrow(_partnered(percent), "key long, x long, y long, rep long, comp long, a long, b long, na long, nb long"))


def _dense(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members (key, x, y, rep, comp) that meet in blocks of full sets."""
    sets = _item_sets(docs, members.select(F.col("rep").alias("doc_id")), words)
    return members.join(sets, F.col("rep") == F.col("id")).drop("id").groupBy("key", "x", "y").applyInArrow(_linked(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return grouped_by_row(docs.select("doc_id", "text"), "doc_id", "component_id", lambda d: _near_duplicates(d, words, percent))


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The same where each row has a doc_id of its own."""
    sketch = ", ".join(f"{x} long" for x in SKETCH)
    marked = saved(in_batches(docs, _signatures(words), f"doc_id long, n_shingles long, f1 long, f2 long, sign array<int>, {sketch}"))
    classes = saved(marked.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n"), *(F.first(x).alias(x) for x in SKETCH)))
    posts = classes.select("rep", "n", F.posexplode("sign").alias("c", "v")).select("rep", F.col("n").alias("size"), (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = posts.join(often, "key").groupBy("rep", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    # coordinates that no other set shares come first in the prefix; they have no partner
    prefix = saved(ranked.where(F.size("keys") >= MATCHES).select("rep", "size", F.explode(F.slice("keys", 1, F.size("keys") - (MATCHES - 1))).alias("k")).select("rep", "size", F.col("k.key").alias("key")))
    lists = prefix.groupBy("key").agg(F.min(F.struct("rep", "size")).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    stars = prefix.join(lists, "key").where((F.col("rep") != F.col("pivot.rep")) & _alike("size", "pivot.size", percent)).select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct()
    starred = _close(stars, classes, percent)
    links = saved(_confirmed(starred, docs, words, percent))
    # members of one list in different components have not been compared yet, or not linked
    found = components(links)
    placed = prefix.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    unsettled = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    rest = saved(placed.join(unsettled, "key").join(classes.select("rep", "n", *SKETCH), "rep"))
    short, long_ = rest.where(F.col("m") <= SHORT), rest.where(F.col("m") > SHORT).drop("m")
    left, right = (short.select("key", F.col("rep").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), *(F.col(k).alias(f"{k}{x}") for k in SKETCH)) for x in "ab")
    met = left.join(right, "key").where("a < b and ca <> cb").where(_alike("na", "nb", percent) & (_agreeing([f"{x}a" for x in SKETCH], [f"{x}b" for x in SKETCH]) >= MATCHES))
    partners = _partners(long_, percent)
    pairs = met.select("a", "b", "na", "nb").unionByName(partners.where("a is not null").select("a", "b", "na", "nb")).distinct()
    later = saved(pairs.join(starred.select("a", "b"), ["a", "b"], "left_anti"))
    links = links.unionByName(_confirmed(later, docs, words, percent))
    dense = partners.where("a is null").select("key", "x", "y", "rep", "comp")
    links = saved(links if dense.isEmpty() else links.unionByName(_dense(dense, docs, words, percent)))
    found = components(links)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    least = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), (F.col("doc_id") == least).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the least document of each group of near copies stays, with its columns."""
    return by_row(docs, lambda d: d.join(_near_duplicates(d.select("doc_id", "text"), 5, 80).where("kept").select("doc_id"), "doc_id", "left_semi").select(d.columns))
