"""How filters of a corpus interact: every order of five filters, from one table of mask cells.

Each document becomes a mask of the filters it fails; documents are counted by part and mask,
with their labels, before anything else is done, so that the orders cost the same however many
documents there are. The 120 orders of a part are visited by single swaps of neighbours (the
Steinhaus-Johnson-Trotter walk). A swap changes what its two steps see and nothing else, so
only these two are counted anew from the cells, and a filter's Shapley sum takes a value times
the number of orders that it has stood for.

Filters (a document fails if): A it has fewer than 200 words; B its distinct words are under
half of its words; C more than 3 percent of its code points are A-Z; D it holds one of
``#$%&*|``; E its text is that of a document with a smaller doc_id anywhere in the table.

Documents of one text meet as counts (of part, labels and smallest id), never as rows, so a
group of copies of any size is a few rows when it is compared.

Defined cases: a null text is empty and a null lang is the part ''; an empty text fails A
alone (and E, where a smaller id is empty too); rows that repeat a doc_id count each, and are
no copies of each other for filter E; a null doc_id is smaller than none and larger than none,
and has no labels; a doc_id with several label rows is good (toxic) if one of them says so; an
empty table has no parts and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import table

FILTERS = "ABCDE"
COPY = 16  # the bit of filter E; A-D have 1, 2, 4, 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _text_failures(words: Column, text: Column) -> Column:
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail exactly the filters of a mask."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", _text_failures(F.col("words"), F.col("text")).alias("fails"), F.unhex(F.sha2("text", 256)).alias("key"))
    rows = rows.groupBy("doc_id", "part", "fails", "key").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    # rows without a doc_id have no labels; the salt keeps them from meeting in one task
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0))
    marked = salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").select("doc_id", "part", "fails", "key", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    texts = marked.groupBy("key", "part", "fails", "good", "bad").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("firsts"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    least = texts.groupBy("key").agg(F.min("first").alias("least"))
    fresh = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(0)
    split = texts.join(least, "key").select("part", "good", "bad", F.explode(F.array(F.struct(F.col("fails").alias("mask"), fresh.alias("n")), F.struct((F.col("fails") + COPY).alias("mask"), (F.col("n") - fresh).alias("n")))).alias("x"))
    count = lambda who: F.sum(F.when(who, F.col("x.n")).otherwise(0))
    return split.groupBy("part", "x.mask").agg(F.sum("x.n").alias("docs"), count(F.col("good")).alias("good"), count(F.col("bad")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Positions i whose swap with i + 1 leads from each order of n things to the next, through all n! orders."""
    if n < 2:
        return
    rest = swaps(n - 1)
    while True:  # the last thing runs down to the front, then up again; between its runs the others make one swap
        yield from range(n - 2, -1, -1)
        if (k := next(rest, None)) is None:
            return
        yield k + 1
        yield from range(n - 1)
        if (k := next(rest, None)) is None:
            return
        yield k


def audit(cells: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """(filter_order, step, *COUNTS) of every order, from {mask: (documents, good, toxic)}."""
    n = len(FILTERS)
    total, alone = sum(c[0] for c in cells.values()), [cells.get(1 << f, (0, 0, 0))[0] for f in range(n)]

    def counted(f: int, before: int) -> tuple[int, int, int, int]:
        """Removed, redundant, good and toxic documents lost, where filter f follows the filters of ``before``."""
        failing = [(m & before, c) for m, c in cells.items() if m >> f & 1]
        here = [c for seen, c in failing if not seen]
        return sum(c[0] for c in here), sum(c[0] for seen, c in failing if seen), sum(c[1] for c in here), sum(c[2] for c in here)

    order, before = list(range(n)), [(1 << k) - 1 for k in range(n)]
    steps = [counted(f, before[k]) for k, f in enumerate(order)]
    shapley, since, visited, seen = [0] * n, [0] * n, [], 0

    def settle(k: int) -> None:
        """The filter at place k has removed as many documents in each order since its last swap."""
        f = order[k]
        shapley[f] += steps[k][0] * (seen - since[f])
        since[f] = seen

    walk = swaps(n)
    while True:
        visited.append(("".join(FILTERS[f] for f in order), list(order), list(steps)))
        seen += 1
        if (k := next(walk, None)) is None:
            break
        settle(k)
        settle(k + 1)
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        steps[k], steps[k + 1] = counted(order[k], before[k]), counted(order[k + 1], before[k + 1])
    for k in range(n):
        settle(k)
    for name, filters, counts in visited:
        kept = total
        for k, (f, (removed, redundant, good, toxic)) in enumerate(zip(filters, counts), 1):
            kept -= removed
            yield name, k, kept, removed, redundant, alone[f], good, toxic, shapley[f]


def _audited(batches):
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            rows = list(audit({c["mask"]: (c["docs"], c["good"], c["toxic"]) for c in cells}))
            names, steps, *counts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), pa.array(names), pa.array(steps, pa.int32()), *(pa.array(c, pa.int64()) for c in counts)], ["part", "filter_order", "step", *COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step and ``COUNTS``."""
    parts = mask_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # at most 32 cells
    return parts.mapInArrow(_audited, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
x AS (SELECT f.*, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, s.step::INT AS step, (SELECT bit FROM letters WHERE c = substr(o, s.step::INT, 1)) AS bit, coalesce((SELECT sum(bit) FROM letters WHERE strpos(substr(o, 1, s.step::INT - 1), c) > 0), 0)::INT AS before
    FROM orders, range(1, 6) s(step)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM x GROUP BY ALL),
r AS (SELECT part, o, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(t) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
