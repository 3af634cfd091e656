"""The prefix trie of conversations, its subtree totals by peeling leaves with messages.

A node is a distinct sequence of the first d turns (role, text) of a conversation. It is keyed
by its depth and a 120-bit hash of the sequence: the XOR of one hash for each turn and place,
so that a node's parent is its own key XOR that of its last turn, and a prefix of any length
comes from partial XORs of blocks of turns.

Nodes fall into paths: each node belongs to the longest of its member conversations (ties to
the smaller id), so the nodes of one conversation follow each other down to a leaf. A node that
is no leaf waits for its children. The path below it is summed at once (suffix sums, in blocks
of depths), and the leaves are peeled path by path: a path holds a counter of the paths that
hang on its nodes; where the counter is zero, it sends its totals to the node that it hangs on
and is finished, until only the path of the root is left. Peeling single nodes would take as
many rounds as the longest conversation has turns; this way a round ends whole conversations,
and a chain of conversations that each extend the one before is a single path.

Finished paths leave the table, so each path is moved once or twice whatever the number of rounds.

Defined cases: a null role or text is empty; turns are ordered by turn (nulls first), and turns
of one number by role and text; turns without a conv_id belong to no conversation; an empty
table has no root and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm._spark import in_batches, saved, table

BLOCK = 1_024  # turns of one conversation, or depths of one path, that are scanned in one window
PIECE = 8_192  # conversation ids that are joined into one string


def _scanned(rows: DataFrame, key: str, at: str, sums: dict[str, tuple[str, Column]], down: bool = False) -> DataFrame:
    """``rows`` with running aggregates over ``at`` for each ``key`` (backwards where ``down``).

    Each (name: (aggregate, value)) is first run within blocks of ``BLOCK`` places, then over the
    blocks' totals, so that a key with very many rows needs no single task. An aggregate is "sum" or "bit_xor".
    """
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    order = (lambda c: F.col(c).desc()) if down else F.col
    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK))
    blocks = rows.groupBy(key, "block").agg(*(agg[how](value).alias(name) for name, (how, value) in sums.items()))
    earlier = W.partitionBy(key).orderBy(order("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "block", *(F.coalesce(agg[how](name).over(earlier), F.lit(0)).alias(f"{name}_before") for name, (how, _) in sums.items()))
    within = W.partitionBy(key, "block").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    run = rows.select("*", *(agg[how](value).over(within).alias(name) for name, (how, value) in sums.items())).join(blocks, [key, "block"])
    return run.select(*(c for c in rows.columns if c != "block"), *(join[how](F.col(name), F.col(f"{name}_before")).alias(name) for name, (how, _) in sums.items()))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and its rebuilt turns as (conv_id, pos from 0, role, text).

    A conversation starts with the first crc32(conv_id) % 6 turns of conversation conv_id - conv_id % 100.
    """
    turns = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("few", F.floor(F.col("turn") / BLOCK))  # a long conversation is numbered in blocks of turns
    counts = turns.groupBy("conv_id", "few").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("few")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("few").alias("f"), offset.alias("offset"))
    number = F.row_number().over(W.partitionBy("conv_id", "few").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    own = turns.select("*", number.alias("k")).join(counts, (F.col("conv_id") == F.col("c")) & F.col("few").eqNullSafe(F.col("f")))
    own = saved(own.select("conv_id", (F.col("k") + F.col("offset")).alias("pos"), "role", "text"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), heads.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = saved(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    first = convs.join(own.where("pos < 5").select(F.col("conv_id").alias("base"), "pos", "role", "text"), "base").where("pos < h").select("conv_id", "pos", "role", "text")
    later = own.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    return convs.select("conv_id"), first.unionByName(later)


def _memberships(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, t1, t2, chars, length): a row for each prefix of each conversation; t: hash of the last turn."""
    convs, rows = rebuilt(turns)
    digest = F.sha2(F.concat_ws(":", "pos", F.length("role"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = saved(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), half(1).alias("t1"), half(17).alias("t2"), F.length("text").cast("long").alias("chars")))
    chained = _scanned(rows, "conv_id", "depth", {"k1": ("bit_xor", F.col("t1")), "k2": ("bit_xor", F.col("t2"))})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(c) for c in ("depth", "k1", "k2", "t1", "t2", "chars")))
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    every = chained.select(*roots.columns).unionByName(roots)
    return every.join(lengths, "conv_id", "left").withColumn("length", F.coalesce("length", zero))


def _hashed(batches):
    """Hash of the pieces of each node, which come in order, one node's after the other."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))):
            if key != node:
                if node is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2"), node), ends=digest.hexdigest())])
                node, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
    if node is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2"), node), ends=digest.hexdigest())])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): hash of the ids of the conversations that end at a node.

    Ids are joined in pieces by ranges of ``PIECE``; the pieces of a node with several are read in order by one stream.
    """
    node = ["depth", "k1", "k2"]
    last = members.where("depth = length").withColumn("range", F.floor(F.col("conv_id") / PIECE))
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    pieces = saved(last.groupBy(*node, "range").agg(joined.alias("ids")))
    counts = pieces.groupBy(*node).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    many = pieces.join(counts.where("n > 1").select(*node), node).repartition(*node).sortWithinPartitions(*node, "range")
    return counts.where("n = 1").select(*node, F.sha2("ids", 256).alias("ends")).unionByName(in_batches(many.select(*node, "ids"), _hashed, "depth long, k1 long, k2 long, ends string"))


def _peeled(paths: DataFrame) -> DataFrame:
    """Messages (path, at, leaves, saved) to the nodes that paths hang on, from (path, own, parent, at).

    ``own``: the path's own saved tokens; ``parent``, ``at``: the path that it hangs on and the depth there, null for the root's.
    """
    waiting = paths.join(paths.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("pending")), "path", "left")
    waiting = saved(waiting.select("path", "parent", "at", F.coalesce("pending", F.lit(0)).alias("pending"), F.lit(1).cast("long").alias("leaves"), F.col("own").alias("saved")))
    sent = []
    while True:
        done = waiting.where("pending = 0 and parent is not null").select(F.col("parent").alias("path"), "at", "leaves", "saved")
        if done.isEmpty():
            break
        sent.append(saved(done.groupBy("path", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("paths"))))
        news = sent[-1].groupBy("path").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.sum("paths").alias("heard"))
        waiting = saved(
            waiting.where("pending > 0").join(news, "path", "left").select(
                "path", "parent", "at", (F.col("pending") - F.coalesce("heard", F.lit(0))).alias("pending"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            )
        )
    out = paths.limit(0).select("path", "at", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    for x in sent:
        out = out.unionByName(x.select("path", "at", "leaves", "saved"))
    return out.groupBy("path", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    members = saved(_memberships(turns))
    node = ["depth", "k1", "k2"]
    # the tail of a path belongs to the longest member; of equal lengths to the smallest id
    longest = F.max(F.struct("length", (-F.col("conv_id")).alias("id")))
    nodes = members.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (-longest["id"]).alias("path"), *(F.first(c).alias(c) for c in ("t1", "t2", "chars")))
    nodes = saved(nodes.select(*node, "conv_id", "n_convs", "path", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.where("depth > 0").join(above, ["depth", "p1", "p2"]).unionByName(nodes.where("depth = 0"), allowMissingColumns=True).join(children, node, "left").join(_ends(members), node, "left"))
    # a path hangs on the node above its top
    tops = nodes.groupBy("path").agg(F.sum("own").alias("own"), F.min_by(F.struct("parent_path", (F.col("depth") - 1).alias("at")), "depth").alias("top"))
    paths = saved(tops.select("path", "own", F.col("top.parent_path").alias("parent"), F.col("top.at").alias("at")))
    messages = _peeled(paths)
    heard = nodes.join(messages.withColumnRenamed("at", "depth"), ["path", "depth"], "left")
    value = lambda c: F.coalesce(c, F.lit(0))
    totals = _scanned(heard, "path", "depth", {"below": ("sum", value("leaves")), "saved_tokens": ("sum", F.col("own") + value("saved"))}, down=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return totals.select("conv_id", "depth", "parent_conv_id", "n_convs", value("n_children").alias("n_children"), (F.col("below") + 1).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM t),
crc(conv_id, base, rest, k, v) AS (SELECT conv_id, base, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM c0 UNION ALL
    SELECT conv_id, base, CASE WHEN k = 0 THEN substr(rest, 2) ELSE rest END, (k + 1) % 9, CASE WHEN k = 0 THEN xor(v, ascii(rest)::BIGINT) WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM crc WHERE k > 0 OR rest <> ''),
c AS (SELECT conv_id, base, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 0 AND rest = ''),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), coalesce(o.turns[h + 1:], [])) AS turns FROM c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = c.base),
m AS (SELECT conv_id, d AS depth, len(turns) AS n, turns[1:d] AS node, CASE WHEN d > 0 THEN turns[1:d - 1] END AS parent, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars FROM r, range(0, len(turns) + 1) x(d)),
v AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM m GROUP BY depth, node),
k AS (SELECT v.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM v c WHERE c.depth = v.depth + 1 AND c.parent = v.node) AS n_children FROM v LEFT JOIN v p ON p.depth = v.depth - 1 AND p.node = v.parent),
below AS (SELECT m.depth, m.node, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved) AS saved_tokens FROM k JOIN m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.depth, m.node)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256 FROM k JOIN below b ON b.depth = k.depth AND b.node = k.node
"""
