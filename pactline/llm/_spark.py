"""Cutting lineage and connected components, shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and every executor can reach.

    Where a session on one machine names none, a temporary folder is set; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pactline-"))
    return sc.getCheckpointDir()


#: a setting that frees the shuffle files of a job when it has ended
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, with its lineage cut and its shuffle files freed."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:  # the setting is read when a DataFrame is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(FREED, before)


#: so many ids of 8 bytes are broadcast at once
IDS = 500_000


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (one long column of that name), which are sent out a slice at a time.

    Rows with long texts stay where they are: ``df`` is read once for each slice and never shuffled.
    """
    own = saved(ids.select(key).distinct())
    slices = max(1, -(-own.count() // IDS))
    each = [own.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) if slices > 1 else own for k in range(slices)]
    out = [df.join(F.broadcast(x), key, "left_semi") for x in each]
    return reduce(DataFrame.unionByName, out)


#: so many bytes of a table go to a Python worker at once; a longer row is a batch of its own
BATCH = (4 << 20, 4096)
WIDE = (32 << 20, 10_000)


def in_batches(df: DataFrame, run: Callable, schema, size: tuple[int, int] = BATCH) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded by bytes and rows, so that long texts do not fill a worker.

    The bounds are settings of the session and those of the last call hold when a job runs.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size[0]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size[1]))
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` for a stage that needs distinct doc_ids: where some are null or repeated, rows get keys of their own.

    The keys are written once to the shared folder. They follow the order of doc_id, nulls
    last, and the stage's result has the rows' own doc_ids again.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return stage(docs)
    own = unused(docs, "own_doc_id")
    keyed = saved(docs.orderBy(F.asc_nulls_last("doc_id")).select(F.col("doc_id").alias(own), "*").withColumn("doc_id", F.monotonically_increasing_id()))
    out = stage(keyed)
    return out.select(*(F.col(own).alias(c) if c == "doc_id" else F.col(c) for c in out.columns if c != own))


def grouped_by_row(rows: DataFrame, key: str, group: str | None, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(rows)`` for an operator that names rows by ``key`` and groups, if any, by their least ``key`` in a column ``group``.

    Where keys are null or repeated, rows are told apart by keys of their own (as in ``by_row``),
    and afterwards rows and groups have the rows' keys again: a group is named by the least key in
    it, null only if it has no other. ``kept`` is then whether both are the same, nulls included.
    """
    if rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        return stage(rows)
    names = saved(rows.orderBy(F.asc_nulls_last(key)).select(F.monotonically_increasing_id().alias("row_key"), *rows.columns))
    own = names.select(F.col("row_key").alias("k"), F.col(key).alias("own"))
    out = stage(names.select(F.col("row_key").alias(key), *(c for c in rows.columns if c != key)))
    named = out.join(own, F.col(key) == F.col("k"))
    if group is None:
        return named.select(*(F.col("own").alias(c) if c == key else F.col(c) for c in out.columns))
    first = own.select(F.col("k").alias("g"), F.col("own").alias("first"))
    named = named.join(first, F.col(group) == F.col("g"))
    same = F.col("own").eqNullSafe(F.col("first"))
    return named.select(*({key: F.col("own").alias(key), group: F.col("first").alias(group), "kept": same.alias("kept")}.get(c, F.col(c)) for c in out.columns))


def _least(pairs: DataFrame, key: str, other: str) -> DataFrame:
    return pairs.groupBy(F.col(key).alias("k")).agg(F.least(F.min(other), F.col("k")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): the least node reachable, for nodes with an edge.

    Alternating large-star and small-star rounds; each is a grouped minimum (combined on
    the map side) and an equi-join, so a node with very many edges needs no single task.
    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both, "a", "b"), F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.join(_least(large, "a", "b"), F.col("a") == F.col("k"))
        e = saved(down.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
