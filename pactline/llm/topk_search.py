"""Exact top-k search by integer inner products, block at a time.

Components become terms floor(1024 * x). Vectors are laid out in document ranges: a bounded
sample gives centres, rows are sorted by their nearest centre and vec_id, and each run of at
most ``BLOCK`` rows of one centre is a block with a forward index (its matrix of terms) and the
greatest and least value of each term. Runs of blocks make shards of at most ``SHARD`` rows; a
shard is one row of a table, written once. Sorting by centre and id cuts a group of copies of any size into many blocks.

For a query, the sum over its terms of weight times term maximum (minimum where the weight is
negative) bounds every score in a block. A task takes one shard and a chunk of at most
``CHUNK`` queries; each query visits the shard's blocks in the order of their bounds and stops
when the next bound falls below its kth score. Before, every query was scored in the block that
it stands in itself and those that follow, so that it comes to all other shards with a kth
score. Of blocks whose bound equals the kth score, only those that hold a smaller id are
visited, so a query among many copies of one vector stops as well. Each task returns at most k rows for a query, and the k best of all shards are ranked in a window.

The centres change only how much is pruned; every row is indexed and every result exact. Each
query must see each shard's bounds, so the work grows with queries times shards, and where
vectors are in general position (bounds above all scores) with queries times rows: a chunk is
sent to every shard, and a shard to none.

Defined cases: vectors that are null, or hold null or non-finite components take no part;
vectors of different lengths never meet; an empty vector scores 0 with other empty ones;
products are exact whatever the size of components, a score beyond a long is the nearest long;
rows that repeat a vec_id are rows of their own (another row with the query's id is a
candidate); a row with null vec_id is a candidate that comes last among ties, and no query;
queries with fewer than k candidates have fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm._spark import in_batches, saved, table

TERMS = 1024
BLOCK = 128
SHARD = 8_192  # rows at most; fewer where vectors are long
SHARD_BYTES = 8 << 20
CHUNK = 2_048  # queries
CENTRES = 1_024  # at most, and at most CENTRES_BYTES of them
CENTRES_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max  # stands for a null vec_id, which comes last
ROW = "row long, vec_id long, size int, wide boolean, terms binary"


def _terms(batches):
    """Rows that take part, as integers: four bytes a term, or eight (as doubles) where one is beyond."""
    for batch in batches:
        rows = []
        for row, i, v in zip(batch.column("row").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(TERMS * x))
            wide = bool(len(x) and np.abs(x).max() >= 2**31)
            rows.append((row, i, len(x), wide, (x if wide else x.astype(np.int32)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["row", "vec_id", "size", "wide", "terms"])


def _matrix(terms: list[bytes], wide: list[bool], size: int) -> np.ndarray:
    if not any(wide):
        return np.frombuffer(b"".join(terms), np.int32).reshape(len(terms), size).astype(np.float64)
    return np.stack([np.frombuffer(t, np.float64 if w else np.int32).astype(np.float64) for t, w in zip(terms, wide)])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in doubles where no sum can leave 53 bits, else in unbounded integers."""
    with np.errstate(over="ignore"):
        small = not q.size or not x.size or float(np.abs(q).sum(axis=1).max()) * float(np.abs(x).max()) < 2**53
    if small:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and block, what no score of the block is above; rounded up where doubles are not exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        b = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
        reach = float(np.abs(q).sum(axis=1).max(initial=0)) * float(max(np.abs(most).max(initial=0), np.abs(least).max(initial=0)))
    if reach < 2**53:
        return b
    return b + reach * 1e-12 if np.isfinite(reach) else np.full(b.shape, np.inf)


class _Best:
    """The k best (score, id, row) of each query, and the kth score and id that a candidate must reach."""

    def __init__(self, score: np.ndarray, last: np.ndarray, k: int):
        self.k, self.score, self.last = k, score.copy(), last.copy()
        n = len(score)
        self.scores, self.ids, self.rows = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), LAST), np.full((n, k), -1)

    def offer(self, who: np.ndarray, own: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries ``who`` (whose own rows are ``own``) with the documents (ids, rows)."""
        good = ((score > self.score[who, None]) | ((score == self.score[who, None]) & (ids[None, :] <= self.last[who, None]))) & (own[:, None] != rows[None, :])
        for p in np.flatnonzero(good.any(axis=1)):
            w, c = who[p], np.flatnonzero(good[p])
            s, i, r = np.append(self.scores[w], score[p, c]), np.append(self.ids[w], ids[c]), np.append(self.rows[w], rows[c])
            best = np.lexsort((r, i, -np.maximum(s, np.iinfo(np.int64).min + 1), r < 0))[: self.k]  # unfilled places come last
            self.scores[w], self.ids[w], self.rows[w] = s[best], i[best], r[best]
            if self.rows[w, -1] >= 0:
                self.score[w], self.last[w] = self.scores[w, -1], self.ids[w, -1]


class _Shard:
    """Blocks of a shard: forward indexes, and the term maxima and minima and least id of each."""

    def __init__(self, row: dict):
        self.ids, self.rows = np.array([LAST if i is None else i for i in row["ids"]], np.int64), np.array(row["rows"], np.int64)
        self.x = _matrix(row["terms"], row["wide"], row["size"])
        self.at = np.append(np.array(row["starts"], np.int64), len(self.ids))
        cuts = list(zip(self.at[:-1], self.at[1:]))
        self.most, self.least = (np.stack([f(self.x[a:b], axis=0) for a, b in cuts]) for f in (np.max, np.min))
        self.first = np.array([self.ids[a:b].min() for a, b in cuts])

    def search(self, q: np.ndarray, own: np.ndarray, best: _Best) -> None:
        """Offer to ``best`` what the blocks hold, each query's blocks in the order of its bounds."""
        bound = bounds(q, self.most, self.least)
        order = np.stack([np.lexsort((self.first, -b)) for b in bound]) if len(q) else np.zeros((0, 0), np.int64)
        left = np.arange(len(q))
        for step in range(len(self.first)):
            block = order[left, step]
            b = bound[left, block]
            # bounds only fall from here: a query below its kth score is finished; one at it may still have a block of smaller ids
            stay = b >= best.score[left]
            left, block, b = left[stay], block[stay], b[stay]
            if not len(left):
                break
            visit = (b > best.score[left]) | (self.first[block] <= best.last[left])
            for k in np.unique(block[visit]):
                who, docs = left[visit & (block == k)], slice(self.at[k], self.at[k + 1])
                best.offer(who, own[who], products(q[who], self.x[docs]), self.ids[docs], self.rows[docs])


def _sharded(batches):
    """Sorted rows (row, vec_id, size, wide, terms, centre) as shards: a row for each run of blocks."""
    ids, rows, wide, terms, starts = [], [], [], [], []
    size = centre = None

    def shard():
        return pa.RecordBatch.from_pylist([{"shard": rows[0], "size": size, "ids": list(ids), "rows": list(rows), "wide": list(wide), "terms": list(terms), "starts": list(starts)}], schema=_SHARD)

    for batch in batches:
        for r, i, s, w, t, c in zip(*(batch.column(n).to_pylist() for n in ("row", "vec_id", "size", "wide", "terms", "centre"))):
            if ids and (s != size or len(ids) >= SHARD or len(ids) * (8 * s + 32) >= SHARD_BYTES):
                yield shard()
                for x in (ids, rows, wide, terms, starts):
                    x.clear()
            if not ids or c != centre or len(ids) - starts[-1] >= BLOCK:
                starts.append(len(ids))
            size, centre = s, c
            for x, v in zip((ids, rows, wide, terms), (i, r, w, t)):
                x.append(v)
    if ids:
        yield shard()


_SHARD = pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("wide", pa.list_(pa.bool_())), ("terms", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32()))])
SHARDS = "shard long, size int, ids array<long>, rows array<long>, wide array<boolean>, terms array<binary>, starts array<int>"


def _rows(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _seeded(every: int, k: int):
    """Queries of each shard with a kth score: the best of the block that they stand in and those beside it."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                s, out = _Shard(row), []
                for b in range(len(s.first)):
                    own = np.arange(s.at[b], s.at[b + 1])
                    own = own[(s.ids[own] != LAST) & (s.ids[own] % every == 0)]
                    own = own[[row["ids"][p] is not None for p in own]]
                    if not len(own):
                        continue
                    best = _Best(np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), LAST), k)
                    lo, hi = b, b + 1
                    while s.at[hi] - s.at[lo] <= k and hi - lo < len(s.first):
                        lo, hi = max(0, lo - 1), min(len(s.first), hi + 1)
                    docs = slice(s.at[lo], s.at[hi])
                    best.offer(np.arange(len(own)), s.rows[own], products(s.x[own], s.x[docs]), s.ids[docs], s.rows[docs])
                    out += [(int(s.rows[p]), int(s.ids[p]), row["size"], row["wide"][p], row["terms"][p], int(best.score[j]), int(best.last[j])) for j, p in enumerate(own)]
                cols = zip(*out) if out else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row", "vec_id", "size", "wide", "terms", "kth", "kth_id"])

    return run


def _searched(k: int):
    """The best of a shard for each query of a chunk: (row, query_id, vec_id, score)."""

    def run(batches):
        last = shard = None
        for batch in batches:
            for row in _rows(batch):
                if row["shard"] != last:
                    last, shard = row["shard"], _Shard(row)
                chunk = row["chunk"]
                q = _matrix([c["terms"] for c in chunk], [c["wide"] for c in chunk], row["size"])
                own = np.array([c["row"] for c in chunk], np.int64)
                best = _Best(np.array([c["kth"] for c in chunk], np.int64), np.array([c["kth_id"] for c in chunk], np.int64), k)
                shard.search(q, own, best)
                p, j = np.nonzero(best.rows >= 0)
                ids = best.ids[p, j]
                names = np.array([c["vec_id"] for c in chunk], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[p]), pa.array(names[p]), pa.array(ids, mask=ids == LAST), pa.array(best.scores[p, j])], ["row", "query_id", "vec_id", "score"])

    return run


def _placed(centres: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            sizes, nearest = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for size in np.unique(sizes):
                if (c := centres.get(int(size))) is not None:
                    own = np.flatnonzero(sizes == size)
                    part = batch.take(pa.array(own))
                    x = _matrix(part.column("terms").to_pylist(), part.column("wide").to_pylist(), int(size))
                    nearest[own] = (x @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], [*batch.schema.names, "centre"])

    return run


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of a bounded sample, for each length; they decide which rows stand together, never what is found."""
    about = rows.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    most = max(1, min(CENTRES, (about.n or 0) // (2 * BLOCK), CENTRES_BYTES // (8 * max(1, about.size or 1))))
    seen = rows.select("row", "size", "wide", "terms").orderBy(F.xxhash64("row"), "row").limit(most).toArrow()
    out = {}
    for size in set(seen["size"].to_pylist()) - {0}:
        own = seen.filter(pc.equal(seen["size"], size))
        x = _matrix(own["terms"].to_pylist(), own["wide"].to_pylist(), size)
        out[size] = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1)
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of (vec_id, embedding) for each row whose vec_id is divisible by ``every``."""
    numbered = saved(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    rows = saved(in_batches(numbered, _terms, ROW))
    placed = in_batches(rows, _placed(_centres(rows)), f"{ROW}, centre int")
    order = ("size", "centre", F.asc_nulls_last("vec_id"), "row")
    shards = saved(in_batches(placed.repartitionByRange(*order).sortWithinPartitions(*order), _sharded, SHARDS))
    queries = saved(in_batches(shards, _seeded(every, k), f"{ROW}, kth long, kth_id long"))
    n = queries.count()
    # whole chunks by hash; each is sent to lanes, and a lane's shards meet it there
    chunked = queries.groupBy("size", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // CHUNK)))).alias("c")).agg(F.collect_list(F.struct("row", "vec_id", "wide", "terms", "kth", "kth_id")).alias("chunk"))
    lanes = max(1, shards.count())
    sent = chunked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = shards.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int")).join(sent, ["size", "lane"])
    found = in_batches(met, _searched(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS t FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.t[i] * c.t[i] FOR i IN range(1, len(q.t) + 1)])::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.t) = len(c.t)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
