"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers (floor(256 x)). Candidates are clustered around ``PIVOTS`` pivots at most and cut into blocks; in a
block every dimension has its own list, sorted once by value. For a query, each list is read from the end that raises the
score, some entries deeper in every round. Rows met for the first time are scored whole (random access). The bound is the
score of a row that would have, in every dimension, the value at the reading depth; reading stops when the k-th score so far is
above the bound. It goes on at equality, as a row of a smaller id may still tie.

A query is answered in the block of its own cluster first, which gives it a k-th score to begin with. Then it goes to every
other block whose bound at depth 0, the score of a row of the best value in each dimension, reaches that score: a table of the
blocks' extremes tells which (at most ``STATS_BLOCKS`` of them are broadcast, beyond that blocks skip the queries themselves).
Queries travel to blocks, blocks stay: a block's task builds its lists once and streams the queries through. Per query and
block at most k rows come out, and are merged per query.

Where all dimensions carry alike, as in random vectors, the bound falls so late that nearly all rows are met: ``met`` says how
many, in the results of ``answers``.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do null ids. Rows equal in id
and vector are one; rows that share an id but differ are each a candidate and a query, left out of their own answer only.
Vectors of different lengths are compared on the dimensions of the longest, missing components being 0. Fewer than k
candidates are all returned. Scores that may not fit a bigint raise ValueError. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, ship, table

QUERY_BLOCK = 512
BLOCK = 8192
PIVOTS = 1024
STATS_BLOCKS = 65_536
FIRST_DEPTH = 32
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint, met bigint"


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part, equal ones once."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    # What is beyond a bigint's halves can't be scored; it is cut here and refused in ``checked``.
    most = float(1 << 62)
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(256.0) * x.cast("double")))).cast("bigint"))
    return embeddings.where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct()


def checked(*frames: DataFrame) -> tuple[list[int], int, bool]:
    """(rows of each frame, dimensions, whether all sums are exact in doubles); raises where a score may not fit a bigint."""
    sizes, most, dims = [], [], 0
    for df in frames:
        n, high, width = df.agg(F.count("*"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max(F.size("v"))).first()
        sizes.append(n)
        most.append(high or 0)
        dims = max(dims, width or 0)
    largest = most[0] * most[-1] * dims
    if largest >= 1 << 63:
        raise ValueError(f"inner products may reach {largest}, beyond a bigint")
    return sizes, dims, largest < 1 << 53


def threshold(q: np.ndarray, skip: np.ndarray, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, k: int, least: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """Best k (score, id) of at least ``least`` for query vector q over one block without the rows ``skip``, and how many rows
    were met; lists[d] are the rows of dimension d by rising value."""
    n = len(ids)
    used = np.flatnonzero(q)
    if not len(used):
        keep = np.sort(np.delete(ids, skip))[:k]
        return [(0, int(i)) for i in keep if least <= 0], 0
    up = q[used] > 0
    seen = np.zeros(n, bool)
    best_s, best_i = np.empty(0, q.dtype), np.empty(0, np.int64)
    depth, step, met = 0, FIRST_DEPTH, 0
    while depth < n:
        # No row that hasn't been met is above the edge of what has been read.
        edge = np.where(up, rows[lists[used, n - depth - 1], used], rows[lists[used, depth], used]) @ q[used]
        if edge < least or (len(best_s) == k and best_s[-1] > edge):
            break
        upto = min(n, depth + step)
        read = np.concatenate([lists[used[up], n - upto : n - depth].ravel(), lists[used[~up], depth:upto].ravel()])
        fresh = np.zeros(n, bool)
        fresh[read] = True
        fresh &= ~seen
        seen |= fresh
        at = np.flatnonzero(fresh)
        met += len(at)
        if len(skip):
            at = at[~np.isin(at, skip)]
        if len(at):
            s, i = np.concatenate([best_s, rows[at] @ q]), np.concatenate([best_i, ids[at]])
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]
        depth, step = upto, step * 2
        if met == n:
            break
    return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True) if s >= least], met


def _matrix(column: pa.ListArray, dims: int, exact: bool) -> np.ndarray:
    """Rows of lists as a matrix, zeros behind the shorter ones; doubles where their sums are exact, which lets BLAS multiply."""
    kind = np.float64 if exact else np.int64
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(kind)
    out = np.zeros((len(column), dims), kind)
    for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[r, : b - a] = flat[a:b]
    return out


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The best score that each query can have in each block."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class _Block:
    """Candidates with their lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lists = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32).copy()

    def answer(self, q_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        same = np.flatnonzero(self.ids == q_id)
        return threshold(q, same[(self.rows[same] == q).all(axis=1)], self.ids, self.rows, self.lists, k, least)


def _found(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["query_id", "query_key", "vec_id", "score", "met"])


def _clustered(pivots, dims: int, exact: bool):
    """The nearest pivot of each vector, by its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _matrix(pa.array(pivots.value, pa.list_(pa.int64())), dims, True).astype(np.float32)
        base /= np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-30)
        for batch in batches:
            rows = _matrix(batch.column(1), dims, True).astype(np.float32)
            near = (rows @ base.T).argmax(axis=1).astype(np.int32) if len(base) else np.zeros(len(rows), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["vec_id", "v", "cluster"])

    return run


def _home(k: int, dims: int, exact: bool):
    """In a block: the answers to its own queries from itself, a row per query with its k-th score; and the block's extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, column, asks, keys = (batch.column(c)[r].values for c in (1, 2, 3, 4))
                block = _Block(ids.to_numpy(zero_copy_only=False), _matrix(column, dims, exact))
                asked = []
                for i in np.flatnonzero(asks.to_numpy(zero_copy_only=False)).tolist():
                    best, met = block.answer(int(block.ids[i]), block.rows[i], k)
                    asked.append({
                        "query_id": int(block.ids[i]), "query_key": keys[i].as_py(), "v": [int(x) for x in block.rows[i]], "met": met,
                        "least": best[-1][0] if len(best) == k else None, "ids": [i for _, i in best], "scores": [s for s, _ in best],
                    })
                high, low = ([[int(x) for x in f(axis=0)]] for f in (block.rows.max, block.rows.min))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64())), pa.array([asked], _ASKED)], names=["block", "high", "low", "asked"])

    return run


_ASKED = pa.list_(pa.struct([("query_id", pa.int64()), ("query_key", pa.int64()), ("v", pa.list_(pa.int64())), ("met", pa.int64()), ("least", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))]))
_HOME = "block bigint, high array<bigint>, low array<bigint>, asked array<struct<query_id: bigint, query_key: bigint, v: array<bigint>, met: bigint, least: bigint, ids: array<bigint>, scores: array<bigint>>>"
_ROUTED = "block bigint, kind int, ids array<bigint>, keys array<bigint>, v array<array<bigint>>, least array<bigint>"


def _route(stats, dims: int, exact: bool):
    """Queries with their k-th score to the blocks that may beat it, all of a batch to a block in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, *extremes = stats.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                home, ids, keys, column, least = part.columns
                queries = _matrix(column, dims, exact)
                bounds = _bounds(queries, *extremes) if extremes else np.full((len(part), len(blocks)), np.inf if exact else np.iinfo(np.int64).max)
                floor = least.cast(pa.float64() if exact else pa.int64()).fill_null(-np.inf if exact else np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                able = (bounds >= floor[:, None]) & (home.to_numpy()[:, None] != blocks)
                for b in np.flatnonzero(able.any(axis=0)).tolist():
                    own = pa.array(np.flatnonzero(able[:, b]))
                    row = [int(blocks[b]), 1, *(x.take(own).to_pylist() for x in (ids, keys, column, least))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], names=["block", "kind", "ids", "keys", "v", "least"])

    return run


_KINDS = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]


def _visit(k: int, dims: int, exact: bool):
    """Blocks and the queries sent to them, sorted by block, the block itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                kind = batch.column(1)[r].as_py()
                ids, column = batch.column(2)[r].values, batch.column(4)[r].values
                rows = _matrix(column, dims, exact)
                if kind == 0:
                    block = _Block(ids.to_numpy(zero_copy_only=False), rows)
                    high, low = block.rows.max(axis=0)[None], block.rows.min(axis=0)[None]
                    continue
                out: list[tuple] = []
                able = _bounds(rows, high, low)[:, 0]
                for q_id, key, q, bound, least in zip(ids.to_pylist(), batch.column(3)[r].as_py(), rows, able, batch.column(5)[r].as_py(), strict=True):
                    if least is not None and bound < least:
                        continue
                    best, met = block.answer(q_id, q, k, -np.inf if least is None else least)
                    out += [(q_id, key, i, s, met if j == 0 else 0) for j, (s, i) in enumerate(best)] or [(q_id, key, None, None, met)]
                yield _found(out)

    return run


def answers(vectors: DataFrame, is_query, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, query_key, vec_id, score, met): of every query, and block that it visited, up to k rows, the best among them; rows
    with a null vec_id only tell how many rows a block without a result met. ``is_query`` is a condition on vec_id."""
    spark = ship(vectors.sparkSession)
    vectors = cut(vectors)
    (n, _), dims, exact = checked(vectors, vectors.where(is_query))
    n_blocks = max(1, -(-n // block))
    # Pivots are the rows of the smallest hashes, a bounded sample; they only place rows, every row is in a block.
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(PIVOTS, 2 * n_blocks)).select("v").collect() if n_blocks > 1 else []
    pivots = spark.sparkContext.broadcast([list(r.v) for r in chosen])
    placed = cut(vectors.mapInArrow(_clustered(pivots, dims, exact), "vec_id bigint, v array<bigint>, cluster int"))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    key = F.xxhash64("vec_id", "v")
    numbered = placed.join(F.broadcast(sizes), "cluster").select(  # a row per pivot
        F.shiftleft(F.col("cluster").cast("bigint"), 32).bitwiseOR(F.pmod(F.xxhash64(key, F.lit("part")), F.col("parts"))).alias("block"), "vec_id", "v", is_query.alias("asks"), key.alias("key")
    )
    packed = numbered.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v", "asks", "key")).alias("rows"))
    packed = cut(packed.select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("v"), F.col("rows.asks").alias("asks"), F.col("rows.key").alias("keys")))
    home = cut(packed.select("block", "ids", "v", "asks", "keys").mapInArrow(_home(k, dims, exact), _HOME))
    asked = home.select("block", F.explode("asked").alias("q")).select("block", "q.*")
    first = asked.select("query_id", "query_key", "met", F.posexplode_outer(F.arrays_zip("ids", "scores")).alias("place", "r"))
    first = first.select("query_id", "query_key", F.col("r.ids").alias("vec_id"), F.col("r.scores").alias("score"), F.when(F.coalesce("place", F.lit(0)) == 0, F.col("met")).otherwise(0).alias("met"))
    known = home.count() <= STATS_BLOCKS
    found = home.select("block", *(("high", "low") if known else ())).toArrow()
    extremes = (found.column("block").to_numpy(), *(_matrix(found.column(c).combine_chunks(), dims, exact) for c in (("high", "low") if known else ())))
    sent = spark.sparkContext.broadcast(extremes)
    routed = asked.select("block", "query_id", "query_key", "v", "least").mapInArrow(_route(sent, dims, exact), _ROUTED)
    none = F.array().cast("array<bigint>")
    whole = packed.select("block", F.lit(0).alias("kind"), "ids", none.alias("keys"), "v", none.alias("least"))
    work = whole.unionByName(routed).repartition("block").sortWithinPartitions("block", "kind")
    return first.unionByName(work.mapInArrow(_visit(k, dims, exact), FOUND))


def top_k(vectors: DataFrame, is_query, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors other than its own of every row that ``is_query`` (on vec_id) holds for."""
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    found = answers(vectors, is_query, k, block).where(F.col("vec_id").isNotNull())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_met(found: DataFrame, n: int) -> float:
    """The mean share of n rows that queries met, from ``answers``; the first row of a block's answer has its figure."""
    seen = found.groupBy("query_id", "query_key").agg(F.sum("met").alias("met"))
    return seen.agg(F.avg(F.col("met") / n)).first()[0]


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def oracle() -> str:
    return """
WITH d AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, v, row_number() OVER () AS r FROM d),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, q.r AS qr
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
