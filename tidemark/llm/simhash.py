"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints at most ``DISTANCE`` bits apart agree in at least ``r`` of ``DISTANCE + r`` bands of bits. So each distinct
fingerprint is sent to one bucket per choice of r bands; a bucket is the top node of an index whose shared pattern is the
bands' value. More bands per choice make more and smaller buckets; r is the least for which the mean bucket has at most
``BUCKET`` rows, and changes no result. In a bucket, fingerprints are sorted by Gray rank, by which neighbours differ in few
bits. Runs of ``FAN_OUT`` form nodes, runs of nodes upper nodes; a node keeps the mask of the bits that all below it share,
and their pattern. Neighbours are linked first. Then pairs of nodes are descended together, all pairs of a level at once:
where the shared bits of two nodes already differ in more than DISTANCE places, or all below both is linked already, the
whole groups are pruned. Of the links that remain, each task emits a spanning star per connected group, never all pairs;
stars are joined by connected components.

Exact copies are one fingerprint from the start. Buckets above a bound are split into chunks, and each pair of chunks is a
task of its own, so that no link is lost and no task grows with a hot bucket or with the corpus.

Defined cases: a null text is an empty one; texts without a word have fingerprint zero and link like any other; repeated rows
are returned each; rows without a doc_id take part, but can't be a component's smallest id (null if there is no other); every
bigint is a doc_id like any other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, documents, ship, shuffle_partitions, table
from tidemark.llm.components import Forest, stars

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
FAN_OUT = 8
LEVELS = 4
PAIRS_AT_ONCE = 1 << 14
BUCKET = 4096
LEAST_CHUNK, MOST_CHUNK = 1024, 8192
ROWS_AT_ONCE = 100_000
_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles: a bit is set if it is in over half of their XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The rows of docs with the fingerprint's 64 bits as a signed number, in a column of a new name."""
    ship(docs.sparkSession)
    names, text_at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "", shingle) for t in batch.column(text_at).to_numpy(zero_copy_only=False).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def bands(distance: int = DISTANCE, agree: int = 1) -> list[tuple[int, int]]:
    """(shift, width) of distance + agree bands that cover all bits."""
    n = distance + agree
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def agreement(n: int, distance: int = DISTANCE) -> int:
    """How many bands must agree for buckets of at most ``BUCKET`` of n even fingerprints."""
    agree = 1
    while n > BUCKET << sum(sorted(w for _, w in bands(distance, agree))[:agree]) and agree < distance:
        agree += 1
    return agree


def _nodes(bucket: np.ndarray, codes: np.ndarray, roots: np.ndarray):
    """Levels of (first child, end, bucket, shared mask, shared pattern, the one root of all below or -1); level 0 are the codes."""
    n = len(codes)
    levels = [(np.arange(n), np.arange(1, n + 1), bucket, codes, codes, roots, roots)]  # AND and OR, least and largest of what lies below
    for _ in range(LEVELS):
        _, _, own, ands, ors, low, high = levels[-1]
        if not len(own):
            break
        fresh = np.concatenate([[True], own[1:] != own[:-1]])
        begin = np.flatnonzero(fresh)
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        first = np.flatnonzero(place % FAN_OUT == 0)
        levels.append((
            first, np.append(first[1:], len(own)), own[first], np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first),
            np.minimum.reduceat(low, first), np.maximum.reduceat(high, first),
        ))
    return [(a, b, own, ~(x ^ y), x, np.where(low == high, low, -1)) for a, b, own, x, y, low, high in levels]


def links(bucket: np.ndarray, codes: np.ndarray, distance: int = DISTANCE, roots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes of one bucket at most ``distance`` bits apart; codes in Gray order within ascending buckets. Pairs that
    have one root already are left out."""
    levels = _nodes(bucket, codes, np.arange(len(codes)) if roots is None else roots)
    top = len(levels) - 1

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
            _, _, _, mask, pattern, root = levels[level]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= distance
            near &= (root[x] != root[y]) | (root[x] < 0)
            x, y = x[near], y[near]
            if level == 0:
                yield x, y
                continue
            first, end = levels[level][:2]
            grid = np.arange(FAN_OUT)
            kids_x, kids_y = first[x][:, None, None] + grid[:, None], first[y][:, None, None] + grid
            real = (kids_x < end[x][:, None, None]) & (kids_y < end[y][:, None, None]) & ((x != y)[:, None, None] | (kids_x <= kids_y if level > 1 else kids_x < kids_y))
            pairs = np.broadcast_arrays(kids_x, kids_y)
            yield from descend(level - 1, pairs[0][real], pairs[1][real])

    own = levels[top][2]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    sizes = np.diff(np.append(begin, len(own)))
    for size in np.unique(sizes):  # top nodes of one bucket meet in all pairs, bounded by the bucket's bound
        heads = begin[sizes == size]
        i, j = np.triu_indices(size)
        for k in range(0, len(heads), max(1, PAIRS_AT_ONCE // len(i))):
            part = heads[k : k + max(1, PAIRS_AT_ONCE // len(i)), None]
            yield from descend(top, (part + i).ravel(), (part + j).ravel())


def _stars_of(distance: int, check_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            # Buckets are sorted, so all but the last, which is of bounded size, are whole.
            if rows >= ROWS_AT_ONCE:
                done, rest = _cut_last(pa.Table.from_batches(held))
                if done.num_rows:
                    yield found(done)
                held, rows = [rest], rest.num_rows
        if rows:
            yield found(pa.Table.from_batches(held))

    def _cut_last(t: pa.Table) -> tuple[pa.Table, pa.RecordBatch]:
        bucket = t.column("bucket").to_numpy()
        last = int(np.flatnonzero(bucket != bucket[-1]).max(initial=-1)) + 1
        return t.slice(0, last), t.slice(last).combine_chunks().to_batches()[0]

    def found(t: pa.Table) -> pa.RecordBatch:
        bucket, node, code, check = (t.column(c).to_numpy() for c in ("bucket", "node", "code", "check"))
        codes = code.view(np.uint64)
        order = np.lexsort((gray_rank(codes), bucket))
        bucket, codes, node, checks = bucket[order], codes[order], node[order], check.view(np.uint64)[order]

        def checked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = np.bitwise_count(checks[a] ^ checks[b]) <= check_distance
            return a[near], b[near]

        forest = Forest(len(codes))
        beside = np.flatnonzero((bucket[1:] == bucket[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance))
        forest.link(*checked(beside, beside + 1))
        for a, b in links(bucket, codes, distance, forest.roots().copy()):
            forest.link(*checked(a, b))
        roots = forest.roots()
        some = node != node[roots]
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[roots][some])], names=["a", "b"])

    return run


def stars_in_buckets(routed: DataFrame, n: int, distance: int, check_distance: int = BITS) -> DataFrame:
    """Edges (a, b) between the nodes of routed rows (node, code, check, bucket) that keep all links connected: codes of a bucket at
    most ``distance`` bits apart, whose check words differ in at most ``check_distance``. ``n`` is about the number of rows."""
    spark = ship(routed.sparkSession)
    most = min(MOST_CHUNK, max(LEAST_CHUNK, n // (2 * shuffle_partitions(spark))))
    hot = routed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    split = routed.join(hot, "bucket", "left").withColumn(
        "with", F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    # A row of chunk i goes to the pairs (i, j) of all j; a pair's bucket holds two chunks.
    spread = split.select("node", "code", "check", "bucket", own.alias("i"), F.explode("with").alias("j"))
    keyed = spread.select(
        F.when(F.col("j") < 0, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))).alias("bucket"), "node", "code", "check"
    )
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars_of(distance, check_distance), "a bigint, b bigint")


def near_stars(codes: DataFrame, distance: int = DISTANCE, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that keep all links of at most ``distance`` bits connected."""
    n = codes.count()
    agree = agree or agreement(n, distance)
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in bands(distance, agree)]
    choices = list(combinations(range(len(parts)), agree))
    values = F.array(*[F.xxhash64(F.lit(k), *[parts[i] for i in choice]) for k, choice in enumerate(choices)])
    routed = codes.select(F.col("fp").alias("node"), F.col("fp").alias("code"), F.lit(0).cast("bigint").alias("check"), F.explode(values).alias("bucket"))
    return stars_in_buckets(routed, n * len(choices), distance)


def groups(own: DataFrame, distance: int = DISTANCE, agree: int | None = None) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (doc_id, fp): the smallest doc_id reachable, null if there is none."""
    codes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return smallest(codes, near_stars(codes.select("fp"), distance, agree))


def smallest(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id): a number that names the component, and the smallest ``least`` in it."""
    roots = stars(edges)
    placed = cut(codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def near_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, agree: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    own = cut(with_fingerprints(documents(docs), shingle).select("doc_id", "fp"))
    return own.join(groups(own, distance, agree), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
