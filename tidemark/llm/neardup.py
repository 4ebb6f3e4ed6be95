"""Near duplicates by word shingles, over the Gray-order index of ``simhash``, one document of each group kept.

Two texts are linked if their sets of five-word shingles (as XXH64 values) have a Jaccard similarity of ``SIMILARITY`` or
more. One fingerprint of 64 bits can't find such pairs: at 0.8 they differ in ten bits in the mean. So a text gets several
fingerprints of its shingle set, independent of one another, and every band of each is a bucket of the index. In a bucket
texts are candidates if that fingerprint differs in at most ``DISTANCE`` bits and the next one in ``CHECK``. Candidate pairs
are kept as connected groups; in each group the links are confirmed on the whole shingle sets, by a search that tests a text
against those not reached yet, so that a group of near copies takes a test per member, and only a spanning tree goes out.

The number of fingerprints follows from the similarity: at the threshold itself a pair is missed with a probability of
``MISS``, by the formula for large sets, and more similar ones far less (``plan``). Bands get wider with the logarithm of the
number of texts, so that buckets stay of one size, and more fingerprints then keep the probability.

Exact copies are one text from the start. Buckets above a bound are split into chunks, and each pair of chunks is a task; large
groups of candidates are confirmed in chunks first, and then only beyond their largest component. Texts stay where they are: what is joined with them is a list of ids, broadcast up to ``BROADCAST_IDS``.

Defined cases are those of ``simhash``: a null text is an empty one, texts without a word are alike, a text of fewer than
five words is one shingle; rows of one doc_id are one document; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, fresh, ship, tidy, with_ids, without_ids
from tidemark.llm.common import cut as kept
from tidemark.llm.components import stars
from tidemark.llm.simhash import BITS, smallest, stars_in_buckets

SHINGLE = 5
SIMILARITY = 0.8
MISS = 0.005
DISTANCE, CHECK = 12, 18
BUCKET = 1024
LEAST_BAND = 12
SEED = 42
CHUNK = 512
_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float32)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Plan:
    """Bits of a band, bands of a fingerprint, and fingerprints."""

    width: int
    bands: int
    tables: int


def _tail(n: int, p: float, most: int) -> float:
    """P(at most ``most`` of n bits differ)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1))


def plan(n: int) -> Plan:
    """For n texts. Sets of one size with similarity s share 2s / (1 + s) of it, which is the cosine of their sums; a bit differs
    with the probability of the angle over pi."""
    width = max(LEAST_BAND, math.ceil(math.log2(max(1, n) / BUCKET)) if n > BUCKET else 0)
    width = min(32, width + width % 2)
    differ = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    hit = (1 - differ) ** width * _tail(BITS - width, differ, DISTANCE) * _tail(BITS, differ, CHECK)
    routes = math.log(MISS) / math.log(1 - hit)
    bands = BITS // width
    return Plan(width, bands, max(2, math.ceil(routes / bands)))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    whole, n = b" ".join(words), len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)), np.uint64, n))


def fingerprints(hashes: np.ndarray, tables: int) -> np.ndarray:
    """``tables`` SimHashes of a set of hashes, each of its own mixture of them, as signed numbers."""
    salts = (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    place = (np.arange(8 * tables) << 8).reshape(tables, 1, 8)
    counts = np.zeros(8 * tables * 256, np.int64)
    for i in range(0, len(hashes), 8192):
        x = hashes[None, i : i + 8192] ^ salts
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        x ^= x >> np.uint64(31)
        counts += np.bincount((x.view(np.uint8).reshape(tables, -1, 8) + place).ravel(), minlength=len(counts))
    bits = counts.reshape(-1, 256).astype(np.float32) @ _BIT  # whole numbers, exact below 2^24
    return np.packbits(2 * bits.ravel() > len(hashes), bitorder="little").view("<i8")


def cut(df: DataFrame) -> DataFrame:
    """``common.cut``, with the driver tidied: this stage has some dozens of jobs, whose plans grow with the partitions."""
    out = kept(df)
    tidy(out.sparkSession)
    return out


def _sketch(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(shingles(t), tables) for t in batch.column(2).to_numpy(zero_copy_only=False).tolist()]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * tables), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], names=["doc_id", "fp", "codes"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).tobytes() for t in batch.column(1).to_numpy(zero_copy_only=False).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "hashes"])


def spanning(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Index pairs of similar sets that keep all similar pairs connected."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left):
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            at = seeds.pop()
            own = sets[at]
            able = np.minimum(sizes[left], len(own)) >= similarity * np.maximum(sizes[left], len(own)) - 1e-9
            tried = left[able]
            if not len(tried):
                continue
            met = np.zeros(len(tried), bool)
            for i in range(0, len(tried), 256):
                part = tried[i : i + 256]
                flat = np.concatenate([sets[j] for j in part])
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat(own[place] == flat, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                met[i : i + 256] = both >= similarity * (sizes[part] + len(own) - both) - 1e-9
            reached = tried[met]
            out += [(int(at), int(j)) for j in reached]
            seeds += reached.tolist()
            able[able] = met
            left = left[~able]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between the texts of each bucket; the rows come sorted by bucket."""
    now, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = [(nodes[i], nodes[j]) for i, j in spanning(sets)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for bucket, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if bucket != now:
                if len(nodes) > 1:
                    yield found()
                now, nodes, sets = bucket, [], []
            nodes.append(node)
            sets.append(np.frombuffer(hashes, np.uint64))
    if len(nodes) > 1:
        yield found()


def candidates(codes: DataFrame, n: int, how: Plan) -> DataFrame:
    """Edges (a, b) between texts (fp, codes) that connect all candidate pairs."""
    entry = lambda t, b: F.struct(
        F.col("codes")[t].alias("code"), F.col("codes")[(t + 1) % how.tables].alias("check"),
        F.xxhash64(F.lit(t * how.bands + b), F.shiftrightunsigned(F.col("codes")[t], b * how.width).bitwiseAND(F.lit((1 << how.width) - 1))).alias("bucket"),
    )
    routes = F.explode(F.array(*[entry(t, b) for t in range(how.tables) for b in range(how.bands)]))
    routed = codes.select(F.col("fp").alias("node"), routes.alias("r")).select("node", "r.code", "r.check", "r.bucket")
    return stars_in_buckets(routed, n * how.tables * how.bands, DISTANCE, CHECK)


def _linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that keep the links within each bucket of rows (fp, bucket) connected."""
    buckets = rows.join(sets, "fp").select("bucket", "fp", "hashes")
    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, "a bigint, b bigint")


def similar_edges(edges: DataFrame, coded: DataFrame) -> DataFrame:
    """Edges (a, b) that keep all links within groups of candidates connected; ``coded`` has the texts (fp, text).

    A group of up to CHUNK texts is one bucket. Larger ones are dealt into chunks twice, each time anew, which connects what is
    similar throughout. What is left is to test the texts outside a group's largest component against all of the group: their chunks
    and the others meet in pairs, but no two chunks of the largest component do.
    """
    placed = stars(edges)
    members = placed.unionAll(placed.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = cut(members.join(sizes, "root"))
    texts = with_ids(coded.select("fp", "text"), members.select("fp").distinct(), "fp").dropDuplicates(["fp"])
    sets = cut(texts.mapInArrow(_sets, "fp bigint, hashes binary"))

    def dealt(rows: DataFrame, turn: int) -> DataFrame:
        return rows.select("fp", F.xxhash64("root", F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("chunks")), F.lit(turn)).alias("bucket"))

    large = members.where("chunks > 1")
    found = cut(_linked(dealt(members, 0).unionAll(dealt(large, 1)), sets))
    if large.isEmpty():
        return found
    known = stars(found)
    own = cut(large.join(known.withColumnRenamed("root", "to"), F.col("fp") == F.col("node"), "left").select("fp", "root", F.coalesce("to", "fp").alias("component")))
    parts = own.groupBy("root", "component").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"))
    counted = parts.where("n > most").select("root", "largest", F.ceil(F.col("most") / CHUNK).cast("int").alias("inner"), F.ceil((F.col("n") - F.col("most")) / CHUNK).cast("int").alias("outer"))
    rows = own.join(counted, "root").withColumn("inside", F.col("component") == F.col("largest"))
    chunk = F.when(F.col("inside"), F.pmod(F.xxhash64("fp"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("fp"), F.col("outer"))).cast("int")
    # Chunks of the largest component come first: one of them meets the outer ones, an outer one meets all.
    meets = F.when(F.col("inside"), F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("inner") + F.col("outer") - 1))
    pairs = rows.select("fp", "root", chunk.alias("i"), F.explode(meets).alias("j"))
    return found.unionAll(_linked(pairs.select("fp", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j"), F.lit("rest")).alias("bucket")), sets))


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every text: the smallest doc_id reachable, null if there is none."""
    ship(docs.sparkSession)
    coded = documents(docs).select("doc_id", F.xxhash64("text").alias("fp"), "text")
    n = docs.count()
    how = plan(n)
    own = cut(coded.mapInArrow(_sketch(how.tables), "doc_id bigint, fp bigint, codes array<bigint>"))
    codes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("codes").alias("codes")))
    confirmed = similar_edges(candidates(codes, n, how), coded)
    return own.select("doc_id", "fp"), smallest(codes.select("fp", "least"), confirmed)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of documents that are linked, over any path, to one of a smaller id.

    Rows of one doc_id are one document. Of rows without a doc_id, one stays in each group that has no other.
    """
    own, found = components(docs)
    found = cut(found)
    losers = own.join(found.where(F.col("component_id").isNotNull()), "fp").where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    named = without_ids(docs.where(F.col("doc_id").isNotNull()), losers, "doc_id").select(docs.columns)
    fp, root = fresh(docs, "fp", "root")
    left = found.where(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root))
    nameless = docs.where(F.col("doc_id").isNull()).withColumn(fp, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(left, fp)
    return named.unionByName(nameless.dropDuplicates([root]).select(docs.columns))
