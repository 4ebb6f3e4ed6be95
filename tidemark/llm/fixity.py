"""Merkle fixity audit of WARC records kept in several replicas.

Pages become WARC response records. A record's place is its key (the page id), a volume is a run of ``VOLUME`` keys, and
inside a volume records follow one another at byte offsets. Leaves hash records; a node hashes the ordered keys, ranges of
offsets (from the node's own beginning) and hashes of up to ``FAN_OUT`` children, and keeps them. Keys, not counts, place a
node, so a lost record changes its own branch only, and the offsets of those behind it below their common nodes. An audit
compares the roots of two replicas and opens, level by level, only nodes that differ: a node tells its children's hashes, so a
level is read for its suspects alone. Levels are tables parted by a hash of the volume, and only the parts of suspects
are listed and read. What is found carries its range of offsets from the way down.

All of it is DataFrame aggregation: at most FAN_OUT rows meet in a group, records of one key are first folded into
one leaf by sums, which combine before the shuffle.

Defined cases: null urls and htmls are empty; rows without a page id get negative keys from a hash of their content, so that
they spread; records that share a key form one leaf, whatever their order; an empty replica differs in every leaf of the
other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, fresh_path, remove, table

FAN_BITS = 4
FAN_OUT = 1 << FAN_BITS
VOLUME_LEVEL = 3
VOLUME = FAN_OUT**VOLUME_LEVEL


def records(pages: DataFrame) -> DataFrame:
    """(record_key, record): the text of each page's WARC record; its bytes are its UTF-8 form."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("url", "html")])
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40))
    key = F.coalesce("page_id", spread)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"),
    )
    return own.select(key.alias("record_key"), F.concat(head, F.col("html"), F.lit("\r\n\r\n")).alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """(node, length, n, hash) of each key. The hash of a lone record is its SHA-256; several are folded as a multiset."""
    hashed = recs.select(F.col("record_key").alias("node"), F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("hash"))
    part = lambda k: F.sum(F.conv(F.substring("hash", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    folded = hashed.groupBy("node").agg(F.sum("length").alias("length"), F.count("*").alias("n"), F.min("hash").alias("hash"), *[part(k).alias(f"s{k}") for k in range(4)])
    many = F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256)
    return folded.select("node", "length", "n", F.when(F.col("n") == 1, F.col("hash")).otherwise(many).alias("hash"))


PARTS, LEAVES_A_PART = 4096, 1 << 18  # of a level's table
KIDS = "array<struct<node: bigint, start: bigint, length: bigint, hash: string>>"


@dataclass(frozen=True)
class Tree:
    """The leaves, and above them the levels: paths of tables (part, node, length, n, hash, kids); the last one has one node."""

    spark: SparkSession
    leaves: DataFrame
    paths: list[str]
    parts: int

    def level(self, h: int) -> DataFrame:
        """Nodes ``h`` levels above the leaves, 1 at least."""
        return self.spark.read.schema(f"node bigint, length bigint, n bigint, hash string, kids {KIDS}, part int").parquet(self.paths[h - 1])

    @property
    def height(self) -> int:
        return len(self.paths)

    @property
    def root(self) -> DataFrame:
        return self.level(self.height)

    def close(self) -> None:
        """Delete the tables."""
        for path in self.paths:
            remove(self.spark, path)


def _part(level: int, parts: int):
    """The part of a level's table that a node is in, by its volume."""
    volume = F.shiftright("node", FAN_BITS * max(0, VOLUME_LEVEL - level))
    return F.pmod(F.xxhash64(volume), F.lit(parts)).cast("int")


def tree(recs: DataFrame, height: int | None = None) -> Tree:
    """The tree over records; replicas to be compared need one height, by default what the keys need."""
    level = cut(leaves(recs))
    return _above(level, height_of(level) if height is None else height)


def _above(leaf_level: DataFrame, height: int) -> Tree:
    spark = leaf_level.sparkSession
    out = Tree(spark, leaf_level, [], min(PARTS, 1 + leaf_level.count() // LEAVES_A_PART))
    below = leaf_level
    for h in range(1, height + 1):
        # The top level also joins negative keys to the others.
        up = F.shiftright("node", FAN_BITS) if h < height else F.lit(0).cast("bigint")
        group = below.groupBy(up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "length", "hash"))).alias("k"), F.sum("length").alias("length"), F.sum("n").alias("n"))
        placed = F.expr("transform(k, (x, i) -> named_struct('node', x.node, 'start', aggregate(slice(k, 1, i), 0L, (t, y) -> t + y.length), 'length', x.length, 'hash', x.hash))")
        line = F.expr("concat_ws('|', transform(kids, x -> concat_ws(':', CAST(x.node AS STRING), CAST(x.start AS STRING), CAST(x.start + x.length AS STRING), x.hash)))")
        whole = group.withColumn("kids", placed).select(F.col("up").alias("node"), "length", "n", F.sha2(line, 256).alias("hash"), "kids")
        path = fresh_path(spark, f"merkle-{h}")
        whole.withColumn("part", _part(h, out.parts)).repartition("part").sortWithinPartitions("node").write.partitionBy("part").parquet(path)
        out.paths.append(path)
        below = out.level(h)
    return out


def height_of(*leaf_levels: DataFrame) -> int:
    """Levels above the leaves until every key is below one node."""
    most = 0
    for level in leaf_levels:
        low, high = level.agg(F.min("node"), F.max("node")).first()
        most = max(most, -(low + 1) if low is not None and low < 0 else 0, high or 0)
    return -(-most.bit_length() // FAN_BITS) + 1


def audit(primary: Tree, replica: Tree) -> DataFrame:
    """(record_key, status, start, length): damaged, missing or extra leaves of the replica, found from the roots downwards, with
    their range of offsets in their volume of the primary (of the replica, where they are extra)."""
    if primary.height != replica.height:
        raise ValueError("the trees must have one height")
    none = F.array().cast(KIDS)
    suspects: DataFrame | None = None
    for h in range(primary.height, 0, -1):
        ours, theirs = primary.level(h), replica.level(h)
        if suspects is not None:
            # At most PARTS numbers.
            read = [[r[0] for r in suspects.select(_part(h, t.parts)).distinct().collect()] for t in (primary, replica)]
            ours, theirs = (x.where(F.col("part").isin(parts)).join(suspects.select("node"), "node", "left_semi") for x, parts in zip((ours, theirs), read, strict=True))
        both = ours.select("node", F.col("hash").alias("a"), F.col("kids").alias("ours")).join(theirs.select("node", F.col("hash").alias("b"), F.col("kids").alias("theirs")), "node", "full_outer")
        both = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node", F.coalesce("ours", none).alias("ours"), F.coalesce("theirs", none).alias("theirs"))
        # Offsets begin anew at every volume, and the children of the top node are the first of theirs.
        inside = h <= VOLUME_LEVEL and h < primary.height
        both = both.join(suspects.select("node", "start", "their_start"), "node") if inside and h < VOLUME_LEVEL else both.withColumns({c: F.lit(0).cast("bigint") for c in ("start", "their_start")})
        kid = F.explode(F.expr("array_distinct(concat(transform(ours, x -> x.node), transform(theirs, x -> x.node)))"))
        kids = both.select(kid.alias("kid"), "ours", "theirs", "start", "their_start").select("kid", "start", "their_start", *[F.expr(f"get(filter({c}, x -> x.node = kid), 0)").alias(c) for c in ("ours", "theirs")])
        found = kids.where(~F.col("ours.hash").eqNullSafe(F.col("theirs.hash")))
        begin = lambda base, side: (F.col(base) + F.col(f"{side}.start") if inside else F.lit(0).cast("bigint")).alias(base)  # noqa: B023, E731
        suspects = cut(found.select(
            F.col("kid").alias("node"), begin("start", "ours"), begin("their_start", "theirs"), F.coalesce("ours.length", "theirs.length").alias("length"),
            F.col("ours.hash").isNull().alias("extra"), F.col("theirs.hash").isNull().alias("missing"),
        ))
    status = F.when(F.col("missing"), "missing").when(F.col("extra"), "extra").otherwise("damaged")
    return suspects.select(F.col("node").alias("record_key"), status.alias("status"), F.coalesce("start", "their_start").alias("start"), "length")


def placed(leaf_level: DataFrame) -> DataFrame:
    """Leaves with their volume and the offset of their bytes in it."""
    volume = F.shiftright("node", FAN_BITS * VOLUME_LEVEL)
    before = Window.partitionBy("volume").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return leaf_level.withColumn("volume", volume).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def fixity(pages: DataFrame, copy: DataFrame) -> DataFrame:
    """Every record of either replica: where it lies in the first, its hash, and whether the second has it whole."""
    first, second = cut(leaves(records(pages))), cut(leaves(records(copy)))
    height = height_of(first, second)
    ours, theirs = _above(first, height), _above(second, height)
    try:
        found = audit(ours, theirs)  # its result is a checkpoint of its own
    finally:
        ours.close()
        theirs.close()
    lost = found.where("status != 'extra'").select("record_key", "status")
    intact = placed(first).join(lost, F.col("node") == F.col("record_key"), "left")
    known = intact.select(F.col("node").alias("record_key"), "volume", "start", "length", "n", F.col("hash").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))
    extra = found.where("status = 'extra'").select(
        "record_key", F.shiftright("record_key", FAN_BITS * VOLUME_LEVEL).alias("volume"), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "bigint"), ("length", "bigint"), ("n", "bigint"), ("sha256", "string"))], "status"
    )
    return known.unionByName(extra)


def damaged_copy(pages: DataFrame) -> DataFrame:
    """The replica of the registered query: some records changed, some lost, by rules on the page id."""
    changed = F.when(F.col("page_id") % 251 == 17, F.concat(F.lit("~"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    return pages.where(F.coalesce(F.col("page_id") % 509 != 33, F.lit(True))).withColumn("html", changed)


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity(pages, damaged_copy(pages))


def oracle() -> str:
    return rf"""
WITH p AS (SELECT page_id AS record_key, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT record_key, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || record_key || '>'
             || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
             || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p)
SELECT record_key, record_key // {VOLUME} AS volume,
       CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY record_key // {VOLUME} ORDER BY record_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(strlen(record) AS BIGINT) AS length, CAST(1 AS BIGINT) AS n, sha256(record) AS sha256,
       CASE WHEN record_key % 509 = 33 THEN 'missing' WHEN record_key % 251 = 17 THEN 'damaged' ELSE 'intact' END AS status
FROM r"""
