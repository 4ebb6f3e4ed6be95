"""Flush statistics, compaction planning and merging, replay, retention and batching, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import LOG_OVERHEAD, common_prefix_length, entry_bytes
from tidemark.functions.visibility import expired, newest

L0_TRIGGER = 4
LEVEL1_BYTES = 64 << 20
LEVEL_FACTOR = 10


def segment_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Manifest figures of each group of log rows: key and seq range, entries, bytes, and the time the last row expires."""
    return rows.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.countDistinct("key").alias("entry_count"), F.sum(entry_bytes(LOG_OVERHEAD)).alias("size_bytes"),
        F.when(F.min("expire_at") == 0, F.lit(0)).otherwise(F.max("expire_at")).cast("bigint").alias("max_expire_at"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def may_hold_key(key: str) -> Column:
    return (F.col("min_key") <= key) & (F.col("max_key") >= key)


def may_hold_prefix(prefix: str) -> Column:
    """Not below the prefix, and not above it unless it begins with it."""
    return (F.col("max_key") >= prefix) & ((F.col("min_key") <= prefix) | F.col("min_key").startswith(prefix))


def overlaps(a: str, b: str) -> Column:
    """The key ranges of two aliased manifests meet."""
    return (F.col(f"{a}.min_key") <= F.col(f"{b}.max_key")) & (F.col(f"{a}.max_key") >= F.col(f"{b}.min_key"))


def merge(segments: DataFrame, now: int, bottom: bool) -> DataFrame:
    """Newest version per key. Only where no deeper segment can hold an older version are deleted and expired rows dropped."""
    rows = newest(segments)
    return rows.where(F.col("value").isNotNull() & ~expired(now)) if bottom else rows


def replay(base: DataFrame, log: DataFrame, lsn: int) -> DataFrame:
    """The snapshot ``base`` brought up to date with the log behind ``lsn``; replaying more than is needed changes nothing."""
    tail = log.where(F.col("seq") > lsn).select("key", "seq", "value", "expire_at")
    return newest(base.select("key", "seq", "value", "expire_at").unionByName(tail))


def retention(files: DataFrame, flushed_seq: int, now: int, most_age: int, most_bytes: int) -> DataFrame:
    """The log files (wal_id, max_seq, size_bytes, mtime) with ``deletable``: fully flushed, and too old or, oldest first,
    more than the bytes kept. The window orders one row per file."""
    order = Window.orderBy(F.col("wal_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    candidate = F.col("max_seq") <= flushed_seq
    kept_with = F.sum(F.when(candidate, F.col("size_bytes")).otherwise(0)).over(order)
    over = (F.lit(now) - F.col("mtime") > most_age) | (kept_with > most_bytes)
    return files.select("wal_id", "max_seq", "size_bytes", "mtime", (candidate & over).alias("deletable"))


def stream_batches(log: DataFrame, most: int, part_rows: int = 1 << 20) -> DataFrame:
    """(batch, n, min_seq, max_seq): the log cut into batches of ``most`` entries in order of seq.

    Entries are counted per range of seq first, so no task sorts the whole log.
    """
    part = F.floor(F.col("seq") / part_rows)
    counts = log.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = log.select("seq", part.alias("part")).withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("seq")))
    placed = ranked.join(offsets, "part").select("seq", F.floor((F.col("rn") - 1 + F.col("skip")) / most).cast("bigint").alias("batch"))
    return placed.groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def index_prefixes(keys: DataFrame, restart: int = 16, lead: int = 8) -> DataFrame:
    """(key, shared): how many characters each of the distinct sorted keys shares with the one before it, as a sorted key column
    stores it; every ``restart``-th key is whole.

    Keys are ranked within their first ``lead`` characters, and the counts before each such group make the ranks those of
    the whole run: only a row per group goes through one task.
    """
    group = F.substring("key", 1, lead)
    own = Window.partitionBy("group").orderBy("key")
    ranked = keys.select("key", group.alias("group")).withColumn("rn", F.row_number().over(own)).withColumn("before", F.lag("key").over(own))
    counts = keys.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.max("key").alias("last"))
    sofar = Window.orderBy("group")
    offsets = counts.select("group", (F.sum("n").over(sofar) - F.col("n")).alias("skip"), F.lag("last").over(sofar).alias("last"))
    placed = ranked.join(offsets, "group").withColumn("before", F.coalesce("before", "last"))
    shared = F.when((F.col("rn") - 1 + F.col("skip")) % restart == 0, F.lit(0)).otherwise(common_prefix_length("key", "before"))
    return placed.select("key", shared.cast("int").alias("shared"))


def level_target(level: int) -> int:
    return LEVEL1_BYTES * LEVEL_FACTOR ** (level - 1)


def span_stats(spans: DataFrame, name: str, duration: str) -> DataFrame:
    """Per span name: count, total, least, greatest and mean duration."""
    return spans.groupBy(F.col(name).alias("name")).agg(
        F.count("*").alias("n"), F.sum(duration).alias("total"), F.min(duration).alias("least"), F.max(duration).alias("greatest"), F.avg(duration).alias("mean")
    )
