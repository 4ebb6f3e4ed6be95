"""One function per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars, visibility
from tidemark.operators import maintenance, mutate, reads
from tidemark.plans.fixtures import ITEMS, NOW, PREFIXES, cas_ops, kv_log, log_now, requests, segments


def kv_live(s: SparkSession, d: str) -> DataFrame:
    return visibility.live(log_now(s, d), NOW)


def kv_snapshot_as_of_seq(s: SparkSession, d: str) -> DataFrame:
    return visibility.snapshot(kv_log(s, d), as_of_seq=5000)


def kv_status_breakdown(s: SparkSession, d: str) -> DataFrame:
    return visibility.snapshot(log_now(s, d)).groupBy(visibility.status(NOW).alias("status")).agg(F.count("*").alias("n"))


def kv_get(s: SparkSession, d: str) -> DataFrame:
    return reads.get(log_now(s, d), "user:00001:click", NOW)


def kv_get_with_expire_at(s: SparkSession, d: str) -> DataFrame:
    return reads.get_with_expire_at(log_now(s, d), "user:00002:purchase", NOW)


def kv_get_expire_at(s: SparkSession, d: str) -> DataFrame:
    asked = requests(s)
    return reads.get_expire_at(log_now(s, d), asked, NOW)


def kv_batch_get_ordered(s: SparkSession, d: str) -> DataFrame:
    return reads.batch_get(log_now(s, d), requests(s), NOW)


def kv_batch_get_dedup(s: SparkSession, d: str) -> DataFrame:
    return reads.batch_get(log_now(s, d), requests(s), NOW, ordered=False)


def kv_batch_get_bulk(s: SparkSession, d: str) -> DataFrame:
    """A request list as long as the key space: joined by shuffle."""
    log = log_now(s, d)
    asked = kv_log(s, d).select("key").distinct()
    return reads.batch_get(log, asked, NOW, ordered=False)


def kv_count_prefix(s: SparkSession, d: str) -> DataFrame:
    return reads.count_prefix(log_now(s, d), "user:0000", NOW)


def kv_count_all(s: SparkSession, d: str) -> DataFrame:
    return reads.count_prefix(log_now(s, d), "", NOW)


def kv_count_multi_prefix(s: SparkSession, d: str) -> DataFrame:
    return reads.count_prefixes(log_now(s, d), list(PREFIXES), NOW)


def kv_scan_prefix(s: SparkSession, d: str) -> DataFrame:
    return reads.scan_prefix(log_now(s, d), "user:0001", NOW)


def kv_scan_prefix_keys(s: SparkSession, d: str) -> DataFrame:
    return reads.scan_prefix_keys(log_now(s, d), "user:0001")


def kv_set_ttl_visibility(s: SparkSession, d: str) -> DataFrame:
    """How many rows are visible around their expiry: at it still, behind it no more."""
    timed = visibility.snapshot(log_now(s, d)).where("expire_at > 0")
    shown = timed.select(F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("delta"), "value", "expire_at")
    return shown.where(visibility.is_live(F.col("expire_at") + F.col("delta"))).groupBy("delta").agg(F.count("*").alias("n"))


def kv_set_expire_at_filter(s: SparkSession, d: str) -> DataFrame:
    return kv_log(s, d).groupBy(mutate.accepted(NOW).alias("accepted")).agg(F.count("*").alias("n"))


def _next_seq(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def kv_batch_set_result(s: SparkSession, d: str) -> DataFrame:
    log = log_now(s, d)
    items = s.createDataFrame([(i, k, v) for i, (k, v) in enumerate(ITEMS)], "pos bigint, key string, value string")
    after = log.unionByName(mutate.set_rows(items, _next_seq(log), NOW))
    done = reads.scan_prefix(after, "team:", NOW)
    return done.select("key", "value", F.lit(len(ITEMS)).cast("bigint").alias("submitted"))


def kv_delete_effect(s: SparkSession, d: str) -> DataFrame:
    log = log_now(s, d)
    gone = mutate.delete_rows(requests(s), _next_seq(log), NOW)
    return reads.scan_prefix(log.unionByName(gone), "user:0000", NOW).select("key", "value")


def kv_batch_delete_found(s: SparkSession, d: str) -> DataFrame:
    asked = requests(s)
    found = mutate.found_keys(log_now(s, d), asked, NOW).agg(F.count("*").alias("found"))
    return asked.agg(F.count("*").alias("submitted")).crossJoin(found)  # one row each


def kv_cas_log(s: SparkSession, d: str) -> DataFrame:
    return mutate.cas_results(mutate.cas_fold(cas_ops(s, d), None, NOW))


def kv_cas_final(s: SparkSession, d: str) -> DataFrame:
    written = mutate.cas_rows(mutate.cas_fold(cas_ops(s, d), None, NOW), NOW)
    return visibility.live(written, NOW).select("key", "value", "seq")


def kv_cas_nx(s: SparkSession, d: str) -> DataFrame:
    """Set if not exists, over the live state: the first operation of each key that has none."""
    ops = kv_log(s, d).where("value IS NOT NULL").select((F.col("seq") + 10_000_000).alias("seq"), "key", F.lit(None).cast("string").alias("expected"), F.col("value").alias("new_value"), F.lit(0).cast("bigint").alias("expire_at"))
    return mutate.cas_results(mutate.cas_fold(ops, log_now(s, d), NOW)).where("success").select("seq", "key", "success", "current_value")


def kv_segment_stats(s: SparkSession, d: str) -> DataFrame:
    return maintenance.segment_stats(kv_log(s, d).withColumn("segment", F.floor(F.col("seq") / 1000).cast("bigint")), "segment")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return maintenance.segment_stats(segments(kv_log(s, d)), "segment", "level")


def kv_segment_prune_key(s: SparkSession, d: str) -> DataFrame:
    return _manifest(s, d).where(maintenance.may_hold_key("user:00080:view")).select("segment", "level")


def kv_segment_prune_prefix(s: SparkSession, d: str) -> DataFrame:
    return _manifest(s, d).where(maintenance.may_hold_prefix("user:00074:")).select("segment", "level")


def kv_compaction_overlap(s: SparkSession, d: str) -> DataFrame:
    """Which level 1 segments a level 0 segment must be merged with; a manifest has a row per file."""
    m = _manifest(s, d)
    pairs = m.where("level = 0").alias("a").join(m.where("level = 1").alias("b"), maintenance.overlaps("a", "b"))
    return pairs.select(F.col("a.segment").alias("upper"), F.col("b.segment").alias("lower"))


def kv_compact_bottom(s: SparkSession, d: str) -> DataFrame:
    return maintenance.merge(segments(kv_log(s, d)), NOW, bottom=True)


def kv_compact_upper(s: SparkSession, d: str) -> DataFrame:
    return maintenance.merge(segments(kv_log(s, d)).where("level = 0"), NOW, bottom=False)


def kv_replay_from_lsn(s: SparkSession, d: str) -> DataFrame:
    log = log_now(s, d)
    return maintenance.replay(visibility.snapshot(log, 3000), log, 3000).where(visibility.is_live(NOW))


def kv_wal_retention(s: SparkSession, d: str) -> DataFrame:
    log = kv_log(s, d)
    files = log.groupBy(F.floor(F.col("seq") / 1000).cast("bigint").alias("wal_id")).agg(
        F.max("seq").alias("max_seq"), F.sum(scalars.entry_bytes(scalars.LOG_OVERHEAD)).alias("size_bytes"), F.max("ts").alias("mtime")
    )
    return maintenance.retention(files, flushed_seq=7500, now=1706659200, most_age=20 * 86400, most_bytes=250_000)


def kv_entry_bytes(s: SparkSession, d: str) -> DataFrame:
    log = kv_log(s, d)
    return log.agg(F.sum(scalars.entry_bytes()).alias("memory_bytes"), F.sum(scalars.entry_bytes(scalars.LOG_OVERHEAD)).alias("log_bytes"), F.count("*").alias("n"))


def kv_replication_batches(s: SparkSession, d: str) -> DataFrame:
    return maintenance.stream_batches(kv_log(s, d), 1000)


def kv_follower_equals_leader(s: SparkSession, d: str) -> DataFrame:
    """A follower that got a part of the log twice holds what the leader holds."""
    log = log_now(s, d)
    return visibility.live(log.unionByName(log.where("seq % 3 = 0")), NOW)


def kv_metrics(s: SparkSession, d: str) -> DataFrame:
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))
    sets, deletes = F.count_if(F.col("value").isNotNull()), F.count_if(F.col("value").isNull())
    pruned, searched = F.count_if(~F.col("key").startswith("user:0000")), F.count_if(F.col("key").startswith("user:0000"))
    return kv_log(s, d).agg(
        sets.alias("set_count"), deletes.alias("delete_count"), pruned.alias("pruned"), searched.alias("searched"),
        ratio(pruned.cast("double"), searched.cast("double")).alias("effectiveness"), F.round(ratio(F.lit(0.0), F.lit(0.0)), 6).alias("idle_ratio"),
    )


def kv_span_stats(s: SparkSession, d: str) -> DataFrame:
    spans = s.read.parquet(f"{d}/events.parquet").select("event_type", F.round(F.col("value") * 1000).cast("bigint").alias("us"))
    return maintenance.span_stats(spans, "event_type", "us")


def kv_scalars(s: SparkSession, d: str) -> DataFrame:
    keys = visibility.snapshot(log_now(s, d)).select("key")
    return keys.select("key", scalars.hex_key().alias("hex"), F.octet_length("key").alias("size"))


def kv_index_prefixes(s: SparkSession, d: str) -> DataFrame:
    """How much of a key the one before it shares, as a sorted key column stores it, in runs of 16."""
    return maintenance.index_prefixes(visibility.snapshot(log_now(s, d)).select("key"))


def kv_documents(s: SparkSession, d: str) -> DataFrame:
    """Long multilingual values: sizes per two-digit prefix."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"), F.col("text").alias("value"), F.lit(0).cast("bigint").alias("expire_at"))
    return visibility.live(docs, NOW).groupBy(F.substring("key", 1, 11).alias("prefix")).agg(F.count("*").alias("n"), F.sum(scalars.entry_bytes()).alias("bytes"))


def kv_orders(s: SparkSession, d: str) -> DataFrame:
    """Newest-wins over orders: each order sets its customer's key, one in seven deletes it."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    log = orders.select(F.col("o_orderkey").cast("bigint").alias("seq"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("value"), F.lit(0).cast("bigint").alias("expire_at"))
    return visibility.snapshot(log).groupBy(F.coalesce("value", F.lit("-")).alias("state")).agg(F.count("*").alias("n"), F.sum("seq").cast("bigint").alias("seqs"))
