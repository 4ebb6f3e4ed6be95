"""Lookups, scans and counts over a mutation log. Predicates on the key go below the aggregate; visibility stays above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.visibility import counted, is_live, newest, newest_keys

#: A request list of at most so many keys and bytes is broadcast; a longer one is joined by shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 100_000, 8 << 20


def get_with_expire_at(log: DataFrame, key: str, now: int) -> DataFrame:
    return newest(log.where(F.col("key") == key)).where(is_live(now)).select("key", "value", "expire_at")


def get(log: DataFrame, key: str, now: int) -> DataFrame:
    return get_with_expire_at(log, key, now).select("key", "value")


def is_small(keys: DataFrame) -> bool:
    """Whether a request list is within the bounds of a broadcast; counts no further than to the bound."""
    n, size = keys.select("key").limit(BROADCAST_KEYS + 1).agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    return n <= BROADCAST_KEYS and (size or 0) <= BROADCAST_BYTES


def wanted(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log rows of some keys; a small request list is broadcast, so that the log isn't shuffled."""
    asked = keys.select("key").distinct()
    return log.join(F.broadcast(asked) if is_small(keys) else asked, "key", "left_semi")


def _resolved(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest rows of some keys. Of a long list, versions are combined before the shuffle that the join then uses as well."""
    asked = keys.select("key").distinct()
    return newest(log.join(F.broadcast(asked), "key", "left_semi")) if is_small(keys) else newest(log).join(asked, "key", "left_semi")


def batch_get(log: DataFrame, requests: DataFrame, now: int, ordered: bool = True) -> DataFrame:
    """Found keys of (pos, key): with positions and duplicates, or each once. Missing keys are left out."""
    found = _resolved(log, requests).where(is_live(now)).select("key", "value")
    return requests.join(found, "key").select("pos", "key", "value") if ordered else found


def get_expire_at(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """(pos, key, exists, expire_at) for every request; (false, 0) if missing, expired or deleted."""
    found = _resolved(log, requests).where(is_live(now)).select("key", "expire_at", F.lit(True).alias("found"))
    joined = requests.join(found, "key", "left")
    return joined.select("pos", "key", F.coalesce("found", F.lit(False)).alias("exists"), F.coalesce("expire_at", F.lit(0)).cast("bigint").alias("expire_at"))


def _starting(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(F.col("key").startswith(prefix)) if prefix else log


def count_prefix(log: DataFrame, prefix: str, now: int) -> DataFrame:
    """(n) distinct live keys; the empty prefix counts all."""
    return newest_keys(_starting(log, prefix)).where(counted(now)).agg(F.count("*").alias("n"))


def count_prefixes(log: DataFrame, prefixes: list[str], now: int) -> DataFrame:
    """(prefix, n) for several prefixes in one pass over the log; prefixes may nest."""
    spark = log.sparkSession
    some = F.lit(False)
    for p in prefixes:
        some = some | F.col("key").startswith(p)
    keys = newest_keys(log.where(some)).where(counted(now)).select("key")
    hits = F.filter(F.array(*[F.when(F.col("key").startswith(p), F.lit(p)) for p in dict.fromkeys(prefixes)]), lambda x: x.isNotNull())
    counts = keys.select(F.explode(hits).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    return asked.join(counts, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def scan_prefix(log: DataFrame, prefix: str, now: int) -> DataFrame:
    return newest(_starting(log, prefix)).where(is_live(now)).select("key", "value", "expire_at")


def scan_prefix_keys(log: DataFrame, prefix: str) -> DataFrame:
    """(key, is_tombstone), without reading values further than their absence."""
    return newest_keys(_starting(log, prefix)).select("key", F.col("gone").alias("is_tombstone"))
