"""Generated load: keys 1..n as text, alphanumeric values, duplicates at a rate; the same for the same seed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _value(length: int, seed: int):
    pick = lambda i: F.substring(F.lit(_LETTERS), (F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(_LETTERS))) + 1).cast("int"), F.lit(1))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(length)), pick))


def _key(space: int, seed: int):
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("key")), F.lit(space)) + 1).cast("string")


def random_sets(spark: SparkSession, n: int, space: int = 100, length: int = 20, seed: int = 0) -> DataFrame:
    """(pos, key, value)."""
    return spark.range(n).select(F.col("id").alias("pos"), _key(space, seed).alias("key"), _value(length, seed).alias("value"))


def random_gets(spark: SparkSession, n: int, space: int = 100, duplicate_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """(pos, key); a share of the requests repeats the first key."""
    again = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("again")), F.lit(1000)) < int(1000 * duplicate_rate)
    return spark.range(n).select(F.col("id").alias("pos"), F.when(again, F.lit("1")).otherwise(_key(space, seed)).alias("key"))


def random_cas(spark: SparkSession, n: int, space: int = 100, base_seq: int = 1, seed: int = 0) -> DataFrame:
    """CAS_OP in two phases: the first half creates keys, the second expects what a former operation may have written."""
    fresh = F.col("id") < n // 2
    expected = F.when(fresh, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit("expected")), F.lit(10)).cast("string")))
    return spark.range(n).select((F.col("id") + base_seq).alias("seq"), _key(space, seed).alias("key"), expected.alias("expected"), F.concat(F.lit("v"), (F.col("id") % 10).cast("string")).alias("new_value"), F.lit(0).cast("bigint").alias("expire_at"))


def timed(work: Callable[[], int], total: int) -> dict[str, float]:
    """A report on one bulk call that returns how many of ``total`` items it served."""
    began = time.perf_counter()
    succeeded = int(work())
    elapsed = time.perf_counter() - began
    return {"total": total, "succeeded": succeeded, "elapsed_s": elapsed, "per_second": total / elapsed}


def each(items: DataFrame, call: Callable[[Row], bool]) -> dict[str, float]:
    """A report on one call per item, in order: how many succeeded, and the times of the calls. Items come one at a time."""
    began, times, succeeded = time.perf_counter(), [], 0
    for row in items.orderBy("pos").toLocalIterator():
        at = time.perf_counter()
        succeeded += bool(call(row))
        times.append(time.perf_counter() - at)
    elapsed, n = time.perf_counter() - began, len(times)
    ranked = sorted(times)
    spread = {f"p{q}_s": ranked[min(n - 1, n * q // 100)] for q in (50, 90, 99)} if n else {}
    return {"total": n, "succeeded": succeeded, "elapsed_s": elapsed, "per_second": n / elapsed, "mean_s": sum(times) / n if n else 0.0, **spread}
