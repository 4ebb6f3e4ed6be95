"""Newest-wins resolution and visibility; the order is always: newest version first, visibility after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clock(now: int | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(int(now)).cast("bigint")


def expired(now: int | Column, inclusive: bool = False) -> Column:
    """Past its time to live. A row is still visible at expire_at itself unless ``inclusive``, as replay may ask."""
    over = _clock(now) >= F.col("expire_at") if inclusive else _clock(now) > F.col("expire_at")
    return (F.col("expire_at") > 0) & over


def is_live(now: int | Column) -> Column:
    return F.col("value").isNotNull() & ~expired(now)


def status(now: int | Column) -> Column:
    return F.when(F.col("value").isNull(), "deleted").when(expired(now), "expired").otherwise("live")


def newest(log: DataFrame, *carried: str) -> DataFrame:
    """One row per key, its highest seq. It combines before the shuffle; as values have no fixed width, both sides of it sort by
    key. Where values aren't needed, ``newest_keys`` hashes instead."""
    names = ["seq", "value", "expire_at", *carried]
    return log.groupBy("key").agg(F.max_by(F.struct(*names), "seq").alias("m")).select("key", *[F.col(f"m.{n}").alias(n) for n in names])


def snapshot(log: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    return newest(log if as_of_seq is None else log.where(F.col("seq") <= as_of_seq))


def live(log: DataFrame, now: int | Column, as_of_seq: int | None = None) -> DataFrame:
    return snapshot(log, as_of_seq).where(is_live(now))


def newest_keys(log: DataFrame) -> DataFrame:
    """(key, gone, expire_at): what counting needs; values are reduced to a flag before the shuffle. Expiries aren't negative."""
    flags = log.select("key", "seq", F.col("value").isNull().alias("gone"), "expire_at")
    # Two numbers of fixed width, each of the highest seq: a hash aggregate, where a struct of both would be sorted. One
    # number holds both, so that rows that share a seq can't be mixed.
    both = F.when(F.col("gone"), -1 - F.col("expire_at")).otherwise(F.col("expire_at"))
    found = flags.groupBy("key").agg(F.max_by(both, "seq").alias("m"))
    return found.select("key", (F.col("m") < 0).alias("gone"), F.when(F.col("m") < 0, -1 - F.col("m")).otherwise(F.col("m")).alias("expire_at"))


def counted(now: int | Column) -> Column:
    """is_live for the rows of ``newest_keys``."""
    return ~F.col("gone") & ~expired(now)
