"""Mutations as log rows, and compare-and-set with one order per key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.visibility import is_live, newest
from tidemark.operators.reads import wanted
from tidemark.schema import CAS_RESULT


def set_rows(items: DataFrame, base_seq: int, now: int) -> DataFrame:
    """Log rows for (pos, key, value[, expire_at]) in order of pos; without expire_at a set clears the time to live."""
    expire_at = F.col("expire_at") if "expire_at" in items.columns else F.lit(0)
    return items.select((F.col("pos") + F.lit(base_seq)).cast("bigint").alias("seq"), F.lit(now).cast("bigint").alias("ts"), "key", "value", expire_at.cast("bigint").alias("expire_at"))


def accepted(now: int):
    """Whether a set with an absolute expiry has an effect: a past one has none, silently."""
    return (F.col("expire_at") == 0) | (F.col("expire_at") > F.lit(now))


def delete_rows(keys: DataFrame, base_seq: int, now: int) -> DataFrame:
    """Tombstones for (pos, key)."""
    return set_rows(keys.select("pos", "key", F.lit(None).cast("string").alias("value")), base_seq, now)


def found_keys(log: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """The distinct requested keys that are live."""
    return newest(wanted(log, keys)).where(is_live(now)).select("key")


def numbered(items: DataFrame, order: str) -> DataFrame:
    """``pos`` 0.. in the order of a column; for request lists, which one writer numbers."""
    return items.withColumn("pos", F.row_number().over(Window.orderBy(order)).cast("bigint") - 1)


def cas_fold(ops: DataFrame, base: DataFrame | None, now: int) -> DataFrame:
    """CAS_RESULT and the written row of each operation, applied per key in order of seq to the live state ``base``.

    A key's operations depend on one another, so a key is one task's; they come sorted and are folded as a stream, in
    memory that doesn't grow with a key's operations, where a collected list would.
    """
    rows = ops.select("key", F.col("seq"), F.lit(1).alias("kind"), "expected", "new_value", "expire_at")
    if base is not None:
        held = newest(base).where(is_live(now)).select("key", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("expected"), F.col("value").alias("new_value"), "expire_at")
        rows = rows.unionByName(held)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = None
        until = 0
        for batch in batches:
            out: list[tuple] = []
            for k, seq, kind, expected, new, expire_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, value, until = k, None, 0
                if value is not None and until and now > until:
                    value = None
                if kind == 0:
                    value, until = new, expire_at
                    continue
                done = expected == value
                out.append((seq, k, done, value, new if done else None, expire_at))
                if done:
                    value, until = new, expire_at
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq", "key", "success", "current_value", "written", "expire_at"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "kind", "seq").select("key", "seq", "kind", "expected", "new_value", "expire_at")
    return ordered.mapInArrow(fold, "seq bigint, key string, success boolean, current_value string, written string, expire_at bigint")


def cas_results(folded: DataFrame) -> DataFrame:
    return folded.select(*CAS_RESULT.names)


def cas_rows(folded: DataFrame, now: int) -> DataFrame:
    """The log rows of the operations that succeeded."""
    return folded.where("success").select("seq", F.lit(now).cast("bigint").alias("ts"), "key", F.col("written").alias("value"), "expire_at")
