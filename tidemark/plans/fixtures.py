"""The mutation log and request lists of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1705276800  # 2024-01-15T00:00:00Z

_GONE = "event_type = 'error' AND event_id % 3 = 0"
_TS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
_KEY = "concat('user:', lpad(CAST(user_id AS STRING), 5, '0'), ':', event_type)"


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "CAST(event_id AS BIGINT) AS seq", f"{_TS} AS ts", f"{_KEY} AS key", f"CASE WHEN {_GONE} THEN CAST(NULL AS STRING) ELSE props END AS value",
        f"CASE WHEN event_id % 4 = 0 AND NOT ({_GONE}) THEN {_TS} + 86400 * (1 + event_id % 7) ELSE CAST(0 AS BIGINT) END AS expire_at",
    )


def log_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as of NOW."""
    return kv_log(spark, sf_dir).where(F.col("ts") <= NOW)


def cas_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "CAST(event_id AS BIGINT) AS seq", "concat('user:', lpad(CAST(user_id AS STRING), 5, '0')) AS key",
        "CASE WHEN event_id % 2 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 3 = 0 THEN 'click' ELSE 'view' END AS expected",
        "event_type AS new_value", "CAST(0 AS BIGINT) AS expire_at",
    )


#: Keys asked for: user 1 twice, some users, and one who isn't there.
REQUESTS = tuple(f"user:{u}:{t}" for u in ("00000", "00001", "00000", "99999") for t in ("click", "error", "purchase", "signup", "view"))
PREFIXES = ("user:0000", "user:0001", "user:00149:", "nope:", "user:0000_", "user:00001:click")
ITEMS = tuple((f"team:{i % 4}", None if i == 9 else f"v{i}") for i in range(12))


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REQUESTS)), "pos bigint, key string")


def segments(log: DataFrame) -> DataFrame:
    """The log with ``segment`` and ``level``: runs of 1000 entries are level 0, all below seq 6000 are merged by
    newest version into two level 1 segments of disjoint key ranges."""
    from tidemark.functions.visibility import newest

    recent = log.where("seq >= 6000").select("key", "seq", "value", "expire_at", F.floor(F.col("seq") / 1000).cast("bigint").alias("segment"), F.lit(0).alias("level"))
    old = newest(log.where("seq < 6000")).select("key", "seq", "value", "expire_at", F.when(F.col("key") < "user:00075", -2).otherwise(-1).cast("bigint").alias("segment"), F.lit(1).alias("level"))
    return recent.unionByName(old)
