"""Segments: sorted Parquet files of log rows, written with key statistics and read by manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.maintenance import segment_stats
from tidemark.schema import KV_LOG
from tidemark.sources.files import Folder
from tidemark.sources.manifest import Segment

OPTIONS = {"compression": "zstd", "parquet.bloom.filter.enabled#key": "true"}
LEAST_KEYS = 1000


def read(spark: SparkSession, folder: Folder, names: list[str], with_file: bool = False) -> DataFrame:
    """KV_LOG rows of some files, with the name of the file if asked for; none gives an empty frame."""
    if not names:
        none = spark.createDataFrame([], KV_LOG)
        return none.withColumn("file", F.lit(None).cast("string")) if with_file else none
    found = spark.read.schema(KV_LOG).parquet(*[folder.full(n) for n in names])
    return found.select(*KV_LOG.names, F.col("_metadata.file_name").alias("file")) if with_file else found


def write_run(rows: DataFrame, folder: Folder, name: str, files: int = 1, keys: int = 0) -> list[tuple[str, dict]]:
    """Write rows as files of disjoint, ascending key ranges; (path under the folder, statistics) of each. ``keys`` is the
    most there can be, for the size of the Bloom filters.

    Statistics are read back from the files by one aggregate that reads keys and numbers, never on the driver.
    """
    spark = rows.sparkSession
    placed = rows.select(*KV_LOG.names)
    placed = placed.repartitionByRange(files, "key") if files > 1 else placed.repartition(1) if files == 1 else placed
    options = {**OPTIONS, "parquet.bloom.filter.expected.ndv#key": str(max(LEAST_KEYS, -(-keys // max(1, files))))}
    placed.sortWithinPartitions("key", F.col("seq").desc()).write.options(**options).parquet(folder.full(name))
    written = spark.read.schema(KV_LOG).parquet(folder.full(name)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    stats = segment_stats(written, "file").orderBy("min_key").collect()  # a row per file
    return [(f"{name}/{r.file}", {k: r[k] for k in ("min_key", "max_key", "entry_count", "max_expire_at", "min_seq", "max_seq")}) for r in stats]


def segment(folder: Folder, path: str, level: int, stats: dict) -> Segment:
    return Segment(filename=path, level=level, size_bytes=folder.size(path), **stats)
