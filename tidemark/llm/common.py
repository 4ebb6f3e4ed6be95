"""What the operators of this subpackage share: worker path, shared folder, input hygiene."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    A cluster installs the package or gets it with --py-files; the path added here does no harm there.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset (tests, local runs)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for what is planned inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the plans of finished jobs and, with their handles, shuffles and broadcasts. A driver
    that runs dozens of jobs else fills its heap before it looks, and the heap's pages count whether they are used or not. What its
    compiler and its libraries have freed outside the heap goes back to the system, too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> str:
    """``trim`` for the driver's JVM, by its diagnostic command; what the command says, or nothing from a JVM that hasn't got it."""
    sc = spark.sparkContext
    lang, management = sc._jvm.java.lang, sc._jvm.javax.management

    def array(kind, *values):
        out = sc._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    # The server's own class isn't open to reflection, its interface is.
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(lang.Class.forName, kinds)))
    name = management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        said = invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, name, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JJavaError:
        return ""
    return str(said).strip()


def settle(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """``cut``, after which the shuffles and checkpoints that only df stood on go from disk: Spark removes them when the driver has
    collected their handles as garbage, which else may take as long as the job. A caller that keeps df, be it as an argument by keyword, keeps them too.
    Rows that df has dealt to a number of partitions by a key can be joined by that key without being moved again."""
    spark = df.sparkSession
    if partitioned:
        with setting(spark, "spark.sql.adaptive.enabled", "false"):  # an adaptive plan doesn't tell its partitioning
            out = cut(df)
    else:
        out = cut(df)
    del df
    for _ in range(2):  # listeners hold the plan of the last query they were told of
        spark.range(0, 1, 1, 1).collect()
        time.sleep(0.2)
        tidy(spark)
    return out


def discard(df: DataFrame) -> None:
    """Take from disk what ``cut`` or ``settle`` has written for df, which nothing reads any more."""
    remove(df.sparkSession, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table of one's own."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string): a null text counts as an empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(keys: pa.Array, texts: pa.Array, most: int) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows with at most ``most`` characters of text, or a single longer row."""
    whole = texts.to_numpy(zero_copy_only=False).tolist()
    named = whole if keys is texts else keys.to_pylist()
    at = held = 0
    for i, t in enumerate(whole):
        if held and held + len(t) > most:
            yield named[at:i], whole[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(whole):
        yield named[at:], whole[at:]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names in any case: a result takes the place of an input column of its name."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


BROADCAST_IDS = 1_000_000


def _by_ids(df: DataFrame, ids: DataFrame, name: str, how: str) -> DataFrame:
    """A join of wide rows with a list of distinct bigints: a list of up to BROADCAST_IDS goes to the rows, and only beyond that
    are rows moved."""
    ids = cut(ids)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, name, how)


def with_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose ``name`` is in the list."""
    return _by_ids(df, ids, name, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose ``name`` isn't in the list."""
    return _by_ids(df, ids, name, "left_anti")


_CLAIMED: dict[str, dict] = {}


def claim(name: str, cache: dict) -> dict:
    """A worker's cache for one operator; those that other operators left in this worker are emptied first, and their memory is
    given back."""
    left = [held for other, held in _CLAIMED.items() if other != name and held]
    for held in left:
        held.clear()
    if left:
        trim()
    _CLAIMED[name] = cache
    return cache


def trim() -> None:
    """Give freed memory back to the system: a worker serves one task after another."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
