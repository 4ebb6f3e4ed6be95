"""What stages leave in the driver's memory."""

import re
from pathlib import Path

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def resident(pid: int) -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) // 1024


def test_a_stage_begins_with_freed_memory_given_back(spark):
    """Memory that the driver's JVM has allocated outside its heap and freed again doesn't stay with it."""
    jvm = spark.sparkContext._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    corpus_pipeline.replace_personal_data(spark, docs, DATA)  # its code is loaded
    made = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    for i, d in enumerate(made):
        if i % 100:  # what is left between keeps the rest from going by itself
            d.end()
    jvm.System.gc()
    before = resident(pid)
    corpus_pipeline.replace_personal_data(spark, docs, DATA)
    assert resident(pid) < before - 60
