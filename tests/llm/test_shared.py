import gc
import re
import time
from pathlib import Path

from palimpsest.llm.shared import settle, settle_fully


def test_the_drivers_jvm_hands_native_memory_back(spark):
    """Blocks that are freed between others stay with the process until it trims its native heap."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) / 1024
    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3_000)]
    kept = blocks[::50]
    del blocks
    for _ in range(2):  # the blocks are freed, and the Java heap shrinks
        gc.collect()
        time.sleep(0.5)
        jvm.System.gc()
        time.sleep(1)
    before = resident()
    settle(spark)
    assert resident() < before - 50
    assert len(kept) == 60


def test_shuffles_are_gone_when_settled_fully(spark):
    """Not some time after."""
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    settle_fully(spark)
    before = known.size()
    for _ in range(20):
        spark.range(100).repartition(3).groupBy("id").count().collect()
    assert known.size() >= before + 20
    settle_fully(spark)
    assert known.size() <= before + 1
