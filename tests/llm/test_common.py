"""The shared folder and the driver's memory."""

import os
import re
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm.common import done, staged


def held(pid):
    """MB that a process keeps from the system, without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.parametrize("step", ["staged", "done"])
def test_the_driver_gives_back_what_it_freed(spark, step):
    """200 MB of Python's and of the JVM's, freed but for every fiftieth block: the rest must not stay with the C library."""
    jvm = spark.sparkContext._jvm
    native, pids = jvm.org.apache.spark.unsafe.Platform, (os.getpid(), jvm.java.lang.ProcessHandle.current().pid())
    table = staged(spark.range(3), "test-table")
    jvm.System.gc()
    blocks, places = [np.ones(100_000, np.uint8) for _ in range(2000)], [native.allocateMemory(100_000) for _ in range(2000)]
    for p in places:
        native.setMemory(p, 1, 100_000)
    blocks = blocks[::50]
    for i, p in enumerate(places):
        if i % 50:
            native.freeMemory(p)
    before = [held(p) for p in pids]
    if step == "staged":
        assert staged(table, "test-again").count() == 3
    else:
        done(table)
    after = [held(p) for p in pids]
    for p in places[::50]:
        native.freeMemory(p)
    assert len(blocks) == 40 and all(b - a > 120 for b, a in zip(before, after, strict=True)), (before, after)
