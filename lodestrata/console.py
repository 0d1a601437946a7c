"""Small formats for people."""

from __future__ import annotations

import os
import platform
import re
import statistics
import sys
import threading
import time


def short_time(seconds: float) -> str:
    """42s, 2:05; parts of a second are cut off."""
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}:{s % 60:02d}"


def file_size(n: float) -> str:
    """Bytes with a unit, in steps of 1024."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def wall_seconds(text: str) -> float:
    """Seconds of h:mm:ss, m:ss.cc or s."""
    if not re.fullmatch(r"(\d+:)*\d+(\.\d+)?", text.strip()):
        raise ValueError(f"not a time: {text!r}")
    total = 0.0
    for part in text.strip().split(":"):
        total = total * 60 + float(part)
    return total


class Progress:
    """A line on a stream while Spark works: what is done, tasks a second, time so far and about left. Nothing is written if `shown` is false."""

    def __init__(self, spark, what: str, shown: bool = True, every: float = 1.0, stream=None) -> None:
        self.tracker, self.what, self.every, self.stream = spark.sparkContext.statusTracker(), what, every, stream or sys.stderr
        self.shown, self.over = shown, threading.Event()

    def line(self, seconds: float) -> str:
        infos = [i for i in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if i]
        done, total = sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)
        left = f", about {short_time(seconds * (total - done) / done)} left" if done and total > done else ""
        return f"{self.what}: {done}/{total} tasks, {done / seconds if seconds else 0:.1f}/s, {short_time(seconds)}{left}"

    def _run(self) -> None:
        began = time.monotonic()
        while not self.over.wait(self.every):
            self.stream.write(f"\r{self.line(time.monotonic() - began):<78}")
            self.stream.flush()
        self.stream.write("\r" + " " * 78 + "\r")

    def __enter__(self) -> Progress:
        if self.shown:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        if self.shown:
            self.thread.join()


def status(label: str, detail: str, timing: str = "") -> str:
    return f"  {label:<12} {detail}" + (f"  {timing}" if timing else "")


def run_stats(seconds: list[float | None]) -> dict[str, float | int]:
    """Median, standard deviation, least and most over the runs that succeeded (the others are None)."""
    good = [s for s in seconds if s is not None]
    if not good:
        return {"runs": 0, "failed": len(seconds)}
    return {"runs": len(good), "failed": len(seconds) - len(good), "median": statistics.median(good), "stdev": statistics.stdev(good) if len(good) > 1 else 0.0, "min": min(good), "max": max(good)}


def system_info() -> dict[str, str | int]:
    return {"system": platform.system(), "release": platform.release(), "machine": platform.machine(), "python": platform.python_version(), "cpus": os.cpu_count() or 0}
