"""Lines of ``key=value`` for logs and progress with an estimate of the time left, on standard error."""

from __future__ import annotations

import logging
import sys
import threading
import time

from pyspark.sql import SparkSession

LOG = logging.getLogger("turnwise")


def configure() -> None:
    """Messages as they are to standard error, unless logging is set up already."""
    if not logging.getLogger().handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(message)s"))
        logging.getLogger().addHandler(handler)
        logging.getLogger().setLevel(logging.INFO)


def pairs(**values) -> str:
    """``a=1 b=2``; None is left out, line ends become blanks."""
    return " ".join(f"{k}={' '.join(str(v).splitlines())}" for k, v in values.items() if v is not None)


def log(**values) -> None:
    LOG.info(pairs(**values))


def wanted(on: bool, off: bool) -> bool:
    """Whether progress is printed: as asked, else if standard error is a terminal."""
    return not off and (on or sys.stderr.isatty())


def target_rows(total: int | None, most: int | None) -> int | None:
    """Rows that will be read, as far as known."""
    known = [x for x in (total, most) if x is not None]
    return min(known) if known else None


def duration_text(seconds: float | None) -> str:
    """``45s``, ``1m30s``, ``1h01m40s``; ``?`` for nothing sensible."""
    if seconds is None or seconds != seconds or seconds < 0:
        return "?"
    s = round(seconds)
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m{s % 60:02d}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60:02d}m{s % 60:02d}s"


def line(phase: str, done: int, target: int | None, elapsed: float, unit: str = "rows") -> str:
    """One line of progress; the time left follows from the mean rate so far."""
    rate = done / elapsed if elapsed > 0 else 0.0
    left = target - done if target is not None and target > done else None
    eta = duration_text(left / rate) if left is not None and rate > 0 else None
    return f"[{phase}] " + pairs(**{unit: done, f"{unit}_a_second": f"{rate:.0f}", "elapsed": duration_text(elapsed), "left": left, "eta": eta})


class Tasks:
    """Prints how many tasks of the running jobs are done every few seconds; used as a context around a phase."""

    def __init__(self, spark: SparkSession, phase: str, on: bool, every: float = 5.0) -> None:
        self.tracker, self.phase, self.on, self.every = spark.sparkContext.statusTracker(), phase, on, every
        self.stop = threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        began = time.time()
        while not self.stop.wait(self.every):
            stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
            if stages:
                print(line(self.phase, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages), time.time() - began, "tasks"), file=sys.stderr, flush=True)

    def __enter__(self) -> "Tasks":
        self.began = time.time()
        if self.on:
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        log(phase=self.phase, seconds=round(time.time() - self.began, 1))
