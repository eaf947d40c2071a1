"""Progress of long runs on the driver: counts, rates, time left, file events, and cancelling."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


class Monitor:
    """Items done of a total, and the time of named stages."""

    def __init__(self, total: int = 0, clock: Callable[[], float] = time.monotonic):
        self.total, self.done, self.clock = total, 0, clock
        self.began = clock()
        self.stages: dict[str, list[float]] = {}

    def advance(self, items: int = 1) -> None:
        self.done += items

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.stages.setdefault(name, []).append(self.clock() - began)

    def elapsed(self) -> float:
        return self.clock() - self.began

    def left(self) -> float:
        """Seconds to go at the present rate; 0 before a hundredth is done."""
        if not self.total or self.done / self.total < 0.01:
            return 0.0
        return self.elapsed() / (self.done / self.total) - self.elapsed()

    def rate(self) -> float:
        return self.done / self.elapsed() if self.elapsed() > 0 else 0.0

    def timings(self) -> dict[str, tuple[float, float, int]]:
        """Total and mean seconds and number of runs of each stage."""
        return {k: (sum(v), sum(v) / len(v), len(v)) for k, v in self.stages.items()}

    def to_json(self) -> str:
        return json.dumps({"elapsed_seconds": self.elapsed(), "total_items": self.total, "processed_items": self.done})

    def report(self) -> str:
        """Progress, rate, time left and stages, as lines of text."""
        share = 100 * self.done / self.total if self.total else 0.0
        lines = [f"{self.done} of {self.total} ({share:.1f} %), {self.elapsed():.0f} s, {self.rate():.0f} a second, {self.left():.0f} s left"]
        return "\n".join(lines + [f"{name}: {total:.2f} s in {n} runs, {mean:.3f} s each" for name, (total, mean, n) in self.timings().items()])


def file_events(folder: str, seen: dict[str, float], endings: tuple[str, ...] = (".fastq", ".fq", ".fastq.gz", ".fq.gz")) -> list[tuple[str, str]]:
    """(event, path) of files that came (created), changed (modified) or went (deleted) since ``seen``, which is brought up to date."""
    now = {e.path: e.stat().st_mtime for e in os.scandir(folder) if e.is_file() and e.name.endswith(endings)} if os.path.isdir(folder) else {}
    out = [("created" if p not in seen else "modified", p) for p in sorted(now) if seen.get(p) != now[p]]
    out += [("deleted", p) for p in sorted(set(seen) - set(now))]
    seen.clear()
    seen.update(now)
    return out


@contextlib.contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs of the block run under a group; the function it gives cancels them, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
