"""Encodes as jobs that can be cancelled, counted and reported: tags, observations, and an encoder that keeps its options."""

from __future__ import annotations

import os
import platform
import subprocess
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import images

T = TypeVar("T")


class Cancelled(RuntimeError):
    """The work was cancelled before it was done; nothing that it wrote counts."""


@dataclass
class Cancellation:
    """Stops what runs under it. Jobs carry its tag, so that cancelling reaches the tasks that are running, and no others."""

    spark: SparkSession
    tag: str = field(default_factory=lambda: f"encode-{uuid.uuid4().hex}")
    stopped: bool = False

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, work: Callable[[], T]) -> T:
        """work(), under the tag of this thread; raises Cancelled if it was or is cancelled. Other failures pass through."""
        if self.stopped:
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return work()
        except Exception as e:
            if self.stopped:
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)


@dataclass(frozen=True)
class Encoder:
    """Options of an encode; without any, the default mode."""

    mode: str = "default"

    def encode(self, packed: DataFrame, cancellation: Cancellation | None = None, out: str | None = None) -> DataFrame:
        """(img, webp) of packed images. With `out` the files are written there, under the cancellation if one is given."""
        files = images.encode(packed, self.mode)
        if out is None:
            return files
        write = lambda: files.write.parquet(out)
        cancellation.run(write) if cancellation else write()
        return packed.sparkSession.read.parquet(out)


@contextmanager
def counted(layouts: DataFrame) -> Iterator[tuple[DataFrame, Callable[[], dict[str, int]]]]:
    """(layouts that count as they are read, the counters): files, tokens by kind, and bits by use, summed on the executors."""
    seen = Observation(f"layouts-{uuid.uuid4().hex}")
    sums = {c: F.sum(c) for c in ("literals", "copies", "cached", "header_bits", "code_bits", "data_bits", "total_bits", "bytes")}
    yield layouts.observe(seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("cache_bits") > 0).alias("with_cache"), *[s.alias(c) for c, s in sums.items()]), lambda: {k: v or 0 for k, v in seen.get.items()}


def environment(folder: str = ".") -> dict[str, str | int | bool | None]:
    """What a report says about the machine and the code: commit, uncommitted changes, system, processors, versions."""

    def git(*words: str) -> str | None:
        got = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=False)
        return got.stdout.strip() if not got.returncode else None

    changes = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "dirty": bool(changes) if changes is not None else None, "system": platform.system(), "machine": platform.machine(), "processors": os.cpu_count(), "python": platform.python_version()}
