"""Counters that can be watched while a walk or a removal runs, and a token to stop it.

A stopped walk gives what it has found so far. The token is a file, so tasks of another process see it too.
"""

from __future__ import annotations

import os
import sys
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.functions.formats import human

CADENCE_S = 0.12


class Tally:
    """What one task has seen so far, in a file of a folder that the watcher reads; written at most every CADENCE_S."""

    def __init__(self, folder: str | None):
        self.path = os.path.join(folder, uuid.uuid4().hex) if folder else None
        self.files = self.bytes = 0
        self.told = time.monotonic()

    def add(self, size: int) -> None:
        self.files += 1
        self.bytes += size
        if self.path and time.monotonic() - self.told >= CADENCE_S:
            self.tell()

    def tell(self) -> None:
        self.told = time.monotonic()
        if not self.path:
            return
        try:
            with open(f"{self.path}.tmp", "w") as f:
                f.write(f"{self.files} {self.bytes}")
            os.replace(f"{self.path}.tmp", self.path)
        except OSError:  # the folder isn't there on this host: the final counts don't come from here
            self.path = None


class Progress:
    """Files and bytes so far. token: a file that stops the work, also in other processes. tallies: a folder that tasks tell their counts in
    while they run; their final counts are added instead when they are done."""

    def __init__(self, token: str | None = None, tallies: str | None = None):
        self._lock, self._files, self._bytes, self._stop, self.token, self.tallies = threading.Lock(), 0, 0, False, token, tallies

    def _told(self) -> tuple[int, int]:
        files = size = 0
        for name in os.listdir(self.tallies) if self.tallies and os.path.isdir(self.tallies) else ():
            try:
                a, b = open(os.path.join(self.tallies, name)).read().split()
            except (OSError, ValueError):
                continue
            files, size = files + int(a), size + int(b)
        return files, size

    def settle(self, files: int, size: int) -> None:
        """The final counts of tasks, in place of what they told."""
        if self.tallies and os.path.isdir(self.tallies):
            for name in os.listdir(self.tallies):
                os.unlink(os.path.join(self.tallies, name))
        self.add(files, size)

    def add(self, files: int, size: int) -> None:
        with self._lock:
            self._files += files
            self._bytes += size

    @property
    def files(self) -> int:
        return self._files + self._told()[0]

    @property
    def bytes(self) -> int:
        return self._bytes + self._told()[1]

    def cancel(self) -> None:
        self._stop = True
        if self.token:
            open(self.token, "w").close()

    def cancelled(self) -> bool:
        return self._stop or bool(self.token) and os.path.exists(self.token)


def watched[R](work: Callable[[Progress], R], progress: Progress, stream=sys.stderr) -> R:
    """work(progress), with a live line while it runs if stream is a terminal."""
    if not stream.isatty():
        return work(progress)
    over = threading.Event()

    def tell() -> None:
        while not over.wait(CADENCE_S):
            stream.write(f"\r  working: {progress.files} files, {human(progress.bytes)}   ")
            stream.flush()

    thread = threading.Thread(target=tell, daemon=True)
    thread.start()
    try:
        return work(progress)
    finally:
        over.set()
        thread.join()
        stream.write("\r\x1b[2K")
        stream.flush()


def observed(inventory: DataFrame, name: str = "walk") -> tuple[DataFrame, Observation]:
    """inventory, and an observation that has files and bytes once an action has run."""
    seen = Observation(name)
    file = F.col("entry_type") == "file"
    return inventory.observe(seen, F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes")), seen


class Tagged:
    """Jobs started in this block can be stopped from another thread by stop(); they then fail."""

    def __init__(self, spark: SparkSession, tag: str):
        self.context, self.tag = spark.sparkContext, tag

    def __enter__(self) -> Tagged:
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.context.removeJobTag(self.tag)

    def stop(self) -> None:
        self.context.cancelJobsWithTag(self.tag)
