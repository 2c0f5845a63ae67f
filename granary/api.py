"""The verbs: walk_files, scan, find_duplicates, reclaim, remove_path, disk_space, validate_globs, human_size.

Each takes a directory of the local (or a shared) file system and returns plain objects; the DataFrame forms are in granary.operators.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.formats import human as human_size
from granary.functions.globs import validate_globs
from granary.operators import duplicates
from granary.operators import scan as scans
from granary.operators.reclaim import ReclaimReport, reclaim
from granary.operators.removal import RemoveReport, remove_path
from granary.sources import file_tree, frontier, inventory
from granary.sources.file_tree import Options, parse_options
from granary.streaming.progress import Progress, observed

__all__ = [
    "DirSize", "DupGroup", "FileEntry", "Options", "Progress", "ReclaimReport", "RemoveReport", "ScanReport",
    "disk_space", "duplicate_members", "find_duplicates", "human_size", "parse_options", "reclaim", "remove_path", "scan", "validate_globs", "walk_files",
]


@dataclass(frozen=True)
class FileEntry:
    path: str
    size: int
    logical_size: int


@dataclass(frozen=True)
class DirSize:
    path: str
    size: int
    file_count: int


@dataclass
class ScanReport:
    root: str
    total_size: int = 0
    total_files: int = 0
    total_dirs: int = 0
    skipped: int = 0
    children: list[DirSize] = field(default_factory=list)
    root_files_size: int = 0
    root_files_count: int = 0
    top_files: list[FileEntry] = field(default_factory=list)
    disk_total: int = 0
    disk_free: int = 0


@dataclass(frozen=True)
class DupGroup:
    hash: str
    size: int
    files: list[str]
    wasted: int


def disk_space(path: str) -> tuple[int, int]:
    """(total, free to others than root) of the file system of path; (0, 0) if it can't be told."""
    try:
        usage = shutil.disk_usage(path)
    except OSError:
        return 0, 0
    return usage.total, usage.free


def _inventory(spark: SparkSession, root: str, options: Options, progress: Progress | None) -> tuple[DataFrame, Callable[[], object]]:
    """(the inventory of a tree, what lets go of it), walked once and kept: read twice it could differ, and would cost twice."""
    if progress:
        options = replace(options, token=options.token or progress.token, tallies=options.tallies or progress.tallies)
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    if progress and progress.cancelled():
        return spark.createDataFrame([], file_tree.SCHEMA), lambda: None
    walked = frontier.walk(spark, root, options)
    if walked:
        if progress:
            files = walked[0].filter("entry_type = 'file'").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
            progress.settle(files["n"], files["bytes"])
        return walked
    found, seen = observed(file_tree.read(spark, root, options))
    kept = inventory.keep(found)
    if progress:
        progress.settle(seen.get["files"], seen.get["bytes"])
    return kept


def walk_files(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    """(path, size, logical_size) of the files below root."""
    return file_tree.read(spark, root, options).filter("entry_type = 'file'").select("path", "size", "logical_size")


def scan(spark: SparkSession, root: str, top_n: int = 20, options: Options = Options(), progress: Progress | None = None) -> ScanReport:
    """Totals, largest direct sub-folders and largest files of root. A stopped scan reports what it has seen."""
    found, let_go = _inventory(spark, root, options, progress)
    try:
        row = scans.report(found, root, top_n, disk_space(root)).first().asDict(recursive=True)
    finally:
        let_go()
    row["children"] = [DirSize(**x) for x in row["children"]]
    row["top_files"] = [FileEntry(**x) for x in row["top_files"]]
    return ScanReport(**row)


@contextmanager
def duplicate_members(spark: SparkSession, root: str, min_size: int = 1, options: Options = Options(), progress: Progress | None = None) -> Iterator[DataFrame]:
    """duplicates.members() of the files below root, as they were found: written once, and there while the block runs."""
    if min_size < 0:
        raise ValueError("min_size is negative")
    with ExitStack() as after:
        walked, let_go = _inventory(spark, root, options, progress)
        after.callback(let_go)
        held: list[DataFrame] = []
        after.callback(lambda: [df.unpersist() for df in held])
        found, forget = inventory.keep(duplicates.members(walked, min_size, held=held, digest="blake3"))
        after.callback(forget)
        yield found


def find_duplicates(spark: SparkSession, root: str, min_size: int = 1, options: Options = Options(), progress: Progress | None = None) -> list[DupGroup]:
    """Groups of files of equal content of at least min_size bytes below root, most wasted first."""
    with duplicate_members(spark, root, min_size, options, progress) as found:
        return [DupGroup(r["hash"], r["size"], list(r["files"]), r["wasted"]) for r in duplicates.groups(found).collect()]
