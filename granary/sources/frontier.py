"""A directory walk in rounds: tasks list folders, what is left to list goes to the shared folder and is dealt out again.

An item is a folder, or some names of one (a large folder is listed in chunks of CHUNK names: the task that lists it keeps the first
and passes on the others, so that many tasks read their sizes). A task walks its items depth first until it has seen its share of entries and
passes on what it has not come to. The share grows round by round, so a small tree is one round of one task, and a deep or uneven one is dealt out anew
by hash as often as it needs. Rows and items of a round are one Parquet folder: a lost task lists its items again, nothing before it. The driver
holds the number of items.
"""

from __future__ import annotations

import os
import shutil
import stat
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import globs
from granary.shipping import ship
from granary.sources.file_tree import Options, Walk
from granary.sources.inventory import SCHEMA
from granary.streaming.progress import Tally

#: Names of a folder that a task looks at itself, and that are an item of their own beyond it.
CHUNK = 2048
#: Entries that a task looks at in the first round, and at most in any.
FIRST, SHARE = 4096, 1 << 22
ROWS = 2000

_ITEM = T.StructType([T.StructField("path", T.BinaryType()), T.StructField("depth", T.IntegerType()), T.StructField("names", T.ArrayType(T.BinaryType())), T.StructField("above", T.ArrayType(T.StringType()))])
_ROUND = T.StructType([*SCHEMA.fields, T.StructField("item", _ITEM)])
_TYPES = {"string": pa.string(), "binary": pa.binary(), "integer": pa.int32(), "long": pa.int64()}
_ARROW = pa.schema([(f.name, _TYPES[f.dataType.typeName()]) for f in SCHEMA] + [("item", pa.struct([("path", pa.binary()), ("depth", pa.int32()), ("names", pa.list_(pa.binary())), ("above", pa.list_(pa.string()))]))])


class Lister(Walk):
    """Listing of items: (path, depth, names or None, above), above being the folders over it by device and inode where links are followed."""

    def __init__(self, root: str, options: Options, share: int):
        super().__init__(root, options)
        self.share, self.seen = share, 0

    def entry(self, path: str, depth: int, above: list[str]) -> tuple[tuple | None, tuple | None]:
        """(row, item) of one entry; either may be None."""
        o = self.options
        if globs.is_excluded(path, self.exclude):
            return None, None
        try:
            s = os.lstat(path)
            if stat.S_ISLNK(s.st_mode):
                if not o.follow_symlinks:
                    return (self._row(path, depth, "special", s) if o.include_special else None), None
                s = os.stat(path)
        except OSError as e:
            return self._row(path, depth, "error", error=str(e)), None
        if stat.S_ISDIR(s.st_mode):
            own = f"{s.st_dev}:{s.st_ino}"
            if own in above:
                return self._row(path, depth, "error", error="a loop of links"), None
            return self._row(path, depth, "dir"), (os.fsencode(path), depth, None, [*above, own] if o.follow_symlinks else [])
        if stat.S_ISREG(s.st_mode):
            return self._row(path, depth, "file", s), None
        return (self._row(path, depth, "special", s) if o.include_special else None), None

    def _names(self, item: tuple) -> Iterator[list[bytes]]:
        """The names of an item in chunks, as the folder gives them."""
        path, _, names, _ = item
        if names is not None:
            yield names
            return
        some: list[bytes] = []
        with os.scandir(path) as entries:
            for e in entries:
                some.append(e.name)
                if len(some) == CHUNK:
                    yield some
                    some = []
        if some:
            yield some

    def walk(self, items: list[tuple]) -> Iterator[tuple[tuple | None, tuple | None]]:
        """(row, None) of what is listed and (None, item) of what is left to list."""
        waiting, o = list(items), self.options
        while waiting:
            item = waiting.pop()
            path, depth, names, above = item
            if o.max_depth is not None and depth >= o.max_depth or o.token and os.path.exists(o.token):
                continue
            if self.seen >= self.share:
                yield None, item
                continue
            text, kept = os.fsdecode(path), True
            try:
                for chunk in self._names(item):
                    if not kept:
                        yield None, (path, depth, chunk, above)
                        continue
                    kept = False
                    self.seen += len(chunk)
                    for name in chunk:
                        row, below = self.entry(os.path.join(text, os.fsdecode(name)), depth + 1, above)
                        if row is not None:
                            yield row, None
                        if below is not None:
                            waiting.append(below)
            except OSError as e:
                yield self._row(text, depth, "error", error=str(e)), None


def _round(root: str, options: Options, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, lister, out = Tally(options.tallies), Lister(root, options, share), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(list(columns[k]) if out else [], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)

        items = [(i["path"], i["depth"], i["names"], i["above"] or []) for b in batches for i in b.column(0).to_pylist()]
        for row, item in lister.walk(items):
            if row is not None:
                out.append((*row, None))
                if row[4] == "file":
                    tally.add(row[5])
            else:
                out.append((root, "", None, item[1], "item", *[None] * 6, dict(zip(("path", "depth", "names", "above"), item))))
            if len(out) >= ROWS:
                yield batch()
                out.clear()
        tally.tell()
        yield batch()

    return run


def _place(spark: SparkSession) -> tuple[str, Callable[[], object]] | None:
    """(a new folder that driver and executors share, what removes it); None if none is known."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            return None
        own = tempfile.mkdtemp(prefix="granary-walk-")
        return f"file://{own}/walk", lambda: shutil.rmtree(own, True)
    path = f"{named}/walk-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, lambda: where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def walk(spark: SparkSession, root: str, options: Options = Options(), first: int = FIRST, share: int = SHARE) -> tuple[DataFrame, Callable[[], object]] | None:
    """(the inventory of a directory tree, what removes it): walked once and written; None where driver and executors share no folder that is known.

    The same rows as the data source file_tree gives. root has to be visible to all executors. NotADirectoryError if it is none.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    place = _place(spark)
    if place is None:
        return None
    path, let_go = place
    ship(spark)
    above = []
    if options.follow_symlinks:
        s = os.stat(root)
        above = [f"{s.st_dev}:{s.st_ino}"]
    items, left, rounds = spark.createDataFrame([((bytearray(os.fsencode(root)), 0, None, above),)], T.StructType([T.StructField("item", _ITEM)])), 1, 0
    width = 4 * spark.sparkContext.defaultParallelism
    most = lambda n: max(width, n // 50_000)  # items that a task holds
    try:
        while left:
            where = f"{path}/round={rounds}"
            dealt = items.repartition(min(left, most(left)), F.xxhash64("item.path", F.get("item.names", F.lit(0))))
            dealt.mapInArrow(_round(root, options, min(share, first << min(rounds, 20))), _ROUND).write.parquet(where)
            items = spark.read.schema(_ROUND).parquet(where).filter("entry_type = 'item'").select("item")
            left, rounds = items.count(), rounds + 1
    except BaseException:
        let_go()
        raise
    kept = spark.read.schema(_ROUND).parquet(*[f"{path}/round={k}" for k in range(rounds)])
    return kept.filter("entry_type != 'item'").select(*SCHEMA.names), let_go
