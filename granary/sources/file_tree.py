"""A live directory tree as a Spark data source: spark.read.format("file_tree").

Options: path, exclude (globs, one a line), max_depth, follow_symlinks, include_special, token (a file that stops the walk), tallies
(a folder for counts while it runs), tasks, columns (names apart by commas: the others are neither read nor given; without sizes and identities no entry is
asked for them, and one that is gone by then is not seen to be), push (true where the session enables spark.sql.python.filterPushdown: conditions on depth,
entry_type and the start of path then end the walk where nothing below can meet them). The driver looks for folders only as
deep as gives enough sub-trees for the tasks, and holds names of folders, never rows: tasks list those upper folders too, one level each, and walk
the sub-trees below. Hidden entries count. Entries that a glob excludes are not read, nor is what lies
below. The path has to be visible to all executors.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from granary.functions import globs
from granary.shipping import ship
from granary.sources.inventory import SCHEMA
from granary.streaming.progress import Tally

ALLOCATION_UNIT = 512
#: Sub-trees a task that the driver looks for: they differ in size, and several even that out.
SUBTREES = 8
#: Columns that an entry has to be asked for.
OF_STAT = frozenset({"size", "logical_size", "dev", "inode", "nlink"})
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def allocated(s: os.stat_result) -> int:
    """Bytes that a file takes on disk; its length where the system doesn't tell."""
    blocks = getattr(s, "st_blocks", None)
    return s.st_size if blocks is None else blocks * ALLOCATION_UNIT


@dataclass(frozen=True)
class Options:
    exclude: tuple[str, ...] = ()
    max_depth: int | None = None
    follow_symlinks: bool = False
    include_special: bool = False
    token: str | None = None
    tallies: str | None = None


def parse_options(exclude: str = "", max_depth: str = "", follow_symlinks: bool = False) -> Options:
    """Options as typed into a form: globs apart by commas (so none may hold one), blanks around them and empty ones dropped; a depth that
    doesn't start with a number, or with one under 1, sets no bound."""
    globs_ = tuple(g for g in (x.strip() for x in exclude.split(",")) if g)
    number = re.match(r"\s*[+-]?[0-9]+", max_depth)
    depth = int(number[0]) if number else 0
    return Options(globs_, depth if depth > 0 else None, follow_symlinks)


@dataclass
class _Tree:
    path: str
    depth: int
    #: (dev, inode) of the folders above, to see loops of links.
    above: frozenset = field(default_factory=frozenset)


@dataclass
class Wanted:
    """Which rows are asked for: down to a depth, of some types (None: all), whose path starts with each of some texts; and whether with what only a
    stat call tells."""

    deepest: int | None = None
    kinds: frozenset[str] | None = None
    starts: tuple[str, ...] = ()
    sized: bool = True

    def row(self, row: tuple) -> bool:
        return (self.deepest is None or row[3] <= self.deepest) and (self.kinds is None or row[4] in self.kinds) and all(row[1].startswith(x) for x in self.starts)

    def near(self, path: str) -> bool:
        """Whether path or something below it may start as asked."""
        return all(path.startswith(x) or x.startswith(path.rstrip("/") + "/") for x in self.starts)

    def asks(self) -> bool:
        """Whether entries have to be asked for more than their type."""
        return self.kinds is not None and "error" in self.kinds or self.sized and (self.kinds is None or bool(self.kinds & {"file", "special"}))


def shown(path: str) -> str:
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Walk:
    def __init__(self, root: str, options: Options, wanted: Wanted | None = None):
        self.root, self.options, self.exclude = root, options, globs.compile_python(list(options.exclude))
        self.wanted = wanted or Wanted()

    def _row(self, path: str, depth: int, kind: str, s: os.stat_result | None = None, error: str | None = None) -> tuple:
        sizes = (allocated(s), s.st_size, s.st_dev, s.st_ino, s.st_nlink) if s is not None and kind in ("file", "special") else (None,) * 5
        signed = lambda x: x if x is None or x < 1 << 63 else x - (1 << 64)
        return (self.root, shown(path), os.fsencode(path), depth, kind, sizes[0], sizes[1], signed(sizes[2]), signed(sizes[3]), sizes[4], error)

    def _over(self, tree: _Tree) -> bool:
        o = self.options
        return o.max_depth is not None and tree.depth >= o.max_depth or bool(o.token) and os.path.exists(o.token)

    def folder(self, tree: _Tree) -> tuple[list[tuple], list[_Tree]]:
        """(rows, folders to walk) of one folder."""
        rows, deeper = self._folder(tree)
        return [r for r in rows if self.wanted.row(r)], deeper

    def _folder(self, tree: _Tree) -> tuple[list[tuple], list[_Tree]]:
        rows, deeper, o, asks = [], [], self.options, self.wanted.asks()
        if self._over(tree):
            return rows, deeper
        try:
            with os.scandir(tree.path) as found:
                # Of a folder at the last depth that is asked for only whether it can be read matters.
                last = self.wanted.deepest is not None and tree.depth >= self.wanted.deepest
                entries = [] if last else sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [self._row(tree.path, tree.depth, "error", error=str(e))], deeper
        depth = tree.depth + 1
        for e in entries:
            if globs.is_excluded(e.path, self.exclude) or self.wanted.starts and not self.wanted.near(shown(e.path)):
                continue
            try:
                linked = e.is_symlink()
                if linked and not o.follow_symlinks:
                    if o.include_special:
                        rows.append(self._row(e.path, depth, "special", e.stat(follow_symlinks=False) if asks else None))
                    continue
                # Links and, where they may be loops, folders are always asked for.
                s = e.stat(follow_symlinks=linked) if asks or linked or o.follow_symlinks and e.is_dir() else None
                folder, file = (e.is_dir(), e.is_file()) if s is None else (stat.S_ISDIR(s.st_mode), stat.S_ISREG(s.st_mode))
            except OSError as x:
                rows.append(self._row(e.path, depth, "error", error=str(x)))
                continue
            if folder:
                own = (s.st_dev, s.st_ino) if o.follow_symlinks else None
                if own in tree.above:
                    rows.append(self._row(e.path, depth, "error", error="a loop of links"))
                    continue
                rows.append(self._row(e.path, depth, "dir"))
                deeper.append(_Tree(e.path, depth, tree.above | {own} if o.follow_symlinks else tree.above))
            elif file:
                rows.append(self._row(e.path, depth, "file", s))
            elif o.include_special:
                rows.append(self._row(e.path, depth, "special", s))
        return rows, deeper

    def folders(self, tree: _Tree) -> list[_Tree]:
        """The folders in one folder that folder() would give to walk, without a row for anything else."""
        found, o = [], self.options
        if self._over(tree) or self.wanted.deepest is not None and tree.depth >= self.wanted.deepest:
            return found
        try:
            with os.scandir(tree.path) as entries:
                for e in entries:
                    if not e.is_dir(follow_symlinks=o.follow_symlinks) or globs.is_excluded(e.path, self.exclude) or not self.wanted.near(shown(e.path)):
                        continue
                    above = tree.above
                    if o.follow_symlinks:
                        s = e.stat()
                        if (s.st_dev, s.st_ino) in above:
                            continue
                        above |= {(s.st_dev, s.st_ino)}
                    found.append(_Tree(e.path, tree.depth + 1, above))
        except OSError:  # the task that lists it reports that
            pass
        return sorted(found, key=lambda t: t.path)

    def start(self) -> _Tree:
        above = frozenset()
        if self.options.follow_symlinks:
            s = os.stat(self.root)
            above = frozenset({(s.st_dev, s.st_ino)})
        return _Tree(self.root, 0, above)

    def all(self, trees: list[_Tree]) -> Iterator[tuple]:
        waiting = list(trees)
        while waiting:
            rows, deeper = self.folder(waiting.pop())
            yield from rows
            waiting += deeper


@dataclass
class _Part(InputPartition):
    #: Folders to walk whole, and folders of which only the direct entries are listed here.
    trees: list[_Tree]
    upper: list[_Tree]


class _Reader(DataSourceReader):
    def __init__(self, root: str, options: Options, tasks: int, columns: list[str] = SCHEMA.names):
        self.root, self.options, self.tasks = root, options, tasks
        self.places = [SCHEMA.names.index(c) for c in columns]
        self.wanted = Wanted(sized=bool(OF_STAT & set(columns)))

    def partitions(self) -> list[_Part]:
        walk = Walk(self.root, self.options, self.wanted)
        upper, level = [], [walk.start()]
        while level and len(level) < SUBTREES * self.tasks:  # a whole level at a time, breadth first
            upper += level
            level = [below for tree in level for below in walk.folders(tree)]
        deal = lambda trees, k: trees[k :: self.tasks]
        return [p for p in (_Part(deal(level, k), deal(upper, k)) for k in range(self.tasks)) if p.trees or p.upper] or [_Part([], [])]

    def read(self, part: _Part) -> Iterator[tuple]:
        tally, walk = Tally(self.options.tallies), Walk(self.root, self.options, self.wanted)
        for row in chain(chain.from_iterable(walk.folder(t)[0] for t in part.upper), walk.all(part.trees)):
            if row[4] == "file":
                tally.add(row[5] or 0)
            yield tuple(row[k] for k in self.places)
        tally.tell()


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions that are met in full here are not given back; an equal depth or path bounds the walk and is left to Spark as well."""
        w = self.wanted
        for f in filters:
            match f:
                case LessThanOrEqual(("depth",), int(v)):
                    w.deepest = v if w.deepest is None else min(v, w.deepest)
                case LessThan(("depth",), int(v)):
                    w.deepest = v - 1 if w.deepest is None else min(v - 1, w.deepest)
                case EqualTo(("entry_type",), str(v)):
                    w.kinds = frozenset({v}) & (w.kinds if w.kinds is not None else {v})
                case In(("entry_type",), tuple(vs)):
                    w.kinds = frozenset(vs) & (w.kinds if w.kinds is not None else frozenset(vs))
                case StringStartsWith(("path",), str(v)):
                    w.starts += (v,)
                case IsNotNull(("root" | "path" | "depth" | "entry_type",)):
                    pass
                case EqualTo(("depth",), int(v)):
                    w.deepest = v if w.deepest is None else min(v, w.deepest)
                    yield f
                case EqualTo(("path",), str(v)):
                    w.starts += (v,)
                    yield f
                case _:
                    yield f


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c] or SCHEMA.names

    def schema(self):
        return T.StructType([SCHEMA[c] for c in self._columns()])

    def reader(self, schema) -> _Reader:
        o = self.options
        true = lambda k: o.get(k, "false").lower() == "true"
        depth = o.get("max_depth")
        options = Options(tuple(x for x in o.get("exclude", "").split("\n") if x), int(depth) if depth not in (None, "") else None, true("follow_symlinks"), true("include_special"), o.get("token") or None, o.get("tallies") or None)
        root = o["path"]
        if not os.path.isdir(root):
            raise NotADirectoryError(f"not a directory: {root}")
        return (_PushedReader if true("push") else _Reader)(root, options, int(o.get("tasks", "8")), self._columns())


def read(spark: SparkSession, root: str, options: Options = Options(), columns: tuple[str, ...] = ()) -> DataFrame:
    """The inventory of a directory tree, or some columns of it. NotADirectoryError if root is none.

    Spark tells a Python source no columns, so they are named here; conditions it tells where the session sets spark.sql.python.filterPushdown.enabled.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    ship(spark)
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("path", root).option("exclude", "\n".join(options.exclude)).option("tasks", str(max(2, spark.sparkContext.defaultParallelism)))
    reader = reader.option("columns", ",".join(columns)).option("push", spark.conf.get(PUSHDOWN, "false"))
    if options.max_depth is not None:
        reader = reader.option("max_depth", str(options.max_depth))
    for name in ("token", "tallies"):
        if getattr(options, name):
            reader = reader.option(name, getattr(options, name))
    return reader.option("follow_symlinks", str(options.follow_symlinks)).option("include_special", str(options.include_special)).load()
