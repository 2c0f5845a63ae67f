"""What is pushed into the walk: the same rows as a filter of the whole walk gives, and fewer folders and entries looked at."""

import os

import pytest
from pyspark.sql import functions as F

from granary.sources import file_tree
from granary.sources.file_tree import Options, Walk, Wanted


@pytest.fixture
def tree(tmp_path):
    for name in ("a/1", "a/b/2", "a/b/c/3", "ab/4", "d/e/5", "6"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "a/loop")
    os.mkfifo(tmp_path / "d/pipe")
    return str(tmp_path)


@pytest.fixture
def pushing(spark):
    spark.conf.set(file_tree.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(file_tree.PUSHDOWN)


def rows(df):
    return sorted(map(tuple, df.select("path", "depth", "entry_type", "size", "inode").collect()), key=str)


CONDITIONS = [
    "depth <= 2", "depth < 2", "depth = 2", "depth <= 0", "entry_type = 'dir'", "entry_type = 'file'", "entry_type in ('error', 'special')",
    "entry_type = 'dir' and entry_type = 'file'", "startswith(path, '{0}/a')", "startswith(path, '{0}/a/b')", "path = '{0}/a/b/2'", "startswith(path, '{0}/d') and depth <= 2 and entry_type = 'dir'",
    "depth <= 2 or entry_type = 'file'", "logical_size > 3", "startswith(path, '/nowhere')", "startswith(path, '')", "depth is not null",
]


@pytest.mark.parametrize("options", [Options(), Options(follow_symlinks=True, include_special=True)])
def test_the_same_rows(spark, tree, options):
    whole = file_tree.read(spark, tree, options).persist()
    whole.count()
    spark.conf.set(file_tree.PUSHDOWN, "true")
    try:
        for condition in CONDITIONS:
            condition = condition.format(tree)
            assert rows(file_tree.read(spark, tree, options).filter(condition)) == rows(whole.filter(condition)), condition
    finally:
        spark.conf.unset(file_tree.PUSHDOWN)
        whole.unpersist()


def test_what_is_pushed_is_no_filter_of_the_plan(pushing, tree):
    def left(condition):
        plan = file_tree.read(pushing, tree).filter(condition)._jdf.queryExecution().executedPlan().toString()
        return "Filter (" in plan

    assert not left((F.col("depth") <= 2) & (F.col("entry_type") == "dir") & F.col("path").startswith(tree))
    assert left(F.col("logical_size") > 3) and left(F.col("path") == tree)


class Entry:
    """An entry that counts what it is asked."""

    def __init__(self, entry, asked):
        self.entry, self.asked, self.name, self.path = entry, asked, entry.name, entry.path

    def __getattr__(self, name):
        return getattr(self.entry, name)

    def stat(self, **how):
        self.asked.append(self.path)
        return self.entry.stat(**how)


@pytest.fixture
def counted(monkeypatch):
    real, asked, opened = os.scandir, [], []

    class Scan:
        def __init__(self, path):
            opened.append(path)
            self.found = real(path)

        def __enter__(self):
            return (Entry(e, asked) for e in self.found)

        def __exit__(self, *_):
            self.found.close()

    monkeypatch.setattr(os, "scandir", Scan)
    return asked, opened


def walked(tree, wanted, options=Options()):
    walk = Walk(tree, options, wanted)
    return sorted(os.path.relpath(r[1], tree) for r in walk.all([walk.start()]))


def test_no_entry_is_asked_where_only_names_are_wanted(tree, counted):
    asked, _ = counted
    everything = walked(tree, Wanted())
    assert len(asked) >= 11
    asked.clear()
    assert walked(tree, Wanted(sized=False)) == everything and not asked
    assert walked(tree, Wanted(kinds=frozenset({"dir"}))) == ["a", "a/b", "a/b/c", "ab", "d", "d/e"] and not asked
    walked(tree, Wanted(kinds=frozenset({"error"}), sized=False))
    assert asked


def test_folders_that_cannot_hold_a_row_are_not_opened(tree, counted):
    _, opened = counted
    assert walked(tree, Wanted(starts=(f"{tree}/a/b",))) == ["a/b", "a/b/2", "a/b/c", "a/b/c/3"]
    assert sorted(os.path.relpath(p, tree) for p in opened) == [".", "a", "a/b", "a/b/c"]
    opened.clear()
    assert walked(tree, Wanted(deepest=1)) == ["6", "a", "ab", "d"]
    assert sorted(os.path.relpath(p, tree) for p in opened) == [".", "a", "ab", "d"]


def test_some_columns(spark, tree):
    some = file_tree.read(spark, tree, columns=("path", "depth"))
    assert some.columns == ["path", "depth"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, file_tree.read(spark, tree).select("path", "depth").collect()))
    with pytest.raises(Exception):
        file_tree.read(spark, tree, columns=("none",)).collect()
