"""The walk in rounds against the data source, on uneven trees."""

import os

import pytest
from pyspark.sql import functions as F

from granary.sources import file_tree, frontier
from granary.sources.file_tree import Options


def chain_and_bush(root):
    at = root
    for k in range(60):  # a chain, with a file at each link
        at = at / f"c{k}"
        at.mkdir(parents=True)
        (at / "f.bin").write_bytes(b"x" * k)
    for k in range(40):
        bush = root / "bush" / f"b{k % 5}" / f"d{k}"
        bush.mkdir(parents=True)
        for j in range(5):
            (bush / f"{j}.{'tmp' if j == 4 else 'txt'}").write_bytes(b"y" * j)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "h").write_bytes(b"h")
    os.symlink(root / "bush", root / ".hidden" / "link")
    os.symlink(root, root / "bush" / "loop")
    os.symlink(root / "gone", root / "dangling")


def rows(df):
    return sorted((tuple(r) for r in df.select("path", "path_raw", "depth", "entry_type", "size", "logical_size", "dev", "inode", "nlink").collect()), key=str)


@pytest.mark.parametrize("options", [Options(), Options(exclude=("*.tmp", "b3")), Options(max_depth=7), Options(follow_symlinks=True), Options(include_special=True)])
def test_equals_the_data_source(spark, tmp_path, monkeypatch, options):
    chain_and_bush(tmp_path)
    monkeypatch.setattr(frontier, "CHUNK", 3)
    want = rows(file_tree.read(spark, str(tmp_path), options))
    for first, share in ((7, 30), (frontier.FIRST, frontier.SHARE)):
        found, let_go = frontier.walk(spark, str(tmp_path), options, first, share)
        assert rows(found) == want
        let_go()


def test_a_flat_folder_is_many_tasks(spark, tmp_path):
    for k in range(12_000):
        (tmp_path / f"f{k}").touch()
    found, let_go = frontier.walk(spark, str(tmp_path))
    by_task = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert sum(by_task) == 12_000 and len(by_task) >= 4 and max(by_task) <= 3 * frontier.CHUNK
    let_go()
    assert frontier.walk(spark, str(tmp_path), Options(token=str(tmp_path / "f1")))[0].count() == 0


def test_names_that_are_no_text_and_no_folder(spark, tmp_path):
    name = os.fsencode(tmp_path) + b"/\xff\xfe"
    open(name, "wb").close()
    found, let_go = frontier.walk(spark, str(tmp_path))
    assert [bytes(r["path_raw"]) for r in found.collect()] == [name]
    let_go()
    with pytest.raises(NotADirectoryError):
        frontier.walk(spark, str(tmp_path / "none"))
