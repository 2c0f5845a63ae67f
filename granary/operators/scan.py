"""Where the space went: totals, sub-folders, largest files.

Sizes are allocated bytes; hard links count each time. Every result is one aggregation that combines before its shuffle, or a top k
that keeps k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import globs, paths


def select(inventory: DataFrame, exclude: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """The entries that a walk with these options would have seen."""
    out = inventory if max_depth is None else inventory.filter(F.col("depth") <= max_depth)
    return out.filter(~globs.excluded(F.col("path"), exclude)) if exclude else out


def files(inventory: DataFrame) -> DataFrame:
    return inventory.filter("entry_type = 'file'")


def totals(inventory: DataFrame) -> DataFrame:
    """One row: total_size, total_files, total_dirs, skipped, root_files_size, root_files_count."""
    kind = F.col("entry_type")
    loose = (kind == "file") & (F.col("depth") == 1)
    total = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("size"))), F.lit(0)).alias(name)
    return inventory.agg(
        total(kind == "file", "total_size"),
        F.count_if(kind == "file").alias("total_files"),
        F.count_if((kind == "dir") & (F.col("depth") > 0)).alias("total_dirs"),
        F.count_if(kind == "error").alias("skipped"),
        total(loose, "root_files_size"),
        F.count_if(loose).alias("root_files_count"),
    )


def folder_count(inventory: DataFrame, root: str) -> DataFrame:
    """One row, total_dirs: the folders below root that files of a table imply (its own folders aren't entries)."""
    below = paths.relative(F.col("path"), root)
    folders = files(inventory).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(below) - 1), lambda i: F.array_join(F.slice(below, 1, i), "/"))).alias("folder")).filter(F.size(below) > 1)
    return folders.distinct().agg(F.count("*").alias("total_dirs"))


def implied_folders(inventory: DataFrame, root: str) -> DataFrame:
    """(path, depth): the distinct folders below root that the paths of files imply, without root."""
    below = paths.relative(F.col("path"), root)
    several = files(inventory).select(below.alias("below")).filter(F.size("below") > 1)
    prefix = root.rstrip("/") + "/"
    each = several.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("below") - 1), lambda i: F.array_join(F.slice(F.col("below"), 1, i), "/"))).alias("k", "p"))
    return each.select(F.concat(F.lit(prefix), "p").alias("path"), (F.col("k") + 1).alias("depth")).distinct()


def children(inventory: DataFrame, root: str, top: int | None = None) -> DataFrame:
    """(path, size, file_count): direct sub-folders of root with all files below them, largest first, ties by path."""
    found = files(inventory).select(paths.child(F.col("path"), root).alias("path"), "size").filter("path is not null")
    found = found.groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("file_count")).orderBy(F.desc("size"), "path")
    return found if top is None else found.limit(top)


def top_files(inventory: DataFrame, top: int) -> DataFrame:
    """(path, size, logical_size): the largest files, ties by path."""
    return files(inventory).select("path", "size", "logical_size").orderBy(F.desc("size"), "path").limit(top)


def top_files_per_child(inventory: DataFrame, root: str, top: int) -> DataFrame:
    """(child, rank, path, size): the largest files of each sub-folder. Tasks keep `top` rows per folder before the shuffle."""
    of = files(inventory).select(paths.child(F.col("path"), root).alias("child"), "path", "size").filter("child is not null")
    rank = F.row_number().over(Window.partitionBy("child").orderBy(F.desc("size"), "path"))
    return of.withColumn("rank", rank).filter(F.col("rank") <= top).select("child", "rank", "path", "size")


def page(df: DataFrame, start: int, count: int, *order: Column | str) -> DataFrame:
    """Rows start to start + count of df in an order: what a scrolled list shows."""
    return df.orderBy(*order).offset(start).limit(count)


def report(inventory: DataFrame, root: str, top: int, disk: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row with all of a scan: root, totals, children, top_files (largest first), disk_total, disk_free."""
    part = lambda df, name, *fields: df.select(F.lit(name).alias("part"), F.struct((-F.col("size")).alias("k"), *fields).alias(name))
    rows = totals(inventory).withColumn("part", F.lit("totals"))
    rows = rows.unionByName(part(children(inventory, root, top), "c", "path", "size", "file_count"), allowMissingColumns=True)
    rows = rows.unionByName(part(top_files(inventory, top), "f", "path", "size", "logical_size"), allowMissingColumns=True)
    one = lambda name: F.max(name).alias(name)
    listed = lambda c, name, *fields: F.transform(F.sort_array(F.collect_list(c)), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name)
    # At most 2 * top + 1 rows come together here.
    return rows.agg(
        F.lit(root).alias("root"),
        *map(one, ("total_size", "total_files", "total_dirs", "skipped")),
        listed("c", "children", "path", "size", "file_count"),
        *map(one, ("root_files_size", "root_files_count")),
        listed("f", "top_files", "path", "size", "logical_size"),
        F.lit(disk[0]).cast("long").alias("disk_total"),
        F.lit(disk[1]).cast("long").alias("disk_free"),
    )
