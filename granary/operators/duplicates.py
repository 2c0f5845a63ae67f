"""What is stored twice: files of equal content, hard links apart.

Work narrows step by step: lengths that occur once are out before any content is read; hard links of one file count once; a digest of
the first block, then one of all, decides. Contents never enter a shuffle: digests are taken where a row is read. members() is the
relation to work on; groups() adds the paths of a group as an array for display.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import blake3, paths
from granary.shipping import ship

PREFIX = 4096
SALTS = 16
LARGEST = 9_223_372_036_854_775_807
#: Distinct lengths (8 bytes each) that may be broadcast to restrict a scan; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def at_least(inventory: DataFrame, min_size: int = 1) -> DataFrame:
    """Files of at least min_size bytes; empty files are never duplicates."""
    return inventory.filter((F.col("entry_type") == "file") & (F.col("logical_size") >= min_size) & (F.col("logical_size") > 0))


def size_buckets(inventory: DataFrame, min_size: int = 1) -> DataFrame:
    """(logical_size, n): lengths that more than one file has."""
    return at_least(inventory, min_size).groupBy("logical_size").agg(F.count("*").alias("n")).filter("n > 1")


def candidates(inventory: DataFrame, *columns: Column | str, min_size: int = 1) -> DataFrame:
    """logical_size and the given columns of the files whose length another file has too. The first pass reads lengths only.

    Where the lengths are few they are broadcast, and columns (such as digests of the content) are computed of candidates only; else columns are
    computed first, so that the join shuffles them and never what they are computed from.
    """
    files, lengths = at_least(inventory, min_size), size_buckets(inventory, min_size).select("logical_size")
    if lengths.count() <= BROADCAST_ROWS:
        return files.join(F.broadcast(lengths), "logical_size", "left_semi").select("logical_size", *columns)
    return files.select("logical_size", *columns).join(lengths, "logical_size", "left_semi")


def without_hard_links(files: DataFrame, *carried: str) -> DataFrame:
    """One path, the first in component order, per file identity and length; files of unknown identity all stay."""
    known = F.col("dev").isNotNull() & F.col("inode").isNotNull()
    own = F.when(known, F.struct(F.col("dev"), F.col("inode"), F.lit(None).cast("string").alias("p"))).otherwise(F.struct(F.lit(None).cast("long").alias("dev"), F.lit(None).cast("long").alias("inode"), F.col("path").alias("p")))
    first = F.min_by(F.struct("path", *carried), paths.sort_key(F.col("path")))
    return files.groupBy("logical_size", own.alias("own")).agg(first.alias("f")).select("logical_size", "f.*")


def prefix_digest(content: Column) -> Column:
    return F.sha2(F.substring(content, 1, PREFIX), 256)


def _digest_files(prefix_only: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path_raw").to_pylist():
                try:
                    with open(path, "rb") as f:
                        if kind == "blake3":
                            found.append(blake3.digests([f.read(PREFIX) if prefix_only else f.read()])[0])
                        else:
                            found.append(hashlib.sha256(f.read(PREFIX)).hexdigest() if prefix_only else hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:  # a file that can't be read is no duplicate
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "digest"])

    return run


def _width(df: DataFrame) -> int:
    """Tasks that files are dealt to: given as a number, as adaptive execution would join tasks of a few names, whatever the files hold."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _read_and_digest(files: DataFrame, prefix_only: bool, kind: str = "sha256") -> DataFrame:
    """files with the digest of their content, read by path where the task runs; dealt by path, so that one frequent length is many tasks."""
    ship(files.sparkSession)
    schema = T.StructType([*files.schema.fields, T.StructField("digest", T.StringType())])
    return files.repartition(_width(files), F.col("path")).mapInArrow(_digest_files(prefix_only, kind), schema).filter("digest is not null")


def file_blocks(files: DataFrame) -> DataFrame:
    """(logical_size, path, path_raw, block): a row for each block of a file, dealt by path and block, so that one large file is many tasks."""
    last = F.floor((F.greatest(F.col("logical_size"), F.lit(1)) - 1) / blake3.BLOCK_BYTES)
    return files.select("logical_size", "path", "path_raw", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition(_width(files), F.col("path"), F.col("block"))


def block_digests(files: DataFrame) -> DataFrame:
    """(logical_size, path, path_raw, digest) of files of more than one block: each block is hashed as a sub-tree of its file, and a file's values, of 32
    bytes each, are merged in order. A file that can't be read, or is shorter now, has no row."""
    ship(files.sparkSession)
    size = blake3.BLOCK_BYTES

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, length, block in zip(batch.column("path_raw").to_pylist(), batch.column("logical_size").to_pylist(), batch.column("block").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        f.seek(block * size)
                        data = f.read(min(size, length - block * size))
                except OSError:
                    data = b""
                found.append(blake3.subtree(data, block * size) if len(data) == min(size, length - block * size) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "value"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if any(v is None for v in values) else blake3.merged(values) for values in batch.column("values").to_pylist()]
            kept = ["logical_size", "path", "path_raw"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "digest"])

    blocks = file_blocks(files)
    schema = T.StructType([*blocks.schema.fields, T.StructField("value", T.BinaryType())])
    values = blocks.mapInArrow(hashed, schema).groupBy("logical_size", "path", "path_raw")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"])
    out = T.StructType([blocks.schema["logical_size"], blocks.schema["path"], blocks.schema["path_raw"], T.StructField("digest", T.StringType())])
    return values.agg(ordered.alias("values")).mapInArrow(joined, out).filter("digest is not null")


def members(inventory: DataFrame, min_size: int = 1, collapse_links: bool = True, held: list[DataFrame] | None = None, digest: str = "sha256") -> DataFrame:
    """(hash, size, path, keep, n, wasted): each file that has an equal one. keep: the first path of its group in component order.

    An inventory with a column digest (SHA-256, hexadecimal) is taken by it, one with a column content is hashed from that, another one by reading
    the files, each at most once: what was read is persisted, and put in held for the caller to unpersist. Equal digests of 256 bits count as
    equal content.
    """

    def once(df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        if held is not None:
            held.append(df)
        return df

    if {"digest", "content"} & set(inventory.columns):
        ready = F.col("digest") if "digest" in inventory.columns else F.sha2("content", 256)
        narrow = candidates(inventory, "path", "dev", "inode", ready.alias("hash"), min_size=min_size)
        hashed = without_hard_links(narrow, "hash") if collapse_links else narrow.select("logical_size", "path", "hash")
    else:
        # Files are opened by the bytes of their path, which need not be text.
        narrow = candidates(inventory, "path", F.coalesce("path_raw", F.col("path").cast("binary")).alias("path_raw"), "dev", "inode", min_size=min_size)
        single = without_hard_links(narrow, "path_raw") if collapse_links else narrow.drop("dev", "inode")
        started = once(_read_and_digest(single, True, digest).withColumnRenamed("digest", "prefix"))
        again = started.groupBy("logical_size", "prefix").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
        left = started.join(again, ["logical_size", "prefix"], "left_semi")
        # A file of at most one block is its prefix.
        small = left.filter(F.col("logical_size") <= PREFIX).select("logical_size", "path", F.col("prefix").alias("hash"))
        rest = left.filter(F.col("logical_size") > PREFIX).drop("prefix")
        whole = rest if digest != "blake3" else rest.filter(F.col("logical_size") <= blake3.BLOCK_BYTES)
        large = _read_and_digest(whole, False, digest).select("logical_size", "path", F.col("digest").alias("hash"))
        if digest == "blake3":
            large = large.unionByName(block_digests(rest.filter(F.col("logical_size") > blake3.BLOCK_BYTES).select("logical_size", "path", "path_raw")).select("logical_size", "path", F.col("digest").alias("hash")))
        large = once(large)
        hashed = small.unionByName(large)
    # Counting and joining both start from this exchange, so contents of tables are hashed once; the third column spreads a large group.
    hashed = hashed.repartition(F.col("logical_size"), F.col("hash"), F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    key = ["logical_size", "hash"]
    found = hashed.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("path", paths.sort_key(F.col("path"))).alias("keep")).filter("n > 1")
    wasted = F.coalesce(F.try_multiply(F.col("logical_size"), F.col("n") - 1), F.lit(LARGEST))
    return hashed.join(found, key).select("hash", F.col("logical_size").alias("size"), "path", "keep", "n", wasted.alias("wasted"))


def summaries(found: DataFrame) -> DataFrame:
    """(hash, size, n, keep, wasted): a row per group of members()."""
    return found.filter("path = keep").select("hash", "size", "n", "keep", "wasted").dropDuplicates(["hash", "size"])


def groups(found: DataFrame) -> DataFrame:
    """(hash, size, files, wasted): a row per group with its paths in component order, most wasted first, ties by the first path."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(paths.sort_key(F.col("path")).alias("k"), "path"))), lambda x: x["path"])
    return found.groupBy("hash", "size").agg(ordered.alias("files"), F.first("wasted").alias("wasted")).orderBy(F.desc("wasted"), paths.sort_key(F.get("files", F.lit(0)))).select("hash", "size", "files", "wasted")


def total(found: DataFrame) -> DataFrame:
    """One row: n, the groups, and wasted, the sum over them."""
    return summaries(found).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("wasted").cast("decimal(38,0)")), F.lit(0)).alias("wasted"))


def listed(found: DataFrame) -> DataFrame:
    """(hash, size, path, n, wasted): the rows of members() as a list shows them, most wasted first, ties by the first path, paths of a group in component
    order. A sort of all rows by range: a group may be larger than a task holds, and no array is made of it."""
    order = (F.desc("wasted"), paths.sort_key(F.col("keep")), F.col("hash"), F.col("size"), paths.sort_key(F.col("path")))
    return found.orderBy(*order).select("hash", "size", "path", "n", "wasted")


def prefix_buckets(inventory: DataFrame, min_size: int = 1) -> DataFrame:
    """(logical_size, prefix, n): lengths and first blocks that more than one file of a table-backed inventory has."""
    some = candidates(inventory, prefix_digest(F.col("content")).alias("prefix"), min_size=min_size)
    return some.groupBy("logical_size", "prefix").agg(F.count("*").alias("n")).filter("n > 1")


ORDERS = {"wasted": "wasted", "size": "size", "count": "n"}


def shown(found: DataFrame, text: str = "", by: str = "wasted", limit: int = 1000) -> DataFrame:
    """(rank, hash, size, n, keep, wasted): groups as a list shows them. text: lower-case part of some path of the group."""
    column = ORDERS[by]
    rows = summaries(found)
    if text:
        hit = found.filter(F.contains(F.lower("path"), F.lit(text.lower()))).select("hash", "size").distinct()
        rows = rows.join(hit, ["hash", "size"], "left_semi")
    top = rows.orderBy(F.desc(column), "keep").limit(limit)
    # At most `limit` rows are left to be numbered.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), "keep"))).select("rank", "hash", "size", "n", "keep", "wasted")


def keep_instead(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """members() with another path kept where overrides (hash, keep) names one of the group's."""
    chosen = overrides.select(F.col("hash").alias("h"), F.col("keep").alias("other")).dropDuplicates(["h"])
    valid = found.join(chosen, (F.col("hash") == F.col("h")) & (F.col("path") == F.col("other"))).select(F.col("hash").alias("h"), "other").distinct()
    return found.join(valid, F.col("hash") == F.col("h"), "left").withColumn("keep", F.coalesce("other", "keep")).drop("h", "other")
