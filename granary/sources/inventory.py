"""The inventory: one row per entry, whatever it was made from.

root, path, depth, entry_type (file, dir, special, error), size (allocated bytes), logical_size (content bytes), dev and inode (null:
unknown), content (null for files that are read by path).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import paths

BLOCK = 4096
SCHEMA = T.StructType(
    [
        T.StructField("root", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("path_raw", T.BinaryType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("entry_type", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("logical_size", T.LongType()),
        T.StructField("dev", T.LongType()),
        T.StructField("inode", T.LongType()),
        T.StructField("nlink", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def from_table(df: DataFrame, root: str, path: Column, content: Column | None, dev: Column | None = None, inode: Column | None = None) -> DataFrame:
    """Files of a table: a path and a content per row; allocated sizes are whole blocks. Rows of a null path are left out.

    Without content, df has the columns logical_size and digest (see digested()), and the inventory a column digest in place of content.
    """
    data = F.col("digest") if content is None else F.coalesce(content.cast("binary"), F.lit(b""))
    length = F.col("logical_size") if content is None else F.octet_length(data).cast("long")
    return df.select(
        F.lit(root).alias("root"),
        path.alias("path"),
        paths.depth(path, root).alias("depth"),
        F.lit("file").alias("entry_type"),
        (F.ceil(length / BLOCK) * BLOCK).cast("long").alias("size"),
        length.alias("logical_size"),
        (F.lit(None) if dev is None else dev).cast("long").alias("dev"),
        (F.lit(None) if inode is None else inode).cast("long").alias("inode"),
        data.alias("digest" if content is None else "content"),
    ).filter(F.col("path").isNotNull())


def digested(df: DataFrame, content: str) -> DataFrame:
    """df with logical_size and digest (SHA-256, hexadecimal) of a column in place of it, taken where rows are read: what follows can shuffle them."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.withColumn("logical_size", F.octet_length(data).cast("long")).withColumn("digest", F.sha2(data, 256)).drop(content)


def corpus(spark: SparkSession, sf_dir: str, identity: bool = False) -> DataFrame:
    """The tables documents and benchmark as files below /corpus.

    identity: every third document is a hard link of the first document of the same text, which joins on a digest of the text; the inventory then
    has digests in place of contents, so that no text is shuffled. Else each row has an inode of its own.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    inode, content = F.col("doc_id"), F.col("text")
    if identity:
        docs, items, content = digested(docs, "text"), digested(items, "text"), None
        first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
        docs = docs.join(first, "digest", "left")
        inode = F.when(F.col("doc_id") % 3 == 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    files = from_table(docs, "/corpus", path, content, F.lit(1), inode)
    path = F.concat(F.lit("/corpus/item_"), F.lpad(F.col("item_id").cast("string"), 8, "0"), F.lit(".txt"))
    return files.unionByName(from_table(items, "/corpus", path, content, F.lit(1), F.col("item_id") + 1_000_000_000))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table pages as files below /: scheme, query and fragment of the url are left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace(F.col("url"), r"\A[^:/]*://", ""), r"[?#].*\z", "")
    return from_table(pages, "/", F.concat(F.lit("/"), bare), F.col("html"), F.lit(1), F.col("page_id"))


def below(inventory: DataFrame, root: str) -> DataFrame:
    """The entries strictly below another root: drilling in filters, it doesn't walk again."""
    return inventory.filter(paths.under(F.col("path"), root)).withColumn("root", F.lit(root)).withColumn("depth", paths.depth(F.col("path"), root))


def keep(inventory: DataFrame, folder: str | None = None) -> tuple[DataFrame, Callable[[], object]]:
    """(inventory as it is now, what lets go of it): written once to the shared folder (by default what spark.checkpoint.dir names), so that a lost
    executor doesn't walk again a tree that may have changed; where none is named, kept by this application."""
    spark = inventory.sparkSession
    folder = folder or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = inventory.persist()
        held.count()
        return held, held.unpersist
    path = f"{folder}/inventory-{uuid.uuid4().hex}"
    inventory.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(inventory.schema).parquet(path), lambda: where.getFileSystem(conf).delete(where, True)


def save(inventory: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A snapshot, with files of like sizes together, so that row groups can be skipped by size."""
    inventory.repartitionByRange(F.col("logical_size")).sortWithinPartitions("logical_size").write.mode(mode).parquet(path)
