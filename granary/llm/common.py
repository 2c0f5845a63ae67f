"""Shared plumbing: table access, the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.shipping import ship

#: Rows, and bytes of their columns, that may be broadcast; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24 << 20
#: Bytes that a column counts for: numbers are 8 at most, strings are ids, hosts, urls and digests.
_WIDTHS = {"string": 64, "binary": 64}

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset, as in tests, an own one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="granary-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Rows, and bytes, of a batch between the JVM and Python. Texts average kilobytes and some are far longer; Spark's own 10,000 rows make batches of
#: tens of megabytes, several of which each task holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def _number(value: str | None) -> int:
    """A number of rows, or of bytes such as 64m or 256MB; 0 if it says neither."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([kmg]?)b?\s*", (value or "").lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def map_batches(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of at most BATCH_ROWS rows and about BATCH_BYTES (a longer row is alone). Both options stay set in the
    session, as plans read them when they run; lower ones are left as they are."""
    conf = df.sparkSession.conf
    ship(df.sparkSession)
    for name, most in _BATCH.items():
        if not 0 < _number(conf.get(name, None)) <= most:
            conf.set(name, most)
    return df.mapInArrow(tidied(f), schema)


def give_back() -> None:
    """Return what Python, Arrow and the C library hold but don't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(f):
    """f, giving memory back when a task ends: the worker process lives on, and other operators' tasks follow in it."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    file = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _folders.append(file.get())
        done.written_to = file.get()
    return done


#: Folders that operators of this process have written, in order.
_folders: list[str] = []


def own_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder; discard() removes what was made there."""
    _folders.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _folders[-1]


def mark() -> int:
    """Where discard() may start: folders that are made from here on."""
    return len(_folders)


def discard(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Remove the folders that were written since a mark, once what was read from them has been used; but not those of the DataFrames to keep.

    Operators do so with what only led to their results. The rest a result reads from lazily: call it when the result has been used.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = [df.written_to for df in keep]
    for folder in _folders[since:]:
        if folder not in kept:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    _folders[since:] = kept


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: a cut in the lineage that keeps columns prunable."""
    path = own_folder(df.sparkSession, what)
    df.write.parquet(path)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done.written_to = path
    return done


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows of at most BROADCAST_BYTES together, else df as it is (the join then shuffles)."""
    width = sum(_WIDTHS.get(f.dataType.typeName(), 8) for f in df.schema.fields)
    return F.broadcast(df) if df.count() <= min(max_rows, BROADCAST_BYTES // width) else df


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id is not in ids (a null id is never in it)."""
    gone = checked_broadcast(ids.select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys, with one of its texts (the least by a hash): a repeated id is no more of a sample than another."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    return rows.groupBy(*keys).agg(least).select(*keys, "t.text")
