"""MinHash near-dedup: ProbMinHash sketches of word shingles, banding, exact verification, components.

Each distinct shingle of a text is an element with weight 1, however often it occurs, as links are verified by sets. Its arrivals form a Poisson process of that
rate, drawn from the shingle's hash; each arrival falls on one of k registers, which keep the earliest arrival's shingle.
An element stops as soon as its next arrival is later than every register's (early termination), so a sketch takes about
n + k ln k arrivals and not n * k. Two sketches agree in a register with probability equal to the probability Jaccard
similarity of the weights, which is the plain Jaccard similarity as all weights are equal.

Stages: (1) sketch every text in a narrow pass, which emits a digest of the words, the band keys and four bits of each
register; (2) texts of the same words are one (a min() per digest, combined before the shuffle); (3) in each band bucket,
members meet the bucket's most central member, which is linear in the bucket; (4) candidate pairs are verified by the exact
Jaccard similarity of their shingle sets; (5) links are closed to classes; members of a bucket that are then still in
different classes are compared with each other too, unless their sketches agree in fewer registers than all but 3 in
100,000 pairs of the similarity do. A bucket of more than BLOCK members is compared in pairs of blocks, each a task's work of bounded size:
the same pairs as in one place, so that no result depends on how large a bucket is. No cap is set on buckets or partners.

A pair of the similarity shares one of the BANDS bands but with probability 0.00001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytehash
from granary.llm.common import checked_broadcast, discard, map_batches, mark, settle, table, without_ids, written
from granary.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 7
#: Members of a bucket that are compared with each other in one place.
BLOCK = 2048
#: Bits of each register that a document carries for the comparison of sketches.
PLANES = 4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Sketches (n x k uint64) of n weighted sets: h, weight and owner (0 to n-1) of each element. An empty set's are 0."""
    q = np.full(n * k, np.inf)
    sketch = np.zeros(n * k, np.uint64)
    left = np.arange(len(h))
    x = np.zeros(len(h))
    latest = np.full(n, np.inf)
    t = 0
    while len(left):
        block = int(max(1, min(64, 100_000 // len(left))))
        seed = mixed = bytehash.mix(h[left][:, None] + (np.arange(t + 1, t + block + 1).astype(np.uint64) * _GOLD)[None, :])
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[left][:, None]
        gap[:, 0] += x[left]
        at = np.cumsum(gap, axis=1)
        mixed = bytehash.mix(seed + _GOLD)
        register = ((mixed >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64) + owner[left][:, None] * k
        soon = at < latest[owner[left]][:, None]
        when, where = at[soon], register[soon]
        who = np.broadcast_to(h[left][:, None], at.shape)[soon]
        np.minimum.at(q, where, when)
        won = when == q[where]
        sketch[where[won]] = who[won]
        x[left] = at[:, -1]
        t += block
        latest = q.reshape(n, k).max(axis=1)
        left = left[x[left] < latest[owner[left]]]
    return sketch.reshape(n, k)


def _shingles(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts i to j: word hashes and their owner, shingle hashes and their owner."""
    buf, starts = bytehash.padded(raw, offsets, i, j)
    s, e = bytehash.words(buf)
    h = bytehash.span_hashes(buf, s, e)
    owner = np.searchsorted(starts, s, "right") - 1
    return h, owner, *bytehash.windows(h, owner, size)


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, owner) with their counts, by owner and then h."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], owner[first], np.diff(np.r_[first, len(h)])


def _sketcher(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = np.arange(1, rows + 1, dtype=np.uint64) * _GOLD
        for batch in batches:
            raw, offsets = bytehash.column_bytes(batch.column(1))
            for i, j in bytehash.groups(offsets, 1 << 19):
                n = j - i
                words, word_owner, grams, gram_owner = _shingles(raw, offsets, i, j, size)
                counts = np.bincount(word_owner, minlength=n)
                place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                digests = []
                for salt in (0x51ED270B153A4D2F, 0xD6E8FEB86659FD93):
                    acc = np.zeros(n, np.uint64)
                    np.add.at(acc, word_owner, bytehash.mix(bytehash.mix(words + np.uint64(salt)) + place.astype(np.uint64) * np.uint64(salt)))
                    digests.append(acc.view(np.int64))
                h, owner, _ = _distinct(grams, gram_owner)
                sketch = prob_minhash(h, np.ones(len(h)), owner, n, bands * rows)
                keys = bytehash.mix(sketch.reshape(n, bands, rows) + position).sum(axis=2, dtype=np.uint64)
                keys = bytehash.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)
                words64 = -(-bands * rows // 64)
                bits = np.zeros((n, PLANES, words64 * 64), np.uint8)
                for plane in range(PLANES):
                    bits[:, plane, : bands * rows] = (sketch >> np.uint64(20 + plane)) & np.uint64(1)
                bits = np.packbits(bits, axis=2).view(np.int64).reshape(n, PLANES * words64)
                full = counts > 0
                at = np.flatnonzero(full)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n).take(pa.array(at)),
                        pa.array(digests[0][full]),
                        pa.array(digests[1][full]),
                        *(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[full].ravel())) for x in (keys, bits)),
                    ],
                    names=["doc", "d1", "d2", "keys", "bits"],
                )

    return run


def _gram_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytehash.column_bytes(batch.column(1))
            for i, j in bytehash.groups(offsets):
                h, owner, _ = _distinct(*_shingles(raw, offsets, i, j, size)[2:])
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=j - i))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["doc", "grams"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity. texts: (doc, text). A set travels once for each pair that has it as a; b is the
    side that may be in many pairs, whose set meets them where they are."""
    some = checked_broadcast(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct())
    sets = map_batches(texts.join(some, "doc", "left_semi"), _gram_sets(size), T.StructType([T.StructField("doc", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType(), False))]))
    sets = written(sets, "grams")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", common.alias("c"), (F.size("ga") + F.size("gb")).alias("n")).filter(F.col("c") + 1e-9 >= similarity * (F.col("n") - F.col("c"))).select("a", "b")


def least_agreement(k: int, similarity: float) -> int:
    """Registers of k in which three bits agree, at similarity and 4 standard deviations below what is expected there."""
    p = similarity + (1 - similarity) / 2**PLANES
    return int(k * p - 4 * (k * p * (1 - p)) ** 0.5)


def _agreement(x: str, y: str, k: int):
    """Registers that agree in their PLANES bits: bits holds, plane by plane, one bit of each register."""
    words = -(-k // 64)
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    total = F.lit(0)
    for w in range(words):
        differs = None
        for plane in range(PLANES):
            d = at(x, plane * words + w).bitwiseXOR(at(y, plane * words + w))
            differs = d if differs is None else differs.bitwiseOR(d)
        total = total + F.bit_count(differs)
    return F.lit(k) - total


def _mixed(members: DataFrame, place: str) -> DataFrame:
    """(at, n): the buckets whose members are of more than one class, and how many members they have."""
    found = members.groupBy(place).agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
    return checked_broadcast(settle(found.filter("low < high").select(F.col(place).alias("at"), "n")))


def _apart(labelled: DataFrame, sketches: DataFrame, k: int, similarity: float, block: int) -> DataFrame:
    """(a, b), a < b: pairs of different classes that share a bucket and whose sketches leave the similarity open, each once.

    labelled: (key, band, doc, class). A pair is looked at in the first band that it shares, however large that bucket is: block only says in how
    many places the members of one bucket meet, not which of them do. sketches: (doc, keys, bits).
    """
    mixed = _mixed(labelled, "key")
    apart = settle(labelled.join(mixed, F.col("key") == F.col("at")).select("key", "band", "doc", "class", "n").distinct())
    docs = checked_broadcast(apart.select(F.col("doc").alias("d")).distinct())
    theirs = settle(sketches.join(docs, F.col("doc") == F.col("d"), "left_semi"))
    # Of a large bucket the members of its largest class, which need not meet each other, have the first blocks; the others have the rest.
    most = apart.filter(F.col("n") > block).groupBy("key", "class").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "class")).alias("top"))
    most = checked_broadcast(settle(most.select(F.col("key").alias("large"), "top.m", F.col("top.class").alias("main"))))
    cells = apart.join(most, F.col("key") == F.col("large"), "left").withColumn("m", F.coalesce("m", F.lit(0)))
    cells = cells.withColumn("from", F.ceil(F.col("m") / block).cast("int")).withColumn("blocks", F.col("from") + F.ceil((F.col("n") - F.col("m")) / block).cast("int"))
    dealt = lambda n: F.pmod(F.xxhash64("doc"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("class").eqNullSafe(F.col("main")), dealt(F.col("from"))).otherwise(F.col("from") + dealt(F.col("blocks") - F.col("from")))
    cells = cells.select(F.col("key").alias("cell"), F.col("band").alias("upto"), "doc", "class", "from", "blocks", own.alias("own"))
    there = (F.col("doc") == F.col("d")) & (F.get("keys", "upto") == F.col("cell"))
    cells = written(cells.join(theirs.withColumnRenamed("doc", "d"), there).drop("d"), "cells")
    # Two blocks meet in one place: the first from below, the second from above.
    one = cells.withColumn("q", F.explode(F.sequence(F.greatest("own", "from"), F.col("blocks") - 1))).withColumn("p", F.col("own")).alias("x")
    two = cells.filter(F.col("own") >= F.col("from")).withColumn("p", F.explode(F.sequence(F.lit(0), "own"))).withColumn("q", F.col("own")).alias("y")
    meet = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    unlike = ((F.col("x.p") < F.col("x.q")) | (F.col("x.doc") < F.col("y.doc"))) & (F.col("x.class") != F.col("y.class"))
    open_yet = _agreement("x.bits", "y.bits", k) >= least_agreement(k, similarity)
    first = F.expr("not exists(zip_with(slice(x.keys, 1, x.upto), slice(y.keys, 1, x.upto), (m, n) -> m = n), e -> e)")
    return one.join(two, meet & unlike & open_yet & first).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written, with a number for each row, and that column's name: rows are told apart by it, whatever ids repeat or are null."""
    row = "row"
    while row in docs.columns:
        row = f"_{row}"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _classes(texts: DataFrame, size: int, similarity: float, bands: int, rows: int, block: int) -> DataFrame:
    """(doc, d1, d2, class), written: of each row of texts (doc, text) that has a word the digest of its words and its class, the least doc of some
    row in it. doc numbers the rows."""
    since = mark()
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("keys", longs), T.StructField("bits", longs)])
    sketches = written(map_batches(texts.filter("text is not null"), _sketcher(bands, rows, size), schema), "sketches")
    # Minima are settled before they are joined: they are broadcast if they are few, and else the join can split a hot key.
    same = checked_broadcast(settle(sketches.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")))
    member = settle(sketches.select("doc", "d1", "d2").join(same, ["d1", "d2"], "left").select("doc", "d1", "d2", F.coalesce("first", "doc").alias("first")))
    kept = sketches.select("doc", "d1", "d2", "keys").join(same, ["d1", "d2"], "left").filter("first is null or doc = first")
    keys = kept.select("doc", F.posexplode("keys").alias("band", "key"))
    shared = checked_broadcast(settle(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")))
    buckets = written(keys.join(shared, "key").select("key", "band", "doc", "n"), "buckets")

    # The star's centre is the member that shares most buckets with most documents: copies of one text stand around it.
    rank = buckets.groupBy("doc").agg(F.sum("n").alias("rank"))
    centre = buckets.join(rank, "doc").groupBy("key").agg(F.max(F.struct("rank", (-F.col("doc")).alias("doc"))).alias("top")).select("key", (-F.col("top.doc")).alias("centre"))
    centre = checked_broadcast(settle(centre))
    pairs = settle(buckets.join(centre, "key").filter("doc != centre").select(F.col("doc").alias("a"), F.col("centre").alias("b")).distinct())
    links = settle(_links(pairs, texts, size, similarity))

    classes = settle(connected_components(links, "a", "b").select(F.col("node").alias("doc"), F.col("component").alias("class")))
    labelled = buckets.select("key", "band", "doc").join(checked_broadcast(classes), "doc", "left").select("key", "band", "doc", F.coalesce("class", "doc").alias("class"))
    more = _apart(labelled, sketches.select("doc", "keys", "bits"), bands * rows, similarity, block)
    met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = settle(more.join(met, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = settle(links.unionByName(_links(more, texts, size, similarity)))
        classes = settle(connected_components(links, "a", "b").select(F.col("node").alias("doc"), F.col("component").alias("class")))
    found = member.join(checked_broadcast(classes.withColumnRenamed("doc", "first")), "first", "left").select("doc", "d1", "d2", F.coalesce("class", "first").alias("class"))
    found = written(found, "classes")
    discard(texts.sparkSession, since, keep=(found,))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, class_id): one row per row of docs; class_id is the least id of its class of near duplicates.

    Two texts are linked if the sets of their `size`-word shingles have a Jaccard similarity of at least `similarity`
    (a text of fewer words has one shingle, all of it); classes are the components of the links. Words are runs of
    characters other than space and U+0009 to U+000D. A null text, and one without a word, is alone in its class. Classes are of
    texts and an id is only a label: rows that repeat an id have the class of their own text each, and a row of a null id has that of
    its text, null where no row of it has an id. Ids are integers. Other columns of docs are not read. No rows: no rows.
    """
    since = mark()
    ready, _ = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    found = _classes(ready.select(F.col("row").alias("doc"), "text"), size, similarity, bands, rows, block)
    named = settle(found.join(ready.select(F.col("row").alias("doc"), "id"), "doc").select("doc", "class", "id"))
    least = checked_broadcast(settle(named.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).filter("n > 1").drop("n")))
    several = settle(named.join(least, "class").select("doc", "class_id", F.lit(True).alias("many")))
    labels = ready.select(F.col("row").alias("doc"), "id").join(several, "doc", "left")
    done = written(labels.select(F.col("id").alias(id_col), F.when(F.col("many"), F.col("class_id")).otherwise(F.col("id")).alias("class_id")), "near")
    discard(docs.sparkSession, since, keep=(done,))
    return done


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates: that of the least id (a null one is last), among rows of one id the least text by a hash,
    among equal ones any one. Null texts and those without a word are in no class and stay."""
    since = mark()
    ready, row = _numbered(docs)
    found = _classes(ready.select(F.col(row).alias("doc"), F.col(text_col).cast("string").alias("text")), **near_duplicates.__kwdefaults__)
    named = found.join(ready.select(F.col(row).alias("doc"), F.col(id_col).cast("long").alias("id")), "doc")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "d1", "d2", "doc")
    first = named.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("class", F.col("first.doc").alias("first"))
    gone = settle(named.join(checked_broadcast(settle(first)), "class").filter("doc != first").select(F.col("doc").alias(row)))
    discard(docs.sparkSession, since, keep=(ready, gone))
    return without_ids(ready, gone, row).drop(row)


def op10_prob_minhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its near duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents"))
