"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal texts are a group and stay together. Groups of at least a share of the capacity are items of their own; the
others are dealt by hash into bundles, whose count follows the row count, and each bundle is an item. So the driver packs a
number of items that is bounded by rows / ROWS_PER_BUNDLE, never the groups themselves, and no row moves for it. A group of many rows, however
few bytes they have (null and empty texts), is numbered in pieces of about ROWS_PER_BUNDLE rows by the id, and where an id is null or repeats so
often that a piece still is several times that, by the place of the rows: no task sorts more.

Items sorted by size, largest first, enter the bin with the least remaining capacity that still holds them, found in a balanced
tree (a treap) of the open bins. pack() opens as few bins of a fixed capacity as that gives; for a fixed number of shards the
least capacity that needs no more bins is searched by halving. A group larger than the capacity can't be whole; it is cut into pieces.
"""

from __future__ import annotations

import heapq
from random import Random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checked_broadcast, discard, mark, settle, table

ROWS_PER_BUNDLE, LEAST_BUNDLES = 50_000, 2048
#: A group of at least this share of a shard is packed by itself, in pieces of at most about this share.
LARGE = 1 / 256


class BalancedTree:
    """Ordered set of (key, bin) with a successor search: a treap, of logarithmic expected depth."""

    def __init__(self):
        self.root = None  # [entry, priority, left, right]
        self.random = Random(7)

    def _split(self, node, entry):
        """(entries < entry, entries >= entry)"""
        if node is None:
            return None, None
        if node[0] < entry:
            low, high = self._split(node[3], entry)
            node[3] = low
            return node, high
        low, high = self._split(node[2], entry)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, entry) -> None:
        low, high = self._split(self.root, entry)
        self.root = self._merge(self._merge(low, [entry, self.random.random(), None, None]), high)

    def pop_at_least(self, key):
        """Remove and return the least entry whose key is at least key; None if there is none."""
        low, high = self._split(self.root, (key, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin (from 0) of each item by best fit decreasing. An item over the capacity gets a bin of its own."""
    bins, tree, out = 0, BalancedTree(), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.pop_at_least(sizes[k])
        room, b = found if found else (capacity, bins)
        bins += found is None
        out[k] = b
        tree.add((room - sizes[k], b)) if room > sizes[k] else None
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """The bin of each item, at most `shards` bins, of the least capacity that best fit decreasing can do with."""
    if not sizes:
        return []
    total = sum(sizes)
    low, high = max(max(sizes), -(-total // shards)), max(max(sizes), -(-total // shards)) * 2
    best = None
    while low < high:
        mid = (low + high) // 2
        found = pack(sizes, mid)
        if max(found) < shards:
            best, high = found, mid
        else:
            low = mid + 1
        if best is not None and (high - low) * 100_000 < low:
            break
    if best is None:
        found = pack(sizes, high)
        best = found if max(found) < shards else _lightest(sizes, shards)
    return best


def _lightest(sizes: list[int], shards: int) -> list[int]:
    """Each item, largest first, into the lightest shard: where best fit can't do with the shards."""
    heap, out = [(0, b) for b in range(shards)], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, b = heapq.heappop(heap)
        out[k] = b
        heapq.heappush(heap, (load + sizes[k], b))
    return out


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", *, rows_per_bundle: int = ROWS_PER_BUNDLE) -> DataFrame:
    """(id, size, text_crc32, shard, slot): one row per row of docs; size is the UTF-8 bytes of the text (null: none) plus 1.

    Shards have nearly equal sizes; rows of equal texts share one unless together they are larger than a shard. Null texts are one group,
    empty ones too. slot counts from 0 without gaps within a shard. Repeated ids, and null ones, keep a row each.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(t, 256)).alias("group")
    )
    since = mark()
    rows = settle(rows.withColumn("place", F.monotonically_increasing_id()))  # a number for each row, kept as it is from here on
    totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total, count = totals["bytes"] or 0, totals["n"]
    target = max(1, -(-total // shards))
    large_size = max(2, int(target * LARGE))
    bundles = max(LEAST_BUNDLES, -(-count // rows_per_bundle))
    # At most shards / LARGE + rows / rows_per_bundle groups are this large.
    large = rows.groupBy("group").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows")).filter((F.col("group_bytes") >= large_size) | (F.col("group_rows") >= rows_per_bundle))
    large = checked_broadcast(settle(large))
    # Groups over a shard fall apart into pieces by the id; in others the pieces only spread the work of numbering.
    named = rows.join(large, "group", "left")
    pieces = F.greatest(F.ceil(F.col("group_bytes") / large_size), F.ceil(F.col("group_rows") / rows_per_bundle))
    named = named.select(
        "id", "size", "text_crc32", "place",
        F.when(F.col("group_bytes").isNotNull(), F.col("group")).alias("whole"),
        F.when(F.col("group_bytes").isNotNull(), F.pmod(F.xxhash64("id", F.lit(3)), pieces)).otherwise(F.pmod(F.xxhash64("group"), F.lit(bundles))).cast("long").alias("part"),
    )
    named = settle(named)
    parts = lambda: named.groupBy("whole", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # At most rows / (4 * rows_per_bundle) pieces of an id that fills them; bundles hold small groups only and stay whole.
    heavy = [(r["whole"], r["part"], -(-r["n"] // rows_per_bundle)) for r in parts().filter((F.col("n") >= 4 * rows_per_bundle) & F.col("whole").isNotNull()).collect()]
    if heavy:
        cut = F.broadcast(docs.sparkSession.createDataFrame(heavy, "whole string, part long, cuts long"))
        again = F.when(F.col("cuts").isNotNull(), -1 - F.pmod(F.xxhash64("place"), F.col("cuts")) - F.col("part") * count).otherwise(F.col("part"))
        named = settle(named.join(cut, ["whole", "part"], "left").select("id", "size", "text_crc32", "place", "whole", again.alias("part")))
    discard(docs.sparkSession, since, keep=(named,))
    items = sorted(((r["whole"] or "", r["part"], r["bytes"], r["n"]) for r in parts().collect()), key=lambda r: (r[0], r[1]))
    units: dict = {}  # what is packed: bundles, whole groups, pieces of groups over a shard
    group_bytes: dict[str, int] = {}
    for whole, _, size, _ in items:
        if whole:
            group_bytes[whole] = group_bytes.get(whole, 0) + size
    for k, (whole, part, size, _) in enumerate(items):
        unit = (whole, -1) if whole and group_bytes[whole] <= target else (whole, part)
        units.setdefault(unit, []).append(k)
    names = list(units)
    placed = pack_into([sum(items[k][2] for k in units[u]) for u in names], shards)
    filled = [0] * shards
    plan = []
    for name, b in zip(names, placed, strict=True):
        for k in units[name]:
            plan.append((items[k][0] or None, items[k][1], b, filled[b]))
            filled[b] += items[k][3]
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan, "whole string, part long, shard int, first long")
    numbered = named.join(checked_broadcast(plan_df), named["part"].eqNullSafe(plan_df["part"]) & named["whole"].eqNullSafe(plan_df["whole"])).select("id", "size", "text_crc32", named["whole"], named["part"], "shard", "first")
    place = F.row_number().over(Window.partitionBy("whole", "part").orderBy("id", "size", "text_crc32")) - 1
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + place).cast("long").alias("slot"))


def op9_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (bytes), shard (0 to 7), slot, grown_shard (null: the law isn't key)."""
    found = shard(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    """Per document, its size as the shards count it."""
    return op9_best_fit_shards(spark, sf_dir).select("doc_id", "size")


def shard_report(spark, sf_dir: str) -> DataFrame:
    """One row on the shards of the documents: n_rows, bytes, shards, whether slots have no gaps (gapless), whether the fullest shard holds at most
    2 % more than the mean (even), and whether copies of a text that fit into a shard share one (copies_together)."""
    found = settle(op9_best_fit_shards(spark, sf_dir))
    per = found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    shards = per.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.every(whole).alias("gapless"), (F.max("bytes") <= 1.02 * F.avg("bytes")).alias("even"))
    copies = found.groupBy("text_crc32", "size").agg(F.sum("size").alias("group_bytes"), F.countDistinct("shard").alias("k"))
    room = (found.agg(F.sum("size")).first()[0] or 0) / 8
    apart = copies.filter((F.col("k") > 1) & (F.col("group_bytes") <= room)).count()
    return shards.withColumn("copies_together", F.lit(apart == 0))
