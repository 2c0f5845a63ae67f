"""Merkle manifest of a dataset, by higher-order functions over blocks of ordered leaves.

Each row is a leaf. Leaves of a group ascend by key; while a group has more than one node, each run of FAN consecutive ones becomes their
hash. The groups' subroots, in the order of the groups, make the root in the same way.

Leaves get their place in their group without any task that holds a group: rows are range-partitioned by (group, key, leaf, tie), numbered
as they lie, and the number of a group's first row in each partition is taken off. BLOCK = FAN^DEPTH consecutive nodes are one row with
an ordered array; sequence, transform and slice collapse DEPTH levels of it at a time and the rows of block roots are the nodes of the next
round, so rounds are log(rows) / log(BLOCK). Then proofs come down: the steps (the siblings left and right of a node) of a block's root
are joined to the block's row, and each node of the block gets its own steps before them. Texts of proofs are never shuffled but for those
of block roots: a leaf's proof is made, hashed and folded in the row of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checked_broadcast, discard, mark, settle, table, written

FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(x: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 bytes with their count before them."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (written; g and others) with n, the nodes of g, and i, the place in g from 0 by the columns of order; equal ones in some order."""
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange("g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33).alias("part")
    runs = ranged.groupBy("g", part).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    # As many rows as partitions and groups together.
    runs = settle(runs.withColumn("before", F.sum("m").over(Window.partitionBy("g").orderBy("part")) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy("g"))))
    runs = checked_broadcast(runs.select("g", F.col("part").alias("p"), (F.col("before") - F.col("first")).alias("shift"), "n"))
    found = ranged.withColumn("p", F.shiftright("at", 33)).join(runs, ["g", "p"])
    return found.withColumn("i", F.col("at") + F.col("shift")).drop("p", "at", "shift")


def _collapsed(level: str) -> Column:
    """The level above: the hash of each run of FAN nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda r: F.sha2(F.array_join(F.slice(F.col(level), r * FAN + 1, FAN), ""), 256))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (g, n, b, items, l0 .. lDEPTH): BLOCK consecutive nodes each. A level that the group doesn't have is null; what is in a group of more than
    one node has one level at least."""
    items = F.array_sort(F.collect_list(F.struct("i", "node", *payload))).alias("items")
    blocks = nodes.groupBy("g", "n", F.floor(F.col("i") / BLOCK).alias("b")).agg(items).withColumn("l0", F.transform("items", lambda x: x["node"]))
    for d in range(1, DEPTH + 1):
        blocks = blocks.withColumn(f"l{d}", F.when(F.col("n") > FAN ** (d - 1), _collapsed(f"l{d - 1}")))
    return written(blocks, "blocks")


def _roots(blocks: DataFrame) -> DataFrame:
    """Each block's highest node as a node of the next round, with how many there are."""
    top = F.coalesce(*[F.col(f"l{d}") for d in range(DEPTH, -1, -1)])
    return blocks.select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("b").alias("i"), F.get(top, F.lit(0)).alias("node"))


def _steps(p: Column) -> Column:
    """The siblings of the node at place p of a block, left and right, level by level."""
    steps = []
    for d in range(DEPTH):
        level, own = F.col(f"l{d}"), F.floor(p / FAN**d).cast("int")
        start = (F.floor(own / FAN) * FAN).cast("int")
        left = F.array_join(F.slice(level, start + 1, own - start), "")
        right = F.array_join(F.slice(level, own + 2, start + FAN - 1 - own), "")
        steps.append(F.when(F.col(f"l{d + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _tower(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of all rounds, the lowest first; the last has one block a group."""
    rounds = [_blocks(nodes, payload)]
    while not rounds[-1].filter(F.col("n") > BLOCK).isEmpty():
        rounds.append(_blocks(_roots(rounds[-1]), []))
    return rounds


def _placed(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the steps of their roots. Both are a row for each BLOCK nodes."""
    return blocks.join(above.withColumnRenamed("i", "b"), ["g", "b"])


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Steps (g, i, up) of the lowest round's block roots, from those of the groups' subroots (g, i = 0, up)."""
    for blocks in reversed(rounds[1:]):
        each = F.explode(F.transform(F.col("items"), lambda x, p: F.struct(x["i"].alias("i"), F.concat(_steps(p), F.col("up")).alias("up"))))
        above = written(_placed(blocks, above).select("g", each.alias("x")).select("g", "x.i", "x.up"), "proofs")
    return above


def manifest(docs: DataFrame, group_col: str, key_col: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest's nodes and proof of each row of docs.

    A leaf is the hash of the fields (columns of docs; a null is `-`). Groups come in the order of their bytes, null first; leaves of a group by
    key, null first, then by the leaf, so rows that repeat are leaves of their own whose order makes no difference. The proof's digest is that of all
    siblings from leaf to root. tampered names fields that are replaced by other columns before the leaf is folded with its original siblings:
    folded_root is what comes of it, verified whether it is the root. Keys are integers. Other columns are not read. No rows: no rows.
    """
    since = mark()
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf, other = digest(*[field(F.col(c)) for c in fields]), digest(*[field(c) for c in changed])
    leaves = docs.select(g.alias("g"), F.col(key_col).cast("long").alias("key"), leaf.alias("node"), (other if tampered else F.lit(None).cast("string")).alias("other"))
    # Only a leaf that tampering changes is carried twice.
    leaves = written(leaves.withColumn("other", F.nullif("other", "node")), "leaves")
    rounds = _tower(_numbered(leaves, "key", "node"), ["key", "other"])
    subroots = written(_roots(rounds[-1]).select("g", "node"), "subroots")
    over = _tower(_numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "node"), "group"), ["group"])
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    root = _roots(over[-1]).select("g", F.col("i"), none.alias("up"), F.col("node").alias("root"))
    above = _down(over, root.drop("root"))
    each = F.explode(F.transform("items", lambda x, p: F.struct(x["group"].alias("g"), x["node"].alias("subroot"), F.concat(_steps(p), F.col("up")).alias("up"))))
    groups = _placed(over[0], above).join(F.broadcast(root.select("g", "root")), "g")  # one row
    groups = written(groups.select(each.alias("x"), "root").select("x.*", "root").withColumn("i", F.lit(0).cast("long")), "groups")
    above = _down(rounds, groups.select("g", "i", "up"))

    def out(x: Column, p: Column) -> Column:
        way = F.concat(_steps(p), F.col("up"))
        return F.struct(x["key"].alias("key"), x["node"].alias("leaf"), F.coalesce(x["other"], x["node"]).alias("start"), way.alias("way"))

    proofs = _placed(rounds[0], above).join(checked_broadcast(groups.select("g", "subroot", "root")), "g")
    # Steps of a whole block are made at once: BLOCK times some kilobytes.
    proofs = proofs.select("subroot", "root", F.explode(F.transform("items", out)).alias("x")).select("x.*", "subroot", "root")
    sibling = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("way", F.col("start"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    done = proofs.select(F.col("key").alias(key_col), "leaf", "subroot", "root", sibling.alias("proof_sha256"), folded.alias("folded_root"))
    done = written(done.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    discard(docs.sparkSession, since, keep=(done,))
    return done


def op11_merkle_blocks(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 5 divides crc32 of the id, A-Z of the text were lower-cased after the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": text})
