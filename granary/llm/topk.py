"""Exact top-k search by inner product with block-at-a-time pruning.

The terms of a vector are its components, those above zero and those below. Rows are put in an order in which vectors that share their
largest terms are neighbours, and cut into document-range blocks of BLOCK rows; a stripe is a run of blocks and travels as one row: its
forward index (the components of each of its rows, in the least integer type that holds them) and, block by block, each term's maximum.

For a query, a block's bound is the sum over terms of weight times maximum (a weight below zero times the least component). Blocks are
scored from the highest bound down, in waves of 1, 2, 4 ... blocks, until no bound reaches the k-th best score so far; a bound that equals it
is still scored, as ties go by the id. Stages: (1) rows are sorted, cut into stripes and written; (2) each query meets the blocks of its own
stripe, which gives it a k-th score to begin with; (3) bounds of whole stripes, compared in groups, say which other stripes a query has to
see; (4) these stripes' blocks are scored in the same way; (5) the lists of at most k rows a stripe are merged.

What moves: a stripe once, a query once for each stripe whose bound reaches its k-th score. No task holds more than a few stripes, a pack of
queries and a group of summaries, whatever the size of the table. All arithmetic is exact: products are taken in floats only where every sum
of them stays an exact integer there, else in Python's integers; a score beyond 64 bits becomes the nearest that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import discard, map_batches, mark, table, written

SCALE, K, EVERY = 64, 20, 20
BLOCK = 64
#: Rows, and bytes of the components as 64-bit integers, of a stripe (one row may be larger).
STRIPE_ROWS, STRIPE_BYTES = 4096, 4 << 20
#: Stripes, about, whose summaries are compared with a pack of queries at a time.
GROUP = 512

_LONG, _BYTES = T.LongType(), T.BinaryType()
_LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as a double; without vectors that are null or hold null or non-finite components."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter(x.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists as rows of one int64 matrix; shorter ones are filled with zeros."""
    n = len(column)
    ends = np.asarray(column.offsets)
    size = np.diff(ends)
    values = np.asarray(column.values)[ends[0] : ends[-1]]
    out = np.zeros((n, int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = values
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    """m in the least integer type that holds it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _exact_type(x: np.ndarray, y: np.ndarray):
    """A type in which all inner products of rows of x and y are exact."""
    top = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (x, y)]
    most = top[0] * top[1] * max(1, min(x.shape[1], y.shape[1]))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def products(x: np.ndarray, y: np.ndarray, kind=None) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact; rows of unlike length meet in the components that both have."""
    d = min(x.shape[1], y.shape[1])
    x, y = x[:, :d], y[:, :d]
    kind = kind or _exact_type(x, y)
    if d == 0:
        return np.zeros((len(x), len(y)), np.int64)
    if kind is object:
        found = np.array([[int(s) for s in row] for row in x.astype(object) @ y.astype(object).T], object).reshape(len(x), len(y))
        return np.clip(found, _LEAST, np.iinfo(np.int64).max).astype(np.int64)
    return (x.astype(kind, copy=False) @ y.astype(kind, copy=False).T).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries x blocks: the most that a row of the block, whose terms lie between low and high, can score. Never less than its true score: a row that
    is shorter than the block's longest one holds zeros, which lie between too as low is at most 0 and high at least 0 for such a term."""
    d = min(q.shape[1], high.shape[1])
    q = q[:, :d]
    kind = _exact_type(q, np.concatenate([high[:, :d], low[:, :d]]))
    if kind is object:  # each half can leave 64 bits: their sum is taken before it is cut
        q, high, low = q.astype(object), high[:, :d].astype(object), low[:, :d].astype(object)
        both = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T if d else np.zeros((len(q), len(high)), object)
        return np.clip(both, _LEAST, np.iinfo(np.int64).max).astype(np.int64)
    return products(np.maximum(q, 0), high, np.float64) + products(np.minimum(q, 0), low, np.float64)


class Stripe:
    """A run of blocks: the forward index m, ids (null where none), and the terms' extremes block by block."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, none: np.ndarray):
        self.ids, self.none = ids, none
        starts = np.arange(0, len(m), BLOCK)
        self.high, self.low = (f.reduceat(m, starts, axis=0).astype(np.int64) if m.shape[1] else np.zeros((len(starts), 0), np.int64) for f in (np.maximum, np.minimum))
        self.most = int(max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))))
        self.m, self.as_float = m, {}

    def rows(self, kind) -> np.ndarray:
        if kind not in self.as_float:
            self.as_float[kind] = self.m.astype(kind)
        return self.as_float[kind]

    def best(self, q: np.ndarray, floor: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of the k best rows of each query that score at least its floor, and how many of the blocks were scored.

        own: the row of the stripe that each query is, which doesn't count; None if it is elsewhere.
        """
        bound = bounds(q, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        ordered = np.take_along_axis(bound, order, axis=1)
        kind = _exact_type(q, self.m)
        whole, floor = self.rows(kind), floor.copy()
        qf = q.astype(kind)
        at, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, width, scored = 0, 1, 0
        while first < bound.shape[1]:
            last = min(first + width, bound.shape[1])
            who, place = np.nonzero(ordered[:, first:last] >= floor[:, None])
            if not len(who):
                break
            block = order[who, first + place]
            scored += len(who)
            new = [(at, row, score)]
            turn = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(block[turn]) != 0, True])
            for i, j in zip(cuts[:-1], cuts[1:]):
                b, those = int(block[turn[i]]), who[turn[i:j]]
                s = products(qf[those], whole[b * BLOCK : (b + 1) * BLOCK], kind)
                keep = s >= floor[those][:, None]
                if own is not None:
                    mine = own[those] - b * BLOCK
                    here = np.flatnonzero((mine >= 0) & (mine < s.shape[1]))
                    keep[here, mine[here]] = False
                x, y = np.nonzero(keep)
                new.append((those[x], y + b * BLOCK, s[x, y]))
            at, row, score = (np.concatenate(c) for c in zip(*new))
            turn = np.lexsort((self.ids[row], self.none[row], -score, at))
            at, row, score = at[turn], row[turn], score[turn]
            place = np.arange(len(at)) - np.searchsorted(at, at, "left")
            kept = place < k
            full = place == k - 1
            floor[at[full]] = np.maximum(floor[at[full]], score[full])
            at, row, score = at[kept], row[kept], score[kept]
            first, width = last, width * 2
        return at, row, score, scored


_STRIPE = T.StructType(
    [T.StructField("stripe", _LONG), T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType())]
    + [T.StructField(c, _BYTES) for c in ("m", "ids", "none", "high", "low", "q", "queries", "floor")]
    + [T.StructField(c, T.ArrayType(_LONG, False)) for c in ("at", "row", "score")]
    + [T.StructField("blocks", _LONG), T.StructField("scored", _LONG)]
)


def _cut(k: int, every: int, rows_most: int, bytes_most: int):
    """Sorted rows (id, v) to stripes, with the queries among their rows and what these find in their own stripe."""

    def made(number: int, m: np.ndarray, ids: np.ndarray, none: np.ndarray) -> dict:
        s = Stripe(m, ids, none)
        queries = np.flatnonzero(~none & (ids % every == 0))
        at, row, score, scored = s.best(m[queries], np.full(len(queries), _LEAST), queries, k)
        floor = np.full(len(queries), _LEAST)
        count = np.bincount(at, minlength=len(queries)) if len(queries) else np.zeros(0, np.int64)
        full = np.flatnonzero(count == k)
        floor[full] = score[np.cumsum(count)[full] - 1]
        narrow = _narrow(m)
        return {
            "stripe": (TaskContext.get().partitionId() << 32) + number, "kind": narrow.dtype.str, "width": m.shape[1], "m": narrow.tobytes(), "ids": ids.tobytes(), "none": none.tobytes(),
            "high": s.high.max(axis=0).tobytes(), "low": s.low.min(axis=0).tobytes(), "q": narrow[queries].tobytes(), "queries": queries.tobytes(), "floor": floor.tobytes(),
            "at": at, "row": row, "score": score, "blocks": len(s.high) * len(queries), "scored": scored,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"string": pa.string(), "integer": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "array": pa.list_(pa.int64())}[f.dataType.typeName()]) for f in _STRIPE])
        number, held, rows, width = 0, [], 0, 0

        def joined():
            m = np.zeros((rows, width), np.int64)
            start = 0
            for part, _, _ in held:
                m[start : start + len(part), : part.shape[1]] = part
                start += len(part)
            record = made(number, m, np.concatenate([i for _, i, _ in held]), np.concatenate([n for _, _, n in held]))
            return pa.RecordBatch.from_pylist([record], schema)

        for batch in batches:
            all_ids, lists = batch.column(0), batch.column(1)
            none = np.asarray(all_ids.is_null())
            ids = np.asarray(all_ids.fill_null(0))
            size = np.diff(np.asarray(lists.offsets))
            i = 0
            while i < batch.num_rows:
                room = rows_most - rows
                most = np.maximum.accumulate(np.maximum(size[i : i + room], width))
                fits = int(np.count_nonzero((rows + np.arange(1, len(most) + 1)) * most * 8 <= bytes_most))
                if fits == 0 and rows == 0:
                    fits = 1
                if fits:
                    held.append((_matrix(lists.slice(i, fits)), ids[i : i + fits], none[i : i + fits]))
                    rows, width, i = rows + fits, int(most[fits - 1]), i + fits
                if rows and (i < batch.num_rows or rows == rows_most):
                    yield joined()
                    number, held, rows, width = number + 1, [], 0, 0
        if rows:
            yield joined()

    return run


def _read(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(record["m"], record["kind"])
    ids = np.frombuffer(record["ids"], np.int64)
    return m.reshape(len(ids), record["width"]), ids, np.frombuffer(record["none"], bool)


_PACK = T.StructType([T.StructField("stripe", _LONG), T.StructField("home", _LONG), T.StructField("q_kind", T.StringType()), T.StructField("q_width", T.IntegerType())] + [T.StructField(c, _BYTES) for c in ("q", "rows", "floor")])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stripe of a group, the queries of a stripe whose bound there reaches the score that they have already."""
    for batch in batches:
        for record in batch.to_pylist():
            rows, floor = np.frombuffer(record["queries"], np.int64), np.frombuffer(record["floor"], np.int64)
            q = np.frombuffer(record["q"], record["kind"]).reshape(len(rows), record["width"])
            others = [s for s in record["group"] if s["stripe"] != record["stripe"]]
            if not others:
                continue
            width = max(s["width"] for s in others)
            high, low = np.zeros((len(others), width), np.int64), np.zeros((len(others), width), np.int64)
            for i, s in enumerate(others):
                high[i, : s["width"]], low[i, : s["width"]] = np.frombuffer(s["high"], np.int64), np.frombuffer(s["low"], np.int64)
            reach = bounds(q, high, low) >= floor[:, None]
            for i in np.flatnonzero(reach.any(axis=0)):
                those = reach[:, i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (others[i]["stripe"], record["stripe"], record["kind"])] + [pa.array([record["width"]], pa.int32())] + [pa.array([x.tobytes()]) for x in (q[those], rows[those], floor[those])],
                    names=[f.name for f in _PACK],
                )


_FOUND = T.StructType([T.StructField(c, _LONG) for c in ("home", "query", "vec_id", "score")])


def _scored(k: int):
    """(home, query, id, score) of what queries find in other stripes than their own; rows come sorted by stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, stripe = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                record = {name: batch.column(name)[i] for name in batch.schema.names}
                if record["stripe"].as_py() != number:
                    number = record["stripe"].as_py()
                    stripe = Stripe(*_read({c: record[c].as_py() for c in ("m", "ids", "none", "kind", "width")}))
                rows = np.frombuffer(record["rows"].as_py(), np.int64)
                q = np.frombuffer(record["q"].as_py(), record["q_kind"].as_py()).reshape(len(rows), record["q_width"].as_py())
                at, row, score, _ = stripe.best(q, np.frombuffer(record["floor"].as_py(), np.int64), None, k)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), record["home"].as_py())), pa.array(rows[at]), pa.array(stripe.ids[row], mask=stripe.none[row]), pa.array(score)], names=[f.name for f in _FOUND])

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(home, query, query_id, id, score) of what queries find in their own stripe; one row of no score for each query, with its id."""
    for batch in batches:
        for record in batch.to_pylist():
            ids, none = np.frombuffer(record["ids"], np.int64), np.frombuffer(record["none"], bool)
            queries, at, row = np.frombuffer(record["queries"], np.int64), np.array(record["at"], np.int64), np.array(record["row"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), record["stripe"])), pa.array(queries[at]), pa.array(ids[row], mask=none[row]), pa.array(np.array(record["score"], np.int64))], names=[f.name for f in _FOUND])


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for record in batch.to_pylist():
            queries = np.frombuffer(record["queries"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), record["stripe"])), pa.array(queries), pa.array(np.frombuffer(record["ids"], np.int64)[queries])], names=["home", "query", "query_id"])


def stripes(vectors: DataFrame, id_col: str, vector_col: str, *, k: int = K, every: int = EVERY, scale: float = SCALE, rows: int = STRIPE_ROWS, bytes_most: int = STRIPE_BYTES) -> DataFrame:
    """The index, written: a row for each stripe, with its queries' best rows of the stripe itself."""
    ready = quantised(vectors, id_col, vector_col, scale).withColumn("tie", F.monotonically_increasing_id())
    ready = written(ready, "vectors")
    # The two largest terms of a vector: place and sign.
    terms = F.slice(F.reverse(F.array_sort(F.transform("v", lambda e, i: F.struct(F.abs(e).alias("w"), F.when(e < 0, -i - 1).otherwise(i + 1).alias("t"))))), 1, 2)
    ready = ready.withColumn("terms", F.transform(terms, lambda t: t["t"])).withColumn("first", F.get("terms", F.lit(0))).withColumn("second", F.get("terms", F.lit(1)))
    ranged = ready.repartitionByRange("first", "second", "tie").sortWithinPartitions("first", "second", "tie").select("id", "v")
    return written(map_batches(ranged, _cut(k, every, rows, bytes_most), _STRIPE), "stripes")


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, every: int = EVERY, scale: float = SCALE, rows: int = STRIPE_ROWS, bytes_most: int = STRIPE_BYTES, group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id `every` divides, the k rows of the greatest integer inner products, from rank 1.

    Components are floor(scale * x). Every row but the query's own is a candidate, those of a null id (last among equal scores) and those that
    repeat an id or a vector too; rows that repeat a query's id are queries of their own, each with ranks from 1. Ties go to the lesser id. Vectors
    that are null or hold a null or non-finite component take no part; of vectors of unlike length the missing components are 0. Other columns are
    not read. Fewer than k candidates: all of them; no rows: no rows.
    """
    since = mark()
    index = stripes(vectors, id_col, vector_col, k=k, every=every, scale=scale, rows=rows, bytes_most=bytes_most)
    groups = max(1, -(-index.count() // group))
    g = F.pmod(F.xxhash64("stripe"), F.lit(groups)).cast("int")
    summaries = index.groupBy(g.alias("g")).agg(F.collect_list(F.struct("stripe", "width", "high", "low")).alias("group"))
    asking = index.filter(F.octet_length("queries") > 0)
    meet = asking.select("stripe", "kind", "width", "q", "queries", "floor", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).join(summaries, "g")
    packs = written(map_batches(meet.drop("g"), _chosen, _PACK), "packs")
    there = packs.join(index.select("stripe", "kind", "width", "m", "ids", "none"), "stripe").sortWithinPartitions("stripe")
    more = map_batches(there, _scored(k), _FOUND)
    own = map_batches(asking.select("stripe", "ids", "none", "queries", "at", "row", "score"), _own, _FOUND)
    names = map_batches(asking.select("stripe", "ids", "queries"), _query_ids, T.StructType([T.StructField(c, _LONG) for c in ("home", "query", "query_id")]))
    place = Window.partitionBy("home", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = own.unionByName(more).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    done = written(best.join(names, ["home", "query"]).select("query_id", "rank", F.col("vec_id").alias(id_col), "score"), "top-k")
    discard(vectors.sparkSession, since, keep=(done,))
    return done


def op13_block_pruned_topk(spark, sf_dir: str) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))
