"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes bad (0) or good (1) on a text, or abstains (2). The pattern of votes is counted over all documents (at most
3^LABELLERS rows); expectation-maximisation of a two-class model with independent labellers runs on those counts, and gives
each pattern a posterior. A bounded sample of TRAIN_ROWS texts per side with their posteriors as soft labels trains a linear scorer on
hashed byte trigrams, the only thing that is applied to documents. All texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytehash, weak_labels
from granary.llm.common import give_back, map_batches, table
from granary.llm.weak_labels import ABSTAIN, BAD, GOOD

#: Sample that trains the scorer: so many texts that the posterior calls bad and so many that it calls good, each of at most TRAIN_BYTES.
TRAIN_ROWS, TRAIN_BYTES = 2000, 20_000
BITS = 16
THRESHOLD = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[0x80:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>~^_=+\\{}[]@"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True

#: (name, bad at least or at most, good at most or at least): votes bad beyond the first, good short of the second, and abstains between.
LABELLERS = (
    ("few_words", "low", 8, 40),
    ("symbols", "high", 0.05, 0.004),
    ("capitals", "high", 0.35, 0.08),
    ("shouting", "high", 0.02, 0.002),
    ("repeated_words", "low", 0.25, 0.45),
    ("words_with_symbols", "high", 0.15, 0.02),
    ("repeated_runs", "high", 0.4, 0.02),
    ("prose_marks", "low", 0.004, 0.01),
    ("word_length", "high", 14.0, 11.0),
)


def measures(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    """What each labeller looks at, for texts i to j: (texts x LABELLERS)."""
    n = j - i
    buf, starts = bytehash.padded(raw, offsets, i, j)
    s, e = bytehash.words(buf)
    owner = np.searchsorted(starts, s, "right") - 1
    h = bytehash.span_hashes(buf, s, e)
    words = np.bincount(owner, minlength=n)
    per = np.maximum(words, 1)
    letters = np.maximum(np.add.reduceat((~bytehash.SPACE[buf]).astype(np.int64), starts[:-1]), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[buf].astype(np.int64), starts[:-1]) / letters

    order = np.lexsort((h, owner))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(owner[order][fresh], minlength=n)
    runs, run_owner = bytehash.windows(h, owner, 5)
    order = np.lexsort((runs, run_owner))
    fresh = np.r_[True, (runs[order][1:] != runs[order][:-1]) | (run_owner[order][1:] != run_owner[order][:-1])] if len(runs) else np.zeros(0, bool)
    new_runs = np.bincount(run_owner[order][fresh], minlength=n)
    all_runs = np.maximum(np.bincount(run_owner, minlength=n), 1)
    marked = np.zeros(n)
    if len(s):
        # A word is marked if any byte of it is a symbol.
        sums = np.r_[0, np.cumsum(_SYMBOL[buf])]
        marked = np.bincount(owner, (sums[e] > sums[s]).astype(float), minlength=n)
    columns = [
        words,
        share(_SYMBOL),
        share(_UPPER) / np.maximum(share(_UPPER) + share(_LOWER), 1e-9),
        share(_SHOUT),
        # Longer texts repeat more words: the share of distinct words is held against a root of the length.
        distinct / per * np.maximum(1.0, (per / 200.0) ** 0.3),
        marked / per,
        1 - new_runs / all_runs,
        share(_STOP),
        letters / per,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    out = np.full(m.shape, ABSTAIN, np.int64)
    for k, (_, side, bad, good) in enumerate(LABELLERS):
        low = side == "low"
        out[:, k][m[:, k] <= bad if low else m[:, k] >= bad] = BAD
        out[:, k][m[:, k] >= good if low else m[:, k] <= good] = GOOD
    return out


def pattern_codes(column: pa.Array) -> np.ndarray:
    raw, offsets = bytehash.column_bytes(column)
    base = 3 ** np.arange(len(LABELLERS))
    return np.concatenate([votes(measures(raw, offsets, i, j)) @ base for i, j in bytehash.groups(offsets)] or [np.zeros(0, np.int64)])


def features(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of texts i to j and the start of each text's there: one for each byte, the last ones with line feeds behind the
    text, and two of 1 << BITS, which stand for nothing."""
    lengths = np.diff(offsets[i : j + 1])
    starts = np.r_[0, np.cumsum(lengths + 2)]
    out = np.full(starts[-1] + 2, 10, np.uint8)
    keep = np.ones(starts[-1] + 2, bool)
    none = np.r_[starts[1:] - 2, starts[1:] - 1]
    keep[none] = keep[-2:] = False
    out[keep] = raw[offsets[i] : offsets[j]]
    wide = out.astype(np.uint32)
    grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    grams[none] = 1 << BITS
    return grams, starts[:-1]


def score_column(column: pa.Array, weights: np.ndarray, bias: float, scale: float) -> np.ndarray:
    """Scores (0 to 1, higher is better) of the texts of a column, a million bytes at a time."""
    raw, offsets = bytehash.column_bytes(column)
    parts = []
    weights = np.r_[weights, 0.0]
    for i, j in bytehash.groups(offsets):
        grams, starts = features(raw, offsets, i, j)
        sums = np.add.reduceat(weights[grams], starts)
        parts.append(sums / (np.diff(offsets[i : j + 1]) + 1))
    z = np.concatenate(parts or [np.zeros(0)]) * scale + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train_scorer(texts: list[str], labels: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float, float]:
    """(weights, bias, scale) of a logistic scorer of mean trigram weights, by full-batch gradient steps on soft labels."""
    column = pa.array(texts, pa.large_string())
    raw, offsets = bytehash.column_bytes(column)
    rows, cols, vals = [], [], []
    for i, j in bytehash.groups(offsets):
        grams, starts = features(raw, offsets, i, j)
        ends = np.r_[starts[1:], len(grams)]
        for k in range(j - i):
            g, c = np.unique(grams[starts[k] : ends[k] - 2], return_counts=True)
            rows.append(np.full(len(g), i + k))
            cols.append(g)
            vals.append(c / (offsets[i + k + 1] - offsets[i + k] + 1))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    n = len(texts)
    weights, bias, scale = np.zeros(1 << BITS), 0.0, 1.0
    moment = np.full(1 << BITS, 1e-8)
    balance = np.where(labels >= 0.5, 0.5 / max(1e-9, (labels >= 0.5).sum()), 0.5 / max(1e-9, (labels < 0.5).sum()))
    for step in range(rounds):
        z = np.bincount(rows, vals * weights[cols], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * balance
        grad = np.bincount(cols, vals * error[rows], minlength=1 << BITS)
        moment += grad**2
        weights -= 2.0 * grad / np.sqrt(moment)
        bias -= 0.5 * error.sum()
    return weights, float(bias), scale


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray, float, float] | None:
    """A scorer for texts like those of docs; None if the labellers call no sampled text bad, or none good.

    The sample is the TRAIN_ROWS texts a side of the least hashes of id and text, so null ids are told apart by their texts; equal rows count once,
    and however often they repeat the sample is as large. Somewhat more than that comes to the driver, of which the least are taken.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pattern_codes(batch.column(0))), batch.column(1)], names=["pattern", "place"])

    text = F.col(text_col).cast("string")
    texts = docs.filter(F.length(text) > 0).select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("place"))
    coded = map_batches(texts, codes, T.StructType([T.StructField("pattern", T.LongType()), T.StructField("place", T.LongType())]))
    counted = coded.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("place", 0.05).alias("places")).collect()
    patterns = {r["pattern"]: r["n"] for r in counted}
    if not patterns:
        return None
    labelled = weak_labels.fit(patterns, len(LABELLERS))
    posterior = {p: labelled.posterior(p) for p in patterns}
    # A share of the distinct texts, sized so that either side has TRAIN_ROWS and some to spare; of a rare side all may be needed.
    share = {side: min(1.0, 1.3 * TRAIN_ROWS / max(1, sum(r["places"] for r in counted if (posterior[r["pattern"]] >= 0.5) == side))) for side in (False, True)}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = bytehash.mix(batch.column(1).to_numpy().astype(np.int64).view(np.uint64)).astype(np.float64) / 2.0**64
            size = np.diff(bytehash.column_bytes(batch.column(0))[1])
            at = np.flatnonzero((place < max(share.values())) & (size <= TRAIN_BYTES))
            some = batch.take(pa.array(at))
            post = np.array([posterior.get(c, 0.5) for c in pattern_codes(some.column(0)).tolist()])
            keep = place[at] < np.where(post >= 0.5, share[True], share[False])
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(post, pa.float64())], names=["text", "place", "good"]).filter(pa.array(keep))

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("place", T.LongType()), T.StructField("good", T.DoubleType())])
    sampled = map_batches(texts, sample, kind).groupBy("place").agg(F.min(F.struct("text", "good")).alias("t"))
    rows = sorted((int(bytehash.mix(np.array([r["place"]]).view(np.uint64))[0]), r["text"], r["good"]) for r in sampled.select("place", "t.*").collect())
    rows = sorted(r for side in (False, True) for r in [r for r in rows if (r[2] >= 0.5) == side][:TRAIN_ROWS])
    good = np.array([g for _, _, g in rows])
    if not len(rows) or good.min() >= 0.5 or good.max() < 0.5:
        return None
    model = train_scorer([t for _, t, _ in rows], good)
    del rows
    give_back()
    return model


def quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, kept): one row per row of docs; kept if the score is at least THRESHOLD.

    A null text, and one without a word, scores 0. Without a model every other text scores 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores_of(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= THRESHOLD)], names=[id_col, "score", "kept"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def scores_of(column: pa.Array, model) -> np.ndarray:
    raw, offsets = bytehash.column_bytes(column)
    inside = np.r_[0, np.cumsum(~bytehash.SPACE[raw])]
    found = np.ones(len(column)) if model is None else score_column(column, *model)
    return np.where(inside[offsets[1:]] > inside[offsets[:-1]], found, 0.0)


def without_poor(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, less the rows that score under THRESHOLD. The model is fitted on docs."""
    model = fit(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch.column(at), model) >= THRESHOLD))

    return map_batches(docs, run, docs.schema)


def op3_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, score, kept."""
    documents = table(spark, sf_dir, "documents")
    return quality(documents, fit(documents))
