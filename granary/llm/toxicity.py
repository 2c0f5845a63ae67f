"""Compression-distance toxicity: one zstandard dictionary of toxic text, one of ordinary text.

A window of text (`window` letter runs, lower-cased, with its separators) is compressed with either dictionary; its gain is
the bytes that the toxic one saves. Gains of one toxic word are 2 to 6 bytes, so the production window is a single word:
longer windows bury that in the noise of the other words. A document is described by its largest gain and by how many distinct windows
reach that of the calibrated threshold; the score is the share of toxic documents among calibration documents of the same
description, smoothed.

Labels are per document, and most windows of a toxic document are ordinary. So the toxic dictionary is trained on those windows
of toxic documents that are far more frequent there than in ordinary ones, by their evidence, and the ordinary one on the most frequent windows of
ordinary documents. All windows of the sample are counted, by hashes; only the size of a dictionary bounds how many windows it holds.

Fitting reads a bounded sample: MAX_TOXIC and MAX_ORDINARY labelled rows (by a hash of the id) of at most MAX_BYTES bytes of
text each; two thirds train the dictionaries and one third calibrates. Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checked_broadcast, give_back, held_out, map_batches, one_text, settle, table

MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2500, 5000, 20_000
THRESHOLD = 0.3
DICTIONARY_BYTES = 131_072
LIFT = 4.0
#: Least evidence for a toxic window: documents that hold it times the log of the lift.
EVIDENCE, LEAST_DOCUMENTS = 20.0, 3
#: A window also counts as its first so many characters: stems with many endings are else too rare each.
STEMS = (4, 5, 6, 7, 8)
LEVEL = 12
#: Windows whose gain a worker keeps in each of two generations.
CACHE = 100_000
#: Stands before every sample and every window: zstandard stores an input of a few bytes as it is, and behind bytes that both
#: dictionaries hold, each byte that a window costs shows in the length.
CARRIER = b"\x02window of the text to be compared with either dictionary\x03"

_RUN = re.compile(r"[^\W\d_]+")


def text_windows(text: str | None, window: int) -> list[str]:
    """The distinct windows of a whole text, each of `window` letter runs (all runs, if there are fewer)."""
    runs = _RUN.findall(text.lower()) if text else []
    if window == 1 or len(runs) <= window:
        return list(set(runs)) if window == 1 else ([" ".join(runs)] if runs else [])
    return list({" ".join(runs[i : i + window]) for i in range(len(runs) - window + 1)})


_codes: dict[str, bytes] = {}


def widened(window: str) -> bytes:
    """The window as four fixed bytes for each three neighbouring characters (a space stands on either side)."""
    padded = f" {window} "
    grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
    for g in grams:
        if g not in _codes:
            if len(_codes) > CACHE:
                _codes.clear()
            _codes[g] = zlib.crc32(g.encode("utf-8", "surrogatepass")).to_bytes(4, "little")
    return b"".join([_codes.get(g) or zlib.crc32(g.encode("utf-8", "surrogatepass")).to_bytes(4, "little") for g in grams])


def dictionary_of(windows: dict[str, float], size: int = DICTIONARY_BYTES) -> bytes:
    """The content of a zstandard dictionary: the windows of most weight, the heaviest last (nearest), then the carrier.

    zstandard's own trainer cuts segments of 16 bytes and more out of long samples and drops most of a few hundred short windows,
    the carrier among them; so the content is set here, and zstandard takes it as raw content.
    """
    held, room = [], size
    for w, _ in sorted(windows.items(), key=lambda x: (-x[1], x[0])):
        held.append(widened(w))
        room -= len(held[-1])
        if room <= 0:
            break
    return b"".join(reversed(held))[-size:] + CARRIER


def counted(documents: Iterator[set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rising; in how many documents each is) of the windows of documents: 8 bytes for each window of each document."""
    parts = [np.fromiter(map(hash, d), np.int64, len(d)) for d in documents]
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)


def named(documents: Iterator[set[str]], hashes: np.ndarray, values: np.ndarray) -> dict[str, float]:
    """The windows of documents that have the hashes, with their values."""
    value_of = dict(zip(hashes.tolist(), values.tolist(), strict=True))
    return {w: value_of[hash(w)] for d in documents for w in d if hash(w) in value_of}


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    window: int
    level: int
    gain: int
    #: Score by (windows that reach gain, 0 to 3, and more than gain + 1 at most or not).
    scores: dict[tuple[int, bool], float]


class Gains:
    """Gains of windows, with those met lately kept: at most CACHE in either of two generations."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int):
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.compressors = []
        for data in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            plain = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=plain))

    def of(self, windows: list[str]) -> list[int]:
        known, older = self.known, self.older
        ordinary, toxic = (c.compress for c in self.compressors)
        for w in windows:
            if w not in known:
                gain = older.get(w)
                if gain is None:
                    b = CARRIER + widened(w)
                    gain = len(ordinary(b)) - len(toxic(b))
                known[w] = gain
        out = [known[w] for w in windows]
        if len(known) > CACHE:
            self.known, self.older = {}, known
        return out


def _apart(rows: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int]]:
    """rows without most near copies within a label, whose shared windows would pass for frequent ones: those that share a least hash of
    their runs of four windows with a row before."""
    seen = set()
    for i, text, y in rows:
        runs = _RUN.findall(text.lower())
        fours = [" ".join(runs[k : k + 4]).encode() for k in range(max(1, len(runs) - 3))]
        least = {(y, salt, min(zlib.crc32(f, salt) for f in fours)) for salt in (0, 77)}
        if not least & seen:
            yield i, text, y
        seen |= least


def _stems(windows: list[str]) -> set[str]:
    """The windows, and their first characters by STEMS."""
    return {w[:k] for w in windows for k in (*STEMS, len(w))}


def _describe(gains: list[int], least: int) -> tuple[int, bool]:
    reach = [g for g in gains if g >= least]
    return min(3, len(reach)), bool(reach) and max(reach) > least + 3


def fit(rows: list[tuple[int, str, int]], toxic_rows: int, ordinary_rows: int, window: int = 1, level: int = LEVEL) -> Model | None:
    """A model from rows (id, text, toxic 0 or 1); toxic_rows and ordinary_rows: how many labelled rows of either kind there are.

    None where either kind has no row: every text then scores the share of toxic rows.
    """
    some = list(_apart(rows))
    fold_of = lambda i: zlib.crc32(str(i).encode()) // 4 % 3
    if len({y for _, _, y in some}) < 2:
        return None
    split = len({y for i, _, y in some if fold_of(i)}) == 2 and any(y == 1 and fold_of(i) == 0 for i, _, y in some)
    train = [(t, y) for i, t, y in some if not split or fold_of(i)]
    held = [(t, y) for i, t, y in some if not split or not fold_of(i)]
    n = {y: max(1, sum(1 for _, z in train if z == y)) for y in (0, 1)}
    windows_of = lambda label: (set(text_windows(t, window)) for t, y in train if y == label)
    stems_of = lambda label: map(_stems, windows_of(label))
    hashes, count = counted(stems_of(1))
    # Fewer than LEAST_DOCUMENTS can't reach the evidence; the others are counted in ordinary documents.
    often = count >= min(LEAST_DOCUMENTS, n[1])
    some, c = hashes[often], count[often]
    other = np.zeros(len(some))
    for stems in stems_of(0):
        met = np.fromiter(map(hash, stems), np.int64, len(stems))
        at = np.minimum(np.searchsorted(some, met), len(some) - 1) if len(some) else np.zeros(0, np.int64)
        if len(some):
            other[at[some[at] == met]] += 1
    lift = c / n[1] / (other + 0.5) * n[0]
    evidence = np.where(lift > LIFT, c * np.log(lift), 0.0)
    good = evidence >= EVIDENCE
    toxic = named(stems_of(1), some[good], evidence[good]) if good.any() else named(stems_of(1), hashes, count)
    hashes, count = counted(windows_of(0))
    # A window takes four bytes for each of its characters, so no more than these can have room; of equal counts all are looked at.
    least = np.sort(count)[::-1][min(len(count), DICTIONARY_BYTES // 4) - 1] if len(count) else 0
    frequent = count >= least
    dictionaries = dictionary_of(toxic), dictionary_of(named(windows_of(0), hashes[frequent], count[frequent]))
    del hashes, count, often, some
    gains = Gains(*dictionaries, level)
    weight = {1: toxic_rows / max(1, sum(y for _, y in held)), 0: ordinary_rows / max(1, sum(1 - y for _, y in held))}
    # A document's gains from 1 up are all that can reach a threshold.
    measured = [(y, [g for g in gains.of(text_windows(t, window)) if g > 0]) for t, y in held]

    def table_of(least: int) -> tuple[float, dict]:
        mass: dict = {}
        for y, g in measured:
            mass.setdefault(_describe(g, least), [0.0, 0.0])[y] += weight[y]
        base = (toxic_rows + 0.5) / (toxic_rows + ordinary_rows + 1)
        prior = sum(weight.values()) / 2
        scores = {(k, b): 0.0 for k in range(4) for b in (False, True)}
        for key in scores:
            zero, one = mass.get(key, (0.0, 0.0))
            start = base / 2 if key[0] == 0 else min(0.9, base * 2 * key[0])
            scores[key] = (one + prior * start) / (zero + one + prior)
        right = sum(2 * one for k, (_, one) in mass.items() if scores[k] >= THRESHOLD)
        wrong = sum(zero for k, (zero, _) in mass.items() if scores[k] >= THRESHOLD) + sum(one for k, (_, one) in mass.items() if scores[k] < THRESHOLD)
        return right / max(right + wrong, 1e-9), scores

    best = max(range(2, 33), key=lambda g: (table_of(g)[0], -abs(g - 10)))
    return Model(*dictionaries, window, level, best, table_of(best)[1])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], max_bytes: int) -> tuple[list, dict[int, int]]:
    """([(doc_id, text, label)], {label: ids}): at most limits[label] labelled documents outside the held-out fourth, the first by a
    hash of the id, of those that have a text of at most max_bytes, and how many of these there are: labels of other documents play no part. Only
    chosen texts reach the driver, one for each id."""
    known = labels.filter(F.col(label).isin(*limits) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    short = documents.filter(F.octet_length("text") <= max_bytes).select("doc_id")
    known = settle(short.join(checked_broadcast(settle(known)), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for y, most in limits.items():
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = one_text(documents.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id"), "doc_id", "label")
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows.collect()), counts


def train(documents: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    rows, counts = labelled_sample(documents, labels, "toxic", {1: MAX_TOXIC, 0: MAX_ORDINARY}, MAX_BYTES)
    toxic, ordinary = counts.get(1, 0), counts.get(0, 0)
    model = fit(rows, toxic, ordinary)
    del rows
    give_back()
    return model, toxic / max(1, toxic + ordinary)


def score_texts(model: Model | None, base: float):
    """A function from a list of texts to their scores."""
    if model is None:
        return lambda texts: [base] * len(texts)
    gains = Gains(model.toxic, model.ordinary, model.level)
    return lambda texts: [model.scores[_describe(gains.of(text_windows(t, model.window)), model.gain)] for t in texts]


def toxicity(docs: DataFrame, model: Model | None, base: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): one row per row of docs. A null or empty text has no window: it scores as texts without a toxic window do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = score_texts(model, base)
        for batch in batches:
            found = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, less the rows that score THRESHOLD or more. The model is fitted on docs."""
    model, base = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = score_texts(model, base)
        for batch in batches:
            yield batch.filter(pa.array([s < THRESHOLD for s in score(batch.column(at).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op5_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    documents = table(spark, sf_dir, "documents")
    found = toxicity(documents, *train(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
