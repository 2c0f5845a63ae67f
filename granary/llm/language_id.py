"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into segments of SEGMENT bytes. Over each segment one gated recurrent unit runs forward and one backward; their
two states at a byte label that byte with a language, and the mean of the label probabilities over the bytes that belong to letters is
the document's distribution. Trained by backpropagation through time (Adam) on segments of a bounded sample of labelled texts:
about ROWS_PER_LANGUAGE documents a language, each of at most MAX_BYTES bytes, chosen by a hash of the id. Whole texts are read.

The gates use the hard sigmoid min(max(x / 4 + 1/2, 0), 1), which costs a fraction of the exponential.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytehash
from granary.llm.common import held_out, map_batches, one_text, table

SEGMENT = 64
HIDDEN = 10
ROWS_PER_LANGUAGE, MAX_BYTES, MAX_LANGUAGES = 400, 20_000, 1000
STEPS, BATCH = 240, 192
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HAS_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    #: By direction (forward, backward): input weights by byte (256 x 3H: update, reset, new), recurrent weights (H x 3H), bias (3H).
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray  # (2H x L)
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.bias, self.out, self.out_bias]


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
    two = lambda make: [make(), make()]
    return Network(
        languages,
        two(lambda: f(256, 3 * hidden, by=0.3)),
        two(lambda: f(hidden, 3 * hidden, by=hidden**-0.5)),
        two(lambda: np.zeros(3 * hidden, np.float32)),
        f(2 * hidden, len(languages), by=0.1),
        np.zeros(len(languages), np.float32),
    )


def _run(net: Network, d: int, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T x B x H) of one direction over segments x (T x B bytes), at each byte. keep: gets what backpropagation needs."""
    steps, b = x.shape
    n = net.recurrent[d].shape[0]
    h = np.zeros((b, n), net.recurrent[d].dtype)
    states = np.empty((steps, b, n), h.dtype)
    w = net.inputs[d] + net.bias[d]
    gates_u, new_u = np.ascontiguousarray(net.recurrent[d][:, : 2 * n]), np.ascontiguousarray(net.recurrent[d][:, 2 * n :])
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        given = w[x[t]]
        raw = h @ gates_u
        raw += given[:, : 2 * n]
        gates = raw * np.float32(0.25)
        gates += np.float32(0.5)
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:, :n], gates[:, n:]
        rh = r * h
        c = rh @ new_u
        c += given[:, 2 * n :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, r, rh, c, (raw > -2) & (raw < 2)))
        h = h + z * (c - h)
        states[t] = h
    return states


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(loss, its gradient by parameters()): mean cross entropy of the label of each byte of segments x (T x B), backpropagated through time."""
    n = net.recurrent[0].shape[0]
    kept: list[list] = [[], []]
    states = [_run(net, d, x, kept[d]) for d in (0, 1)]
    both = np.concatenate(states, axis=2)
    p = _softmax(both @ net.out + net.out_bias)
    right = (slice(None), np.arange(len(y)), y)
    loss = -float(np.log(np.maximum(p[right], 1e-30)).mean())
    p[right] -= 1
    delta = p / np.float32(x.size)
    back = delta @ net.out.T
    inputs, recurrent, bias = [], [], []
    for d in (0, 1):
        u = net.recurrent[d]
        g_in, g_u = np.zeros_like(net.inputs[d]), np.zeros_like(u)
        g_bias = np.zeros_like(net.bias[d])
        carry = np.zeros((x.shape[1], n), u.dtype)
        for t, h, z, reset, rh, c, inside in reversed(kept[d]):
            dh = back[t][:, d * n : (d + 1) * n] + carry
            dc = dh * z * (1 - c * c)
            d_rh = dc @ u[:, 2 * n :].T
            d_gates = np.concatenate([dh * (c - h), d_rh * h], axis=1) * (inside * np.float32(0.25))
            g_u[:, 2 * n :] += rh.T @ dc
            g_u[:, : 2 * n] += h.T @ d_gates
            whole = np.concatenate([d_gates, dc], axis=1)
            np.add.at(g_in, x[t], whole)
            g_bias += whole.sum(0)
            carry = dh * (1 - z) + d_rh * reset + d_gates @ u[:, : 2 * n].T
        inputs.append(g_in)
        recurrent.append(g_u)
        bias.append(g_bias)
    return loss, [*inputs, *recurrent, *bias, np.einsum("tbh,tbl->hl", both, delta), delta.sum((0, 1))]


def train(segments: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 3) -> Network:
    """A network fitted to segments (N x SEGMENT bytes) and their languages (indices): cross entropy of each byte's label."""
    net = new_network(languages)
    r = np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    slots = net.parameters()
    first, second = [np.zeros_like(p) for p in slots], [np.zeros_like(p) for p in slots]
    for step in range(steps):
        picked = np.concatenate([r.choice(own, max(1, batch // len(languages))) for own in by_label if len(own)])
        grads = gradients(net, np.ascontiguousarray(segments[picked].T), labels[picked])[1]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (steps - step) / steps)
        for k, slot in enumerate(slots):
            g = grads[k] * min(1.0, 1.0 / (size + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.005 * (g * g - second[k])
            slot -= (pace * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.995 ** (step + 1))) + 1e-8)).astype(np.float32)
    return net


def segments_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(N x SEGMENT lower-cased bytes, owner) of texts; the last segment of a text is filled with spaces."""
    count = -(-(ends - starts) // SEGMENT)
    owner = np.repeat(np.arange(len(starts)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (starts[owner] + within * SEGMENT)[:, None] + np.arange(SEGMENT)
    inside = at < ends[owner][:, None]
    out = np.full(at.shape, 32, np.uint8)
    out[inside] = _LOWER[data[at[inside]]]
    return out, owner


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    """(texts x languages): mean label probabilities over the letters of each whole text; zeros where there is no letter byte."""
    raw, offsets = bytehash.column_bytes(column)
    total = np.zeros((len(column), len(net.languages)))
    weight = np.zeros(len(column))
    for i, j in bytehash.groups(offsets, 1 << 18):
        segments, owner = segments_of(raw, offsets[i:j], offsets[i + 1 : j + 1])
        for k in range(0, len(segments), 4096):
            part, whose = segments[k : k + 4096], owner[k : k + 4096]
            x = np.ascontiguousarray(part.T)
            p = _run(net, 0, x) @ net.out[: net.out.shape[0] // 2]
            p += _run(net, 1, x) @ net.out[net.out.shape[0] // 2 :]
            p += net.out_bias
            p = _softmax(p)
            letters = _LETTER[x]
            p *= letters[:, :, None]
            summed = p.sum(0, dtype=np.float64)
            first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            total[i + whose[first]] += np.add.reduceat(summed, first)
            weight[i + whose[first]] += np.add.reduceat(letters.sum(0), first)
    return total / np.maximum(weight, 1)[:, None]


def fit(documents: DataFrame) -> Network | None:
    """A network from the text and lang of documents outside the held-out fourth; None where no such row has a language and letters.

    Languages beyond the MAX_LANGUAGES most frequent are not learned. A repeated id is one text of a language.
    """
    known = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= MAX_BYTES))
    counted = known.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("doc_id", 0.05).alias("ids"))
    # Of distinct ids, with some to spare; of those that come the first are taken.
    shares = counted.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang", (F.lit(1.3 * ROWS_PER_LANGUAGE) / F.col("ids")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 52)) / F.lit(1 << 52)
    chosen = known.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(shares), "lang").filter("place < share")
    by_lang: dict = {}
    for r in sorted(one_text(chosen, "doc_id", "lang", "place").collect(), key=lambda r: (r["place"], r["doc_id"])):
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], r["lang"], r["text"]))
    rows = sorted(r for some in by_lang.values() for r in some[:ROWS_PER_LANGUAGE])
    languages = sorted({lang for _, lang, text in rows if _HAS_LETTER.search(text)})
    if not languages:
        return None
    del chosen
    raw, offsets = bytehash.column_bytes(pa.array([t for _, _, t in rows], pa.large_string()))
    segments, owner = segments_of(raw, offsets[:-1], offsets[1:])
    index = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([index.get(lang, -1) for _, lang, _ in rows])[owner]
    full = (_LETTER[segments].mean(axis=1) > 0.3) & (labels >= 0)
    return train(segments[full], labels[full], languages) if full.any() else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): one row per row of docs; score is the pooled probability of lang_pred.

    A null text, and one without a letter, is `und` with score 0, as is every text where there is no network.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            p = probabilities(net, column) if net else np.zeros((len(column), 1))
            best = p.argmax(axis=1)
            langs, scores = [], []
            for k in range(0, len(column), 500):
                for m, text in enumerate(column.slice(k, 500).to_pylist(), k):
                    lettered = net is not None and bool(text) and p[m, best[m]] > 0 and bool(_HAS_LETTER.search(text))
                    langs.append(net.languages[best[m]] if lettered else UNKNOWN)
                    scores.append(min(1.0, float(p[m, best[m]])) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def op8_bigru_language(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
