"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are composed when the vocabulary is read, into one table of states: the normaliser (a space reads as U+2581, and one is
written before the text), the pieces (a trie whose arcs read characters and whose ends write a piece at its weight), and byte
fallback (a character that is no piece writes its UTF-8 bytes, at a weight). States are rows of sorted arrays: (state, character) to state.
Composed with an input, the table gives a lattice; relaxing its arcs position by position in the tropical semiring (weights add along a
path, the least total wins) leaves each position one weight and one back-pointer, and the back-pointers from the end are the encoding.

Weights are numbers. A unigram vocabulary's arcs weigh the negated log probabilities of their pieces. A BPE vocabulary has no piece weights whose
least sum is the result of merging, so its arcs weigh 0 and a pair of neighbours weighs 0 if merging their joined text gives just these two,
else infinity: the one path of weight 0 is the result of merging, and so is its part up to each of its positions, which is why one state a
position is enough. A pair's weight is found by undoing the last merges on both sides of the border, and kept in a table of fixed size.

No piece holds a character before U+2581, or a line feed, so the lattice is cut there, and equal segments of a batch are encoded once, all
together: numpy walks the table for all positions of all segments at once, and relaxes the arcs of all segments that start at one offset. Segments
of over LONG characters go through the same relaxation one by one. What is held at a time is bounded in bytes, whatever the texts are.
The vocabulary is read from a file of a public tokenizer, whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import map_batches, table

SPACE = "▁"
#: Slots of the table of pair weights (9 bytes each), and characters of distinct segments that are encoded together.
SLOTS, BLOCK = 1 << 20, 400_000
#: A segment of more characters is relaxed by itself.
LONG = 200
#: Bytes of texts of a batch that are worked on together (a longer text is alone).
BATCH_BYTES = 2 << 20
#: What a character that is no piece weighs above the heaviest piece of a unigram vocabulary.
UNKNOWN_WEIGHT = 10.0

_SEGMENT = re.compile(f"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from the model file (the protocol buffer's fields 1.1, 1.2 and 1.3)."""
    data = open(path, "rb").read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        while at < end:
            key, at = varint(at)
            kind = key & 7
            if kind == 0:
                start, at = at, varint(at)[1]
            elif kind == 2:
                n, start = varint(at)
                at = start + n
            else:
                start, at = at, at + (4 if kind == 5 else 8)
            yield key >> 3, kind, start, at

    pieces = []
    for number, kind, start, end in fields(0, len(data)):
        if number == 1 and kind == 2:
            piece, score, type_ = "", 0.0, 1
            for f, _, s, e in fields(start, end):
                if f == 1:
                    piece = data[s:e].decode()
                elif f == 2:
                    score = float(np.frombuffer(data[s:e], "<f4")[0])
                elif f == 3:
                    type_ = varint(s)[0]
            pieces.append((piece, score, type_))
    return pieces


class Transducer:
    """Encoder and decoder for one vocabulary. merging: whether pairs weigh what merging says (BPE), or pieces their scores (unigram)."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None, merging: bool = True):
        self.pieces, self.merging = pieces if pieces is not None else read_vocabulary(path), merging
        normal = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == 1}
        self.byte = {int(p[3:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == 6}
        self.text = [p if t == 1 else "" for p, _, t in self.pieces]
        self.of_byte = {i: b for b, i in self.byte.items()}
        #: The text of a piece, or of a byte that is a character; None for other bytes.
        self.plain = [t if k != 6 else chr(self.of_byte[i]) if self.of_byte[i] < 128 else None for i, (t, k) in enumerate(zip(self.text, (p[2] for p in self.pieces), strict=True))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal) or len(self.byte) != 256:
            raise ValueError("segments can't be cut at U+2581 and line feeds with this vocabulary")
        self._compile(normal)
        self.rank = {p: (-self.pieces[i][1], i) for p, i in normal.items()} if merging else {}
        self._derive() if merging else None
        self.keys, self.free = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _compile(self, normal: dict[str, int]) -> None:
        """The composed table: self.arcs (sorted keys, next states), self.written (the piece that a state ends, or -1) and self.weight by piece; the
        last entry of weight is that of byte fallback."""
        characters = sorted({c for p in normal for c in p})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(characters, 1):
            self.classes[ord(c)] = k
        self.classes[ord(" ")] = self.classes[ord(SPACE)]  # the normaliser
        self.width = len(characters) + 1
        arcs: dict[int, int] = {}
        written = [-1]
        for p, i in normal.items():
            state = 0
            for c in p:
                key = state * self.width + int(self.classes[ord(c)])
                state = arcs.get(key, 0)
                if not state:
                    written.append(-1)
                    state = arcs[key] = len(written) - 1
            written[state] = i
        keys = np.fromiter(arcs.keys(), np.int64, len(arcs))
        order = np.argsort(keys)
        self.by_key = arcs
        self.arc_keys, self.arc_to = keys[order], np.fromiter(arcs.values(), np.int32, len(arcs))[order]
        # A state's arcs by character class are looked up by key; from the first state, and for a second character, by a dense table.
        self.first = np.zeros(self.width, np.int32)
        for k in range(1, self.width):
            self.first[k] = arcs.get(k, 0)
        self.written = np.array(written, np.int32)
        scores = np.array([0.0 if self.merging or t != 1 else -s for _, s, t in self.pieces])
        self.weight = np.r_[scores, 0.0 if self.merging else float(scores.max()) + UNKNOWN_WEIGHT]

    def merged(self, text: str) -> list[str]:
        """The text's parts after merging the neighbours of least rank, the first of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _derive(self) -> None:
        """self.halves: by piece, the texts of which its last merge makes it; None for a character, False for a piece that merging never gives."""
        self.halves: list = [None] * len(self.pieces)
        for p, (_, i) in self.rank.items():
            if len(p) < 2:
                continue
            parts = list(p)
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r[0] < best):
                        best, at = r[0], k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[i] = tuple(parts) if len(parts) == 2 else False

    def may_follow(self, x: str, y: str) -> bool:
        """Whether merging x + y gives just x and y, each of which merging gives by itself.

        The merges that make x and y happen by rank. A merge across the border would have to come before the merge that took away its
        part of the border, so the last merges are undone one by one, the later first, and no part that comes to light may merge across.
        """
        rank, halves = self.rank, self.halves
        a, b = rank.get(x), rank.get(y)
        if a and halves[a[1]] is False or b and halves[b[1]] is False:
            return False
        limit = (float("inf"), 1)  # the merge undone last: its rank, and whether it lies right of the border
        while True:
            across = rank.get(x + y)
            # Of merges of equal rank the first place in the text comes first: what is left of the border comes before what crosses it.
            if across and (across[0], 0.5) < limit:
                return False
            made_x, made_y = halves[a[1]] if a else None, halves[b[1]] if b else None
            if not made_x and not made_y:
                return True
            if made_x and (not made_y or (a[0], 0) > (b[0], 1)):
                limit, x = (a[0], 0), made_x[1]
                a = rank.get(x)
            else:
                limit, y = (b[0], 1), made_y[0]
                b = rank.get(y)

    def _texts(self, arc: int, character: str) -> str:
        return character if arc == len(self.pieces) else self.text[arc]

    def _pairs(self, first: np.ndarray, second: np.ndarray, characters) -> np.ndarray:
        """Whether each pair of arcs may be neighbours. An arc of byte fallback that a piece's text could merge with is told by its character:
        characters(k) gives those of pair k."""
        key = first * (len(self.pieces) + 1) + second
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        free = self.free[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            odd = (first[missing] == len(self.pieces)) | (second[missing] == len(self.pieces))
            for k in missing[odd].tolist():
                x, y = characters(k)
                free[k] = self.may_follow(self._texts(int(first[k]), x), self._texts(int(second[k]), y))
            plain = missing[~odd]
            some, where = np.unique(key[plain], return_inverse=True)
            text, count = self.text, len(self.pieces) + 1
            found = np.fromiter((self.may_follow(text[a // count], text[a % count]) for a in some.tolist()), bool, len(some))
            free[plain] = found[where]
            self.keys[slot[plain]], self.free[slot[plain]] = key[plain], free[plain]
        return free

    def _lattice(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, arc) of the arcs of segments that stand one behind the other; left: characters from each on to its segment's end."""
        classes = self.classes[codes]
        at = np.arange(len(codes))
        state = self.first[classes]
        single = self.written[state] >= 0
        single[state == 0] = False
        out = [(at[~single], at[~single] + 1, np.full(int((~single).sum()), len(self.pieces), np.int32)), (at[single], at[single] + 1, self.written[state[single]])]
        size = 1
        while True:
            go = (state > 0) & (left[at] > size)
            at, state = at[go], state[go]
            if not len(at):
                break
            key = state.astype(np.int64) * self.width + classes[at + size]
            place = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            state = np.where(self.arc_keys[place] == key, self.arc_to[place], 0)
            size += 1
            full = (state > 0) & (self.written[state] >= 0)
            out.append((at[full], at[full] + size, self.written[state[full]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _relax(self, segments: list[str]) -> list[bytes]:
        """Ids (int32, little-endian) along the shortest path of each segment: all together, offset by offset."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(s) for s in segments])
        begin = np.r_[0, np.cumsum(sizes)]
        offset = np.arange(len(codes)) - np.repeat(begin[:-1], sizes)
        start, end, arc = self._lattice(codes, np.repeat(sizes, sizes) - offset)
        # Positions: a segment of n characters has n + 1 of them.
        owner = np.repeat(np.arange(len(segments)), sizes)
        place, whose = offset[start], owner[start]
        start, end = start + whose, end + whose
        origin = begin[:-1] + np.arange(len(segments))
        order = np.argsort(place, kind="stable")
        start, end, arc, place = start[order], end[order], arc[order], place[order]
        weight = np.full(len(codes) + len(segments), np.inf)
        back = np.full(len(weight), -1, np.int32)
        weight[origin] = 0.0
        bounds = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)]
        text = None
        for k in range(len(bounds) - 1):
            some = slice(bounds[k], bounds[k + 1])
            s, e, a = start[some], end[some], arc[some]
            total = weight[s] + self.weight[a]
            if self.merging and k:
                last = back[s]

                def characters(n: int, s=s) -> tuple[str, str]:
                    nonlocal text
                    if text is None:
                        text = "\n".join(segments)
                    return text[s[n] - 1], text[s[n]]

                total[~self._pairs(last.astype(np.int64), a.astype(np.int64), characters)] = np.inf
            # The least weight into each position wins; of equal ones the arc from the left, as those were relaxed before.
            better = total < weight[e]
            s, e, a, total = s[better], e[better], a[better], total[better]
            weight[e], back[e] = total, a
        return self._follow(segments, origin, sizes, back)

    def _follow(self, segments: list[str], origin: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> list[bytes]:
        """The ids that the back-pointers from each segment's end give."""
        lengths = np.r_[[len(t) for t in self.text], 1]
        at, live = origin + sizes, np.arange(len(segments))
        steps = []
        while len(live):
            arc = back[at[live]]
            if (arc < 0).any():
                raise RuntimeError("a segment has no path of finite weight")
            steps.append((live, arc))
            at[live] -= lengths[arc]
            live = live[at[live] > origin[live]]
        if not steps:
            return [b""] * len(segments)
        whose, arcs = np.concatenate([x for x, _ in steps])[::-1], np.concatenate([x for _, x in steps])[::-1]
        order = np.argsort(whose, kind="stable")
        arcs = np.ascontiguousarray(arcs[order].astype("<i4"))
        ends = np.cumsum(np.bincount(whose, minlength=len(segments)))
        data, odd = arcs.tobytes(), set(whose[order][arcs == len(self.pieces)].tolist())
        out = [data[4 * (a) : 4 * b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        for k in odd:
            out[k] = self._with_bytes(segments[k], np.frombuffer(out[k], "<i4").tolist())
        return out

    def _with_bytes(self, segment: str, arcs: list[int]) -> bytes:
        """The ids of arcs, with the bytes of the characters that are no piece."""
        ids, at = array("i"), 0
        for arc in arcs:
            if arc == len(self.pieces):
                ids.extend(self.byte[b] for b in segment[at].encode("utf-8", "surrogatepass"))
                at += 1
            else:
                ids.append(arc)
                at += len(self.text[arc])
        return ids.tobytes()

    def shortest_path(self, segment: str) -> bytes:
        """Ids (int32, little-endian) of one segment: the same relaxation, character by character, for segments of any length."""
        n, count, width, go, written = len(segment), len(self.pieces), self.width, self.by_key, self.written
        classes = self.classes[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        weight, back = [float("inf")] * (n + 1), array("i", [-1]) * (n + 1)
        weight[0] = 0.0
        cost, known = self.weight, {}
        normal = segment.replace(" ", SPACE)
        for at in range(n):
            here, last = weight[at], back[at]
            if here == float("inf"):
                continue
            state, end, arcs = 0, at, []
            while end < n and (state := go.get(state * width + classes[end], 0)):
                end += 1
                if written[state] >= 0:
                    arcs.append((end, int(written[state])))
            if not arcs or arcs[0][0] > at + 1:
                arcs.insert(0, (at + 1, count))
            for end, arc in arcs:
                total = here + cost[arc]
                if total >= weight[end]:
                    continue
                if self.merging and at:
                    key = (last, arc, normal[at - 1] if last == count else "", normal[at] if arc == count else "")
                    free = known.get(key)
                    if free is None:
                        free = self.may_follow(self._texts(last, key[2]), self._texts(arc, key[3]))
                        if len(known) < SLOTS:
                            known[key] = free
                    if not free:
                        continue
                weight[end], back[end] = total, arc
        arcs, at = [], n
        while at:
            arcs.append(back[at])
            at -= 1 if back[at] == count else len(self.text[back[at]])
        return self._with_bytes(segment, arcs[::-1])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (int32, little-endian) of whole texts; of the empty one none."""
        cut = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        known: dict[str, bytes] = {}
        block, held = [], 0
        for s in set().union(*cut):
            if len(s) > LONG:
                known[s] = self.shortest_path(s)
                continue
            block.append(s)
            held += len(s)
            if held >= BLOCK:
                known.update(zip(block, self._relax(block), strict=True))
                block, held = [], 0
        known.update(zip(block, self._relax(block), strict=True) if block else ())
        return [b"".join([known[s] for s in found]) for found in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; U+2581 comes back as the space that it stands for."""
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids]).replace(SPACE, " ")[1:]
        except TypeError:  # a byte of a longer character
            pass
        out, run = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(plain[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _id_lists(encoded: list[bytes | None]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(x or b"") // 4 for x in encoded])].astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x or b"" for x in encoded), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in encoded], pa.bool_()))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches of about BATCH_BYTES of the texts in a column, with those texts."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BATCH_BYTES, "right")))
            part = batch.slice(i, j - i)
            yield part, part.column(at).to_pylist()
            i = j


def _encode_rows(machine: Transducer, texts: list[str | None]) -> list[bytes | None]:
    found = iter(machine.encode_all([t for t in texts if t is not None]))
    return [None if t is None else next(found) for t in texts]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per row of docs, the piece ids of its whole text.

    A null text has null, an empty one an empty list. Repeated rows keep a row each, null ids too; other columns are not read. A text of any length
    is one row. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part, texts in _parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(_encode_rows(machine, texts))], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): one row per row of encoded, the text of its ids. A null list has null, an empty one the empty text. No rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return map_batches(encoded.select(id_col, ids_col), run, schema)


def op4_piece_transducer(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of the ids as little-endian int32), byte_ids, exact (the ids decode to the text)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        low, high = min(machine.of_byte), max(machine.of_byte)
        for batch, texts in _parts(batches, 1):
            rows = []
            for text, held in zip(texts, _encode_rows(machine, texts), strict=True):
                if held is None:
                    rows.append((0, 0, 0, True))
                    continue
                ids = np.frombuffer(held, np.int32)
                rows.append((len(ids), zlib.crc32(held), int(((ids >= low) & (ids <= high)).sum()), machine.decode(ids.tolist()) == text.replace(SPACE, " ")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "byte_ids", "exact"])

    kinds = (("doc_id", T.LongType()), ("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("byte_ids", T.LongType()), ("exact", T.BooleanType()))
    return map_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), run, T.StructType([T.StructField(*k) for k in kinds]))
