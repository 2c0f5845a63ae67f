"""Word hashes, ProbMinHash sketches and near duplicates."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import bytehash, near_dedup
from granary.llm.components import connected_components

TEXT = st.text(st.sampled_from(list("ab \n\té漢😀")), max_size=40)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_and_their_hashes(texts, limit):
    raw, offsets = bytehash.column_bytes(pa.array(texts, pa.string()))
    found, of = [], {}
    for i, j in bytehash.groups(offsets, limit):
        buf, starts = bytehash.padded(raw, offsets, i, j)
        s, e = bytehash.words(buf)
        for h, a, b, k in zip(bytehash.span_hashes(buf, s, e), s, e, np.searchsorted(starts, s, "right") - 1):
            word = bytes(buf[a:b]).decode()
            found.append((i + int(k), word))
            assert of.setdefault(word, int(h)) == int(h)
    assert found == [(k, w) for k, t in enumerate(texts) for w in words_of(t)]
    assert len(set(of.values())) == len(of)


def test_a_text_of_many_slices_hashes_as_its_words_do():
    words = [f"w{k}" * (k % 7 + 1) for k in range(60_000)] + ["x" * 1_500_000]
    raw, offsets = bytehash.column_bytes(pa.array([" ".join(words)]))
    buf, _ = bytehash.padded(raw, offsets, 0, 1)
    s, e = bytehash.words(buf)
    h = bytehash.span_hashes(buf, s, e)
    assert len(h) == len(words)
    for k in (0, 59_999, 31_000, 60_000):
        alone, _ = bytehash.padded(*bytehash.column_bytes(pa.array([words[k]])), 0, 1)
        assert bytehash.span_hashes(alone, *bytehash.words(alone))[0] == h[k]


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = bytehash.mix(np.arange(1, 401, dtype=np.uint64))
    wx, wy = rng.gamma(1.0, size=400) * (rng.random(400) < 0.8), rng.gamma(1.0, size=400) * (rng.random(400) < 0.8)
    both = np.flatnonzero((wx > 0) & (wy > 0))
    truth = sum(1 / np.maximum(wx / wx[i], wy / wy[i]).sum() for i in both)
    k = 4096
    hs = np.concatenate([pool[wx > 0], pool[wy > 0]])
    ws = np.concatenate([wx[wx > 0], wy[wy > 0]])
    own = np.repeat([0, 1], [(wx > 0).sum(), (wy > 0).sum()])
    sketch = near_dedup.prob_minhash(hs, ws, own, 2, k)
    assert abs((sketch[0] == sketch[1]).mean() - truth) < 4 * (truth * (1 - truth) / k) ** 0.5
    # A sketch depends neither on the order of the elements, nor on what else is sketched, nor on the scale of the weights.
    order = rng.permutation((wx > 0).sum())
    alone = near_dedup.prob_minhash(pool[wx > 0][order], 8 * wx[wx > 0][order], np.zeros(len(order), np.int64), 1, k)
    assert (alone[0] == sketch[0]).mean() > 0.999


def classes_by_force(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and jaccard(x, y) >= 0.8 for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def row_classes(rows):
    """(class of each row, least id of each class that has one) of (id, text): classes are of texts, named by their least row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    classes, least = [find(k) for k in range(len(rows))], {}
    for c, (i, _) in zip(classes, rows):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return classes, least


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(3000)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(6, 150))] for _ in range(25)]
    rows = []
    for k in range(260):
        text = list(bases[r.randrange(25)] if r.random() < 0.8 else [r.choice(vocabulary) for _ in range(40)])
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((k * 3, r.choice((" ", "  ", "\n")).join(text)))
    rows += [(1000, None), (1001, None), (1002, ""), (1003, " \n"), (1004, "one two"), (1005, "one  two "), (1006, "one two three"), (None, "one two"), (3, rows[40][1]), (1007, rows[0][1]), (1007, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = [tuple(x) for x in near_dedup.near_duplicates(docs).collect()]
    classes, least = row_classes(rows)
    assert sorted(found, key=str) == sorted(((i, least.get(c)) for (i, _), c in zip(rows, classes)), key=str)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(least.values())


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(5000)]
    base, passage = [r.choice(vocabulary) for _ in range(140)], [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 4))):
            text[r.randrange(140)] = r.choice(vocabulary)
        rows.append((k, " ".join(text)))
    rows += [(k, " ".join([r.choice(vocabulary) for _ in range(50)] + passage + [r.choice(vocabulary) for _ in range(50)])) for k in range(300, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()}
    assert found == classes_by_force(rows)


def test_large_buckets_are_compared_in_cells_and_blocks(spark):
    """A passage that many texts share and that most of their registers lie in, and copies just under and over the similarity; blocks of few members."""
    r = random.Random(12)
    word = lambda: f"u{r.randrange(10**7)}"
    passage = [word() for _ in range(80)]
    rows = [(k, " ".join(passage + [word() for _ in range(r.choice((30, 40, 50)))])) for k in range(150)]
    base = [word() for _ in range(140)]
    for k in range(150, 330):
        text = list(base)
        for _ in range(r.choice((2, 3, 4, 5, 6))):
            text[r.randrange(140)] = f"e{r.randrange(40)}"
        rows.append((k, " ".join(text)))
    rows += [(k, rows[k - 330][1] + " end") for k in range(330, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_force(rows)
    seen = []
    original = near_dedup._mixed
    near_dedup._mixed = lambda members, place: seen.append((place, members.count())) or original(members, place)
    try:
        found = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs, block=16).collect()}
    finally:
        near_dedup._mixed = original
    assert found == want and len(set(want.values())) > 50
    assert found == {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()}


def test_pairs_of_blocks_meet_once(spark):
    """All pairs of different classes of a cell of many blocks, each once; and no task gets more than a block of either side."""
    keys, bits = list(range(100, 148)), [0] * (near_dedup.PLANES * 6)
    labelled = spark.createDataFrame([(100, 0, d, d % 7) for d in range(90)], "key long, band int, doc long, class long")
    sketches = spark.createDataFrame([(d, keys, bits) for d in range(90)], "doc long, keys array<long>, bits array<long>")
    for block in (8, 200):
        got = sorted(tuple(x) for x in near_dedup._apart(labelled, sketches, 336, 0.8, block).collect())
        assert got == [(a, b) for a in range(90) for b in range(a + 1, 90) if a % 7 != b % 7]


def test_pairs_that_share_one_band_meet_however_large_its_bucket_is(spark):
    """Buckets of more members than a block, whose members share no other band; one class has most of the members of the second bucket."""
    bits = [0] * (near_dedup.PLANES * 6)
    rows = [(100, 3, d, d) for d in range(30)] + [(200, 5, d, 40 if d < 75 else d) for d in range(40, 80)]
    labelled = spark.createDataFrame(rows, "key long, band int, doc long, class long")
    sketches = spark.createDataFrame([(d, [key if j == band else 1000 * d + j + 1000 for j in range(48)], bits) for key, band, d, _ in rows], "doc long, keys array<long>, bits array<long>")
    want = sorted((a, b) for (k, _, a, x), (m, _, b, y) in itertools.combinations(rows, 2) if k == m and x != y)
    for block in (1, 4, 8, 200):
        got = sorted(tuple(x) for x in near_dedup._apart(labelled, sketches, 336, 0.8, block).collect())
        assert got == want, block


def one_band_rows():
    """Forty texts of one passage that are no near copies of each other, each with two near copies."""
    r = random.Random(31)
    word = lambda: f"z{r.randrange(10**7)}"
    passage, rows = [word() for _ in range(60)], []
    for k in range(40):
        text = passage + [word() for _ in range(40)]
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join([*text, "end"])), (3 * k + 2, " ".join(["start", *text]))]
    return rows


def test_classes_do_not_depend_on_the_size_of_a_block(spark):
    """With one band all pairs share at most one."""
    rows = one_band_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs, bands=1, rows=1, block=block).collect()} for block in (4, 2048)]
    assert found[0] == found[1] and len(set(found[1].values())) < len(rows) / 2


def test_copies_of_which_one_repeats_a_passage(spark):
    r = random.Random(5)
    rows = []
    for k in range(40):
        text = [f"p{k}x{r.randrange(10**6)}" for _ in range(200)]
        copy = list(text)
        for _ in range(2 * (k % 2)):
            copy[r.randrange(200)] = f"e{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy + copy[:60] * 50))]
    want = classes_by_force(rows)
    assert len(set(want.values())) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()} == want


def test_an_empty_table_and_one_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    long = " ".join(f"t{k % 977}x{k % 1009}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 2_000_000)], "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(200, k) for k in range(201, 260)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 7), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {x.node: x.component for x in found.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
