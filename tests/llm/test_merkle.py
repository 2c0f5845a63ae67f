"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from granary.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, node string, i long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[1], row[2], row[3], text)))


def climb(nodes, fan=16):
    """(root, proofs): for each node its steps (left, right) to the root."""
    ways, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), fan):
            run = nodes[a : a + fan]
            for k in range(len(run)):
                for o in owners[a + k]:
                    ways[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append([o for os in owners[a : a + fan] for o in os])
        nodes, owners = above, held
    return nodes[0], ways


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, over = climb([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, up in zip(sources, over):
        for (_, _, leaf, r), way in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            way = way + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else leaf
            for a, b in way:
                node = sha(a + node + b)
            out.append((r[0], leaf, trees[s][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=str)


def found(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = merkle.op11_merkle_blocks(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(r, sizes):
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            k = r.randrange(10**6)
            rows.append((k, s, r.choice(("en", "de", None)), k % 7 or None, r.choice((f"Text {k} É", f"text {k}", "", None, "漢A" * (k % 5)))))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 17}, {"b": 257, "a": 1, "é": 2, "": 256}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_equals_a_plain_tree(spark, tmp_path, sizes):
    rows = made(random.Random(len(sizes)), sizes)
    assert found(spark, tmp_path, rows) == plain(rows)


def test_repeats_nulls_long_texts_and_three_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "DEPTH", 1)
    r = random.Random(3)
    rows = made(r, {"a": 700, None: 30, "b": 15})
    rows += rows[:60] + [(5, "a", "en", 1, "Ä B" * 300_000)] + [(None, "a", None, None, None)] * 40 + [(None, None, None, None, "A")] * 3 + [(7, "a", "en", k, f"T{k}") for k in range(40)]
    got = found(spark, tmp_path, rows)
    assert got == plain(rows)
    assert {x[6] for x in got} == {True, False} and len({x[3] for x in got}) == 1


def test_no_rows(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_nothing_is_tampered_with_without_replacements(spark):
    rows = [(k, f"s{k % 3}", "t") for k in range(50)]
    got = merkle.manifest(spark.createDataFrame(rows, "id long, src string, text string"), "src", "id", ["id", "text"]).collect()
    assert len(got) == 50 and all(x["verified"] for x in got)
