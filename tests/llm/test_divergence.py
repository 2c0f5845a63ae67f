"""Divergence of sources against a plain count with Python's integers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, value long, item string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == lang]
        seen = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least)
        sources = sorted({x[1] for x in mine}, key=lambda s: s.encode())
        counts = {s: Counter(t for _, o, ts in mine if o == s for t in ts if seen[t] >= least) for s in sources}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(counts[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.divergence(df, **how).collect())


WORDS = ["a", "the", "Über", "漢字", "x1y", "don't", "É", "naïve", "AbC", "ﬀ", "\U0001d400b", "z"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_count(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(("en", "en", "de", None, "")), r.choice(("s1", "s2", "é", "z", None)), r.choice((None, "", "12 - 34")) if r.random() < 0.1 else " ".join(r.choices(WORDS, weights=range(12, 0, -1), k=r.randrange(30)))) for _ in range(150)]
    rows += [("fr", "only", "un deux")] * 3 + [("it", "a", "raro"), ("it", "b", "unico"), ("it", "c", None)] + [("en", "long", "word " * 200_000)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_docs=10, top=2) == plain(rows, 10, 2)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(c, n, v) for c in (0, 5, 9223372035, 9223372036, 10**13, 3 * 10**15 + 7) for n in (c + 1, 4 * 10**15 + 1) for v in (1, 12345)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(x.p == 1 + 10**9 * (x.c + 1) // (x.n + x.v) for x in df.collect())


def test_no_python_in_the_plan(spark):
    rows = [(1, "en", "a", "x y z", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = divergence.term_counts(docs, docs.selectExpr("lang", "source", "0 AS at"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
