"""Weak labels, quality rules, the quality classifier, toxicity and language identification."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import language_id, quality_model, quality_rules, toxicity, weak_labels

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "a", "é" * 30, "word " * 5000, "x" * 300_000, "#" * 1000, "one two three four five six seven eight one two three four five six seven eight", "l\nl\n\nl\n \n l"]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_expectation_maximisation_finds_accuracies():
    r = random.Random(2)
    rates = [(0.9, 0.05), (0.7, 0.02), (0.5, 0.1), (0.8, 0.03), (0.3, 0.01)]  # bad votes in the bad and the good class
    patterns, truth = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for _ in range(30_000):
        good = r.random() < 0.85
        code = 0
        for k, (bad_rate, false_rate) in enumerate(rates):
            bad = r.random() < (false_rate if good else bad_rate)
            code += (weak_labels.BAD if bad else weak_labels.GOOD if r.random() < 0.8 else weak_labels.ABSTAIN) * 3**k
        patterns[code] += 1
        truth[code][good] += 1
    model = weak_labels.fit(dict(patterns), len(rates))
    assert abs(model.good - 0.85) < 0.03
    for k, (bad_rate, false_rate) in enumerate(rates):
        assert abs(model.chance[0][k][weak_labels.BAD] - bad_rate) < 0.08 and abs(model.chance[1][k][weak_labels.BAD] - false_rate) < 0.03
    right = sum(t[model.posterior(c) >= 0.5] for c, t in truth.items())
    assert right / 30_000 > 0.95 and all(0 <= a <= 1 for a in model.accuracy())
    start = weak_labels.fit({}, 3)
    assert all(math.isfinite(w) for row in start.weights() for w in row)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_rules_count_as_brute_force_does(spark):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a ", "b ", "c\n", "# ", "d e f g h i j k ", "é|", "\t"]) for _ in range(r.randint(1, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_words int, h int")
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x, want = got[k], counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert x.base_failed == failed and not (failed and x.kept)


def test_the_posterior_in_the_plan_is_the_models(spark):
    measured = quality_rules.measures(spark.read.parquet(f"{SF}/documents.parquet")).persist()
    model = quality_rules.fit(measured)
    code = sum((quality_rules._vote(r) * 3**k for k, r in enumerate(quality_rules.RULES)), 0)
    for x in measured.select(code.alias("c"), quality_rules.posterior(model).alias("p")).distinct().collect():
        assert abs(model.posterior(x.c) - x.p) < 1e-9
    measured.unpersist()


def test_rules_use_no_python_on_the_executors(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("judged", ["rules", "model"])
def test_poor_documents_go_and_good_ones_stay(spark, judged):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    if judged == "rules":
        kept = {x.doc_id: x.kept or (x.base_failed and label.get(x.doc_id) == 1) for x in quality_rules.judge(docs).collect()}
    else:
        kept = {x.doc_id: x.kept for x in quality_model.op3_weak_label_quality(spark, SF).collect()}
    good, poor = [kept[i] for i, q in label.items() if q == 1], [kept[i] for i, q in label.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(poor) / len(poor) < 0.05


def test_the_quality_model_on_odd_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(ODD)] + [(None, "a b", 0.1)], "doc_id long, text string, score double")
    model = quality_model.fit(docs)
    got = {x.doc_id: x for x in quality_model.quality(docs, model).collect()}
    assert len(got) == len(ODD) + 1 and [got[k].score for k in range(3)] == [0.0, 0.0, 0.0]
    empty = docs.limit(0)
    assert quality_model.fit(empty) is None
    assert quality_model.quality(empty, None).count() == 0
    assert quality_model.without_poor(docs).columns == docs.columns


def test_scores_do_not_depend_on_batches():
    texts = ["the cat sat on the mat", "", "###", "the " * 400, None, "dog"]
    rng = np.random.default_rng(0)
    model = rng.standard_normal(1 << quality_model.BITS), 0.1, 1.0
    whole = quality_model.scores_of(pa.array(texts, pa.string()), model)
    single = np.concatenate([quality_model.scores_of(pa.array([t], pa.string()), model) for t in texts])
    assert np.allclose(whole, single)


def test_toxicity_on_held_out_documents(spark):
    label = {x.doc_id: x.toxic for x in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    lang = {x.doc_id: x.lang for x in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    got = toxicity.op5_compression_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(lang) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) and x.held_out == held_out(x.doc_id) for x in got)
    table = collections.Counter((label[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in label)
    assert table[1, 1] / (table[1, 1] + table[1, 0]) > 0.7 and table[0, 1] / (table[0, 1] + table[0, 0]) < 0.02


def test_toxicity_learns_words_and_stems():
    r = random.Random(5)
    words = ["".join(r.choice(("ba", "de", "li", "mo", "nu", "ro", "sa")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(900):
        text = [r.choice(words) for _ in range(60)]
        toxic = k % 9 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                text[r.randrange(60)] = r.choice(("vexed", "grumzt")) + r.choice(("", "ba", "nulide"))
        rows.append((k, " ".join(text), int(toxic)))
    train, rest = rows[:600], rows[600:]
    model = toxicity.fit(train, sum(x[2] for x in train), sum(1 - x[2] for x in train))
    scores = toxicity.score_texts(model, 0.1)([t for _, t, _ in rest])
    wrong = sum((s >= 0.3) != bool(y) for s, (_, _, y) in zip(scores, rest))
    assert wrong <= 6
    assert toxicity.fit([(1, "a b", 0)], 0, 1) is None and toxicity.fit([], 0, 0) is None


def test_toxicity_on_odd_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(ODD)] + [(None, "idiot", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model, base = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, model, base).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= x.score <= 1 for x in got)
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 1
    assert toxicity.toxicity(docs.limit(0), None, 0.0).count() == 0


def test_gradients_are_those_of_finite_differences():
    r = np.random.default_rng(1)
    net = language_id.new_network(["p", "q", "r"], hidden=4, seed=2)
    for name in ("inputs", "recurrent", "bias"):
        setattr(net, name, [w.astype(np.float64) + (0.1 * r.standard_normal(w.shape) if name == "bias" else 0) for w in getattr(net, name)])
    net.out, net.out_bias = net.out.astype(np.float64) * 5, net.out_bias.astype(np.float64)
    x, y = r.integers(97, 104, (9, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = language_id.gradients(net, x, y)
    assert len(grads) == len(net.parameters())
    for slot, grad in zip(net.parameters(), grads):
        places = [tuple(int(r.integers(97, 104)) if n == 256 else int(r.integers(n)) for n in slot.shape) for _ in range(25)]
        for at in places:
            kept, step = slot[at], 1e-6
            slot[at] = kept + step
            up = language_id.gradients(net, x, y)[0]
            slot[at] = kept - step
            down = language_id.gradients(net, x, y)[0]
            slot[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5 + 1e-3 * abs(grad[at]), (slot.shape, at)


def test_training_learns_an_order_of_letters():
    """Two languages that differ in the order of their letters only, which needs memory in either direction."""
    seg = np.array([[ord("ab"[(k + i) % 2]) if i % 2 else ord("aabb"[k % 4]) for k in range(64)] for i in range(200)], np.uint8)
    net = language_id.train(seg, np.arange(200) % 2, ["even", "odd"], steps=60, batch=40)
    p = language_id.probabilities(net, pa.array([bytes(s).decode() for s in seg[:10]]))
    assert [net.languages[k] for k in p.argmax(1)] == ["even", "odd"] * 5


def labels_of_bytes(net, segment):
    """Label probabilities of each byte of one segment, a byte and a unit at a time."""
    n, states = net.recurrent[0].shape[0], []
    for d in (0, 1):
        h, out = [0.0] * n, {}
        for t in range(len(segment)) if d == 0 else reversed(range(len(segment))):
            w, u, b = net.inputs[d][segment[t]].tolist(), net.recurrent[d].tolist(), net.bias[d].tolist()
            hard = lambda v: min(max(v / 4 + 0.5, 0.0), 1.0)
            z = [hard(w[k] + b[k] + sum(h[i] * u[i][k] for i in range(n))) for k in range(n)]
            reset = [hard(w[n + k] + b[n + k] + sum(h[i] * u[i][n + k] for i in range(n))) for k in range(n)]
            new = [math.tanh(w[2 * n + k] + b[2 * n + k] + sum(reset[i] * h[i] * u[i][2 * n + k] for i in range(n))) for k in range(n)]
            h = [h[k] + z[k] * (new[k] - h[k]) for k in range(n)]
            out[t] = h
        states.append(out)
    found = []
    for t in range(len(segment)):
        both = states[0][t] + states[1][t]
        logits = [sum(v * w for v, w in zip(both, net.out[:, c].tolist())) + float(net.out_bias[c]) for c in range(len(net.languages))]
        top = max(logits)
        found.append([math.exp(x - top) / sum(math.exp(v - top) for v in logits) for x in logits])
    return found


def test_pooled_probabilities_equal_brute_force():
    r = random.Random(3)
    net = language_id.new_network(["p", "q", "r"], seed=9)
    net.out *= 30
    texts = ["", "a", "Ab Cd", "1 2 3", None, "é漢 x", "".join(r.choice("abcdeé XYZ12.") for _ in range(200)), "z" * 64, "y" * 65]
    got = language_id.probabilities(net, pa.array(texts, pa.string()))
    for text, p in zip(texts, got):
        data = (text or "").encode()
        small = bytes(x + 32 if 65 <= x <= 90 else x for x in data)
        total, weight = [0.0] * 3, 0
        for at in range(0, len(small), language_id.SEGMENT):
            segment = small[at : at + language_id.SEGMENT].ljust(language_id.SEGMENT, b" ")
            for byte, q in zip(segment, labels_of_bytes(net, segment)):
                if 97 <= byte <= 122 or byte >= 128:
                    total, weight = [a + b for a, b in zip(total, q)], weight + 1
        assert np.allclose(p, np.array(total) / max(1, weight), atol=2e-4)


def test_scores_of_the_quality_scorer_equal_brute_force():
    r = random.Random(6)
    weights, bias, scale = np.random.default_rng(4).standard_normal(1 << quality_model.BITS), -0.2, 1.5
    texts = [t for t in ODD if t is None or len(t) < 2000] + ["".join(r.choice("ab é#\n") for _ in range(r.randint(1, 90))) for _ in range(40)]
    got = quality_model.scores_of(pa.array(texts, pa.string()), (weights, bias, scale))
    for text, score in zip(texts, got):
        data = (text or "").encode()
        if not re.search(rb"[^\x20\x09-\x0d]", data):
            assert score == 0
            continue
        long = data + b"\n\n"
        total = sum(weights[((long[k] << 16 | long[k + 1] << 8 | long[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality_model.BITS] for k in range(len(data)))
        assert abs(score - 1 / (1 + math.exp(-(total / (len(data) + 1) * scale + bias)))) < 1e-9


def toxic_rows(r, n):
    words = ["".join(r.choice(("ba", "de", "li", "mo", "nu", "ro", "sa")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(n):
        text = [r.choice(words) for _ in range(60)]
        if k % 9 == 0:
            for _ in range(r.randint(1, 3)):
                text[r.randrange(60)] = r.choice(("vexed", "grumzt")) + r.choice(("", "ba", "nulide"))
        rows.append((k, " ".join(text), int(k % 9 == 0)))
    return rows


def test_toxicity_scores_equal_brute_force():
    """Every distinct word compressed with either dictionary, afresh for each text."""
    import zstandard

    rows = toxic_rows(random.Random(8), 500)
    model = toxicity.fit(rows, sum(x[2] for x in rows), sum(1 - x[2] for x in rows))
    plain = zstandard.ZstdCompressionParameters.from_level(model.level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
    held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
    for d in held:
        d.precompute_compress(level=model.level)
    machines = [zstandard.ZstdCompressor(dict_data=d, compression_params=plain) for d in held]
    texts = [t for _, t, _ in rows[:60]] + [t for t in ODD if t is None or len(t) < 6000]
    for text, score in zip(texts, toxicity.score_texts(model, 0.5)(texts)):
        gains = []
        for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
            data = toxicity.CARRIER + b"".join(zlib.crc32(f" {word} "[i : i + 3].encode()).to_bytes(4, "little") for i in range(len(word)))
            gains.append(len(machines[0].compress(data)) - len(machines[1].compress(data)))
        reach = [g for g in gains if g >= model.gain]
        assert score == model.scores[min(3, len(reach)), bool(reach) and max(reach) > model.gain + 3]


def test_windows_are_counted_whole():
    """Evidence by plain counting; nothing but the size of a dictionary bounds it."""
    rows = toxic_rows(random.Random(5), 400)
    documents = [toxicity._stems(toxicity.text_windows(t, 1)) for _, t, _ in rows]
    hashes, count = toxicity.counted(iter(documents))
    plain = collections.Counter(w for d in documents for w in d)
    assert toxicity.named(iter(documents), hashes, count) == dict(plain)
    weights = {w: float(n) for w, n in plain.items()}
    small = toxicity.dictionary_of(weights, 400)
    heaviest = sorted(weights, key=lambda w: (-weights[w], w))
    assert len(small) == 400 + len(toxicity.CARRIER) and small[: -len(toxicity.CARRIER)].endswith(toxicity.widened(heaviest[0]))
    assert len(toxicity.dictionary_of(weights, 10**9)) == sum(len(toxicity.widened(w)) for w in weights) + len(toxicity.CARRIER)


def test_samples_are_bounded_however_ids_repeat(spark, monkeypatch):
    prose = lambda k: f"Some plain words of prose number {k}, as they are written by people who write, and by nobody else. " * 3
    poor = lambda k: f"### {k} $$$ @@ {k * 7} %% ^^ [[ ]] {{}} ~~ || BUY!!! NOW!!! {k} " * 5
    rows = [(None, prose(k)) for k in range(800)] + [(None, poor(k)) for k in range(200)] + [(5, prose(0))] * 600 + [(k, prose(k + 1000)) for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    monkeypatch.setattr(quality_model, "TRAIN_ROWS", 20)
    monkeypatch.setattr(quality_model, "train_scorer", lambda texts, labels: seen.append((len(texts), len(set(texts)))))
    quality_model.fit(docs)
    assert seen and all(10 <= n <= 80 and n == distinct for n, distinct in seen)

    many = spark.createDataFrame([(k % 3, prose(k)[:64], "en" if k % 2 else "de") for k in range(900)] + [(k, prose(k)[:64], "en") for k in range(900, 1000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in (0, 1, 2, *range(900, 1000))] * 2, "doc_id long, toxic int")
    sample, counts = toxicity.labelled_sample(many, labels, "toxic", {1: 30, 0: 30}, 20_000)
    assert len(sample) == len({i for i, _, _ in sample}) <= 60 and sum(counts.values()) <= 103
    trained = []
    monkeypatch.setattr(language_id, "train", lambda segments, labels, languages, **more: trained.append((len(segments), languages)))
    language_id.fit(many)
    assert "en" in trained[0][1] and 20 <= trained[0][0] <= 106  # a text for each id and language, of 900 and 100


def test_held_out_is_never_null(spark):
    from granary.llm.common import held_out as column

    got = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,)], "doc_id long").select("doc_id", column().alias("h")).collect()
    assert all(x.h is (x.doc_id is not None and held_out(x.doc_id)) for x in got)


def test_languages_on_held_out_documents(spark):
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language_id.op8_bigru_language(spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= x.score <= 1 for x in got)
    right = [x.lang_pred == lang[x.doc_id] for x in got if x.held_out]
    assert sum(right) / len(right) > 0.95


def test_languages_of_odd_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t, None, 1) for k, t in enumerate([*ODD, "123 456", " —"])], "doc_id long, text string, lang string, score int")
    assert language_id.fit(docs) is None
    net = language_id.train(np.full((4, 64), 97, np.uint8), np.array([0, 0, 1, 1]), ["p", "q"], steps=2)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, net).collect()}
    unlettered = [k for k, t in enumerate([*ODD, "123 456", " —"]) if not t or not re.search(r"[^\W\d_]", t)]
    assert all(got[k] == ("und", 0.0) for k in unlettered) and all(got[k][0] in "pq" for k in got if k not in unlettered)
    assert language_id.identify(docs.limit(0), net).count() == 0


def repeated(spark, docs, times):
    return docs.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))


def test_a_quality_sample_is_as_large_however_rows_repeat(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seen = []
    monkeypatch.setattr(quality_model, "TRAIN_ROWS", 15)
    monkeypatch.setattr(quality_model, "train_scorer", lambda texts, good, *_: seen.append((sorted(texts), len(texts))) or (np.zeros(1), 0.0, 1.0))
    for rows in (docs, repeated(spark, docs, 60)):
        assert quality_model.fit(rows) is not None
    assert seen[0] == seen[1] and 15 < seen[0][1] <= 30


def test_a_language_sample_is_as_large_however_ids_repeat(spark, monkeypatch):
    rows = [(k, ("ein kleiner Text", "some small text")[k % 2] + f" {'x' * (k % 9)}", ("de", "en")[k % 2]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "ROWS_PER_LANGUAGE", 20)
    monkeypatch.setattr(language_id, "train", lambda segments, labels, languages: seen.append((len(segments), labels.tolist(), languages)) or "net")
    for some in (docs, repeated(spark, docs, 300)):
        assert language_id.fit(some) == "net"
    assert seen[0] == seen[1] and seen[0][2] == ["de", "en"] and 0 < seen[0][0] <= 40


def test_labels_of_other_documents_play_no_part(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kind = labels.schema["doc_id"].dataType
    other = spark.range(10**9, 10**9 + 20_000).select(F.col("id").cast(kind).alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    limits = {1: 5, 0: 10}
    want = toxicity.labelled_sample(docs, labels, "toxic", limits, 20_000)
    assert toxicity.labelled_sample(docs, labels.unionByName(other), "toxic", limits, 20_000) == want
    assert len(want[0]) == 15 and sum(want[1].values()) <= labels.count()
    assert toxicity.labelled_sample(docs, other, "toxic", limits, 20_000) == ([], {})
