"""Decontamination and piece encoding."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import decontaminate, spiece

SF = "/root/testdata/sf0.01"
ITEM = "He said that Tom bought 3 apples and Tom gave 5 km of rope to his friend yesterday"


def contaminated(spark, texts, items=(ITEM,), **more):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, size int, item string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {x.doc_id for x in decontaminate.contamination(docs, bench, **more).collect()}


def test_questions_asked_again_with_other_values(spark):
    texts = [
        ITEM,
        "Well. He said that Ann bought 70 apples and Ann gave 9.5 miles of rope to his friend yesterday, too",
        "He said that Ann bought 7 apples and Bob gave 9 miles of rope to his friend yesterday",  # one name became two
        "he said that Ann bought 7 apples and Ann gave 7 miles of rope to his friend yesterday",  # two numbers became one
        "He said that nobody bought any apples and that nobody gave any rope to a friend of his",
        "HE SAID -- THAT Ann bought 1,000 apples; and Ann gave 12 km of rope to his friend (yesterday)!",
        None,
        "",
        "3 5 7 9 11 13 15 17 19 21",
    ]
    assert contaminated(spark, texts) == {0, 1, 3, 5}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 3 apples. Tom eats 2 of them. How many are left?"
    texts = ["So. Ann has 9 apples. Ann eats 4 of them. How many are left? Say it.", "Ann has 9 apples. Bob eats 4 of them. How many are left?", "ANN HAS 3 APPLES. TOM EATS 2 OF THEM. HOW MANY ARE LEFT?", "Then eat of them. How are many left"]
    # In the second, windows of enough words cover the later name only, so the earlier one, which differs, has no say.
    assert contaminated(spark, texts, [item]) == {0, 1, 2}


def test_values_that_coincide_and_number_words(spark):
    item = "Tom has 3 apples. Tom eats 2 of them. How many are left?"
    texts = ["Ann has 4 apples. Ann eats 4 of them. How many are left?", "Ann has nine apples. Ann eats four of them. How many are left?", "Ann has few apples. Ann eats some of them. Now none is left?"]
    assert contaminated(spark, texts, [item]) == {0, 1}


def generated(r, n):
    """Items with slots, and each asked again with other values, some of them words: (item, asked again)."""
    nouns, verbs = "apples books coins stamps plates shells ropes tiles".split(), "buys sells finds loses paints counts".split()
    names, units = "Tom Ann Bob Olga Karl Mia Ivan Zoe".split(), ("km", "kg", "miles", "hours", "litres")
    words = "nine four seven twelve twenty".split()
    out = []
    for k in range(n):
        noun, verb, other, place = r.choice(nouns), r.choice(verbs), r.choice(nouns), f"place{k}"
        shape = r.choice((
            "{a} {verb} {x} {noun} at the {place} and then {a} gives {y} of those {noun} to {b}, so how many {noun} are left for {a}?",
            "A box from the {place} weighs {x} {u} and holds {y} {noun} along with several {other}; what is the weight without the {other}?",
            "If {a} walks {x} {u} to the {place} each morning, how far does {a} walk in {y} days of the week?",
            "The {place} has {x} rows with {y} {noun} in each of them, and {a} {verb} {z} more {noun} there. How many are there now?",
            "{a} and {b} share {x} {noun} from the {place}.",
        ))
        fill = lambda number, fixed=dict(noun=noun, verb=verb, other=other, place=place), shape=shape: shape.format(**fixed, a=r.choice(names[:4]), b=r.choice(names[4:]), x=number(), y=number(), z=number(), u=r.choice(units))
        out.append((fill(lambda: str(r.randint(2, 99))), fill(lambda: r.choice((str(r.randint(2, 99)), "1,250", "3.5", r.choice(words) if "{u}" not in shape else "17")))))
    return out


def test_recall_of_questions_asked_again(spark):
    """Generated questions, each asked again in the middle of other prose; and as many that share only their scheme with another item."""
    r = random.Random(11)
    pairs = generated(r, 300)
    prose = lambda: " ".join(r.choice("la mo ti su re na ki vo".split()) + r.choice(("", "na", "ro", "li")) for _ in range(30))
    texts = [f"{prose()}. {again} {prose()}" for _, again in pairs] + [f"{prose()}. {prose()}." for _ in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(pairs)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contamination(docs, bench).collect()}
    recall = sum((k, k) in found for k in range(300)) / 300
    assert recall >= 0.9, recall
    assert not [k for k, _ in found if k >= 300]


def test_runs_of_slots_are_one(spark):
    item = "How many apples does Mary Jane Watson have if Tom gives her twenty five more?"
    texts = ["How many apples does Ann have if Bob gives her 7 more?", "So: how many apples does Ann Lee have if Bob Dyk gives her 1 200 more? Say it."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted((x.doc_id, x.first, x.last) for x in found.collect()) == [(0, 1, 12), (1, 3, 16)]
    # A name that is the same in the item has to be the same run in the document.
    item = "Mary Jane sold 3 of the old apples then Mary Jane went home by bus"
    texts = ["Ann Lee sold 45 of the old apples then Ann Lee went home by bus", "Ann Lee sold 45 of the old apples then Bob Lee went home by bus"]
    assert contaminated(spark, texts, [item]) == {0}


def test_recall_with_names_and_numbers_of_several_words_and_other_questions_of_one_shape(spark):
    """Each of 200 questions asked again with names and numbers of one to three tokens; then questions of the same shapes about other things."""
    r = random.Random(5)
    first, last = "Tom Ann Bob Olga Karl Mia Ivan Zoe".split(), "Lee Watson Stone Berg Novak Ito".split()
    name = lambda: " ".join([r.choice(first), *r.sample(last, r.randint(0, 2))])
    number = lambda: r.choice((str(r.randint(2, 99)), "twenty five", "3 hundred thousand", "1,250", "four", "two hundred"))
    things = [f"{a}{b}" for a in "lamp rope shell coin tile brick wheel spoon".split() for b in ("s", "works", "boxes", "parts", "rings")]
    shapes = (
        "how many {n} does {a} have if {b} gives them {x} more of the {m} today?",
        "after {a} sold {x} old {n} to {b}, who counted {y} broken {m}, what did {a} still own?",
        "the {n} of {a} weigh as much as {x} new {m}, so what do {y} of them weigh?",
    )
    made = []
    for k in range(200):
        shape, n, m = shapes[k % 3], *r.sample(things, 2)
        ask = lambda shape=shape, n=n, m=m: shape.format(n=n, m=m, a=(a := name()), b=name(), x=number(), y=number())  # noqa: E731, F841
        made.append((shape, n, m, ask(), ask()))
    other = [shapes[k % 3].format(n="kettles", m="ladders", a=name(), b=name(), x=number(), y=number()) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([x[4] for x in made] + other)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, x[3]) for k, x in enumerate(made)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contamination(docs, bench).collect()}
    assert sum((k, k) in found for k in range(200)) >= 180
    # A question about other things is met where its scheme alone holds a window of words, as the first and the third do, and only there.
    assert {k for k, _ in found if k >= 200} == {200 + k for k in range(60) if k % 3 != 1}
    assert {x.doc_id for x in decontaminate.contaminated(docs, bench).collect()} == {k for k, _ in found}


def test_contaminated_are_the_documents_of_contamination(spark):
    texts = [ITEM, ITEM.replace("Tom", "Ann"), ITEM.replace("Tom bought", "Ann bought"), "of rope to his friend yesterday", None, "", ITEM + " 3", ITEM]
    docs = spark.createDataFrame([(k if k < 6 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM), (1, ITEM), (2, ITEM + " or the day before"), (3, None)], "item_id long, text string")
    want = {(x.doc_id, x.text_hash) for x in decontaminate.contamination(docs, bench).collect()}
    got = [(x.doc_id, x.text_hash) for x in decontaminate.contaminated(docs, bench).collect()]
    assert len(want) == 5 and len(got) == len(set(got)) and set(got) == want


def test_windows_of_all_sizes_share_their_parts(spark):
    rows = [(k, [hash((k, j)) for j in range(n)]) for k, n in enumerate((0, 1, 4, 5, 7, 8, 9, 30))] + [(99, [7] * 20)]
    df = decontaminate.with_windows(spark.createDataFrame(rows, "k long, h array<long>"), ["h"], [5, 6, 7, 8, 13])
    for x in df.collect():
        for size in (5, 6, 7, 8, 13):
            spans = [tuple(x.h[i : i + size]) for i in range(len(x.h) - size + 1)]
            assert len(x[f"h_{size}"]) == len(spans) and len(set(zip(spans, x[f"h_{size}"]))) == len(set(spans)) == len(set(x[f"h_{size}"]))


def test_a_long_text_that_repeats_an_items_phrase(spark):
    """Each repetition is an alignment; none of them are gathered in one row."""
    item = "Tom bought 3 red apples for the old friend of his"
    long = " ".join(f"{r} bought {k} red apples for the old friend of his and" for k, r in enumerate(("Ann", "Bob") * 4000))
    docs = spark.createDataFrame([(1, long), (2, "nothing of it")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert found.count() == 8000 and {x.doc_id for x in found.select("doc_id").distinct().collect()} == {1}


def test_items_of_several_sizes_take_one_pass(spark):
    items = ["five words of it here", "six words of it right here", "these are seven words of it here", "and these here are eight words of it"]
    texts = [f"so {x} and more" for x in items] + ["five words of them here"]
    assert contaminated(spark, texts, items) == {0, 1, 2, 3}
    docs, bench = spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seen = []
    original = decontaminate.settle
    decontaminate.settle = lambda df: seen.append(df._jdf.queryExecution().analyzed().toString()) or original(df)
    try:
        decontaminate.contamination(docs, bench)
    finally:
        decontaminate.settle = original
    assert max(plan.count("LogicalRDD [doc_id") for plan in seen) == 1


def test_verbatim_copies_dense_in_names_and_numbers(spark):
    short, dense = "What is the capital of France?", "Der Lehrer gab Anna 3 Bücher und Peter 5 Hefte. Wie viele Bücher hat Anna?"
    texts = [f"Asked once: {short} Nobody knew.", f"Hier steht es. {dense} Ende.", short.lower(), dense.upper(), "What is the colour of France?", "Der Wirt gab Olga 3 Äpfel und Boris 5 Birnen."]
    assert contaminated(spark, texts, [short, dense]) == {0, 1, 2, 3}


def test_a_slot_that_disagrees_costs_no_verbatim_match(spark):
    item = "The cat sat on the mat by a door. The dog ran to the gate at noon."
    texts = ["One cat sat on the mat by a door. The dog ran to the gate at noon.", "A cat sat on the mat by a door. Some dog walked off.", "So the cat sat there. Every dog ran to the gate."]
    assert contaminated(spark, texts, [item]) == {0, 1}
    changed = "The first box holds 12 red balls and all the others hold none at all, while the last one, so he said to me then, holds 12 too in a bag of red cloth"
    assert contaminated(spark, [changed.replace("12", "13", 1)], [changed]) == {0}


def test_slots_count_only_where_windows_match(spark):
    item = "Tom bought red apples and green pears for his old friend, then 3 4 5 Ann Tom Bob 6 7 left by train"
    texts = ["Joe bought red apples and green pears for his old friend, then 3 3 4 Joe Joe Joe 1 1 left by ship", "Joe bought red apples and green pears for his old friend"]
    assert contaminated(spark, texts, [item]) == {0, 1}
    docs = spark.createDataFrame([(0, "the box holds 7 red balls and some other things of his; ")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "The box holds 5 red balls and some other things of his")], "item_id long, text string")
    assert [(x.first, x.last) for x in decontaminate.contamination(docs, bench).select("first", "last").collect()] == [(1, 12)]


def test_short_items_slots_only_and_empty_tables(spark):
    texts = ["say five words of it here", "five words", "a five words of it b", "five of these words", "so it is", "It"]
    assert contaminated(spark, texts, ["five words of it here", ""]) == {0}
    assert contaminated(spark, texts, ["five words of it here", "five words", ""]) == {0, 1, 2}  # a short item is found verbatim, all of it
    assert contaminated(spark, texts, ["So it is.", "...", "five, of these"]) == {3, 4} and contaminated(spark, texts, ["it"]) == {0, 2, 4, 5}
    assert contaminated(spark, ["1 2 3 4 5 6 7 8 9"], ["9 8 7 6 5 4 3 2 1"]) == set()
    assert contaminated(spark, [ITEM], []) == set()
    assert contaminated(spark, [], [ITEM]) == set()
    assert contaminated(spark, [None], [ITEM]) == set()


def test_scripts_without_spaces(spark):
    items = ["法国的首都是哪一座城市?", "フランスの首都はどこですか", "เมืองหลวงของฝรั่งเศสคืออะไร", "小明有3个苹果，小红有5个苹果，一共多少个?"]
    texts = [*(f"前文{x}后文" for x in items), "法国的城市", "フランスの車はどこでも人気", "小明有7个苹果，小红有9个苹果，一共多少个?", "Über 東京Tom"]
    assert contaminated(spark, texts, items) == {0, 1, 2, 3, 6}


def test_very_long_texts(spark):
    long = "word " * 100_000 + ITEM + " 1.1" * 50_000 + " " + "9." * 200_000 + "1 " + "z" * 300_000
    assert contaminated(spark, [long, "word " * 1000]) == {0}


def test_all_planted_passages_are_found_and_nothing_else(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    tokens = lambda s: re.sub(r"[^\w\s]+", "", s.lower()).split()
    known = {tuple(t[i : i + 8]) for t in (tokens(x.text) for x in bench.collect()) for i in range(len(t) - 7)}
    want = {x.doc_id for x in docs.collect() if any(tuple(t[i : i + 8]) in known for t in [tokens(x.text)] for i in range(len(t) - 7))}
    got = decontaminate.op1_template_decontamination(spark, SF).collect()
    assert len(got) == docs.count() and {x.doc_id for x in got if x.contaminated} == want and want
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.select("doc_id").collect()} == {x.doc_id for x in got} - want


def test_repeated_rows_stay_or_go_together(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "a"), (2, "a"), (None, ITEM)], "doc_id long, text string")
    left = decontaminate.without_contaminated(docs, spark.createDataFrame([(0, ITEM), (1, ITEM)], "item_id long, text string"))
    assert sorted((x.doc_id, x.text) for x in left.collect()) == [(2, "a"), (2, "a")]
    docs = spark.createDataFrame([(1, ITEM), (1, "other text of this id"), (None, "x"), (None, None)], "doc_id long, text string")
    left = decontaminate.without_contaminated(docs, spark.createDataFrame([(0, ITEM)], "item_id long, text string"))
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == [(1, "other text of this id"), (None, "x"), (None, None)]


def test_decontamination_uses_no_python_on_the_executors(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not re.search("Python|Pandas|Arrow", decontaminate.contamination(docs, bench)._jdf.queryExecution().toString())


@pytest.fixture(scope="module")
def both():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = spiece.default_vocabulary()
    return spiece.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


def ids(machine, text):
    held = memoryview(machine.encode(text)).cast("i")
    return list(held)


FIXED = ["", " ", "a  b", "   x", "x   ", "\n\n a\n  b ", "é́ ☃ 😀 漢字かな", "\t\ttab", "def f(x):\n    return  x   # ok", "a" * 60, "=" * 70, "\x00\x01", "a\r\nb", " " * 40 + "z" + " " * 33, "x" * 3000, "1234567890 " * 5, "ﬁ ǅ ß İ"]


@pytest.mark.parametrize("text", FIXED)
def test_encoding_is_that_of_the_vocabularys_own_library(both, text):
    machine, library = both
    assert ids(machine, text) == library.encode(text)
    assert machine.decode(ids(machine, text)) == text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from(list("ab cde  \nthe.ing!é漢0123")), max_size=120)))
def test_encoding_of_any_text(both, text):
    machine, library = both
    text = text.replace("\u2581", "_")
    assert ids(machine, text) == library.encode(text)
    assert machine.decode(ids(machine, text)) == text


def test_neighbours_weigh_nothing_or_everything(both):
    machine, _ = both
    r = random.Random(1)
    pieces = [p for p, _, kind in machine.pieces if kind == 1 and len(p) > 1]
    pairs = [(p[:k], p[k:]) for p in r.sample(pieces, 600) for k in range(1, len(p))] + [(r.choice(pieces), r.choice(pieces)) for _ in range(600)]
    pairs += [(p[:k], p[k:] + "".join(r.choice("etaoinsr") for _ in range(2))) for p in r.sample(pieces, 600) for k in range(1, len(p))]
    known = [(x, y) for x, y in pairs if x in machine.rank and y in machine.rank]
    found = [machine.may_follow(x, y) for x, y in known]
    assert found == [machine.merged(x + y) == [x, y] for x, y in known] and 200 < sum(found) < len(known) - 200


def test_the_table_and_the_single_relaxation_give_one_path(both):
    machine, _ = both
    r = random.Random(2)
    segments = [spiece.SPACE * (k % 2) + "".join(r.choice("etaoinshrdlu\xe9\u6f22\U0001f600\x00") for _ in range(r.randint(1, 30))) for k in range(400)]
    together = machine._relax(segments)
    for s, found in zip(segments, together):
        assert found == machine.shortest_path(s)
        parts, at = [], 0
        for part in machine.merged(s):
            known = machine.rank.get(part)
            parts += [known[1]] if known else [machine.byte[b] for b in part.encode()]
        assert list(memoryview(found).cast("i")) == parts


def test_a_vocabulary_of_scores_takes_the_least_total(both):
    """Unigram scores, through the same machine, against all segmentations."""
    r = random.Random(4)
    letters = "abc"
    pieces = {spiece.SPACE} | set(letters) - {"c"} | {"".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in range(25)}
    rows = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, -r.uniform(1, 9), 1) for p in sorted(pieces))]
    machine = spiece.Transducer(pieces=rows, merging=False)
    score = {p: -w for p, w, kind in rows if kind == 1}
    unknown = max(score.values()) + spiece.UNKNOWN_WEIGHT

    def least(s):
        best = [0.0] + [float("inf")] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(end):
                cost = score.get(s[start:end], unknown if end == start + 1 else float("inf"))
                best[end] = min(best[end], best[start] + cost)
        return best[-1]

    for _ in range(150):
        s = "".join(r.choice(letters + "z") for _ in range(r.randint(1, 12)))
        for found in (machine._relax([s])[0], machine.shortest_path(s)):
            ids = list(memoryview(found).cast("i"))
            total = sum(unknown if i in machine.of_byte else score[machine.text[i]] for i in ids)
            assert abs(total - least(s)) < 1e-9 and "".join(machine.plain[i] for i in ids) == s
    assert machine.decode(memoryview(machine.encode("ab ca")).cast("i").tolist()) == "ab ca"


def test_encoding_and_decoding_of_tables(spark):
    texts = [*FIXED, None, "word " * 40_000 + "x" * 100_000]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(None, "a", 0), (0, "twice", 0)], "doc_id long, text string, ids int")
    encoded = spiece.encode(docs, spiece.default_vocabulary())
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == len(texts) + 2
    again = {x.doc_id: x.text for x in spiece.decode(encoded.filter("doc_id > 0"), spiece.default_vocabulary()).collect()}
    assert again == {k: t for k, t in enumerate(texts) if k}
    assert spiece.encode(docs.limit(0), spiece.default_vocabulary()).count() == 0
    got = spiece.op4_piece_transducer(spark, SF).collect()
    assert len(got) == 1000 and all(x.exact and x.n_ids > 0 for x in got)
