"""The pipeline's stages one by one, on the test tables and on odd ones."""

import random

import corpus_pipeline
from tests.llm.test_sketches import row_classes

from granary.llm import common, decontaminate, near_dedup, quality_model, spiece, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        left.append(docs.count())
        ids = {x.doc_id for x in docs.select("doc_id").collect()}
        if k == 0:
            model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {x.doc_id for x in toxicity.toxicity(before, *model).collect() if not x.predicted}
        elif k == 1:
            assert ids == {x.doc_id for x in quality_model.quality(before, quality_model.fit(before)).collect() if x.kept}
        elif k == 2:
            assert ids == {x.doc_id for x in near_dedup.near_duplicates(before).collect() if x.class_id == x.doc_id}
        elif k == 3:
            found = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids == {x.doc_id for x in before.collect()} - {x.doc_id for x in found.collect()}
        else:
            texts = {x.doc_id: x.text for x in before.collect()}
            assert {x.doc_id: x.text for x in spiece.decode(docs, spiece.default_vocabulary()).collect()} == texts
    assert left[0] > left[1] > left[2] > left[3] > left[4] == left[5] > 0


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids"] and out.count() > 0


def test_odd_rows_and_an_empty_table_pass_all_stages(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, class_id int, score string"
    rows = [(1, None, None, None, None, 1, "a"), (2, "", "en", "s", 0, 1, "a"), (None, "text", "en", "s", 4, 1, "a"), (3, "w " * 30_000, "en", "s", 60_000, 1, "a"), (4, "some plain words of prose, as they are.", "en", "s", 1, 1, "a"), (4, "some plain words of prose, as they are.", "en", "s", 1, 1, "a")]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert len(docs.columns) == (7 if k < 4 else 2)
        docs.collect()


def test_near_copies_that_stay_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch):
    """The stage with blocks of few members and with larger ones, on texts of which many share just one band."""
    r = random.Random(31)
    word = lambda: f"z{r.randrange(10**7)}"
    passage, rows = [word() for _ in range(60)], []
    for k in range(40):
        text = passage + [word() for _ in range(40)]
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join([*text, "end"])), (3 * k + 2, " ".join(["start", *text]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = near_dedup.near_duplicates.__kwdefaults__
    monkeypatch.setitem(usual, "bands", 1)
    monkeypatch.setitem(usual, "rows", 1)
    left = []
    for block in (4, 2048):
        monkeypatch.setitem(usual, "block", block)
        left.append(sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()))
    assert left[0] == left[1] and len(left[1]) < len(rows) / 2


def test_near_copies_that_stay_do_not_depend_on_where_rows_of_one_id_lie(spark, monkeypatch):
    """Near copies that only meet apart from the centres of their buckets, one of each two with another text of its id, in files of different sizes."""
    r = random.Random(31)
    word = lambda: f"z{r.randrange(10**7)}"
    passage, rows = [word() for _ in range(88)], []
    for k in range(40):
        text = passage + [word() for _ in range(12)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, "end"])), (2 * k + 1, " ".join(word() for _ in range(100)))]
    usual = near_dedup.near_duplicates.__kwdefaults__
    monkeypatch.setitem(usual, "bands", 8)
    monkeypatch.setitem(usual, "rows", 1)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        for dealt in (docs.coalesce(1), docs.repartition(7)):
            left = sorted((x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, dealt, SF).collect())
            assert left == sorted(rows[3 * k + j] for k in range(40) for j in (0, 2))


def test_near_duplicates_lose_no_text_and_keep_no_copy(spark):
    """Every row that goes has a row that stays in its class of texts, and of each class one row stays, whatever ids say."""
    word = lambda k: f"w{k}"
    a, b, c, d = (" ".join(word(100 * k + j) for j in range(60)) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (7, b), (3, c), (3, c), (None, c), (None, c), (None, d), (None, d + " end"), (8, None), (8, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int")
    left = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert left.columns == docs.columns
    left = [(x.doc_id, x.text) for x in left.collect()]
    assert sorted(left[:], key=str) == sorted([(1, a), (5, b), (3, c), next(x for x in left if x[1] in (d, d + " end")), (8, None), (8, None), (9, ""), (9, "")], key=str)
    few = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, few, SF).collect()) == [(1, a), (2, b)]


def test_near_duplicates_that_stay_by_brute_force(spark):
    r = random.Random(8)
    bases = [[f"b{k}x{j}" for j in range(r.randrange(20, 90))] for k in range(12)]
    rows = []
    for k in range(150):
        text = list(bases[r.randrange(12)])
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
        rows.append((r.choice((None, *range(25))), " ".join(text)))
    classes, _ = row_classes(rows)
    want = {}
    for (i, t), c in zip(rows, classes):
        want.setdefault(c, []).append((i is None, i or 0, t))
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert len(left) == len(want)
    of = {}
    for (i, t), c in zip(rows, classes):
        of[t] = c
    assert sorted((of[x.text], x.doc_id is None, x.doc_id or 0) for x in left) == sorted((c, *min(m)[:2]) for c, m in want.items())


def test_no_stage_depends_on_the_bounds_of_what_is_done_at_once(spark, monkeypatch):
    """All stages with joins that shuffle, blocks of few members and batches of few rows, and as usual."""
    batch, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for small in (False, True):
        if small:
            monkeypatch.setattr(common.checked_broadcast, "__defaults__", (0,))
            monkeypatch.setitem(near_dedup.near_duplicates.__kwdefaults__, "block", 3)
            spark.conf.set(batch, 37)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, SF), "stage")
            found.append(sorted((tuple(x) for x in docs.collect()), key=str))
    spark.conf.unset(batch)
    n = len(corpus_pipeline.STAGES)
    assert found[:n] == found[n:] and found[n - 1]
