"""Quality rules under weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote bad, good, or abstain. Instead of asking that a text passes all of them, the share of texts
with each pattern of votes is fitted by expectation-maximisation (see weak_labels), which estimates how far each rule can be
trusted; a text's verdict is its posterior probability of good quality. Patterns are counted where the texts are (at most 3**RULES rows reach
the driver, whatever the input), and the posterior is a sum of one weight per rule, evaluated in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import weak_labels
from granary.llm.common import WORD_SPLIT, table, written

RUN = 8
THRESHOLD = 0.5
_SPACES = " \t\n\x0b\x0c\r"

#: (name, measure, side, bad, good): votes bad from `bad` on (down for low, up for high), good from `good` back, and abstains between.
RULES = (
    ("few_words", "n_words", "low", "8", "40"),
    ("symbols", "n_symbols / greatest(word_chars, 1)", "high", "0.05", "0.004"),
    ("marked_words", "n_symbol_runs / greatest(n_words, 1)", "high", "0.15", "0.02"),
    ("capitals", "n_capitals / greatest(word_chars, 1)", "high", "0.30", "0.08"),
    ("shouting", "n_shouts / greatest(word_chars, 1)", "high", "0.02", "0.002"),
    ("varied_words", "n_distinct / greatest(n_words, 1) * greatest(1, power(n_words / 200, 0.3))", "low", "0.25", "0.45"),
    ("repeated_runs", "n_repeat_words / greatest(n_words, 1)", "high", "0.30", "0.03"),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", "high", "0.30", "0.05"),
    ("prose_marks", "n_marks / greatest(word_chars, 1)", "low", "0.004", "0.01"),
    ("word_length", "word_chars / greatest(n_words, 1)", "high", "14", "11"),
)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once per row and not again inside the lambdas of use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(hashes: Column, run: int = RUN) -> Column:
    """Words that lie in a window of `run` words found twice or more; hashes: an array of hashes of the words.

    Almost all texts repeat no window, which a hash set shows; the windows of others are sorted, and linear passes over the sorted
    ones find those with an equal neighbour and the union of their places.
    """

    def places(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.array_sort(F.transform(_let(by_hash, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(run), F.coalesce(F.get(at, k + 1) - p, F.lit(run))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (run - 1)), lambda i: F.xxhash64(F.slice(h, i, run)))
        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(places(w), covered)))

    return F.when(F.size(hashes) > run, _let(hashes, count)).otherwise(0).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...): the counts of each text, without the text."""
    lost = lambda c, *parts: F.length(c) - F.length(parts[0])
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("core", F.trim("t", F.lit(_SPACES)))
    t = t.withColumn("words", F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", WORD_SPLIT)))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != ""))
    t = t.withColumn("runs", F.regexp_replace("t", "[#*$%&|<>]+", "#"))
    symbol_runs = F.length("runs") - F.length(F.replace("runs", F.lit("#"), F.lit("")))
    t = t.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    long = lambda c, name: c.cast("long").alias(name)
    return t.select(
        id_col,
        long(F.size("words"), "n_words"),
        long(F.length(F.array_join("words", "")), "word_chars"),
        long(F.length("t") - F.length("runs") + symbol_runs, "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(symbol_runs, "n_symbol_runs"),
        long(F.size(F.array_distinct("h")), "n_distinct"),
        long(lost("t", F.regexp_replace("t", r"[A-ZÀ-Þ]+", "")), "n_capitals"),
        long(lost("t", F.replace(F.replace("t", F.lit("!"), F.lit("")), F.lit("?"), F.lit(""))), "n_shouts"),
        long(lost("t", F.replace(F.replace("t", F.lit("."), F.lit("")), F.lit(","), F.lit(""))), "n_marks"),
    )


def _vote(rule: tuple[str, str, str, str, str]) -> Column:
    _, measure, side, bad, good = rule
    a, b = ("<=", ">=") if side == "low" else (">=", "<=")
    return F.expr(f"case when {measure} {a} {bad} then {weak_labels.BAD} when {measure} {b} {good} then {weak_labels.GOOD} else {weak_labels.ABSTAIN} end")


def fit(measured: DataFrame) -> weak_labels.Model:
    """The model of the vote patterns of all rows of measures()."""
    code = sum((_vote(r) * 3**k for k, r in enumerate(RULES)), F.lit(0))
    patterns = {r["code"]: r["n"] for r in measured.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect()}
    return weak_labels.fit(patterns, len(RULES))


def posterior(model: weak_labels.Model) -> Column:
    """The posterior probability of good quality, over the columns of measures()."""
    z = F.lit(model.bias)
    for rule, (bad, good, none) in zip(RULES, model.weights(), strict=True):
        v = _vote(rule)
        z = z + F.when(v == weak_labels.BAD, bad).when(v == weak_labels.GOOD, good).otherwise(none)
    return 1 / (1 + F.exp(-z))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() with base_failed, quality (the posterior) and kept.

    A text fails the base if it has under 20 words or if over 30 % of its words lie in repeated windows of 8; others are kept if their
    quality is at least THRESHOLD. Null and empty texts have no words and fail. Repeated ids keep a row each. No rows: no rows.
    """
    measured = written(measures(docs, id_col, text_col), "measures")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.withColumn("base_failed", base_failed).withColumn("quality", posterior(fit(measured)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def op2_weak_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def quality_rule_counts(spark, sf_dir: str) -> DataFrame:
    """Per document, what the query above counts and the base rule says: all that doesn't depend on the fitted model."""
    counts = judge(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
