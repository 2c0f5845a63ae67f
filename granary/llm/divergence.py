"""Source divergence audit: how the word use of each source differs from that of the others of its language, by wide term vectors.

(1) Each text becomes its terms, and its distinct terms once more; counts of both by (language, source, term) are combined before they are
shuffled. (2) Terms in enough documents are kept, and each is pivoted into one array of counts, indexed by the sources of its
language. (3) Higher-order functions turn a term's array into shares; these are laid out for each pair of sources, whose sums of contributions are
combined map-side, so a pair travels once from each task. A pair of sources neither of which has the term contributes the same for every
such term: that amount times the number of kept terms is added at the end and only what differs from it is emitted, so a term costs the
number of its sources times that of all, not all by all.

What a row of this holds is one text's terms, or one number for each source of a language, of which the result has a row each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checked_broadcast, discard, mark, settle, table, written

NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, at, term, c, docs) of docs (lang, source, text): occurrences, and rows with the term. sources: (lang, source, at)."""
    docs = docs.join(checked_broadcast(sources), ["lang", "source"])
    words = F.array_remove(F.split(F.translate("text", _UPPER, _LOWER), NO_TERM), "")
    rows = docs.select("lang", "at", words.alias("t"))
    # All occurrences, and after them each distinct term once more, for the count of documents.
    each = rows.select("lang", "at", F.size("t").alias("n"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("k", "term"))
    return each.groupBy("lang", "at", "term").agg(F.count_if(F.col("k") < F.col("n")).alias("c"), F.count_if(F.col("k") >= F.col("n")).alias("docs"))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: in 64 bits where they hold it, else in decimals."""
    up, down = count + 1, F.greatest(total + terms, F.lit(1).cast("long"))
    fits = up <= F.lit(((1 << 63) - 1) // SCALE)
    large = _div(up.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), down.cast("decimal(20,0)"))
    return F.when(fits, _div(F.when(fits, up).otherwise(F.lit(0)) * F.lit(SCALE), down)).otherwise(large) + F.lit(1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def wide_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, c, some): of each term in at least least_docs documents of its language the count, and by the places of sources those above 0.

    counts: as term_counts gives them.
    """
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("some"))
    return found.filter(F.col("docs") >= least_docs).select("lang", "term", F.col("all").alias("c"), "some")


def _pair_sums(known: DataFrame) -> DataFrame:
    """(lang, i, j, v): what the terms that source i or j has, or both, add to the pair beyond what as many that neither has would.

    known: (lang, v, totals, base, some). A share that equals that of no occurrence contributes as such, whatever the count.
    """
    dense = F.transform("base", lambda b, j: F.when(F.try_element_at("some", j).isNull(), b).otherwise(share(F.try_element_at("some", j), F.get("totals", j), F.col("v"))))
    vectors = known.select("lang", "base", dense.alias("p"))
    here = vectors.select("lang", "base", "p", F.posexplode("p").alias("i", "x")).withColumn("y", F.get("base", "i")).filter("x != y")
    # Of a source that has the term: to all others, and back from those that don't have it. A lambda that emits the contribution itself is interpreted
    # for each pair; the array is laid out and the arithmetic is compiled with the sum.
    each = here.select("lang", "i", "x", "y", "base", F.posexplode("p").alias("j", "q")).withColumn("b", F.get("base", "j"))
    back = F.when(F.col("q") == F.col("b"), apart(F.col("b"), F.col("x")) - apart(F.col("b"), F.col("y")))
    sums = each.groupBy("lang", "i", "j").agg(F.sum(apart(F.col("x"), F.col("q"))).alias("forth"), F.sum(back).alias("back"), F.count("*").alias("n"))
    return sums.filter("i != j")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Terms are runs of letters A-Z and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at least least_docs of its rows (V of
    them). A source's share of a term is 1 + floor(SCALE * (count + 1) / (N + V)), with N the count of all kept terms there. Part `pair`: for each other
    source of the language the sum over kept terms of floor((p - q)^2 / q), 0 if there are none. Part `term`: the term's own value against the
    language's share q, of terms that the source has and with p > q, the `top` greatest. Ranks go from 1, by value and then by item. Null languages,
    sources and texts are read as ''; rows that repeat count as often; other columns are not read. No rows: no rows.
    """
    since = mark()
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = settle(docs.select("lang", "source").distinct())
    sources = settle(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    wide = written(wide_terms(term_counts(docs, sources), least_docs), "terms")
    each = wide.select("lang", F.explode("some").alias("at", "c")).groupBy("lang", "at").agg(F.sum("c").alias("n"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("whole"))
    placed = sources.join(each, ["lang", "at"], "left").select("lang", F.struct("at", "source", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    langs = placed.groupBy("lang").agg(F.array_sort(F.collect_list("x")).alias("x")).join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = langs.select("lang", "v", "whole", F.transform("x", lambda x: x["source"]).alias("sources"), F.transform("x", lambda x: x["n"]).alias("totals"))
    # One row for each language: places and totals of its sources, and their shares of a term that they don't have.
    langs = settle(langs.withColumn("base", F.transform("totals", lambda n: share(F.lit(0).cast("long"), n, F.col("v")))))
    known = wide.join(checked_broadcast(langs), "lang")
    sums = _pair_sums(known)
    both = sums.select("lang", "i", "j", "forth", "n", F.lit(0).cast("long").alias("back"))
    both = both.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0).cast("long").alias("forth"), F.lit(0).cast("long").alias("n"), F.coalesce("back", F.lit(0)).alias("back")))
    both = both.groupBy("lang", "i", "j").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"), F.sum("n").alias("n"))
    every = langs.select("lang", "v", "sources", "base", F.posexplode("sources").alias("i", "source"))
    every = every.select("*", F.posexplode("sources").alias("j", "item")).filter("i != j").withColumn("none", F.when(F.col("v") > 0, apart(F.get("base", "i"), F.get("base", "j"))).otherwise(F.lit(0)))
    every = every.join(both, ["lang", "i", "j"], "left")
    value = F.coalesce("forth", F.lit(0)) + F.coalesce("back", F.lit(0)) + (F.col("v") - F.coalesce("n", F.lit(0))) * F.col("none")
    pairs = every.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    own = known.withColumn("q", share(F.col("c"), F.col("whole"), F.col("v"))).select("lang", "term", "q", "totals", "v", "sources", F.explode("some").alias("at", "n"))
    own = own.withColumn("p", share(F.col("n"), F.get("totals", "at"), F.col("v")))
    terms = own.filter("p > q").select("lang", F.get("sources", "at").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(place)).unionByName(terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top))
    done = written(ranked, "divergence")
    discard(docs.sparkSession, since, keep=(done,))
    return done


def op12_wide_term_divergence(spark, sf_dir: str) -> DataFrame:
    """Per language, source, part and item: lang, source, part, item, value, rank."""
    return divergence(table(spark, sf_dir, "documents"))
