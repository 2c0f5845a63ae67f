"""Benchmark decontamination by templates, in DataFrame functions only.

Texts become tokens (runs of letters, numbers; single letters in scripts that set no spaces), lower-cased. Three kinds are slots: a number (digits or
a number word), a unit after a number in digits, and a name (a capitalised word, which may be one, also at the start of a sentence); in the template a
run of slots of one kind stands as that kind, once ("Mary Jane Watson", "twenty five"), and its value is the whole run. Windows of WINDOW template tokens of documents are hash-joined with those of benchmark items, so a question asked again with
other numbers, names or units still meets its item; items have a second template without names, which copies in one case meet. A match then
has to keep its slots consistent: along one alignment of a document with an item, equal values of the item must be equal in the
document, over the tokens that matching windows cover (different ones may become equal: "has 3, eats 2" asked again as "has 4, eats 4"). Windows of
the plain tokens, nothing masked, are joined too: a verbatim copy is found however many names and numbers it holds and whatever stands around it, and
however short the item is. Templates are checked apart; one that holds is enough.

One pass over all texts emits hashes and positions only, for windows of all sizes at once; slot values are read in a second pass over documents that
matched, as one row per token, so that nothing of a document comes together in one row but its tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checked_broadcast, discard, mark, settle, table

WINDOW = 8
#: Templates of fewer tokens than this are not compared; those of this to WINDOW - 1 tokens match as a whole. Plain tokens have no such bound: an item
#: of fewer than WINDOW tokens is found verbatim, all of it.
SHORTEST = 5
#: Tokens of a masked window that have to be words and not slots; plain windows have no such bound.
LITERALS = 5
#: Windows of one alignment that have to match (an item with fewer windows: all of its).
MATCHES = 1

# Unit words, as they may follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons "
    "ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours d day days week weeks "
    "month months year years c f k kelvin celsius fahrenheit pa kpa bar v kv w kw mw j kj hz khz mhz ghz b kb mb gb tb "
    "percent cent cents dollar dollars usd euro euros eur gbp yen mph kmh"
).split()

# Number words of four languages, without those that are also other common words (one, once, un, ein, elf, mil, cent).
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig "
    "fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien"
).split()

#: Templates: with names, without them (numbers and units only), and the plain tokens.
NAMED, UNNAMED, PLAIN = 0, 1, 2

_NAME, _NUMBER, _UNIT = "\x02", "\x03", "\x04"
_KINDS = (_NAME, _NUMBER, _UNIT)
# Between tokens, and before a token's place, where runs are looked for.
_NEXT, _PLACE = "\x01", "\x05"
_SLOTS = f"'{_NAME}', '{_NUMBER}', '{_UNIT}'"
# Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_LETTER = rf"[a-z[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]]"
_WORD = rf"(?:{_LETTER}++|[\p{{L}}\p{{M}}&&[{_UNSPACED}]]\p{{M}}*+)"
_DIGITS = r"[0-9]++(?:[.,:/-][0-9]++)*+"


def _parts(text: Column, names: bool = True) -> Column:
    """The tokens, lower-cased, with a mark before each name and each unit."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), _NAME + _NUMBER + _UNIT, "   ")
    marked = F.lower(F.regexp_replace(clean, rf"(?<!{_LETTER})(?=\p{{Lu}}\p{{Ll}})", _NAME) if names else clean)
    marked = F.regexp_replace(marked, rf"(?<=[0-9] ?)(?=(?:{'|'.join(UNITS)})(?!{_LETTER}))", _UNIT)
    return F.regexp_extract_all(marked, F.lit(f"([{_NAME}{_UNIT}]?{_WORD}|{_DIGITS})"), 1)


def _value(part: Column) -> Column:
    """A token without its mark."""
    return F.when(part < "\x05", F.substring(part, 2, 1 << 30)).otherwise(part)


def _slotted(part: Column) -> Column:
    """A token as it stands in the template. Marks sort below digits, and digits below letters."""
    marked = F.when(F.substring(part, 2, 1 << 30).isin(NUMBER_WORDS), F.lit(_NUMBER)).otherwise(F.substring(part, 1, 1))
    return F.when(part < ":", F.when(part < "\x05", marked).otherwise(F.lit(_NUMBER))).when(part.isin(NUMBER_WORDS), F.lit(_NUMBER)).otherwise(part)


def _runs(parts: str, plain: Column | None = None) -> Column:
    """(token, val, first, last) of each run of slots of one kind and of each other token (plain, where it holds: of each token).

    token is as in the template, val a hash of the run's values, first and last are places (from 1) among the tokens. Runs are found in the tokens
    as one string, in which each has its place behind it: a lambda that looked at other tokens would compute all of them again for each.
    """
    slot = lambda x: F.when(_slotted(x).isin(*_KINDS) & (F.lit(True) if plain is None else ~plain), _slotted(x)).otherwise("")
    placed = F.transform(parts, lambda x, i: F.concat(slot(x), _value(x), F.lit(_PLACE), (i + 1).cast("string")))
    run = "|".join(f"{k}[^{_NEXT}]*+(?:{_NEXT}{k}[^{_NEXT}]*+)*+" for k in _KINDS)
    found = F.regexp_extract_all(F.array_join(placed, _NEXT), F.lit(f"{run}|[^{_NEXT}]++"), F.lit(0))
    place = lambda r: F.substring_index(r, _PLACE, -1).cast("int")
    token = lambda r: F.when(r < _PLACE, F.substring(r, 1, 1)).otherwise(F.substring_index(r, _PLACE, 1))
    return F.transform(found, lambda r: F.struct(token(r).alias("token"), F.xxhash64(F.regexp_replace(r, f"{_PLACE}[0-9]++", "")).alias("val"), place(F.substring_index(r, _NEXT, 1)).alias("first"), place(r).alias("last")))


def _halves(size: int) -> list[int]:
    """The sizes of windows that those of `size` are made of, in the order in which they can be: halves of a power of two, then what is left."""
    if size < 2:
        return []
    first = 1 << (size - 1).bit_length() - 1
    return [*_halves(first), *_halves(size - first), size]


def with_windows(df: DataFrame, hashes: list[str], sizes: list[int]) -> DataFrame:
    """df with a column <h>_<size> for each column <h> of hashes of tokens: hashes of its windows of that size, by position.

    A window's hash is that of the hashes of its two parts, and windows of all sizes share their parts, so another size costs one step more.
    """
    df = df.withColumns({f"{h}_1": F.col(h) for h in hashes})
    for size in dict.fromkeys(s for size in sizes for s in _halves(size)):
        first = 1 << (size - 1).bit_length() - 1
        n = lambda h, size=size: F.greatest(F.lit(0), F.size(h) - (size - 1))
        both = lambda h, first=first, size=size, n=n: F.zip_with(F.slice(f"{h}_{first}", F.lit(1), n(h)), F.slice(f"{h}_{size - first}", F.lit(1 + first), n(h)), lambda x, y: F.xxhash64(x, y))
        df = df.withColumns({f"{h}_{size}": both(h) for h in hashes})
    return df


def _hashed(tokens: str, what=lambda t: t) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(what(t)))


def item_templates(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, kind, tokens, h, vals): the templates of the items, runs of slots as one token, that are long enough; vals are hashes."""
    texts = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    kinds = [texts.select("item", F.lit(kind).alias("kind"), _parts(F.col("text"), kind == NAMED).alias("parts")) for kind in (NAMED, UNNAMED, PLAIN)]
    items = reduce(DataFrame.unionByName, kinds).select("item", "kind", _runs("parts", F.col("kind") == PLAIN).alias("runs"))
    items = items.select("item", "kind", F.col("runs.token").alias("tokens"), F.col("runs.val").alias("vals"))
    items = items.filter(F.size("tokens") >= F.when(F.col("kind") == PLAIN, 1).otherwise(SHORTEST))
    return items.select("item", "kind", "tokens", _hashed("tokens").alias("h"), "vals").dropDuplicates(["item", "kind", "tokens"])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(hash, size, item, kind, n, at): the windows of templates that hold enough words; n: tokens of the item."""
    sizes = list(range(1, window + 1))
    at = with_windows(items, ["h"], sizes).withColumn("n", F.size("tokens")).withColumn("size", F.least(F.lit(window), F.col("n")))
    of_size = F.coalesce(*(F.when(F.col("size") == k, F.col(f"h_{k}")) for k in sizes))
    at = at.select("item", "kind", "tokens", "n", "size", F.posexplode(of_size).alias("p", "hash")).withColumn("at", F.col("p") + 1)
    words = F.expr(f"size(filter(slice(tokens, at, size), p -> p not in ({_SLOTS})))")
    at = at.filter((F.col("kind") == PLAIN) | (words >= F.least(F.lit(LITERALS), F.col("size"))))
    return at.select(F.xxhash64("size", "hash").alias("hash"), "size", "item", "kind", "n", "at")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def window_hits(texts: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, t, size, plain, p, hash): the windows of texts that some item has too, in one pass. p: place among plain tokens, or among runs."""
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most window of them
    if not sizes:
        sizes = [window]
    # A slot goes on with its run if the one before it is of its kind. The last of the pairs holds none.
    goes_on = lambda h, before: h.isin(*(F.xxhash64(F.lit(k)) for k in _KINDS)) & h.eqNullSafe(before)
    pairs = F.zip_with("single", F.concat(F.array(F.lit(None).cast("long")), F.col("single")), lambda h, before: F.when(~goes_on(h, before), h))
    hashed = texts.select("doc", "t", _parts(F.col("text")).alias("parts")).select("doc", "t", _hashed("parts", _slotted).alias("single"), _hashed("parts", _value).alias("plain"))
    hashed = hashed.select("doc", "t", "plain", F.filter(pairs, lambda h: h.isNotNull()).alias("masked"))
    known = checked_broadcast(bench.select("hash").distinct())
    # Masked and plain windows of all sizes at once. They share one space of hashes, as a window without slots is the same in both.
    hashed = with_windows(hashed, ["masked", "plain"], sizes)
    every = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(h == "plain").alias("plain"), F.col(f"{h}_{size}").alias("w")) for size in sizes for h in ("masked", "plain") if h == "plain" or size >= SHORTEST))
    found = hashed.select("doc", "t", F.inline(every)).select("doc", "t", "size", "plain", F.posexplode("w").alias("p", "w"))
    found = found.select("doc", "t", "size", "plain", (F.col("p") + 1).alias("p"), F.xxhash64("size", "w").alias("hash"))
    return found.join(known, "hash", "left_semi").distinct()


def _alignments(hits: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc, t, item, kind, shift, ats, size, windows): a document, an item, and how far the one is shifted against the other."""
    met = hits.join(checked_broadcast(bench, 100_000), ["hash", "size"]).filter(F.col("plain") == (F.col("kind") == PLAIN)).groupBy("doc", "t", "item", "kind", "n", (F.col("p") - F.col("at")).alias("shift"))
    met = met.agg(F.collect_set("at").alias("ats"), F.max("size").alias("size")).withColumn("windows", F.size("ats"))  # at most n places
    whole = bench.groupBy("item", "kind").agg(F.countDistinct("at").alias("all"))
    met = met.join(checked_broadcast(whole, 100_000), ["item", "kind"]).filter(F.col("windows") >= F.least(F.lit(MATCHES), F.col("all")))
    return met.select("doc", "t", "item", "kind", "shift", "ats", "size", "windows")


def _spans(met: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, t, item, first, last, windows) of alignments of masked templates that keep their slots consistent over the tokens that windows cover.

    Of one alignment's templates, one whose windows are some of the other's has no say: it would only hide the slots that the other compares.
    """
    alike = met.groupBy("doc", "t", "item", "shift", "size").agg(F.collect_list(F.struct("kind", "ats", "windows")).alias("alike"))  # at most two
    masked = alike.select("doc", "t", "item", "shift", "size", F.expr("inline(filter(alike, a -> not exists(alike, b -> b.windows > a.windows and size(array_except(a.ats, b.ats)) = 0)))"))
    masked = settle(masked)
    slots = items.filter(F.col("kind") != PLAIN).select("item", "kind", F.posexplode(F.arrays_zip("tokens", "vals")).alias("i", "x")).filter(F.col("x.tokens").isin(_NAME, _NUMBER, _UNIT))
    slots = checked_broadcast(slots.select("item", "kind", (F.col("i") + 1).alias("i"), F.xxhash64("x.tokens", "x.vals").alias("theirs")))
    # What to read of a document: its runs at the item's slots, and those where the alignment begins and ends (of no value of the item).
    key = ["doc", "t", "item", "kind", "shift"]
    covered = F.expr("array_distinct(flatten(transform(ats, a -> sequence(a, a + size - 1))))")
    inside = masked.select(*key, "windows", F.explode(covered).alias("i")).join(slots, ["item", "kind", "i"]).select(*key, "windows", (F.col("shift") + F.col("i")).alias("at"), "theirs")
    ends = F.explode(F.array(F.array_min("ats"), F.array_max("ats") + F.col("size") - 1))
    ends = masked.select(*key, "windows", ends.alias("i")).select(*key, "windows", (F.col("shift") + F.col("i")).alias("at"), F.lit(None).cast("long").alias("theirs"))
    needed = checked_broadcast(settle(inside.unionByName(ends)), 200_000)
    again = texts.join(checked_broadcast(masked.select(F.col("doc").alias("d"), F.col("t").alias("u")).distinct(), 200_000), F.col("doc").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left_semi")
    again = again.select("doc", "t", _parts(F.col("text")).alias("parts"))
    again = again.select(F.col("doc").alias("d"), F.col("t").alias("u"), F.posexplode(_runs("parts")).alias("q", "run")).select("d", "u", (F.col("q") + 1).alias("q"), F.col("run.val").alias("mine"), "run.first", "run.last")
    own = needed.join(again, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")) & (F.col("at") == F.col("q")))
    values = own.groupBy(*key, "theirs").agg(F.min("mine").alias("low"), F.max("mine").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("windows").alias("windows"))
    end = lambda c: F.when(F.col("theirs").isNull(), F.col(c))
    spans = values.groupBy(*key).agg(F.bool_and(F.col("theirs").isNull() | (F.col("low") == F.col("high"))).alias("even"), F.min(end("first")).alias("first"), F.max(end("last")).alias("last"), F.max("windows").alias("windows"))
    return spans.filter("even").select("doc", "t", "item", "first", "last", "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", *, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, item, first, last, windows): each stretch of a document that matches a benchmark item, with consistent slots or verbatim.

    first and last are the token positions (from 1) in the document that matching windows cover, windows their count; alignments with an item that
    overlap are one stretch, with the count of the one that has most. Null and empty texts, and items without a token, match nothing. A document is an
    id, which may be null, with a text, whose xxhash64 is text_hash: equal rows count as one document, and other texts of one id apart. An empty table
    on either side gives no rows.
    """
    items = settle(item_templates(benchmark, item_col, "text"))
    bench = settle(item_windows(items, window))
    texts = _texts(docs, id_col, text_col)
    met = settle(_alignments(settle(window_hits(texts, bench, window)), bench))
    plain = met.filter(F.col("kind") == PLAIN)
    plain = plain.select("doc", "t", "item", (F.col("shift") + F.array_min("ats")).alias("first"), (F.col("shift") + F.array_max("ats") + F.col("size") - 1).alias("last"), "windows")
    spans = plain.unionByName(_spans(met.filter(F.col("kind") != PLAIN), texts, items))
    # Spans of one document and item in order; one that begins behind the end of all before it begins a stretch.
    order = Window.partitionBy("doc", "t", "item").orderBy("first", "last")
    spans = spans.withColumn("before", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("stretch", F.sum(F.when(F.col("first") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "t", "item", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("windows").cast("long").alias("windows"))
    return spans.select(F.col("doc").alias(id_col), F.col("t").alias("text_hash"), F.col("item").alias(item_col), "first", "last", "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", *, window: int = WINDOW) -> DataFrame:
    """(id, text_hash), distinct, of the documents in contamination(), without telling where or by which item.

    A document with a plain window of an item is one, whichever items have it: that takes a semi-join, so a passage that many documents and many items
    share costs no row per pair. Only the others are aligned.
    """
    items = settle(item_templates(benchmark, item_col, "text"))
    bench = settle(item_windows(items, window))
    texts = _texts(docs, id_col, text_col)
    hits = settle(window_hits(texts, bench, window))
    verbatim = hits.filter("plain").join(checked_broadcast(bench.filter(F.col("kind") == PLAIN).select("hash", "size").distinct()), ["hash", "size"], "left_semi")
    verbatim = settle(verbatim.select("doc", "t").distinct())
    known = checked_broadcast(verbatim.select(F.col("doc").alias("d"), F.col("t").alias("u")), 200_000)
    rest = hits.filter(~F.col("plain")).join(known, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left_anti")
    again = _spans(_alignments(rest, bench).filter(F.col("kind") != PLAIN), texts, items).select("doc", "t").distinct()
    return verbatim.unionByName(again).select(F.col("doc").alias(id_col), F.col("t").alias("text_hash"))


def _same_document(id_col: str, text_hash: Column) -> Column:
    return F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash == F.col("__t"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, less those that match a benchmark item. Null ids and repeated ones are judged by their texts; null texts stay."""
    since = mark()
    gone = settle(contaminated(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__t")))
    discard(docs.sparkSession, since, keep=(gone,))
    return docs.join(checked_broadcast(gone), _same_document("doc_id", F.xxhash64("text")), "left_anti")


def op1_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_id (the item of most windows, the least of them), windows (of that item)."""
    documents, since = table(spark, sf_dir, "documents"), mark()
    found = contamination(documents, table(spark, sf_dir, "benchmark")).groupBy("doc_id", "text_hash", "item_id").agg(F.sum("windows").alias("windows"))
    best = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__t")).agg(F.count("*").alias("n_items"), F.max(F.struct("windows", (-F.col("item_id")).alias("item"))).alias("top"))
    best = settle(best.select("__id", "__t", "n_items", (-F.col("top.item")).alias("item_id"), F.col("top.windows").alias("windows")))
    discard(spark, since, keep=(best,))
    best = checked_broadcast(best, 200_000)
    judged = documents.select("doc_id", F.xxhash64("text").alias("__text")).join(best, _same_document("doc_id", F.col("__text")), "left")
    return judged.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("windows", F.lit(0)).alias("windows"))
