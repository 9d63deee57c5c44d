"""Benchmark decontamination with a positional inverted index.

The index holds a posting (text, term, position) for each corpus word that the
test items use. A window of a test item is looked up by its rarest term: the
term's positions less its offset in the window are the places where the window
may start. They are intersected with the list of the second-rarest term, again
less its offset, and what is left with the lists of all other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import sized, stage
from lendscope.llm.digests import NOTHING, joined_sha256, key128

#: Between words: all of ASCII but digits and letters (lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term of the posting that closes each text; its position is the number of words.
END = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # The same for ASCII only, but much faster there; and Spark splits a text some twenty times faster than it extracts all matches.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def text_key(text: Column) -> Column:
    return key128(F.coalesce(text, F.lit("")))


def vocabulary(items: DataFrame) -> DataFrame:
    """term (a number), word: every word of the items' texts, and END with the empty word."""
    found = items.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    found = found.select(F.monotonically_increasing_id().alias("term"), "word")
    return stage(found.unionByName(items.sparkSession.range(1).select(F.lit(END).cast("long").alias("term"), F.lit("").alias("word"))), "vocabulary")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key (128 bits of the text's digest), term, pos: a posting for each
    occurrence of one of ``terms`` (term, word), and one of END for each text.
    Written to the shared folder; copies of a text write the same postings under
    one key."""
    # Two selects, or Spark would take the digest again for each word; outer, or it would filter by the words first and so split twice.
    texts = docs.select(text_key(F.col("text")).alias("key"), F.array_append(words(F.col("text")), "").alias("w"))
    tokens = texts.select("key", F.posexplode_outer("w").alias("pos", "word"))
    return stage(tokens.join(sized(terms, F.octet_length("word") + 32), "word").select("key", "term", "pos"), "postings")


def item_windows(items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(window, words) of each distinct window, and (window, item): ``length``
    consecutive words of an item, or all words of a shorter one."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    cut = w.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, length))).alias("words"))
    cut = stage(cut.select("item", "words", key128(F.array_join("words", " ")).alias("window")), "item-windows")
    return cut.groupBy("window").agg(F.first("words").alias("words")), cut.select("window", "item").distinct()


def lookups(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """window, n (words), plan: its (count in the corpus, offset, term), rarest
    first. Windows with a word that the corpus lacks can't occur and are left out."""
    counts = terms.join(index.groupBy("term").agg(F.count(F.lit(1)).alias("count")), "term")
    each = windows.select("window", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word")).join(counts, "word")
    plans = each.groupBy("window", "n").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("plan"))
    return stage(plans.where(F.size("plan") == F.col("n")), "lookups")


def phrase_matches(index: DataFrame, plans: DataFrame) -> DataFrame:
    """key, window, start, n: every place where a window's words follow each other."""
    def entry(i):
        return F.col("plan")[i]
    first = plans.select(entry(0)["term"].alias("term"), entry(0)["offset"].alias("shift"), "window", "n",
                         F.expr("get(plan, 1).term").alias("next_term"), F.expr("get(plan, 1).offset").alias("next_offset"))
    first, seconds = sized(first, 64), sized(plans.select(F.expr("get(plan, 1).term").alias("term")), 16)
    starts = index.join(first, "term").withColumn("start", F.col("pos") - F.col("shift")).where("start >= 0").select(
        "key", "window", "n", "start", F.col("next_term").alias("term"), (F.col("start") + F.col("next_offset")).alias("pos")).distinct()
    both = starts.where("n > 1").join(index.join(seconds, "term", "left_semi"), ["key", "term", "pos"], "left_semi")
    both = stage(both.select("key", "window", "start", "n"), "pairs-of-terms")
    rest = plans.select("window", F.slice("plan", 3, F.greatest(F.col("n") - 2, F.lit(0))).alias("rest"))
    rest = both.join(sized(rest, 64 + 32 * F.size("rest")), "window")
    rest = rest.select("key", "window", "start", "n", F.explode("rest").alias("r")).select(
        "key", "window", "start", "n", F.col("r.term").alias("term"), (F.col("start") + F.col("r.offset")).alias("pos"))
    near = index.join(sized(both.select("key"), 48), "key", "left_semi")  # few texts are left, mostly
    whole = rest.join(near, ["key", "term", "pos"], "left_semi").groupBy("key", "window", "start", "n").agg(
        F.count(F.lit(1)).alias("found")).where("found = n - 2").drop("found")
    return starts.where("n = 1").select("key", "window", "start", "n").unionByName(both.where("n = 2")).unionByName(whole)


def proximity_matches(index: DataFrame, plans: DataFrame, within: int) -> DataFrame:
    """key, window, pos: every place of a window's rarest term that has each
    other distinct term of the window at most ``within`` words away, in any
    order. Places meet lists in cells of ``within`` words, three cells a place."""
    lists = index.select("key", "term", F.col("pos").alias("other"), (F.col("pos") / within).cast("long").alias("cell"))
    first = plans.select(F.col("plan")[0]["term"].alias("term"), "window",
                         F.expr("array_except(array_distinct(transform(plan, x -> x.term)), array(plan[0].term))").alias("others"))
    places = index.join(first, "term").select("key", "window", "pos", "others").distinct()
    wanted = places.where(F.size("others") > 0).select("key", "window", "pos", F.size("others").alias("n"), F.explode("others").alias("term"))
    cells = wanted.withColumn("cell", F.explode(F.array(*[(F.col("pos") / within).cast("long") + d for d in (-1, 0, 1)])))
    near = cells.join(lists, ["key", "term", "cell"]).where(F.abs(F.col("other") - F.col("pos")) <= within)
    met = near.groupBy("key", "window", "pos", "n", "term").agg(F.count(F.lit(1))).groupBy("key", "window", "pos", "n").agg(
        F.count(F.lit(1)).alias("met")).where("met = n")
    return met.select("key", "window", "pos").unionByName(places.where(F.size("others") == 0).select("key", "window", "pos"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items (items with occurring windows), items_sha256
    (of their ids, sorted as strings, joined by commas), contaminated.

    Items are (item_id, text). A window is ``length`` consecutive words of an
    item, or all words of a shorter one; an item without words (NULL, empty) has
    none. Rows of ``items`` with one item_id count as one item; a NULL item_id is
    an item whose id is written as the empty string. NULL, empty and wordless
    documents have no words. Texts of any length are read whole. Rows that share
    an id, lack one or repeat a text are each judged by their own text. Empty
    tables: no documents give no rows, no items clean documents. Other columns
    are not looked at."""
    items = items.select("item_id", "text")
    terms = vocabulary(items)
    index = positional_index(docs, terms)
    windows, owners = item_windows(items, length)
    matches = stage(phrase_matches(index, lookups(windows, terms, index)), "matches")
    # Words covered by spans in rising order: each adds what lies beyond all before it.
    spans = matches.select("key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start")))
    hits = spans.select("key", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    found = matches.select("key", "window").distinct().join(owners, "window").select("key", F.col("item").alias("value")).distinct()
    found = joined_sha256(found).select("key", F.col("n").alias("n_items"), F.col("sha256").alias("items_sha256"))
    texts = index.where(F.col("term") == END).groupBy("key").agg(F.max("pos").cast("long").alias("n_words"))
    per_text = stage(texts.join(hits, "key", "left").join(found, "key", "left"), "texts")
    # Copies of one text are one key: the join comes last, so that Spark may split it.
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(per_text, "key").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(NOTHING)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
