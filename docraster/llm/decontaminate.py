"""Benchmark decontamination with DataFrame functions only.

An item's windows are all its runs of ``width`` normalised words (a shorter item is one window). A window is known
by a key, a hash of the hashes of its first, middle and last word. The set of all keys is broadcast as a hash table
and joined with the keys of all windows of the documents; of those that meet, and of no others, the words are put
together, and joined with the benchmark's own. Documents are read once; nothing but places that hit is shuffled. A set
of more than ``at_once`` keys is dealt to several passes over the documents, each with a broadcast of that size at
most; nothing else depends on the size.

Documents of one text are one case (two 64-bit hashes of the text name it). A window in a great many texts, or a text of
a great many documents, is dealt to many tasks (``salted_join``). What is found is small against the
documents; Spark broadcasts it where its size on disk allows, and joins by a shuffle where not.

Nulls: a null text has no words; an item with a null text or without words has no window, and a null item_id is
left out of the list of items. A null doc_id stays as it is. Repeated rows are judged one by one, repeated items
count by their item_id. Very long texts are scanned whole. An empty benchmark leaves all documents clean, and an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import kept, salted_join

WIDTH, SHARE, KEYS_AT_ONCE = 13, 20, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are taken as a-z."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def text_key(text: Column) -> list[Column]:
    """Two hashes that name a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2")]


def _key(h: Column, first: Column, length: Column) -> Column:
    """The key of the window that starts at ``first`` (from 0). h: hashes of the words."""
    middle = first + F.floor(length / 2).cast("int")
    return F.xxhash64(F.get(h, first), F.get(h, middle), F.get(h, first + length - 1), length)


def _window(w: Column, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, first + 1, length), " ")


def once(value: Column) -> Column:
    """A generator's result is never computed anew inside the expressions and filters above it."""
    return F.explode(F.array(value))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, length, body (the window's words) and key of each window of each item."""
    w = items.select("item_id", once(words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", once(hashes(F.col("w"))).alias("h"), F.least(F.size("w"), F.lit(width)).alias("length"))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda i: F.struct(_window(F.col("w"), i, F.col("length")).alias("body"), _key(F.col("h"), i, F.col("length")).alias("key")))
    return w.select("item_id", "length", F.explode(each).alias("s")).select("item_id", "length", "s.body", "s.key").distinct()


def scanned(docs: DataFrame, known: DataFrame, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """A row of each document (first -1) and of each place at which a key occurs: doc_id, t1, t2, n_words, first,
    length, body."""
    keys = known.select("key").distinct()
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # as many as a window has words
    passes = -(-keys.count() // at_once)
    base = docs.select("doc_id", *text_key(F.col("text")), once(words(F.col("text"))).alias("w"))
    base = base.select("*", once(hashes(F.col("w"))).alias("h"))
    h, n = F.col("h"), F.size("w")

    def of_length(length: int) -> Column:
        return F.transform(h, lambda _, i: F.when(i + length <= F.size(h), _key(h, i, F.lit(length))))

    # places of all lengths in one array of keys; the document's own row stands before them
    every = base.select("doc_id", "t1", "t2", "w", once(F.concat(F.array(F.lit(None).cast("long")), *map(of_length, lengths))).alias("keys"))
    parts = []
    for i in range(max(1, passes)):
        rows = every.select("doc_id", "t1", "t2", "w", F.posexplode("keys").alias("at", "key"))
        if passes:
            own = keys.where(F.pmod("key", F.lit(passes)) == i).select("key", F.lit(True).alias("hit"))
            rows = rows.join(F.broadcast(own), "key", "left").where(F.col("hit") | (F.col("at") == 0) if i == 0 else F.col("hit"))
        place = F.col("at") > 0
        first = F.when(place, (F.col("at") - 1) % n).otherwise(-1)
        length = F.when(place, F.get(F.array(*map(F.lit, lengths)), F.floor((F.col("at") - 1) / n).cast("int"))).otherwise(n) if lengths else n
        parts.append(rows.select("doc_id", "t1", "t2", n.alias("n_words"), first.alias("first"), length.alias("length"), F.when(place, _window(F.col("w"), first, length)).alias("body")))
    return kept(reduce(DataFrame.unionAll, parts), "scan")


def verified(scan: DataFrame, known: DataFrame) -> DataFrame:
    """The windows that do occur, word by word: t1, t2 and n_words of the text, first, length, body; each once."""
    found = kept(scan.where("first >= 0").select("t1", "t2", "n_words", "first", "length", "body").distinct(), "places")
    return kept(salted_join(found, known.select("length", "body").distinct(), ["length", "body"], "left_semi"), "hits")


def in_order(hits: DataFrame) -> DataFrame:
    """t1, t2, n_words and found (first, length; in order) of each text that is hit."""
    return hits.groupBy("t1", "t2").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("first", "length"))).alias("found"))


def spans(found: Column, width: int = WIDTH) -> Column:
    """Union of the windows as (from, to) word ranges, in order. found: windows of at most ``width`` words in order of their
    first word, then length. Work grows with their number: a window touches none but the last ``width`` before it."""
    longest = F.filter(found, lambda s, i: F.coalesce(F.get(found, i + 1)["first"] != s["first"], F.lit(True)))

    def of(w: Column) -> Column:
        def end(i: Column) -> Column:
            """Where the windows up to the i-th end, or -1."""
            begin = F.greatest(i - width, F.lit(0))
            return F.coalesce(F.array_max(F.transform(F.slice(w, begin + 1, F.greatest(i - begin + 1, F.lit(0))), lambda s: s["first"] + s["length"])), F.lit(-1))

        opens = F.filter(w, lambda s, i: end(i - 1) < s["first"])
        closes = F.filter(F.transform(w, lambda s, i: F.struct(end(i).alias("to"), F.get(w, i + 1)["first"].alias("next"))), lambda s: F.coalesce(s["next"] > s["to"], F.lit(True)))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a["first"].alias("from"), b["to"].alias("to")))

    return F.flatten(F.transform(F.array(longest), of))


def n_hit(found: Column) -> Column:
    """Number of words inside any of the windows, which come in order of their first word."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        to = F.greatest(acc["end"], s["first"] + s["length"])
        return F.struct((acc["n"] + to - F.greatest(acc["end"], s["first"])).alias("n"), to.alias("end"))

    return F.aggregate(found, start, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, spans.

    A document is contaminated if at least one in ``share`` of its words is hit.
    """
    known = kept(windows(benchmark, width), "windows")
    scan = scanned(docs, known, at_once)
    hits = verified(scan, known)
    of_text = kept(hits.select("t1", "t2", "length", "body").distinct(), "windows-of-texts")
    named = salted_join(of_text, known.select("length", "body", F.col("item_id").cast("string").alias("item")), ["length", "body"])
    named = named.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    about = in_order(hits).join(named, ["t1", "t2"], "left").select("t1", "t2", "items", n_hit(F.col("found")).alias("n_hit"), "found")
    every = scan.where("first < 0").select("doc_id", "t1", "t2", F.col("n_words").cast("long").alias("n_words"))
    rows = salted_join(every, kept(about, "found"), ["t1", "t2"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"), F.coalesce(spans(F.col("found"), width), F.array().cast("array<struct<from:int,to:int>>")).alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """The documents, whole and with all their columns, that are not contaminated."""
    known = kept(windows(benchmark, width), "windows")
    narrow = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    scan = scanned(narrow, known, at_once)
    hits = verified(scan, known)
    bad = kept(in_order(hits).where(share * n_hit(F.col("found")) >= F.col("n_words")).select("t1", "t2"), "contaminated")
    rows = docs.select(F.struct("*").alias("d"), *text_key(F.col("text")))
    return salted_join(rows, bad, ["t1", "t2"], "left_anti", counted=scan.where("first < 0")).select("d.*")
