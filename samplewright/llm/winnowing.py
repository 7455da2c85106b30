"""Benchmark decontamination by winnowing, with SQL functions only.

Both sides are cut into words. Of the hashes of all k-grams, the smallest in each sliding window of
``span - k + 1`` k-grams is kept, with its place. Two texts that share ``span`` consecutive words share a
whole window, so they keep the same k-gram at the same place of the shared words: no shared span of that
length is missed. Fingerprints that both sides keep are joined, and each hit is extended to the left and
right, word by word, as far as a span of that length can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from . import keyfilter
from .text import ascii_lower

#: Binary logarithm of the most bits that a filter of fingerprints may have: 8 MB are broadcast.
MOST_FILTER_BITS = 26
#: Everything in ASCII but digits and letters separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS)
    # Only the first and the last part can be empty.
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def fingerprints(word_list: str, k: int, span: int) -> Column:
    """Places (0-based) of the k-grams that winnowing keeps, with 31 bits of their hash above the place.

    A place fits in 31 bits, as many as an array can have elements.
    """
    grams = F.size(word_list) - k + 1
    window = span - k + 1

    def coded(i: Column) -> Column:
        gram = F.xxhash64(F.slice(word_list, i + 1, k))
        return F.shiftleft(F.shiftrightunsigned(gram, 33), 31).bitwiseOR(i.cast("long"))

    codes = F.transform(F.sequence(F.lit(0), grams - 1), coded)
    least = lambda c: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size(c) - window + 1), lambda i: F.array_min(F.slice(c, i, window)))
    )
    # The codes are computed once and bound to a lambda variable; named twice they would be computed twice.
    found = F.flatten(F.transform(F.array(codes), least))
    return F.when(F.size(word_list) >= span, found).otherwise(F.array().cast("array<bigint>"))


def _hash_part(code: Column) -> Column:
    return F.shiftright(code, 31)


def _hash_part_of(fp: Column) -> Column:
    """The 31 bits of a k-gram's hash that a fingerprint carries."""
    return F.shiftrightunsigned(fp, 33)


def _place(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _context(word_list: str, place: Column, k: int, span: int) -> list[Column]:
    """The k-gram's words, and the words before (nearest last) and after it that a span can reach."""
    reach = span - k
    start = F.greatest(place - reach, F.lit(0))
    return [
        F.slice(word_list, place + 1, k).alias("gram"),
        F.slice(word_list, start + 1, place - start).alias("left"),
        F.slice(word_list, place + k + 1, reach).alias("right"),
    ]


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    breaks = F.array_position(same, False)
    return F.when(n == 0, 0).when(breaks == 0, n).otherwise(breaks - 1).cast("int")


def shared_spans(
    documents: DataFrame, items: DataFrame, span: int, k: int, filter_bits: int
) -> DataFrame:
    """Stretches of ``span`` words or more around joined fingerprints: (key, item, start, end).

    documents is (key, text), items is (item, words). The work is linear in the length of a text. Only texts with a
    fingerprint that the filter lets through are shuffled.
    """
    k = min(k, span)
    items = items.where(F.size("words") >= span)

    def contexts(places: Column) -> Column:
        """The stretches around places, built inside the row: its words aren't copied to each of them."""
        return F.transform(places, lambda p: F.struct(p.alias("place"), *_context("words", p, k, span)))

    theirs = items.select("item", F.explode(contexts(F.transform(fingerprints("words", k, span), _place))).alias("c"))
    theirs = theirs.select("item", "c.gram", "c.left", "c.right")
    # Items that say the same around a place are one row.
    theirs = theirs.groupBy("gram", "left", "right").agg(F.collect_set("item").alias("found_items"))
    theirs = store(theirs.withColumn("fp", F.xxhash64("gram")), "fingerprints")

    # Fingerprints alone are looked up first. Documents with a hit are few; their texts meet the places of the hits and are
    # cut into words again.
    bits = min(1 << MOST_FILTER_BITS, max(filter_bits, 1 << (1024 * theirs.count()).bit_length()))
    pages = keyfilter.build(theirs.select(_hash_part_of(F.col("fp")).alias("h")), "h", bits)
    cut = documents.select("key", words(F.col("text")).alias("words"))
    codes = cut.select("key", F.explode(fingerprints("words", k, span)).alias("code"))
    codes = codes.select("key", _hash_part(F.col("code")).alias("h"), _place(F.col("code")).alias("place"))
    hits = keyfilter.ask(codes, "h", pages, bits, "maybe").where("maybe")
    # Rows with equal id and text have the same places.
    hits = hits.groupBy("key").agg(F.collect_set("place").alias("places"))
    hits = store(hits.select(F.col("key").alias("hit_key"), F.xxhash64("key").alias("hit"), "places"), "hits")

    keyed = documents.select("key", "text", F.xxhash64("key").alias("mine"))
    some = keyfilter.ask(keyed, "mine", keyfilter.build(hits, "hit", filter_bits), filter_bits, "has_hit").where("has_hit")
    # A null id is equal to itself here, as in the grouping.
    found = some.join(hits, (F.col("mine") == F.col("hit")) & F.col("key").eqNullSafe(F.col("hit_key")))
    found = found.select("key", words(F.col("text")).alias("words"), "places")
    mine = found.select("key", F.explode(contexts(F.col("places"))).alias("c"))
    mine = mine.select("key", "c.place", F.col("c.gram").alias("my_gram"), F.col("c.left").alias("my_left"), F.col("c.right").alias("my_right"))
    mine = mine.withColumn("my_fp", F.xxhash64("my_gram"))

    met = mine.join(theirs, (F.col("my_fp") == F.col("fp")) & (F.col("my_gram") == F.col("gram")))
    back = _common(F.reverse("my_left"), F.reverse("left"))
    ahead = _common(F.col("my_right"), F.col("right"))
    extended = met.select(
        "key", "found_items", (F.col("place") - back).alias("start"), (F.col("place") + k + ahead).alias("end")
    ).where(F.col("end") - F.col("start") >= span)
    return extended


def decontaminate(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    benchmark: DataFrame,
    item_col: str,
    item_text_col: str,
    span: int = 10,
    k: int = 5,
    filter_bits: int = 1 << 23,
) -> DataFrame:
    """Words of documents that lie in benchmark windows: (id, text_key, n_words, n_hit, n_items, item_ids).

    A window is ``span`` consecutive words of an item, or all words of an item that has fewer, but some.
    A document's word is hit if it lies in any occurrence of a window. item_ids holds the items with windows
    in the document as strings in code-point order; text_key, a hash of the text, tells rows with equal ids
    apart. Null texts, and null ids of items, have no words and
    no part. Rows with equal id and text are reported alike; other columns are ignored; an empty table on
    either side gives no hits.

    Short items are matched by winnowing at their own length, one round for each length that occurs.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = cut.select("id", "text", F.xxhash64("text").alias("text_key"))
    cut = cut.withColumn("key", F.struct("id", "text_key"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("words"))
    items = items.where(F.col("item").isNotNull())

    short = items.where((F.size("words") > 0) & (F.size("words") < span)).select(F.size("words").alias("n")).distinct()
    rounds = [(span, items)]
    for row in short.collect():  # fewer than span rows
        rounds.append((row.n, items.where(F.size("words") == row.n)))
    found = None
    for length, part in rounds:
        one = shared_spans(cut.select("key", "text"), part, length, k, filter_bits)
        found = one if found is None else found.unionByName(one)
    found = store(found, "spans")

    hits = found.select("key", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
    hits = hits.groupBy("key").agg(F.count("*").alias("n_hit"))
    names = found.select("key", F.explode("found_items").alias("item")).distinct()
    names = names.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    report = hits.join(names, "key").select(
        F.col("key.id").alias("hit_id"), F.col("key.text_key").alias("hit_text"), "n_hit", "item_ids"
    )
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_text"))
    counted = cut.select("id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(report, same, "left").select(
        F.col("id").alias(id_col),
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )
