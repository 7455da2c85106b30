"""Exact deduplication by progressive refinement, with SQL functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from . import keyfilter
from .text import SPACES


def squeezed(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters; null counts as empty."""
    return functools.reduce(lambda t, space: F.replace(t, F.lit(space), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def exact_dedup(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    prefix_chars: int = 64,
    filter_bits: int = 1 << 23,
    digests: bool = False,
) -> DataFrame:
    """Which of the rows with equal texts stays: (id, keep_id, group_size, kept).

    Texts are equal when they agree after all ASCII white space is deleted. Of equal texts the one with the
    most characters in the original stays, then the smallest id.

    Refinement: rows are first counted by length, then, where a length is shared, by length and a hash of
    the first ``prefix_chars`` characters, and only rows that share both get a hash of the whole text. The
    surviving lengths and prefixes are looked up in bitmaps of ``filter_bits`` bits (1 MB by default), so
    no text is shuffled. A full bitmap lets more rows through to the full hash; the result is the same.
    With ``digests`` there is a fifth column, digest, the SHA-256 of the squeezed text of every row; without
    it texts that were told apart earlier are never hashed as a whole.

    Null texts count as empty, and empty texts are equal to each other. Null ids rank last in ties; of rows
    that repeat the kept row's id and length, one is kept. An empty table gives an empty result. Other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.select("id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), squeezed(F.col("text")).alias("norm"))
    head = F.substring("norm", 1, prefix_chars)
    base = base.select("id", "chars", "norm", F.length("norm").alias("n"), F.xxhash64(F.length("norm"), head).alias("p"))

    # Level 1: length. Level 2: length and prefix hash, where the length is shared. Both on narrow rows.
    narrow = store(base.select("n", "p"), "lengths")
    lengths = narrow.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64("n").alias("key"))
    pages = keyfilter.build(lengths, "key", filter_bits)
    level1 = keyfilter.ask(narrow.withColumn("key", F.xxhash64("n")), "key", pages, filter_bits, "shared")
    heads = level1.where("shared").groupBy("p").agg(F.count("*").alias("c")).where("c > 1")
    level2 = keyfilter.ask(base, "p", keyfilter.build(heads, "p", filter_bits), filter_bits, "shared")

    # Level 3: the full hash, where length and prefix are shared.
    full = F.sha2("norm", 256)
    level3 = level2.select(
        "id",
        "chars",
        F.when(F.col("shared"), full).alias("full_hash"),
        (full if digests else F.lit(None).cast("string")).alias("digest"),
    )
    level3 = store(level3, "hashes")

    best = F.min(F.struct((-F.col("chars")).alias("r"), F.col("id").isNull().alias("u"), "id"))
    groups = (
        level3.where("full_hash is not null")
        .groupBy("full_hash")
        .agg(best.alias("best"), F.count("*").alias("size"))
        .where("size > 1")
        .select(F.col("full_hash").alias("group_key"), F.col("best.id").alias("first"), (-F.col("best.r")).alias("most"), "size")
    )
    # Written out, so that the join's sides are plain tables and a large group can be split among tasks.
    groups = store(groups, "groups")
    # Rows that stand alone get keys of their own, so that the join isn't skewed by nulls.
    own = F.coalesce("full_hash", F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    joined = level3.withColumn("own", own).join(groups, F.col("own") == F.col("group_key"), "left")
    in_group = F.col("size").isNotNull()
    candidate = ~in_group | (F.col("id").eqNullSafe(F.col("first")) & (F.col("chars") == F.col("most")))
    rows = joined.select(
        "id",
        F.when(in_group, F.col("first")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        candidate.alias("candidate"),
        in_group.alias("in_group"),
        "full_hash",
        "digest",
    )
    # One of the rows that repeat the kept row: the window sees one small partition for each group.
    contested = F.col("candidate") & F.col("in_group")
    one = F.row_number().over(Window.partitionBy("full_hash", "id").orderBy(F.lit(1))) == 1
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", "kept", *(["digest"] if digests else [])]
    return (
        rows.where(~contested)
        .withColumn("kept", F.col("candidate"))
        .select(*columns)
        .unionByName(rows.where(contested).withColumn("kept", one).select(*columns))
    )
