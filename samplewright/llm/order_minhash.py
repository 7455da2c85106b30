"""Near-duplicate detection with Order MinHash sketches and banded alignment.

A text is cut into words and into shingles of five consecutive words; the i-th occurrence of a shingle in a
text is told apart from the others. One sketch entry takes, under its own hash function, the few labelled
shingles with the smallest hashes and keeps them in the order of the text. Entries of two texts agree when
they picked the same shingles in the same order, which gets likelier with their similarity under edits.

The similarity of two texts is that of their best alignment: with L the length of the longest common
subsequence of their labelled shingles, L / (n + m - L). For changes in place it is the Jaccard similarity of
the shingles. Because at most (n + m)(1 - s) / (1 + s) shingles may be left over at similarity s, the
alignment only looks at a band of that width around the diagonal, and stays exact for all pairs that reach s.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from ..shipping import ship
from .arrow import mapped_bytes, pieces, word_hashes, word_lists
from .components import components

#: ASCII other than letters and digits separates words, A-Z is lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SHINGLE_WORDS = 5
#: Shingles in one entry, and entries.
TUPLE, ENTRIES = 5, 64
#: The same for short texts. Texts of up to SHORT shingles get both kinds, so two texts at similarity 0.8
#: have the short kind in common if the smaller has up to 0.8 * SHORT shingles.
SHORT_TUPLE, SHORT_ENTRIES, SHORT = 2, 24, 30
#: Entries of the long kind that are used as buckets; all of the short kind are.
BANDS = 24
#: Texts of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 256
#: Agreeing entries of either kind below which a pair isn't aligned. At similarity 0.8 an entry of the long
#: kind agrees with probability 0.8^5, so 21 of 64 agree on average, and fewer than 7 in one of 80,000 pairs;
#: the short kind agrees with 0.6 or more.
LEAST_AGREEING, LEAST_AGREEING_SHORT = 7, 6
#: Cells of the hash table of one text that are worked on at once.
_CELLS = 4 << 20

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Labelled shingles of one text, as hashes, in text order. Fewer words than a shingle's make one shingle."""
    if not len(words):
        return words
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams += words[j : j + n] * _WEIGHTS[j]
    grams = _mixed(grams + np.uint64(width))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not fresh.all():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        grams = _mixed(grams + label * np.uint64(0x9FB21C651E98DF25))
    return grams


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, ENTRIES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, ENTRIES, np.uint32)


def _entries(grams: np.ndarray, size: int, count: int) -> np.ndarray:
    """Entries of one text: hashes of its smallest labelled shingles in text order."""
    odd, flip = _functions()
    n, size_wanted, size = len(grams), size, min(size, len(grams))
    folded = (grams >> np.uint64(32)).astype(np.uint32)
    place = np.arange(n, dtype=np.uint64)
    out = np.empty(count, np.uint64)
    step = max(1, _CELLS // n)
    for first in range(0, count, step):
        rows = slice(first, min(count, first + step))
        values = (folded[None, :] ^ flip[rows, None]) * odd[rows, None]
        values ^= values >> np.uint32(15)
        keyed = (values.astype(np.uint64) << np.uint64(32)) | place
        least = np.partition(keyed, size - 1, axis=1)[:, :size] if size < n else keyed
        picked = grams[np.sort(least & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)]
        entry = np.zeros(len(picked), np.uint64)
        for j in range(size):
            entry = _mixed(entry + picked[:, j])
        out[rows] = entry
    # An entry only ever agrees with the same entry of another text.
    return _mixed(out + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(size_wanted))


def _folded(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _sketch(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, long entries, short entries) of one text."""
    long = _entries(grams, TUPLE, ENTRIES)
    short = _entries(grams, SHORT_TUPLE, SHORT_ENTRIES) if len(grams) <= SHORT else np.zeros(0, np.uint64)
    return np.concatenate([long[:BANDS], short]).view(np.int64), _folded(long).view(np.int32), _folded(short).view(np.int32)


def _compact(grams: np.ndarray) -> np.ndarray:
    """Labelled shingles as distinct 32-bit numbers. Where two of a text fall together, the later takes other bits."""
    out = _folded(grams)
    _, first = np.unique(out, return_index=True)
    if len(first) < len(out):
        again = np.ones(len(out), bool)
        again[first] = False
        taken = set(out[first].tolist())
        for i in np.flatnonzero(again):
            value = int(grams[i] & np.uint64(0xFFFFFFFF))
            while value in taken:
                value = (value + 1) & 0xFFFFFFFF
            taken.add(value)
            out[i] = value
    return out


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the words of texts."""
    offsets, distinct, index = word_lists(mapped_bytes(texts, _TABLE))
    return offsets, word_hashes(distinct)[index] if len(index) else np.zeros(0, np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 2):
            offsets, hashes = _cut(piece.column(2))
            digests, counts, sketches = [], [], []
            for i in range(piece.num_rows):
                words = hashes[offsets[i] : offsets[i + 1]]
                grams = _shingles(words)
                digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                counts.append(len(grams))
                sketches.append(_sketch(grams) if len(grams) else (None, None, None))
            lists = [pa.array([k[i] for k in sketches], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), *lists],
                ["id", "text_key", "node", "n", "bands", "long", "short"],
            )


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their compact shingles, worked out once for all pairs they are in."""
    for batch in batches:
        for piece in pieces(batch, 1):
            offsets, hashes = _cut(piece.column(1))
            grams = [_compact(_shingles(hashes[offsets[i] : offsets[i + 1]])) for i in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([g.tobytes() for g in grams], pa.binary())], ["node", "grams"])


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of labelled shingles by alignment in the band that ``least`` allows; 0 if out of reach."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    spare = (n + m) * (1 - least) / (1 + least)
    near = np.abs(at_a - at_b) <= spare
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least * (n + m - len(at_a)):
        return 0.0
    path = at_b[np.argsort(at_a)]
    if (path[1:] > path[:-1]).all():
        common = len(path)
    else:  # shingles occur once, so the common subsequence is the longest increasing run of places
        ends: list[int] = []
        for p in path.tolist():
            i = bisect_left(ends, p)
            ends[i : i + 1] = [p]
        common = len(ends)
    return common / (n + m - common)


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                same = [
                    aligned(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), least)
                    for a, b in zip(piece.column(2), piece.column(3), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(same, pa.float64())], ["a", "b", "similarity"]
                )

    return run


def _matrix(lists: pa.ChunkedArray, width: int, fill: int) -> np.ndarray:
    """Rows of up to ``width`` numbers; missing ones are ``fill``."""
    whole = lists.combine_chunks()
    sizes = np.diff(whole.offsets.to_numpy())
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = whole.flatten().to_numpy()
    return out


def _link_blocks(least: float):
    """Aligns what may be similar between two blocks of a bucket, or inside one, for all of a group's blocks."""

    def run(table: pa.Table) -> pa.Table:
        bucket, i, j, block, n = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "n"))
        node = table.column("node").combine_chunks()
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        place = node.dictionary_encode().indices.to_numpy()
        long = _matrix(table.column("long"), ENTRIES, 0).astype(np.int32)
        bands = _matrix(table.column("bands"), BANDS + SHORT_ENTRIES, 0)
        # Missing entries agree with nothing: entries are 32-bit numbers.
        short = [_matrix(table.column("short"), SHORT_ENTRIES, 1 << (40 + side)) for side in (0, 1)]
        grams = table.column("grams").combine_chunks()
        shingles = lambda row: np.frombuffer(grams[int(row)].as_buffer(), np.uint32)
        found: list[tuple[int, int]] = []
        order = np.lexsort((block, j, i, bucket))
        key = np.stack([bucket[order], i[order], j[order]])
        edges = np.flatnonzero(np.any(np.diff(key, axis=1, prepend=key[:, :1] - 1) != 0, axis=0))
        for rows in np.split(order, edges[1:]):
            inside = i[rows[0]] == j[rows[0]]
            left = rows if inside else rows[block[rows] == i[rows[0]]]
            right = rows if inside else rows[block[rows] == j[rows[0]]]
            for start in range(0, len(left), BLOCK // 4):
                some = left[start : start + BLOCK // 4]
                for begin in range(0, len(right), BLOCK):
                    others = right[begin : begin + BLOCK]
                    may = root[some][:, None] != root[others][None, :]
                    may &= np.minimum.outer(n[some], n[others]) >= least * np.maximum.outer(n[some], n[others])
                    if inside:
                        may &= place[some][:, None] < place[others][None, :]
                    agree = (long[some][:, None, :] == long[others][None, :, :]).sum(axis=2, dtype=np.uint8) >= LEAST_AGREEING
                    few = np.minimum.outer(n[some], n[others]) <= SHORT
                    if few.any():
                        agree |= (short[0][some][:, None, :] == short[1][others][None, :, :]).sum(axis=2) >= LEAST_AGREEING_SHORT
                    at = np.argwhere(may & agree)
                    x, y = some[at[:, 0]], others[at[:, 1]]
                    # The first band in which they agree is this bucket's.
                    first = (bands[x] == bands[y]).argmax(axis=1)
                    here = bands[x, first] == bucket[rows[0]]
                    found += zip(x[here].tolist(), y[here].tolist(), strict=True)
        links = [(x, y) for x, y in found if aligned(shingles(x), shingles(y), least) >= least]
        a, b = (pa.array([k[side] for k in links], pa.int64()) for side in (0, 1))
        return pa.table([node.take(a), node.take(b)], names=["a", "b"])

    return run


def _agree_enough():
    """Whether sketches a and b agree in enough entries of either kind; entries of a sketch are all different."""
    enough = F.size(F.array_intersect("long_a", "long_b")) >= LEAST_AGREEING
    return enough | (F.size(F.array_intersect("short_a", "short_b")) >= LEAST_AGREEING_SHORT)


def _alike_in_length(x, y, least: float):
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


_SKETCH = ("bands", "long", "short")


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


class _Graph:
    """The distinct texts of a table, their buckets, and the links found so far."""

    def __init__(self, docs: DataFrame, least: float):
        self.docs, self.least = docs, least
        id_type = docs.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, text_key bigint, node binary, n int, bands array<bigint>, long array<int>, short array<int>"
        self.rows = store(docs.select("id", "text_key", "text").mapInArrow(_sketches, schema), "sketches")
        first = F.min(F.struct(F.col("id").isNull().alias("u"), "id", "text_key"))
        nodes = self.rows.where("n > 0").groupBy("node").agg(first.alias("r"), *[F.first(c).alias(c) for c in ("n", *_SKETCH)])
        self.nodes = store(nodes.select("node", "r.id", "r.text_key", "n", *_SKETCH), "nodes")
        keyed = self.nodes.select("node", F.explode("bands").alias("bucket"))
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        # Texts that stand alone in all buckets are done.
        self.buckets = store(keyed.join(sizes, "bucket"), "buckets")

    def central_pairs(self) -> DataFrame:
        """Each member of a bucket with the bucket's most central text: the one in the largest buckets overall."""
        weight = self.buckets.groupBy("node").agg(F.sum("size").alias("weight"))
        weighed = self.buckets.join(weight, "node")
        leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"))
        pairs = self.buckets.join(leaders.select("bucket", F.col("top.node").alias("leader")), "bucket").where("node <> leader")
        return _ordered(pairs, "node", "leader")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose lengths and sketches leave room for the similarity."""
        side = self.nodes.select("node", "n", "long", "short")
        left = pairs.join(side.toDF("a", "n_a", "long_a", "short_a"), "a")
        both = left.join(side.toDF("b", "n_b", "long_b", "short_b"), "b")
        fits = _alike_in_length(F.col("n_a"), F.col("n_b"), self.least) & _agree_enough()
        return both.where(fits).select("a", "b")

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """Compact shingles of nodes: (node, grams). Reads the texts of their documents only."""
        wanted = self.nodes.select("node", "id", "text_key").join(wanted, "node")
        wanted = wanted.select("node", F.col("id").alias("rep_id"), F.col("text_key").alias("rep_key"))
        same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key"))
        texts = self.docs.join(wanted, same).select("node", "text")
        made = texts.mapInArrow(_compacted, "node binary, grams binary")
        return store(made.dropDuplicates(["node"]), "shingles")

    def aligned(self, pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        """Pairs that reach the similarity: (a, b)."""
        side = shingles.select("node", "grams")
        both = pairs.join(side.toDF("a", "grams_a"), "a").join(side.toDF("b", "grams_b"), "b")
        scored = both.select("a", "b", "grams_a", "grams_b").mapInArrow(_align(self.least), "a binary, b binary, similarity double")
        return scored.where(F.col("similarity") >= self.least).select("a", "b")

    def unsettled(self, roots: DataFrame) -> DataFrame:
        """Members of the buckets that more than one component meets in: (bucket, node, size, root)."""
        placed = self.buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        return placed.join(mixed, "bucket", "left_semi")

    def rest_links(self, members: DataFrame) -> DataFrame:
        """Links between components among all texts that share an unsettled bucket: (a, b).

        Buckets are cut into blocks of about ``BLOCK`` texts, and every two blocks of a bucket meet in one
        group, so no task sees a large bucket whole and no pair is a row unless it is a link. A pair is looked
        at in its first common bucket, if components differ, lengths fit and enough entries agree.
        """
        spark = members.sparkSession
        facts = self.nodes.select("node", "n", *_SKETCH).join(self.shingles(members.select("node").distinct()), "node")
        sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = members.select("bucket", "node", "root").join(sizes, "bucket").join(facts, "node")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        spans = F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.withColumn("other", F.explode(spans))
        rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        groups = max(1, members.count() // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.withColumn("group", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))
        rows = rows.select("group", "bucket", "i", "j", "block", "node", "root", "n", *_SKETCH, "grams")
        return rows.groupBy("group").applyInArrow(_link_blocks(self.least), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, least: float = 0.8) -> DataFrame:
    """Classes of near-duplicate documents: (id, text_key, class_id, group_size, kept).

    Two texts are linked if their similarity (see the module) is ``least`` or more; classes are the connected
    components of links. class_id is the smallest id of the class, group_size its number of rows, and the row
    with the smallest id is kept. Words are separated by ASCII other than letters and digits, A-Z counts as
    a-z. text_key (a hash of the text) tells rows with equal ids apart.

    Texts with the same words are one node, so copies are never paired. In each bucket of texts with an
    equal sketch entry, all are first aligned with the most central one. Buckets whose texts are then still
    in different components are worked through in full: every pair across components that shares a bucket and
    enough entries is aligned, so no link found by the sketches is lost, whatever the size of a bucket.

    Null texts count as empty; texts without words are classes of their own, with their own id. Null ids rank
    last. Rows that repeat the kept row are not kept. An empty table gives an empty result; other columns are
    ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    graph = _Graph(docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", F.xxhash64("text")), least)

    pairs = store(graph.filtered(graph.central_pairs()), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = store(graph.aligned(pairs, graph.shingles(ends)), "found")
    roots = store(components(links), "roots")
    unsettled = store(graph.unsettled(roots), "unsettled")
    if not unsettled.isEmpty():
        links = links.unionByName(store(graph.rest_links(unsettled), "found"))
        roots = store(components(links), "roots")

    placed = graph.rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.select("id", "text_key", "n", "root", F.monotonically_increasing_id().alias("row"))
    placed = store(placed, "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("u"), "id", "text_key", "row"))
    classes = placed.where("n > 0").groupBy(F.col("root").alias("r")).agg(first.alias("first"), F.count("*").alias("size"))
    classes = classes.where("size > 1").select("r", "size", F.col("first.id").alias("class"), F.col("first.row").alias("kept_row"))
    # Texts without words get keys of their own, so that the join isn't skewed by them.
    spread = F.when(F.col("n") > 0, F.col("root")).otherwise(F.unhex(F.hex("row")))
    out = placed.withColumn("root", spread).join(classes, F.col("root") == F.col("r"), "left")
    alone = F.col("size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        F.when(alone, F.col("id")).otherwise(F.col("class")).alias("class_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("kept_row"))).alias("kept"),
    )
