"""Language-model scores from a weighted backoff automaton.

The lowest order is a unigram model over all words of the training texts. Higher orders hold the n-grams that
occur at least twice, whatever the size of the corpus. An n-gram can only be kept if what it begins and ends with
is, so filters over the order below leave few others to be counted.

States are the contexts, arcs lead from a state over a word to a state and carry a log-probability (absolute
discounting), and every state but the root has a failure arc to its suffix, whose weight makes the
probabilities of all words add up to one. The arcs of frequent n-grams are held by every task, which scores a
text in one walk from left to right; there are at most 1 / least_share of each order. Each other n-gram
changes the score of a text that has it by a fixed term: its own log-probability and its weight as a context,
less what the walk gives for it by backing off. Tables hold these terms, and those of rare words, and a join
adds them up.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import Steps
from ..shipping import ship
from . import keyfilter
from .arrow import pieces, word_lists

#: Hash of the end of a text, which counts as a word.
END = 0x5DEECE66D
#: Words per task that are summed up before they are passed on.
_FLUSH = 4_000_000
#: The same for n-grams.
_HELD = 600_000
#: Texts are cut into words and n-grams in pieces of about this many bytes.
_PIECE = 1 << 20
#: Words of the training texts for each bucket that n-grams are counted in; it holds fewer n-grams than these.
_BUCKET = 1 << 19
#: The same for each bucket that terms are looked up in.
_TERM_BUCKET = 1 << 21
#: How often an n-gram must occur to be kept.
LEAST = 2
#: Bits of the filters that tasks hold: 32 MB.
_BITS = 1 << 28


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: scrambled, the sum of those of its bytes at their places. That of no word at all is arbitrary."""
    whole = words.cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    starts = offsets[:-1] - offsets[0]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(offsets))
    parts = _mixed((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1))
    return _mixed(np.add.reduceat(np.append(parts, np.uint64(0)), starts))


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of lower-cased words, hashes of the distinct ones, and each word's place there; each text's last word is its end."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    offsets, distinct, index = word_lists(lower)
    hashes = np.append(_word_hashes(distinct) if len(index) else np.zeros(0, np.uint64), np.uint64(END))
    return offsets + np.arange(len(offsets)), hashes, np.insert(index.astype(np.int64), offsets[1:], len(hashes) - 1)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    at = _changes(key)
    return key[at], np.add.reduceat(count[order], at) if len(at) else count


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(len(values[:1]), bool), values[1:] != values[:-1]]))


def _spans(begins: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    return zip(begins.tolist(), np.append(begins, end)[1:].tolist(), strict=True)


def _key_batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, added up per task."""
    keys, counts, held = [], [], 0
    for batch in batches:
        for piece in pieces(batch, 0):
            _, hashes, index = _cut(piece.column(0))
            n = np.bincount(index, minlength=len(hashes))
            keys.append(hashes[n > 0])
            counts.append(n[n > 0])
            held += len(hashes)
            if held > _FLUSH:
                key, n = _summed(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > _FLUSH // 2:
                    yield _key_batch(key, n)
                    keys, counts, held = [], [], 0
    yield _key_batch(*_summed(keys, counts))


def _number(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of words in the sorted table, from 1; 0 for words that aren't there."""
    if not len(table):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at + 1, 0)


def _pair(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Key of an n-gram by the keys of what it begins and what it ends with, which overlap but for a word each."""
    x = pre * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + suf) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _grams(offsets: np.ndarray, words: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, place of the last word, keys by place) of the n-grams of each order from 1, none over the end of a text."""
    keys, whole = words, np.ones(len(words), bool)
    first = np.zeros(len(words) + 1, bool)
    first[offsets[:-1]] = True
    for size in range(1, order + 1):
        if size > 1:
            keys = _pair(keys[:-1], keys[1:])
            whole = whole[:-1] & ~first[size - 1 : len(words)]
        yield keys[whole], np.flatnonzero(whole) + size - 1, keys


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """The bits of a membership filter over keys, as bytes; it misses none and has the same size for any number."""
    bits = np.zeros((_BITS // keyfilter.PAGE, keyfilter.PAGE // 8), np.uint8)
    pages = keyfilter.build(keys, key, _BITS).toArrow()  # at most _BITS / PAGE rows
    for page, bitmap in zip(pages["page"], pages["bitmap"], strict=True):
        bits[page.as_py()] = np.frombuffer(bitmap.as_py(), np.uint8)
    del pages
    pa.default_memory_pool().release_unused()  # the driver's memory is small
    return bits.reshape(-1)


def _maybe(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many buckets keys are in; these are ranges of keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _bytes(*columns: np.ndarray) -> bytes:
    """Arrays of the same length in one value: first all first bytes of their numbers, then all second ones, for compression."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Differences of keys in order, which have fewer bytes than they; np.cumsum gives the keys back."""
    return np.diff(keys, prepend=np.uint64(0))


def _unpacked(value: pa.BinaryScalar, *kinds: type) -> list[np.ndarray]:
    """The arrays of a value made by ``_bytes``; the first holds steps and comes back as keys."""
    raw, at, out = value.as_buffer(), 0, []
    k = len(raw) // sum(np.dtype(kind).itemsize for kind in kinds)
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, k * size, at).reshape(size, k).T.copy().view(kind).reshape(k))
        at += k * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _packed(buckets: int, key: np.ndarray, pre: np.ndarray, suf: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted n-grams as one value for each bucket of keys: what they begin with in order, what they end with, counts."""
    bucket = _bucket(key, buckets)
    # Equal beginnings side by side compress well; the bits that are lost here make no difference to that.
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | (pre >> np.uint64(24)))
    bucket, pre, suf, n = bucket[order], pre[order], suf[order], n[order].astype(np.uint32)
    at = _changes(bucket)
    values = [_bytes(_steps(pre[i:j]), suf[i:j], n[i:j]) for i, j in _spans(at, len(bucket))]
    return pieces(pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(values, pa.binary())], ["bucket", "grams"]), 1)


def _joined(held: list) -> list[np.ndarray]:
    """The columns of several pieces in one; the pieces are let go."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()
    return columns


def _count_pairs(pre: np.ndarray, suf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams (key, pre, suf, n) in the order of their keys, counts added up."""
    key = _pair(pre, suf)
    order = np.argsort(key)
    key = key[order]
    at = _changes(key)
    first = order[at]
    return key[at], pre[first], suf[first], np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else n.astype(np.int64)


def _count_grams(shared, size: int, buckets: int):
    """Counts of n-grams by what they begin and end with, added up per task, if the filter may have both of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            for piece in pieces(batch, 0, _PIECE):
                offsets, hashes, index = _cut(piece.column(0))
                *_, (_, _, lower), (_, place, _) = _grams(offsets, hashes[index], size)
                at = place - size + 1
                may = _maybe(lower, bits)
                at = at[may[at] & may[at + 1]]
                held.append([lower[at], lower[at + 1], np.ones(len(at), np.uint32)])
                count += len(at)
                if count > _HELD:
                    key, pre, suf, n = _count_pairs(*_joined(held))
                    held, count = [[pre, suf, n.astype(np.uint32)]], len(key)
                    if count > _HELD // 2:
                        held, count = [], 0
                        yield from _packed(buckets, key, pre, suf, n)
                    del key, pre, suf, n
        if held:
            yield from _packed(buckets, *_count_pairs(*_joined(held)))

    return run


def _kept(table: pa.Table) -> pa.Table:
    """The n-grams of a bucket that occur often enough: (key, pre, suf, n)."""
    parts = [_unpacked(v, np.uint64, np.uint64, np.uint32) for v in table.column("grams")]
    key, pre, suf, n = _count_pairs(*_joined(parts))
    often = n >= LEAST
    columns = [*(pa.array(c[often].view(np.int64)) for c in (key, pre, suf)), pa.array(n[often])]
    return pa.table(columns, names=["key", "pre", "suf", "n"])


@dataclass
class Automaton:
    """The model: arcs by state * width + word number, failure arcs, and what unigrams need."""

    frequent: np.ndarray
    frequent_counts: np.ndarray
    total: int
    distinct: int
    arcs: dict[int, tuple[float, int]]
    fail: list[int]
    weight: list[float]

    @property
    def width(self) -> int:
        return len(self.frequent) + 1

    def walk(self, numbers: list[int]) -> float:
        """log10 probability of a text but for its rare words' unigram terms."""
        arcs, fail, weight, width = self.arcs, self.fail, self.weight, self.width
        state, score = 0, 0.0
        for word in numbers:
            if not word:
                while state:
                    score += weight[state]
                    state = fail[state]
                continue
            arc = arcs.get(state * width + word)
            while arc is None:
                score += weight[state]
                state = fail[state]
                arc = arcs.get(state * width + word)
            score += arc[0]
            state = arc[1]
        return score


def unigram(count: np.ndarray, total: int, distinct: int, discount: float) -> np.ndarray:
    """Probability of words by their counts; words never seen share one place, which gets what is discounted."""
    if not total:
        return np.ones(len(count))
    return np.where(count > 0, (count - discount) / total, discount * distinct / total)


def build(
    frequent: np.ndarray,
    frequent_counts: np.ndarray,
    weights: dict[int, float],
    grams: list[pa.Table],
    total: int,
    distinct: int,
    discount: float,
) -> Automaton:
    """The automaton of the frequent n-grams, tables (key, pre, suf, p) by order from 2.

    ``weights`` are those of the whole model's contexts by key.
    """
    width = len(frequent) + 1
    chance = unigram(frequent_counts, total, distinct, discount).tolist()
    last = {k: i for i, k in enumerate(frequent.view(np.int64).tolist(), 1)}  # a key's last word
    shorter = dict.fromkeys(last, 0)  # the key without its first word
    rows = [(0, 0, w, p) for w, p in zip(last, chance, strict=True)]
    for table in grams:
        for key, pre, suf, p in zip(*(table[c].to_pylist() for c in ("key", "pre", "suf", "p")), strict=True):
            last[key], shorter[key] = last[suf], suf
            rows.append((pre, suf, key, p))
    states = [k for k in last if k in weights]  # shorter contexts first
    state_of = {k: i for i, k in enumerate(states, 1)}

    def suffix_state(key: int) -> int:
        """The state of the longest suffix, the whole included, that is a context."""
        while key and key not in state_of:
            key = shorter[key]
        return state_of.get(key, 0)

    arcs = {}
    for pre, _, key, p in rows:
        arcs[state_of.get(pre, 0) * width + last[key]] = (math.log10(p), suffix_state(key))
    fail = [0, *(suffix_state(shorter[k]) for k in states)]
    return Automaton(frequent, frequent_counts, total, distinct, arcs, fail, [0.0, *(weights[k] for k in states)])


@dataclass
class Model:
    """A fitted model.

    Every task holds the automaton of the frequent n-grams and a filter over the keys of the others. These are rows
    of ``terms`` (key, n, value): what a word or n-gram that isn't in the automaton adds to a text's score each time.
    """

    automaton: Automaton
    terms: DataFrame
    rare: np.ndarray
    order: int
    discount: float


def fit(training: DataFrame, text_col: str, order: int = 3, least_share: float = 1e-6, discount: float = 0.75) -> Model:
    """Learns from texts, null ones being empty. All counts cover all texts.

    n-grams of two words and more are kept if they occur twice, at any size of the corpus. Those whose share of
    all words is ``least_share`` or more are put into the automaton; that bounds it, not the model.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = training.sparkSession
    ship(spark)
    steps = Steps(spark, "backoff-lm")
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    parts = texts.mapInArrow(_count_words, "word bigint, n bigint")
    words = steps.store(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    least = max(LEAST, math.ceil(least_share * sums.total))
    buckets = max(1, sums.total // _BUCKET)

    # Chances of the kept n-grams, and of what they end with; the weights of their contexts. A context may begin
    # very many n-grams: adaptive execution splits these joins, as what follows each is written first.
    lower = words.select(F.col("word").alias("key"), "n", ((F.col("n") - discount) / F.lit(float(max(1, sums.total)))).alias("p"))
    orders, contexts = [], []
    for size in range(2, order + 1):
        shared = spark.sparkContext.broadcast(_filter(lower.where(F.col("n") >= LEAST), "key"))
        found = texts.mapInArrow(_count_grams(shared, size, buckets), "bucket int, grams binary")
        kept = found.groupBy("bucket").applyInArrow(_kept, "key bigint, pre bigint, suf bigint, n bigint")
        kept = steps.store(kept, f"grams-{size}")
        shared.destroy()
        pre = lower.select(F.col("key").alias("pre"), F.col("n").alias("n_pre"))
        suf = lower.select(F.col("key").alias("suf"), F.col("p").alias("below"))
        whole = kept.join(pre, "pre").join(suf, "suf")
        whole = whole.select("key", "pre", "suf", "n", ((F.col("n") - discount) / F.col("n_pre")).alias("p"), "below")
        lower = steps.store(whole, f"chances-{size}")
        steps.drop(f"grams-{size}")
        left = [F.greatest(F.lit(1e-12), 1 - F.sum(c)) for c in ("p", "below")]
        contexts.append(steps.store(lower.groupBy("pre").agg(F.log10(left[0] / left[1]).alias("weight")), f"weights-{size}"))
        orders.append(lower)
        del shared, found, kept, whole  # with them goes the filter

    # What each n-gram adds to a score once what it ends with, and backing off to that, are counted.
    own = [c.select(F.col("pre").alias("key"), F.col("weight").alias("own")) for c in contexts]
    one = words.select(F.col("word").alias("key"), "n", F.log10((F.col("n") - discount) / F.lit(float(max(1, sums.total)))).alias("value"))
    terms = [one.join(own[0], "key", "left").select("key", "n", (F.col("value") + F.coalesce("own", F.lit(0.0))).alias("value"))]
    for i, table in enumerate(orders):
        rare = table.where(F.col("n") < least).join(contexts[i], "pre")
        value = F.log10("p") - F.log10("below") - F.col("weight")
        if i + 1 < len(orders):
            rare = rare.join(own[i + 1], "key", "left")
            value = value + F.coalesce("own", F.lit(0.0))
        terms.append(rare.select("key", "n", value.alias("value")))
    rare_keys = orders[0].select("key", "n")
    for table in orders[1:]:
        rare_keys = rare_keys.unionByName(table.select("key", "n"))
    rare_bits = _filter(rare_keys.where(F.col("n") < least), "key")
    # One order after the other, so that what they shuffle isn't there at once. These tables stay.
    lasting = Steps(spark, "terms")
    stored = [lasting.store(table.where(F.col("n") < least), f"terms-{i}") for i, table in enumerate(terms, 1)]

    common = words.where(F.col("n") >= least).toArrow()  # at most 1 / least_share rows, as are those below
    hashes = common["word"].to_numpy().view(np.uint64)
    by_hash = np.argsort(hashes)
    frequent, frequent_counts = hashes[by_hash], common["n"].to_numpy()[by_hash]
    core = [t.where(F.col("n") >= least).select("key", "pre", "suf", "p") for t in orders]
    weights: dict[int, float] = {}
    for known, context in zip([words.where(F.col("n") >= least).select(F.col("word").alias("key")), *core], contexts, strict=False):
        found = context.join(known.select(F.col("key").alias("pre")), "pre", "left_semi").toArrow()
        weights.update(zip(found["pre"].to_pylist(), found["weight"].to_pylist(), strict=True))
    automaton = build(frequent, frequent_counts, weights, [c.toArrow() for c in core], sums.total, sums.distinct, discount)
    steps.drop()
    return Model(automaton, functools.reduce(DataFrame.unionByName, stored), rare_bits, order, discount)


def _score(shared, order: int, buckets: int, schema: T.StructType):
    """Walks texts. Gives a row for each, and packed ones with the words and n-grams whose terms aren't in the automaton."""
    target = to_arrow_schema(schema)

    def batch_of(length: int, given: dict) -> pa.RecordBatch:
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(length, f.type) for f in target]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], single: bool) -> Iterator[pa.RecordBatch]:
        """Keys in order and the texts they are in, by bucket; texts are counted from the first one."""
        rows, keys = _joined(held)
        if not len(keys):
            return
        first = int(rows.min())
        order = np.argsort(keys)
        rows, keys = (rows[order] - first).astype(np.uint32), keys[order]
        bucket = _bucket(keys, buckets)
        at = _changes(bucket)
        values = [_bytes(_steps(keys[i:j]), rows[i:j]) for i, j in _spans(at, len(keys))]
        given = {"bucket": bucket[at], "row": np.full(len(at), first), "hits": values, "single": np.full(len(at), single)}
        yield from pieces(batch_of(len(at), given), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bits = shared.value
        share = np.log10((model.frequent_counts + 1.0) / (model.total + model.distinct + 1.0))
        share = np.concatenate([[0.0], share])
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for piece in pieces(batch, 2, _PIECE):
                rows = piece.column(0).to_numpy()
                offsets, hashes, index = _cut(piece.column(2))
                words, number = hashes[index], _number(hashes, model.frequent)[index]
                base = np.add.reduceat(share[number], offsets[:-1])
                known = np.add.reduceat((number > 0).astype(np.int64), offsets[:-1])
                text = np.repeat(rows, np.diff(offsets))
                rare.append((text[number == 0], words[number == 0]))
                held += len(rare[-1][0])
                for keys, at, _ in islice(_grams(offsets, words, order), 1, None):
                    may = _maybe(keys, bits)
                    grams.append((text[at[may]], keys[may]))
                    held += len(grams[-1][0])
                numbers = number.tolist()
                walked = [model.walk(numbers[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                own = _bucket(_pair(rows.view(np.uint64), rows.view(np.uint64)), buckets)
                given = {"bucket": own, "row": rows, "id": piece.column(1), "n_tokens": np.diff(offsets), "known": known, "base": base}
                yield batch_of(piece.num_rows, given | {"walk": np.array(walked)})
                if held > _HELD:
                    yield from packed(rare, True)
                    yield from packed(grams, False)
                    rare, grams, held = [], [], 0
        if rare:
            yield from packed(rare, True)
            yield from packed(grams, False)

    return run


def _pack_terms(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, n, value = _joined(held)
            order = np.argsort(key)
            key, n, value = key[order], n[order], value[order]
            bucket = _bucket(key, buckets)
            at = _changes(bucket)
            values = [_bytes(_steps(key[i:j]), n[i:j], value[i:j]) for i, j in _spans(at, len(key))]
            return pieces(pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(values, pa.binary())], ["bucket", "terms"]), 1)

        for batch in batches:
            key, n, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append([key.view(np.uint64), n, value])
            if sum(len(h[0]) for h in held) > _HELD:
                yield from out()
                held = []
        if held:
            yield from out()

    return run


def _add_terms(total: int, distinct: int, discount: float, schema: T.StructType):
    target = to_arrow_schema(schema)
    # Words never seen share one place; n-grams that aren't kept add nothing.
    never = math.log10(discount * distinct / total) if total else 0.0

    def run(walked: pa.Table, terms: pa.Table) -> pa.Table:
        """What a bucket's terms add to texts, and the rows of texts as they are."""
        parts = [_unpacked(v, np.uint64, np.int64, np.float64) for v in terms.column("terms")]
        parts.append([np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)])
        key, count, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key)
        # Place 0 is that of all keys that have no term.
        key, count, value = key[order], np.concatenate([[0], count[order]]), np.concatenate([[0.0], value[order]])
        is_text = pc.is_null(walked.column("hits"))
        texts = walked.filter(is_text)
        out = [pa.table([texts.column(c) for c in ("row", "id", "n_tokens", "known", "base", "walk")], schema=target)]
        packed = walked.filter(pc.invert(is_text))
        for first, hits, single in zip(*(packed.column(c) for c in ("row", "hits", "single")), strict=True):
            wanted, rows = _unpacked(hits, np.uint64, np.uint32)
            at = _number(wanted, key)
            n = np.bincount(rows)
            there = np.flatnonzero(n)
            if single.as_py():
                c = count[at]
                known = np.bincount(rows, c > 0)[there].astype(np.int64)
                base = np.bincount(rows, np.log10((c + 1.0) / (total + distinct + 1.0)))[there]
                walk = np.bincount(rows, np.where(at > 0, value[at], never))[there]
            else:
                known, base, walk = np.zeros(len(there), np.int64), np.zeros(len(there)), np.bincount(rows, value[at])[there]
            none = [pa.nulls(len(there), target.field(i).type) for i in (1, 2)]
            columns = [pa.array(there + first.as_py(), pa.int64()), *none, pa.array(known), pa.array(base), pa.array(walk)]
            out.append(pa.table(columns, schema=target))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Scores of texts: (id, n_tokens, n_known, train_tokens, base_score, score).

    A-Z is lower-cased, words are runs of other than ASCII white space, and the end of a text is a word. Null and
    empty texts have just that. base_score adds up log10((c + 1) / (N + V + 1)) over the words, c being a
    word's count, N all and V distinct words of the training texts; score is the automaton's log10
    probability. Each row is scored on its own; repeated rows are rows of their own; other columns are ignored.
    Texts are walked once, in the tasks that read them. Rows are numbered there, so they must come in the same
    order if a task runs again, as rows of a table do; store others first.
    """
    spark = docs.sparkSession
    ship(spark)
    automaton = model.automaton
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbers = [("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("walk", T.DoubleType())]
    schema = T.StructType().add("bucket", T.IntegerType()).add("row", T.LongType()).add("hits", T.BinaryType()).add("single", T.BooleanType())
    added = T.StructType().add("row", T.LongType())
    for name, kind in [("id", base.schema["id"].dataType), *numbers]:
        schema, added = schema.add(name, kind), added.add(name, kind)
    buckets = max(1, automaton.total // _TERM_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast((automaton, model.rare))
    walked = base.mapInArrow(_score(shared, model.order, buckets, schema), schema)
    terms = model.terms.select("key", "n", "value").mapInArrow(_pack_terms(buckets), "bucket int, terms binary")
    add = _add_terms(automaton.total, automaton.distinct, model.discount, added)
    found = walked.groupBy("bucket").cogroup(terms.groupBy("bucket")).applyInArrow(add, added)
    # In each column, what texts bring along and what terms add.
    out = found.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(name).alias(name) for name, _ in numbers])
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(automaton.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("walk").alias("score"),
    )
