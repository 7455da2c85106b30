"""Quality rules: counts of words, symbols and repetitions, and how far a text's histograms are from its language's.

Two histograms are taken of every text: of character classes, and of the most common words of its language beside
all other words. References are the same histograms of a language's texts together: of characters over all texts first,
then both over all texts but those that are too far from the first. The Jensen-Shannon distance between a text's
histogram and its language's reference may not be above a limit. Small texts are far from any reference by chance
alone, so the limit is widened by what sampling gives at the text's length, and texts below a minimum length aren't
compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import store
from ..shipping import ship
from .arrow import pieces, word_lists

#: Classes of characters: small and large letters, digits, white space, marks of a sentence, other ASCII, the rest.
CLASSES = 7
_MARKS = ".,;:!?'\"()-"
_SYMBOLS = "#*$%&|<>"
#: ASCII characters that are taken off both ends of a word before it is counted.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Counted words that a task holds before it passes them on.
_HELD = 1_000_000


def _class_table() -> np.ndarray:
    """The class of each byte; bytes that continue a character have none (CLASSES)."""
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[32, 9, 10, 11, 12, 13]] = 3
    table[[ord(c) for c in _MARKS]] = 4
    table[128:] = 6
    table[128:192] = CLASSES
    return table


_CLASS = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in _SYMBOLS])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of texts; null is empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kinds = _CLASS[raw]
    return np.stack([_sums(kinds == k, offsets) for k in range(CLASSES)], axis=1)


def word_keys(distinct: pa.Array) -> pa.Array:
    """What words are counted as: A-Z lower-cased, without ASCII marks at both ends."""
    return pc.ascii_lower(pc.utf8_trim(distinct, characters=EDGES))


_COUNTED = "lang string, kind int, key string, n bigint"


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "kind", "key", "n"])


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind 0, class, n): characters by class, summed per task."""
    held: dict[str | None, np.ndarray] = {}
    for batch in batches:
        for piece in pieces(batch, 0):
            chars = class_counts(*_bytes(piece.column(0)))
            langs = piece.column(1).dictionary_encode(null_encoding="encode")
            lang = langs.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                held[name] = held.get(name, 0) + chars[lang == i].sum(axis=0)
    yield _counted([(name, 0, str(k), n) for name, sums in held.items() for k, n in enumerate(sums.tolist())])


def _count(shared, rules: dict):
    """(lang, kind, key, n): characters by class (kind 0), words (1) and words by key (2), of texts near their reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: References = shared.value
        held: dict[str | None, dict[str, int]] = {}
        small: dict[tuple[str | None, int, str], int] = {}
        size = 0
        for batch in batches:
            for piece in pieces(batch, 0):
                langs = piece.column(1).dictionary_encode(null_encoding="encode")
                names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
                chars = class_counts(*_bytes(piece.column(0)))
                near = ~refs.odd_classes(chars, refs.places(names)[lang], rules)[0]
                places, distinct, index = word_lists(pc.fill_null(piece.column(0), ""))
                keys = word_keys(distinct).dictionary_encode()
                key_of, words = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
                of_word = np.repeat(np.where(near, lang, -1), np.diff(places))
                for i, name in enumerate(names):
                    mine = near & (lang == i)
                    for k, n in enumerate(chars[mine].sum(axis=0).tolist()):
                        small[name, 0, str(k)] = small.get((name, 0, str(k)), 0) + n
                    small[name, 1, ""] = small.get((name, 1, ""), 0) + int(np.diff(places)[mine].sum())
                    counts = np.bincount(key_of[index[of_word == i]], minlength=len(words)) if len(index) else np.zeros(0, np.int64)
                    told = held.setdefault(name, {})
                    before = len(told)
                    for at in np.flatnonzero(counts).tolist():
                        word = words[at]
                        told[word] = told.get(word, 0) + int(counts[at])
                    size += len(told) - before
                if size > _HELD:
                    for name, told in held.items():
                        yield _counted([(name, 2, w, n) for w, n in told.items()])
                    held, size = {}, 0
        for name, told in held.items():
            yield _counted([(name, 2, w, n) for w, n in told.items()])
        yield _counted([(*k, n) for k, n in small.items()])

    return run


@dataclass
class References:
    """Histograms by language; the last one is that of all texts, for languages without one."""

    langs: list[str]
    classes: np.ndarray
    words: list[list[str]] = field(default_factory=list)
    counts: np.ndarray | None = None

    def places(self, langs: list[str | None]) -> np.ndarray:
        place = {name: i for i, name in enumerate(self.langs)}
        return np.array([place.get(x, len(place)) for x in langs], np.int64)

    def odd_classes(self, chars: np.ndarray, ref: np.ndarray, rules: dict) -> tuple[np.ndarray, np.ndarray]:
        """(whether texts are too far from their reference, by their characters; how far)."""
        size = chars.sum(axis=1)
        far = js_distance(chars, self.classes[ref])
        return (size >= rules["class_chars"]) & (far > limit(rules["class_limit"], CLASSES, size)), far


#: The limits of the distances, and the lengths from which texts are compared.
LIMITS = {"class_limit": 0.25, "class_chars": 400, "word_limit": 0.25, "word_words": 50}


def learn(
    docs: DataFrame, text_col: str, lang_col: str, common: int = 20, least_chars: int = 1000, max_langs: int = 200, **limits
) -> References:
    """References of the languages.

    The ``max_langs`` languages with the most characters that have ``least_chars`` at least get a reference of their
    own; the others, and texts without a language, are compared with that of all texts. Characters are counted over
    all texts; then characters and words, over all but those that are too far from that. The ``common`` words that
    occur most often (of equal ones, the first by UTF-8 bytes) make the bins of a language.
    """
    spark = docs.sparkSession
    ship(spark)
    rules = LIMITS | limits
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    first = store(texts.mapInArrow(_count_classes, _COUNTED).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "classes")
    sizes = first.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least_chars)
    langs = sorted(r.lang for r in sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect())

    def with_whole(counted: DataFrame) -> DataFrame:
        own = counted.where(F.col("lang").isin(langs)).select(F.col("lang").alias("ref"), "kind", "key", "n")
        whole = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))
        return own.unionByName(whole.withColumn("ref", F.lit(None).cast("string")))

    def classes(rows: list) -> np.ndarray:
        table = np.zeros((len(langs) + 1, CLASSES), np.int64)
        for row in rows:
            if row.kind == 0:
                table[place[row.ref], int(row.key)] = row.n
        return table

    place = {name: i for i, name in enumerate([*langs, None])}
    shared = spark.sparkContext.broadcast(References(langs, classes(with_whole(first).collect())))
    counted = texts.mapInArrow(_count(shared, rules), _COUNTED).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    both = with_whole(store(counted, "words"))
    # A language's words are ranked in shares first, so that the last window sees few rows.
    shares = Window.partitionBy("ref", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.desc("n"), "key")
    last = Window.partitionBy("ref").orderBy(F.desc("n"), "key")
    words = both.where("kind = 2 AND key <> ''").withColumn("r", F.row_number().over(shares)).where(F.col("r") <= common)
    words = words.withColumn("r", F.row_number().over(last)).where(F.col("r") <= common)
    rows = words.unionByName(both.where("kind < 2").withColumn("r", F.lit(0))).collect()  # (max_langs + 1) x (common + 8) at most

    total = np.zeros(len(place), np.int64)
    names: list[list[str]] = [[] for _ in place]
    counts = np.zeros((len(place), common + 1), np.int64)
    for row in sorted(rows, key=lambda r: (r.kind, r.r)):
        if row.kind == 1:
            total[place[row.ref]] = row.n
        elif row.kind == 2:
            names[place[row.ref]].append(row.key)
            counts[place[row.ref], row.r - 1] = row.n
    counts[:, common] = total - counts[:, :common].sum(axis=1)
    return References(langs, classes(rows), names, counts)


def js_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in [0, 1], between histograms in the rows of a and b; 0 where one is empty."""
    some = (a.sum(axis=1) > 0) & (b.sum(axis=1) > 0)
    p = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
    q = b / np.maximum(b.sum(axis=1, keepdims=True), 1)

    def against_middle(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(2 * x, p + q, out=np.ones_like(x), where=x > 0)
        return (x * np.log2(ratio)).sum(axis=1)

    half = (against_middle(p) + against_middle(q)) / 2
    return np.where(some, np.sqrt(np.clip(half, 0.0, 1.0)), 0.0)


def limit(base: float, bins: int, size: np.ndarray) -> np.ndarray:
    """What a distance may be at a text's size: the divergence of ``base`` and twice what sampling gives on average."""
    return np.sqrt(base * base + 2 * (bins - 1) / (8 * math.log(2) * np.maximum(size, 1)))


def _codes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit code of each row."""
    code = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        code = (code ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def repeated_words(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> np.ndarray:
    """For each text, how many of its words lie in windows of ``size`` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(len(offsets) - 1, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    columns = [text, *(words[k:] for k in range(size))]
    code = _codes([c[at] for c in columns])
    order = np.argsort(code, kind="stable")
    by_code = code[order]
    near = np.flatnonzero(by_code[1:] == by_code[:-1])
    a, b = at[order[near]], at[order[near + 1]]
    if any((c[a] != c[b]).any() for c in columns):  # codes that are equal by chance: sort what they stand for
        order = np.lexsort([c[at] for c in columns])
        x, y = at[order[:-1]], at[order[1:]]
        same = np.logical_and.reduce([c[x] == c[y] for c in columns])
        a, b = x[same], y[same]
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([a, b]))
    covered[starts] += 1
    np.subtract.at(covered, starts + size, 1)
    return _sums(np.cumsum(covered[:-1]) > 0, offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """For each text, how many of its lines with a word are equal to an earlier line of it."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    has_word = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False).astype(bool)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = has_word[line] if len(line) else np.zeros(0, bool)
    pair = text[kept] * max(1, len(coded.dictionary)) + line[kept]
    lines = np.bincount(text[kept], minlength=len(texts))
    distinct = np.bincount(np.unique(pair) // max(1, len(coded.dictionary)), minlength=len(texts))
    return (lines - distinct).astype(np.int64)


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _judge(shared, rules: dict, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: References = shared.value
        common = refs.counts.shape[1] - 1
        union = sorted({w for names in refs.words for w in names})
        at = {w: i for i, w in enumerate(union)}
        # The bin of a word, by reference; the last place is that of all other words.
        bins = np.full((len(refs.words), len(union) + 1), common, np.int64)
        for i, names in enumerate(refs.words):
            for k, word in enumerate(names):
                bins[i, at[word]] = k
        value_set = pa.array(union, pa.string())
        for batch in batches:
            for piece in pieces(batch, 1):
                texts, n = pc.fill_null(piece.column(1), ""), piece.num_rows
                raw, offsets = _bytes(texts)
                places, distinct, index = word_lists(texts)
                n_words = np.diff(places)
                lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
                chars = class_counts(raw, offsets)
                repeat = repeated_words(index, places)
                failed = (n_words < rules["min_words"]) | (100 * repeat > rules["max_repeat"] * n_words)

                ref = refs.places(piece.column(2).to_pylist())
                of = pc.fill_null(pc.index_in(word_keys(distinct), value_set=value_set), len(union)).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(n), n_words)
                spot = bins[ref[text], of[index]] if len(index) else np.zeros(0, np.int64)
                hist = np.bincount(text * (common + 1) + spot, minlength=n * (common + 1)).reshape(n, common + 1)
                odd, by_class = refs.odd_classes(chars, ref, rules)
                by_word = js_distance(hist, refs.counts[ref])
                odd |= (n_words >= rules["word_words"]) & (by_word > limit(rules["word_limit"], common + 1, n_words))
                found = [n_words, _sums(lengths[index], places), _sums(_IS_SYMBOL[raw], offsets), repeated_lines(texts), repeat]
                columns = [pa.array(c, pa.int64()) for c in found]
                columns += [pa.array(failed), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64()), pa.array(~failed & ~odd)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], schema=target)

    return run


def judge(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    references: References,
    min_words: int = 10,
    max_repeat: int = 20,
    **limits,
) -> DataFrame:
    """What the rules say of each text: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept).

    Words are runs of other than ASCII white space. A text fails the base rules with fewer than ``min_words`` words,
    or if more than ``max_repeat`` percent of its words lie in windows of five words that it has twice or more. It
    is kept if it doesn't, and if neither distance is above its limit (``limit``, ``LIMITS``); characters are compared
    from ``class_chars`` characters on, words from ``word_words`` words on.

    Null and empty texts have no words and distances of 0. Texts without a language, or of one without a
    reference, are compared with that of all texts. Each row is judged on its own, so repeated rows are judged
    alike; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rules = LIMITS | limits | {"min_words": min_words, "max_repeat": max_repeat}
    schema = T.StructType([base.schema["id"], *T._parse_datatype_string(COLUMNS)])
    found = base.mapInArrow(_judge(spark.sparkContext.broadcast(references), rules, schema), schema)
    return found.withColumnRenamed("id", id_col)
