"""Token ids of documents in compressed binary files, written and read in parallel.

Ids are written in ascending order of documents. A file set is a folder with two tables: ``frequencies``, the
one table of symbol frequencies that all blocks share, and ``blocks``. A block holds whole documents, is coded
on its own (see ``rans``) and carries its checksum, its documents' ids and lengths, and checkpoints from which
decoding can start in the middle. Shards are ranges of documents; blocks are numbered inside their shard.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path, store
from ..shipping import ship
from . import rans
from .arrow import mapped_bytes, pieces, word_lists

#: Ids in a block, ids in a shard, steps between checkpoints.
BLOCK_IDS, SHARD_IDS, CHECKPOINT_STEPS = 1 << 19, 1 << 24, 128
#: Words whose ids a Python worker remembers.
_REMEMBERED = 300_000

_SPACES = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_MARKS = "".join(c for c in string.punctuation if c != "'")
#: What workers remember, by tokenizer: kept from task to task.
_MEMORY: dict[tuple, tuple[object, _Known]] = {}


class _Known:
    """Ids of words, and of stems and marks that words are made of: one pool of ids, looked up in bulk."""

    def __init__(self, kind: type):
        self.words, self.pool = pa.array([], pa.large_string()), np.zeros(0, kind)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def find(self, parts: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each part, pool of ids, starts and sizes by place). Parts not known yet are tokenized."""
        words, pool, starts, sizes = self.words, self.pool, self.starts, self.sizes
        at = pc.index_in(parts, value_set=words)
        if at.null_count:
            fresh = parts.filter(pc.is_null(at)).unique()
            names, coded = fresh.to_pylist(), []
            for start in range(0, len(names), 20_000):
                coded += [c.ids for c in tokenizer.encode_batch_fast(names[start : start + 20_000], add_special_tokens=False)]
            more = np.array([len(c) for c in coded], np.int64)
            words = pa.concat_arrays([words, fresh])
            starts = np.concatenate([starts, len(pool) + np.cumsum(more) - more])
            pool = np.concatenate([pool, np.array([i for c in coded for i in c], pool.dtype)])
            sizes = np.concatenate([sizes, more])
            at = pc.index_in(parts, value_set=words)
            # Frequent words come early; once the memory is full, rare ones are worked out again.
            if len(self.words) < _REMEMBERED:
                self.words, self.pool, self.starts, self.sizes = words, pool, starts, sizes
        return at.to_numpy(zero_copy_only=False).astype(np.int64), pool, starts, sizes


def _coder(key: tuple, definition: str, kind: type):
    """The tokenizer and what it is known to give, set up once in each worker."""
    if key not in _MEMORY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _MEMORY.clear()
        _MEMORY[key] = (Tokenizer.from_str(definition), _Known(kind))
    return _MEMORY[key]


def splits_at_spaces(definition: str) -> bool:
    """Whether text can be cut at white space, and Latin words lower-cased and cut before marks, without a change of ids.

    Tried out on the tokenizer itself: neither may leave a trace, at the ends or between words.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    words = ["The", "cat's", "3rd", "é—x", "END.", "(a)"]
    apart = [i for w in words for i in ids(w)]
    spaced = (" ".join(words), "\n ".join(words), "  " + "\t".join(words) + "\r\n ")
    marked = ids("Ärger") + ids("?!") == ids("ärger?!")
    return marked and all(ids(text) == apart for text in spaced)


def _cut_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as a first part and the marks after it: Latin letters followed by marks are cut, in lower case, others stay whole."""
    latin = pc.match_substring_regex(words, r"^[\x{00}-\x{FF}]+$")
    low = pc.utf8_lower(words)
    stem = pc.utf8_rtrim(low, characters=_MARKS)
    cut = pc.and_(latin, pc.utf8_is_alpha(stem))
    first = pc.if_else(cut, stem, words)
    # The marks are the bytes of the lower-cased word after its stem.
    size, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (low, stem))
    rest = np.where(cut.to_numpy(zero_copy_only=False), size - kept, 0)
    offsets, data = np.frombuffer(low.buffers()[1], np.int64)[low.offset :][: len(low)], np.frombuffer(low.buffers()[2] or b"", np.uint8)
    ends = np.concatenate([[0], np.cumsum(rest)])
    at = np.repeat(offsets + kept - ends[:-1], rest) + np.arange(ends[-1])
    marks = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(ends), pa.py_buffer(data[at].tobytes()))
    return first, marks


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[i], begins[i] + 1, ... sizes[i] times, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def _word_ids(words: pa.Array, tokenizer, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """(ids of words without white space one after the other, how many ids each has)."""
    if not len(words):
        return known.pool[:0], np.zeros(0, np.int64)
    first, marks = _cut_marks(words)
    at, pool, starts, sizes = known.find(pa.concat_arrays([first, marks]), tokenizer)
    head, tail = at[: len(words)], at[len(words) :]
    total = sizes[head] + sizes[tail]
    begins = np.cumsum(total) - total
    out = np.empty(int(total.sum()), pool.dtype)
    out[_spread(begins, sizes[head])] = pool[_spread(starts[head], sizes[head])]
    out[_spread(begins + sizes[head], sizes[tail])] = pool[_spread(starts[tail], sizes[tail])]
    return out, total


def _tokenize(shared, end_id: int, kind: type, by_word: bool, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _coder((shared.id, kind), shared.value, kind)
        end = np.array([end_id], kind)
        width = np.dtype(kind).itemsize
        for batch in batches:
            for piece in pieces(batch, 1):
                if by_word:
                    offsets, distinct, index = word_lists(mapped_bytes(piece.column(1), _SPACES))
                    pool, sizes = _word_ids(distinct, tokenizer, known)
                    begins = np.cumsum(sizes) - sizes
                    lengths = sizes[index] if len(index) else np.zeros(0, np.int64)
                    upto = np.concatenate([[0], np.cumsum(lengths)])
                    at = _spread(begins[index] if len(index) else lengths, lengths)
                    flat, ends = pool[at], upto[offsets[1:]]
                else:
                    encoded = tokenizer.encode_batch_fast([t or "" for t in piece.column(1).to_pylist()], add_special_tokens=False)
                    parts = [np.array(e.ids, kind) for e in encoded]
                    flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
                whole = np.insert(flat, ends, end)
                stops = (ends + np.arange(1, len(ends) + 1)) * width
                starts = np.concatenate([[0], stops])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(whole.tobytes())])
                counts = pa.array(np.diff(starts) // width, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), counts, data.cast(pa.binary())], schema=target)

    return run


def _tally(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, 0):
                seen = np.bincount(np.frombuffer(b"".join(piece.column(0).to_pylist()), kind))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["symbol", "n"])

    return run


_CHECKPOINT = "array<struct<step:int,words:bigint,states:binary>>"


def _encode(table, kind: type, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        keys: list = []
        texts: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), kind)
            lanes = rans.lanes_for(len(ids))
            payload, marks = rans.encode(ids, table.value, lanes, CHECKPOINT_STEPS)
            sizes = [len(t) // np.dtype(kind).itemsize for t in texts]
            checkpoints = [{"step": s, "words": w, "states": x} for s, w, x in marks]
            values = [shard, block, first, len(ids), lanes, payload, zlib.crc32(payload), checkpoints, keys, sizes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target, strict=True)], schema=target)

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(data) // np.dtype(kind).itemsize
                if texts and held + n > BLOCK_IDS:
                    yield packed()
                    block, first = block + 1, first + held
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(data)
                held += n
        if texts:
            yield packed()

    return run


def _decode(table, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, n, lanes, payload, crc, keys, sizes = (c[row] for c in batch.columns)
                data = payload.as_py()
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError(f"a block of shard {shard} is damaged: its checksum differs")
                ids = rans.decode(data, n.as_py(), table.value, lanes.as_py()).astype("<u4")
                lengths = sizes.values.to_numpy()
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([shard.as_py()] * len(lengths), pa.int32()),
                    keys.values,
                    pa.array(first.as_py() + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def _read_table(spark: SparkSession, path: str) -> rans.Frequencies:
    rows = spark.read.parquet(f"{path}/frequencies").toArrow()  # at most the size of the vocabulary
    order = np.argsort(rows["symbol"].to_numpy())
    bits = int(rows["bits"][0].as_py())
    return rans.Frequencies(rows["symbol"].to_numpy()[order], rows["frequency"].to_numpy()[order].astype(np.uint64), bits)


def write_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, path: str, end_id: int) -> None:
    """Writes the ids of whole texts, without special tokens and with ``end_id`` after each text, to ``path``.

    Documents are ordered by id, nulls first; rows with equal ids follow each other in the order of their ids'
    number and checksum. Null and empty texts have the end id only. Frequencies are counted over all documents. The
    tokenizer is read on the driver and sent to the tasks. If it leaves no trace of white space (tried out on
    it first), each distinct word is tokenized once per piece of text, which gives the same ids as whole texts.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(definition).get_vocab(with_added_tokens=True)
    kind = np.uint16 if max([end_id, *vocabulary.values()]) < 1 << 16 else np.uint32
    shared = spark.sparkContext.broadcast(definition)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([base.schema["id"]]).add("n", T.LongType()).add("data", T.BinaryType())
    tokenize = _tokenize(_Named(shared), end_id, kind, splits_at_spaces(definition), schema)
    tokens = store(base.mapInArrow(tokenize, schema), "tokens")

    counted = tokens.select("data").mapInArrow(_tally(kind), "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = counted.orderBy("symbol").toArrow()  # at most the size of the vocabulary
    table = rans.scaled(counts["symbol"].to_numpy(), counts["n"].to_numpy())
    rows = list(zip(table.symbols.tolist(), table.counts.tolist(), strict=True))
    frequencies = spark.createDataFrame(rows, "symbol bigint, frequency bigint").withColumn("bits", F.lit(table.bits))
    frequencies.coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")

    shards = max(1, -(-int(sum(counts["n"].to_pylist())) // SHARD_IDS))
    ordered = tokens.repartitionByRange(shards, "id").sortWithinPartitions("id", "n", F.crc32("data")).select("id", "data")
    blocks = T._parse_datatype_string("shard int, block int, first bigint, n bigint, lanes int, payload binary, crc bigint, checkpoints " + _CHECKPOINT)
    blocks = blocks.add("ids", T.ArrayType(base.schema["id"].dataType)).add("sizes", T.ArrayType(T.LongType()))
    coded = ordered.mapInArrow(_encode(spark.sparkContext.broadcast(table), kind, blocks), blocks)
    coded.write.mode("overwrite").parquet(f"{path}/blocks")


class _Named:
    """A broadcast variable with a key that tells it from others in a worker's memory."""

    def __init__(self, shared):
        self.shared, self.id = shared, hash(shared.value)

    @property
    def value(self):
        return self.shared.value


def read_index(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Decodes the files: per document (id, start, n_tokens, ids_crc32), start being the ids of all documents before it.

    Raises on blocks whose checksum differs. An empty file set gives no rows.
    """
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.sparkContext.broadcast(_read_table(spark, path))
    schema = T._parse_datatype_string("shard int")
    schema = schema.add("id", blocks.schema["ids"].dataType.elementType)
    schema = schema.add("at", T.LongType()).add("n_tokens", T.LongType()).add("ids_crc32", T.LongType())
    wanted = blocks.select("shard", "first", "n", "lanes", "payload", "crc", "ids", "sizes")
    found = wanted.mapInArrow(_decode(table, schema), schema)
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))  # one row for each shard
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    joined = found.join(offsets, "shard")
    return joined.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """Writes token files to the shared scratch folder and reads them back (``write_tokens``, ``read_index``)."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, id_col, text_col, tokenizer_file, path, end_id)
    return read_index(docs.sparkSession, path, id_col)
