import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from samplewright.llm import rans, token_files
from samplewright.llm.queries import END_ID, tokenizer_file


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 1000, 70_001])
def test_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 49408).astype(np.uint32)
    table = rans.scaled(*np.unique(ids, return_counts=True))
    lanes = rans.lanes_for(n)
    payload, marks = rans.encode(ids, table, lanes, 16)
    assert (rans.decode(payload, n, table, lanes) == ids).all()
    for mark in marks:
        part = rans.decode(payload, n, table, lanes, mark, mark[0] + 5)
        assert (part == ids[mark[0] * lanes : (mark[0] + 5) * lanes]).all()
    assert len(marks) == max(0, (-(-n // lanes) - 1) // 16)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = rng.choice(50, 500_000, p=np.arange(1, 51) / np.arange(1, 51).sum())
    symbols, counts = np.unique(ids, return_counts=True)
    share = counts / counts.sum()
    payload, _ = rans.encode(ids, rans.scaled(symbols, counts), 256, 1 << 30)
    assert len(payload) * 8 < 1.02 * -(counts * np.log2(share)).sum()


def brute(rows):
    coder, at, out = Tokenizer.from_file(tokenizer_file()), 0, []
    coded = [(i, [*coder.encode(t or "", add_special_tokens=False).ids, END_ID]) for i, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    order = sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(np.array(r[1], "<u2").tobytes())))
    for i, ids in order:
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(3)
    pieces = ["The", "cat's", "don’t", "ÉTÉ,", "Straße!", "İstanbul", "ΣΊΣΥΦΟΣ", "éa", "́x", "3rd", "12.5%", "<|endoftext|>", "a<|startoftext|>b",
              "漢字かな", "😀👍🏽", "µm²", "x_y-z", " ", " ", "\x1c", "it'S", "'re", "WORLD...", "(see", "[1])", "naïve?!", "ª", "ﬁne", "\x00", "aaaa" * 30]
    return [(i, rng.choice([" ", "\n", "\t ", "  "]).join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(300)]


def test_ids_are_those_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 1500)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(token_files.encode_and_read(docs, "doc_id", "text", tokenizer_file(), END_ID)) == brute(rows)


def test_words_are_cut_only_where_that_is_safe():
    with open(tokenizer_file(), encoding="utf-8") as f:
        assert token_files.splits_at_spaces(f.read())
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not token_files.splits_at_spaces(f.read())


def test_other_tokenizer(spark):
    """A byte-level tokenizer sees white space, so texts are coded whole."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Two  words"), (2, " two words\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.encode_and_read(docs, "doc_id", "text", path, 50256).collect()
    coder = Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*coder.encode(t, add_special_tokens=False).ids, 50256], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    path = str(tmp_path / "files")
    token_files.write_tokens(docs, "doc_id", "text", tokenizer_file(), path, END_ID)
    blocks = spark.read.parquet(f"{path}/blocks").toPandas()
    blocks["crc"] = blocks["crc"] + 1
    spark.createDataFrame(blocks, spark.read.parquet(f"{path}/blocks").schema).write.parquet(f"{path}/other/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{path}/other/frequencies")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_index(spark, f"{path}/other").collect()


def test_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(token_files.encode_and_read(odd, "doc_id", "text", tokenizer_file(), END_ID)) == brute(rows)


def test_empty(empty):
    assert token_files.encode_and_read(empty, "doc_id", "text", tokenizer_file(), END_ID).count() == 0


def _strings(rng, n):
    letters = "abcXYZéÉßÿÀªºµ×÷¼²"
    kinds = [letters, letters + "!?.,-_'\"()[]{}#$%&*+/<=>@\\^`|~", "0123456789.,", "İıſΣσςK", "漢字かな한", "́̈‍️­", "😀👍🏽\x00\x1c\x85  "]
    special = ["<|startoftext|>", "<|endoftext|>", "</w>", "'s", "'LL", "n't", "..."]
    return [
        "".join(rng.choice(special) if rng.random() < 0.08 else rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 9)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_random_strings_against_whole_texts(seed):
    rng = random.Random(seed)
    coder = Tokenizer.from_file(tokenizer_file())
    with open(tokenizer_file(), encoding="utf-8") as f:
        definition = f.read()

    class Shared:
        value, id = definition, 17

    texts = [rng.choice([" ", "\n", "\t\r\n ", "\x0b\x0c"]).join(_strings(rng, rng.randint(0, 12))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    schema = T.StructType().add("id", "long").add("n", "long").add("data", "binary")
    made = token_files._tokenize(Shared, END_ID, np.uint16, True, schema)(iter([batch.slice(0, 1500), batch.slice(1500)]))
    got = [np.frombuffer(x.as_py(), np.uint16).tolist() for b in made for x in b.column(2)]
    want = [[*e.ids, END_ID] for e in coder.encode_batch(texts, add_special_tokens=False)]
    assert got == want
