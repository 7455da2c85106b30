"""The pipeline against plain Python, stage by stage, on a small corpus with planted cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_language import WORDS
from test_order_minhash import brute as near_brute
from test_winnowing import brute as window_brute
from tokenizers import Tokenizer

import corpus_pipeline as P
from samplewright.llm.queries import END_ID, tokenizer_file


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = {lang: w + [a + b for a in w[:12] for b in w[:12]] for lang, w in WORDS.items()}
    items = [(i, " ".join(rng.choices(words["en"], k=rng.choice([4, 12, 30])))) for i in range(12)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", "fr"])
        w = rng.choices(words[lang], k=rng.choice([12, 40, 150]))
        if i % 19 == 0:
            w[5:5] = items[i % 12][1].split()
        rows.append((i, " ".join(w), lang, rng.choice(["a", "b", "b", "b", "ä", None]), 1))
    for i in range(260, 300):
        _, text, lang, source, _ = rows[rng.randrange(200)]
        w = text.split()
        if len(w) > 100:
            w[7] = "changed"
        rows.append((i, " ".join(w), lang, source, 1))
    rows += [(300, None, "en", "a", 1), (301, "", None, "a", 1), (302, "12 + 34 = 46 !", "en", "b", 1), (303, None, None, None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_against_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stage = dict(P.STAGES)
    assert [name for name, _ in P.STAGES] == ["language ID", "near-duplicates", "decontamination", "mixing", "token output"]

    known = stage["language ID"](spark, docs, folder)
    assert known.columns == columns
    with_words = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(r.doc_id for r in known.collect()) == sorted(r[0] for r in with_words)

    single = stage["near-duplicates"](spark, known, folder)
    classes = near_brute([(r[0], r[1]) for r in with_words])
    left = [r for r in with_words if classes[r[0]][0] == r[0]]
    assert single.columns == columns and sorted(tuple(r) for r in single.collect()) == sorted(left, key=lambda r: r[0])
    assert len(left) < len(with_words)

    clean = stage["decontamination"](spark, single, folder)
    hits = {r[0]: r[2] for r in window_brute([(r[0], r[1]) for r in left], items, 10)}
    left = [r for r in left if not hits[r[0]]]
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in left)
    assert any(hits.values())

    mixed = stage["mixing"](spark, clean, folder)
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes = {r[0]: len(r[1].split()) for r in left}
    taken = Counter()
    for r in left:
        taken[r[3]] += sizes[r[0]] * copies[r[0]]
    whole = sum(sizes.values())
    assert mixed.columns == columns and max(copies.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * whole) <= 4 * max(sizes.values())

    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stage["token output"](spark, mixed, folder).collect())
    coder, at, want, texts = Tokenizer.from_file(tokenizer_file()), 0, [], {r[0]: r[1] for r in left}
    for i in sorted(copies.elements()):
        ids = [*coder.encode(texts[i], add_special_tokens=False).ids, END_ID]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == want

    whole_run = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in P.run(spark, folder).collect())
    assert whole_run == want


def test_repeated_rows_and_clashing_columns(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "a", 1)] * 3 + [(None, "sept huit neuf dix onze douze", "fr", "b", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    single = P.drop_near_duplicates(spark, docs, folder)
    assert sorted(((r.doc_id, r.n_chars) for r in single.collect()), key=repr) == [(1, 1), (None, 1)]
    mixed = P.mix(spark, docs, folder)
    assert 0 < mixed.count() <= 10 and mixed.columns == docs.columns
    assert P.drop_contaminated(spark, docs, folder).count() == 5


def test_empty(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
