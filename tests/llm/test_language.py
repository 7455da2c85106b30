import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import language as L

WORDS = {
    "en": "the and of with which there that this from have were their about would these other into could".split(),
    "de": "der und die nicht über sich auch zwischen werden eine durch schon möglich früher straße ich noch".split(),
    "fr": "le que les été avec dans pour être français où très mais leur après même entre sans déjà".split(),
}


def corpus(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice([4, 15, 60]))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = L.fit(docs.where("doc_id % 4 <> 2"), "text", "lang")
    got = L.identify(docs.where("doc_id % 4 = 2"), "text", model).select("row.lang", "lang_pred", "score", "rejected").collect()
    assert len(got) == 60
    assert sum(r.lang == r.lang_pred for r in got) >= 59
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 1


def test_only_text_counts(spark):
    docs = corpus(spark)
    model = L.fit(docs, "text", "lang")
    wrong = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id"))
    a = sorted((r.t, r.lang_pred, r.score) for r in L.identify(docs, "text", model).select(F.col("row.text").alias("t"), "lang_pred", "score").collect())
    b = sorted((r.t, r.lang_pred, r.score) for r in L.identify(wrong, "text", model).select(F.col("row.text").alias("t"), "lang_pred", "score").collect())
    assert a == b


def test_foreign_text_is_rejected(spark):
    model = L.fit(corpus(spark), "text", "lang")
    rows = [("пример текста на другом языке который никто не видел " * 5,), ("the and of with which there that this from have " * 5,)]
    got = [r.rejected for r in L.identify(spark.createDataFrame(rows, "text string").coalesce(1), "text", model).collect()]
    assert got == [True, False]


def test_several_centroids_for_each_language(spark):
    model = L.fit(corpus(spark), "text", "lang", centroids=4)
    assert model.languages == ["de", "en", "fr"] and len(model.rows) == 12


def test_odd_texts(spark, odd):
    model = L.fit(corpus(spark), "text", "lang")
    got = {r.row.n: r for r in L.identify(odd, "text", model).collect()}
    assert len(got) == 10
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (0, 1, 2, 3))
    assert all(got[i].lang_pred in model.languages for i in (4, 5, 6, 7, 8, 9))
    assert got[7].row.key == "c"


def test_nothing_to_learn(spark, empty):
    model = L.fit(empty, "text", "lang")
    assert [r.lang_pred for r in L.identify(corpus(spark, 6), "text", model).collect()] == ["und"] * 6
    assert L.identify(empty, "text", model).count() == 0


def test_short_foreign_text_is_rejected(spark):
    """Every class of length has a floor, also those that few or no training texts fall into."""
    model = L.fit(corpus(spark), "text", "lang")
    assert (model.floors > 0).all()
    short = "пример текста на другом языке который никто не видел раньше"
    rows = [(short[:8],), (short[:20],), (short,), (short * 2,), (short * 40,), ("the and of with which there that this",), ("the and of with " * 200,)]
    got = [r.rejected for r in L.identify(spark.createDataFrame(rows, "text string").coalesce(1), "text", model).collect()]
    assert got == [True] * 5 + [False] * 2


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅳ Ⅻ", "٣٤ 12", "\u0301\u0301", "_ _", "😀 ؟"])
def test_numerals_and_marks_are_no_letters(text):
    assert L._vector(text) is None


def test_marks_are_part_of_words():
    assert (L._vector("हिन्दी") == L._vector(" हिन्दी, 7")).all()
    assert (L._vector("हिन्दी") != L._vector("ह न द")).any()
    assert (L._vector("Äb c") == L._vector("äB-c!")).all()


def by_hand(text):
    """Counts of the buckets of a text's n-grams, character by character."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    kept = " ".join(kept.split(" ")).split()
    if not any(unicodedata.category(c)[0] == "L" for w in kept for c in w):
        return None
    chars = f" {' '.join(kept)} "
    counts = Counter()
    for row, size in enumerate(L.SIZES):
        for i in range(len(chars) - size + 1):
            gram = 0
            for c in chars[i : i + size]:
                gram = (gram * 2654435761 + ord(c)) % 2**32
            mixed = gram * 0x9E3779B1 % 2**32
            counts[row * L.BUCKETS + ((mixed ^ (mixed >> 15)) & (L.BUCKETS - 1))] += 1
    return counts


def test_against_plain_python(spark):
    rows = corpus(spark, 90).collect()
    more = [(100, "½ ²", "en"), (101, None, "en"), (102, "Straße é 3", None), (103, "ça! très-bon", "fr")]
    docs = spark.createDataFrame([tuple(r) for r in rows] + more, "doc_id long, text string, lang string")
    model = L.fit(docs, "text", "lang", centroids=2)
    counts = {r.doc_id: by_hand(r.text or "") for r in docs.collect()}
    learned = [(r.doc_id, r.lang) for r in docs.collect() if r.lang and counts[r.doc_id]]

    seen = Counter(b for i, _ in learned for b in counts[i])
    idf = [math.log((1 + len(learned)) / (1 + seen[b])) + 0.05 for b in range(L.DIM)]
    assert np.allclose(model.idf, idf, atol=1e-5)

    def unit(c):
        v = {b: (1 + math.log(n)) * idf[b] for b, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    def cosine(c, centroid):
        return sum(x * float(centroid[b]) for b, x in unit(c).items())

    # Centroids are the directions of the means of the texts that are nearest to them.
    for lang in model.languages:
        own = [k for k in range(len(model.rows)) if model.languages[model.language_of[k]] == lang]
        groups = {k: np.zeros(L.DIM) for k in own}
        texts = {tuple(sorted(counts[i].items())): counts[i] for i, x in learned if x == lang}
        for c in texts.values():
            nearest = max(own, key=lambda k: cosine(c, model.rows[k]))
            for b, x in unit(c).items():
                groups[nearest][b] += x
        for k, total in groups.items():
            assert np.allclose(model.rows[k], total / np.linalg.norm(total), atol=1e-4)

    # Floors: 0.4 times the low quantile of cosines, in steps, of classes with ten texts.
    for i, lang in enumerate(model.languages):
        own = [k for k in range(len(model.rows)) if model.language_of[k] == i]
        by_class = {}
        for j, x in learned:
            if x == lang:
                size = sum(n for b, n in counts[j].items() if b < L.BUCKETS)
                by_class.setdefault(sum(size > x for x in L.LENGTH_CLASSES), []).append(max(cosine(counts[j], model.rows[k]) for k in own))
        for k, cosines in by_class.items():
            if len(cosines) >= L.LEAST_TEXTS:  # fewer than 1,000, so the quantile is the least
                assert model.floors[i, k] == pytest.approx(0.4 * math.floor(min(cosines) * L.STEPS) / L.STEPS, abs=0.4 / L.STEPS + 1e-9)

    for r in L.identify(docs, "text", model).collect():
        c = counts[r.row.doc_id]
        if c is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cosines = [cosine(c, centroid) for centroid in model.rows]
        assert r.score == pytest.approx(max(cosines), abs=1e-5)
        assert max(x for x, k in zip(cosines, model.language_of) if model.languages[k] == r.lang_pred) == pytest.approx(max(cosines), abs=1e-5)
        size = sum(n for b, n in c.items() if b < L.BUCKETS)
        floor = model.floors[model.languages.index(r.lang_pred), sum(size > x for x in L.LENGTH_CLASSES)]
        assert r.rejected == (r.score < floor)
