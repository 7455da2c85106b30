import math
import re

import numpy as np
import pytest

from samplewright.llm import quality_rules as rules

SPACES = " \t\n\x0b\f\r"


def by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def js(a, b):
    if not sum(a) or not sum(b):
        return 0.0
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    middle = [(x + y) / 2 for x, y in zip(p, q)]
    part = lambda v: sum(x * math.log2(x / m) for x, m in zip(v, middle) if x)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


TEXTS = [
    "a b c d e f a b c d e g h", "same line\nother\nsame line\n same line\n\n\n \nother", "x x x x x x x", "a b c d e a b c d e a b c d e",
    "## 5% of $3 <b> | & *", "Ünï 漢字 😀 ünï 漢字 😀 x", "one two three four", "one two three four five", "\x1f word \x85 next",
]


def test_counts_against_plain_python(spark, odd):
    docs = odd.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    )
    found = rules.judge(docs, "doc_id", "text", "lang", rules.learn(docs, "text", "lang")).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, found[names].values.tolist())) == sorted(by_hand(r.text) for r in docs.collect())
    failed = (found.n_words < 10) | (100 * found.n_repeat_words > 20 * found.n_words)
    assert (found.base_failed == failed).all()
    assert not (found.kept & found.base_failed).any()


def test_equal_codes_of_different_windows(monkeypatch):
    words, offsets = np.array([0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]), np.array([0, 15, 16])
    want = rules.repeated_words(words, offsets)
    assert want.tolist() == [10, 0]
    monkeypatch.setattr(rules, "_codes", lambda columns: np.zeros(len(columns[0]), np.uint64))
    assert rules.repeated_words(words, offsets).tolist() == want.tolist()


def test_distance_against_plain_python():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (50, 8)), rng.integers(0, 9, (50, 8))
    a[0], b[1] = 0, 0
    assert np.allclose(rules.js_distance(a, b), [js(x, y) for x, y in zip(a.tolist(), b.tolist())])
    assert rules.js_distance(a[2:], a[2:] * 3).max() < 1e-7


def test_references_cover_all_texts_of_a_language(spark):
    rows = [("The cat, the DOG! the end 7" * 20, "en"), ("the cat sat" * 20, "en"), ("le chat le chien" * 30, "fr"), ("x" * 30, "tiny"), (None, "en"), ("", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    refs = rules.learn(docs, "text", "lang", common=2, least_chars=200)
    assert refs.langs == ["en", "fr"]
    en = rows[0][0] + rows[1][0]
    assert refs.classes[0, :4].tolist() == [len(re.findall(p, en)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[ ]")]
    assert refs.classes[2].sum() == sum(len(t or "") for t, _ in rows)  # "tiny" is in the reference of all texts only
    tokens = [w.strip(rules.EDGES).lower() for text in (rows[0][0], rows[1][0]) for w in text.split()]
    best = sorted(set(tokens), key=lambda w: (-tokens.count(w), w))[:2]
    assert refs.words[0] == best
    assert refs.counts[0].tolist() == [*(tokens.count(w) for w in best), len(tokens) - sum(tokens.count(w) for w in best)]


@pytest.fixture(scope="module")
def prose(spark):
    rng = np.random.default_rng(3)
    common, rare = ["the", "of", "and", "to", "in"], ["".join(rng.choice(list("aeioustrnl"), 6)) for _ in range(3000)]
    text = lambda share, n=200: " ".join(str(rng.choice(common)) if rng.random() < share else str(rng.choice(rare)) for _ in range(n)) + "."
    good = [text(0.5) for _ in range(40)]
    bad = [text(0.5).upper(), " ".join(w + "%$#" for w in text(0.5).split()), text(0.0)]
    guarded = ["5550 123 " + text(0.0, 12), text(0.5, 9)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad + guarded)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), len(good), len(bad)


def test_odd_texts_go_and_others_stay(prose):
    docs, good, bad = prose
    found = rules.judge(docs, "doc_id", "text", "lang", rules.learn(docs, "text", "lang")).toPandas().set_index("doc_id")
    assert found.kept[:good].all()
    assert not found.kept[good : good + bad].any()
    assert not found.base_failed[good : good + bad].any()
    # Too short to be compared, and too short at all.
    assert found.kept[good + bad] and not found.kept[good + bad + 1]


def test_unknown_languages_and_empty_tables(prose, empty):
    docs, _, _ = prose
    refs = rules.learn(docs, "text", "lang")
    other = docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, null, 'xx') AS lang")
    one = rules.judge(docs, "doc_id", "text", "lang", refs).orderBy("doc_id").collect()
    assert rules.judge(other, "doc_id", "text", "lang", refs).orderBy("doc_id").collect() == one  # there is one language only
    none = rules.learn(empty, "text", "lang")
    assert none.langs == [] and none.classes.sum() == 0
    assert rules.judge(empty, "doc_id", "text", "lang", none).count() == 0
