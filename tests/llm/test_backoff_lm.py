import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from samplewright import session
from samplewright.llm import backoff_lm as B


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


class Brute:
    """The same model with dictionaries and recursion."""

    def __init__(self, texts, order, least, d):
        self.d, self.order = d, order
        self.one = Counter(w for t in texts for w in tokens(t))
        self.total, self.distinct = sum(self.one.values()), len(self.one)
        frequent = {w for w, n in self.one.items() if n >= least}
        grams = Counter()
        for t in texts:
            w = tokens(t)
            for size in range(2, order + 1):
                for i in range(len(w) - size + 1):
                    g = tuple(w[i : i + size])
                    if all(x in frequent for x in g):
                        grams[g] += 1
        self.grams = {g: n for g, n in grams.items() if n >= least}
        self.after = {}
        for g in self.grams:
            self.after.setdefault(g[:-1], []).append(g[-1])

    def prob(self, h, w):
        if not h:
            n = self.one.get(w, 0)
            return (n - self.d) / self.total if n else self.d * self.distinct / self.total
        if h not in self.after:
            return self.prob(h[1:], w)
        seen = self.grams[h] if len(h) > 1 else self.one[h[0]]
        if w in self.after[h]:
            return (self.grams[*h, w] - self.d) / seen
        own = sum((self.grams[*h, x] - self.d) / seen for x in self.after[h])
        below = sum(self.prob(h[1:], x) for x in self.after[h])
        return (1 - own) / (1 - below) * self.prob(h[1:], w)

    def score(self, t):
        w = tokens(t)
        return sum(math.log10(self.prob(tuple(w[max(0, i - self.order + 1) : i]), x)) for i, x in enumerate(w))


def corpus(n=200, seed=3):
    rng = random.Random(seed)
    common = ["a", "B", "c", "The", "of"]
    return [" ".join(rng.choice(common) if rng.random() < 0.8 else f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3])
def test_against_recursion(spark, order):
    texts, fresh = corpus(), corpus(60, 5)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = B.fit(train, "text", order=order)
    want = Brute(texts, order, 2, 0.75)
    docs = spark.createDataFrame(list(enumerate(texts[:40] + fresh)), "doc_id long, text string")
    got = {r.doc_id: r for r in B.score(docs, "doc_id", "text", model).collect()}
    for i, t in enumerate(texts[:40] + fresh):
        w, r = tokens(t), got[i]
        assert r.n_tokens == len(w) and r.n_known == sum(x in want.one for x in w) and r.train_tokens == want.total
        assert r.base_score == pytest.approx(sum(math.log10((want.one.get(x, 0) + 1) / (want.total + want.distinct + 1)) for x in w))
        assert r.score == pytest.approx(want.score(t)), t


def test_probabilities_add_up_to_one():
    texts = corpus()
    m = Brute(texts, 3, 2, 0.75)
    for h in [(), ("a",), ("a", "b"), ("w1",), ("of", "the")]:
        assert sum(m.prob(h, w) for w in m.one) + m.prob(h, "never seen") == pytest.approx(1)


def test_share_bounds_the_automaton(spark):
    train = spark.createDataFrame([(t,) for t in corpus()], "text string")
    model = B.fit(train, "text", least_share=0.01)
    assert len(model.automaton.frequent) <= 100 and len(model.automaton.arcs) <= 300
    assert (model.automaton.frequent_counts >= 0.01 * model.automaton.total).all()


def test_repeated_text_scores_higher_than_noise(spark):
    train = spark.createDataFrame([("the cat sat on the mat",)] * 50 + [(t,) for t in corpus()], "text string")
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in B.score(docs, "doc_id", "text", B.fit(train, "text")).collect()}
    assert got[1] > got[2] + 2


def test_odd_texts(spark, odd, empty):
    model = B.fit(odd, "text")
    got = B.score(odd, "doc_id", "text", model).collect()
    assert len(got) == 10 and all(np.isfinite(r.score) and np.isfinite(r.base_score) and r.n_tokens >= 1 for r in got)
    assert sorted(r.n_tokens for r in got)[:3] == [1, 1, 1]
    untrained = B.fit(empty, "text")
    assert {(r.train_tokens, r.n_known) for r in B.score(odd, "doc_id", "text", untrained).collect()} == {(0, 0)}
    assert B.score(empty, "doc_id", "text", model).count() == 0


def test_rare_grams_count_at_any_share(spark):
    """Scores don't depend on how much of the model the tasks hold."""
    texts, fresh = corpus(), corpus(60, 5)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Brute(texts, 3, 2, 0.75)
    docs = spark.createDataFrame(list(enumerate(texts[:40] + fresh)), "doc_id long, text string")
    for share in (0.002, 0.02, 0.9):
        model = B.fit(train, "text", least_share=share)
        assert model.terms.count() > 300 and len(model.automaton.arcs) < 300
        for r in B.score(docs, "doc_id", "text", model).collect():
            t = (texts[:40] + fresh)[r.doc_id]
            assert r.score == pytest.approx(want.score(t)), t
            assert r.n_known == sum(x in want.one for x in tokens(t))


def test_only_terms_stay_on_disk(spark, tmp_path, monkeypatch):
    """What a fit counts and joins on its way is deleted with it, and scoring stores nothing."""
    taken = itertools.count()
    monkeypatch.setattr(session, "scratch_path", lambda _, name: f"{tmp_path}/{name}-{next(taken)}")
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    model = B.fit(docs, "text")
    assert B.score(docs, "doc_id", "text", model).count() == 200
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["terms"]


def test_packed_counts_add_up():
    """n-grams that several tasks and flushes counted come together in the bucket of their key."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    want, packed = Counter(), []
    for _ in range(5):
        pre, suf = words[rng.integers(0, 12, 70)], words[rng.integers(0, 12, 70)]
        want.update(zip(pre.tolist(), suf.tolist(), strict=True))
        packed += B._packed(7, *B._count_pairs(pre, suf, np.ones(70, np.uint32)))
    got = {}
    for bucket in range(7):
        rows = pa.Table.from_batches(packed).filter(pc.field("bucket") == bucket)
        if rows.num_rows:
            table = B._kept(rows)
            pre, suf = (table.column(c).to_numpy().view(np.uint64).tolist() for c in ("pre", "suf"))
            got |= dict(zip(zip(pre, suf, strict=True), table.column("n").to_pylist(), strict=True))
    assert got == {g: n for g, n in want.items() if n >= 2}


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in ("", "a", "b", "é", "\0", "\0\0") for b in range(3000)] + ["x" * n for n in range(1, 300)]
    hashes = B._word_hashes(pa.array(["", *words, ""]).dictionary_encode().dictionary)
    assert len(set(hashes[1:].tolist())) == len(words)
    assert (B._word_hashes(pa.array(["zz", *words])[1:]) == hashes[1:]).all()
