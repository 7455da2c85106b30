import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np

from samplewright.llm import order_minhash as M

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k, seen, out = min(5, len(w)), Counter(), []
    for i in range(len(w) - k + 1 if w else 0):
        g = tuple(w[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def similarity(a, b):
    place, ends = {g: i for i, g in enumerate(b)}, []
    for g in a:
        if g in place:
            i = bisect_left(ends, place[g])
            ends[i : i + 1] = [place[g]]
    return len(ends) / (len(a) + len(b) - len(ends)) if a and b else 0.0


def brute(rows, least=0.8):
    """Classes by comparing all pairs."""
    cut = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(cut[i], cut[j]) >= least:
                root[top(i)] = top(j)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(top(i), []).append(doc)
    return {doc: (min(c), len(c)) for c in classes.values() for doc in c}


def edited(rng, words, rate):
    out = []
    for w in words:
        roll = rng.random()
        if roll < rate / 3:
            continue
        out.append(f"n{rng.randint(0, 10**6)}" if roll < rate else w)
        if roll > 1 - rate / 3:
            out.append(f"m{rng.randint(0, 10**6)}")
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return M.near_duplicates(docs, "doc_id", "text").collect()


def test_classes_of_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 6, 8, 12, 40, 200, 600]))]
        for _ in range(rng.randint(1, 12)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = found(spark, rows)
    assert {r.doc_id: (r.class_id, r.group_size) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_large_group_with_chains(spark):
    """Copies of copies: neighbours are similar, ends aren't; and many texts around one that is similar to all."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    chain, rows = base, []
    for _ in range(40):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"c{rng.random()}"
        chain[rng.randrange(len(chain))] = f"c{rng.random()}"
        rows.append(" ".join(chain))
    hub = [f"h{i}" for i in range(150)]
    rows += [" ".join(hub)] + [" ".join(edited(rng, hub, 0.03)) for _ in range(60)]
    rows = list(enumerate(rows))
    assert {r.doc_id: (r.class_id, r.group_size) for r in found(spark, rows)} == brute(rows)


def test_shared_passage_is_no_duplicate(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"o{rng.random()}" for _ in range(60)) + " " + passage) for i in range(80)]
    assert all(r.group_size == 1 and r.kept for r in found(spark, rows))


def test_order_matters(spark):
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(1, " ".join(a + b)), (2, " ".join(b + a)), (3, " ".join(a + b) + " end")]
    assert {r.doc_id: r.class_id for r in found(spark, rows)} == {1: 1, 2: 2, 3: 1}


def test_alignment_is_exact_above_the_threshold():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = rng.sample(range(200), n)
        b = [x if rng.random() > 0.08 else rng.randint(1000, 2000) for x in a]
        if rng.random() < 0.4:
            i = rng.randrange(len(b))
            b = b[i:] + b[:i] if rng.random() < 0.5 else b[:i] + rng.sample(range(3000, 4000), 4) + b[i:]
        b = list(dict.fromkeys(b))
        want = similarity(a, b)
        got = M.aligned(np.array(a), np.array(b), 0.8)
        assert got == want if want >= 0.8 else got < 0.8


def test_odd_texts(odd):
    got = {(r.doc_id, r.text_key): r for r in M.near_duplicates(odd, "doc_id", "text").collect()}
    rows = M.near_duplicates(odd, "doc_id", "text").collect()
    assert len(rows) == 10 and len(got) == 9  # one row is repeated
    assert sum(r.kept for r in rows if r.doc_id == 4) == 1
    assert all(r.kept and r.class_id == r.doc_id and r.group_size == 1 for r in rows if r.doc_id != 4)


def test_empty(empty):
    assert M.near_duplicates(empty, "doc_id", "text").count() == 0
