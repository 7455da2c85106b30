import random
import re
import time

from samplewright.llm import winnowing as W
from samplewright.llm.winnowing import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, span):
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(span, len(b))
            wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in wins and item is not None:
                    hit.update(range(j, j + n))
                    names.add(str(item))
        out.append((i, len(w), len(hit), len(names), sorted(names)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r.item_ids)) for r in df.collect()), key=repr)


def run(spark, rows, items, span=10, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate(docs, "doc_id", "text", bench, "item_id", "text", span, **more)


def test_random_spans(spark):
    """Few words, so that spans of all lengths are shared, repeated, and overlap."""
    rng = random.Random(11)
    text = lambda n, v: " ".join(rng.choices(v, k=n))
    few, many = ["a", "B", "ç"], [f"w{i}" for i in range(50)]
    items = [(i, text(rng.choice([0, 1, 3, 6, 9, 10, 11, 25]), rng.choice([few, many]))) for i in range(30)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 20), rng.choice([few, many]))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(items)[1].split()
            at = rng.randint(0, len(b))
            parts.append("-".join(b[at : at + rng.randint(0, 14)]))
            parts.append(text(rng.randint(0, 5), many))
        rows.append((i, ", ".join(parts)))
    assert found(run(spark, rows, items)) == brute(rows, items, 10)


def test_full_bitmap_changes_nothing(spark):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(base[i * 20 : i * 20 + 30])) for i in range(150)]
    rows = [(i, " ".join(base[(at := rng.randint(0, 3900)) : at + rng.randint(5, 60)])) for i in range(200)]
    assert found(run(spark, rows, items, filter_bits=1 << 15)) == brute(rows, items, 10)


def test_every_span_of_ten_is_found(spark):
    base = [f"q{i}" for i in range(60)]
    items = [(1, " ".join(base))]
    rows = [(i, " ".join(["x", "y", *base[i : i + 10], "z"])) for i in range(51)]
    rows += [(100 + i, " ".join(["x", *base[i : i + 9], "z"])) for i in range(52)]
    got = {r.doc_id: r.n_hit for r in run(spark, rows, items).collect()}
    assert all(got[i] == 10 for i in range(51)) and all(got[100 + i] == 0 for i in range(52))


def test_odd_texts(spark, odd):
    bench = spark.createDataFrame([(1, "word"), (2, "long long long"), (None, "漢字"), (3, None), (4, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert found(decontaminate(odd, "doc_id", "text", bench, "item_id", "text", 10)) == brute(rows, items, 10)


def test_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert found(run(spark, [(1, "a b")], [])) == [(1, 2, 0, 0, [])]


def test_time_is_linear_in_the_length_of_a_text(spark):
    """A document of 800,000 words takes at most 2.5 times as long as one of 400,000, and is read to its end."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(5000)]
    text = [rng.choice(words) for _ in range(800_000)]
    items = spark.createDataFrame([(1, " ".join(text[399_000:399_020])), (2, " ".join(text[799_900:799_915]))], "item_id long, text string")

    def run(n):
        docs = spark.createDataFrame([(1, " ".join(text[:n]))], "doc_id long, text string").cache()
        docs.count()
        started = time.perf_counter()
        row = W.decontaminate(docs, "doc_id", "text", items, "item_id", "text", span=10).first()
        took = time.perf_counter() - started
        docs.unpersist()
        return took, row

    run(20_000)
    half, first = min((run(400_000) for _ in range(2)), key=lambda r: r[0])
    whole, both = min((run(800_000) for _ in range(2)), key=lambda r: r[0])
    assert (first.n_hit, first.item_ids) == (20, ["1"])
    assert (both.n_hit, both.item_ids) == (35, ["1", "2"])
    assert whole < 2.5 * half
