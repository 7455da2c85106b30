import hashlib
import random
import re

from samplewright.llm.exact_dedup import exact_dedup


def brute(rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        group = groups[squeeze(t)]
        first = min(group, key=lambda g: g[:3])
        out.append((i, first[3], len(group), hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, digests=True):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect()), key=repr)


def test_random_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = rng.choices(["ab", "a b", "ba", "c\n", "c", "é", "\t"], k=rng.randint(0, 4))
        rows.append((i, rng.choice(["", " "]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup(docs, "doc_id", "text", prefix_chars=2, digests=True)
    assert found(got) == brute(rows)
    kept = [r for r in got.collect() if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({x[3] for x in brute(rows)})


def test_full_bitmap_changes_nothing(spark):
    rows = [(i, "x" * (i % 40) + str(i // 80)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact_dedup(docs, "doc_id", "text", filter_bits=1 << 15, digests=True)) == brute(rows)


def test_odd_texts(odd):
    got = exact_dedup(odd, "doc_id", "text", digests=True)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(got) == brute(rows)
    # Null, empty and blank are equal: the longest original stays. Of the two rows (4, "word") one stays.
    assert [r.kept for r in got.collect() if r.doc_id == 4].count(True) == 1


def test_empty(empty):
    assert exact_dedup(empty, "doc_id", "text").count() == 0
