import random

from samplewright.llm.line_dedup import line_dedup


def brute(rows, min_docs, min_chars):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for row, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, {})[row] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            held = holders[key(x)]
            top = max((h for h in held.values() if h is not None), default=None)
            if len(key(x)) < min_chars or len(held) < min_docs or i == top:
                stay.append(x)
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_random_lines(spark):
    rng = random.Random(5)
    pool = ["short", "LINE that is long enough", "line THAT is long enough  ", "\tÄ line with umlauts, long", "ä line with umlauts, long", "only here and there it is", ""]
    rows = [(i, "\n".join(rng.choices(pool + [f"a line of its own {i} {rng.random()}"], k=rng.randint(0, 6)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_dedup(docs, "doc_id", "text", 3, 20)) == brute(rows, 3, 20)


def test_full_filters_change_nothing(spark):
    rows = [(i, f"a line that many hold {i // 3}\na line of its own, number {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(line_dedup(docs, "doc_id", "text", 3, 20, cells=512)) == brute(rows, 3, 20)


def test_filters_leave_out_most_lines_seen_once(spark):
    from samplewright.llm.line_dedup import _cells, _is_set, _keys, seen_twice

    rows = [(f"shared by all of them, surely\nthis line is number {i}, and alone",) for i in range(500)]
    docs = spark.createDataFrame(rows, "text string").repartition(6)
    bits = seen_twice(docs, "text", 20, 1 << 20)
    hit = [_is_set(bits, _cells(_keys(t, 20), 1 << 20)).all(axis=1).sum() for (t,) in rows]
    assert min(hit) >= 1 and sum(hit) <= 505


def test_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(line_dedup(odd, "doc_id", "text", 2, 1)) == brute(rows, 2, 1)


def test_empty(empty):
    assert line_dedup(empty, "doc_id", "text").count() == 0
