import hashlib

import pytest
from pyspark.sql import functions as F

from samplewright.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def proof(levels, place, fanout):
    out = ""
    for level in levels[:-1]:
        first = place // fanout * fanout
        out += "".join(h for i, h in enumerate(level[first : first + fanout], first) if i != place)
        place //= fanout
    return out


def by_hand(rows, fanout):
    """(id, leaf, subroot, root, siblings) of rows (doc_id, lang, leaf), level by level."""
    groups = {}
    for doc_id, lang, leaf in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in langs}
    top = tree([trees[g][-1][0] for g in langs], fanout)
    out = []
    for at, g in enumerate(langs):
        for i, (*_, leaf, doc_id) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof(trees[g], i, fanout) + proof(top, at, fanout)))
    return sorted(out, key=repr)


def found(rows, fanout, digits, **more):
    made = merkle.manifest(rows, "doc_id", "lang", COLUMNS, fanout=fanout, digits=digits, **more)
    return made, sorted(
        (tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path"))).collect()), key=repr
    )


# Several layers of blocks, also of groups, and runs that are cut off at every level.
@pytest.mark.parametrize(("fanout", "digits"), [(2, 6), (2, 2), (3, 1)])
def test_against_level_by_level(spark, fanout, digits):
    sizes = [("b", 41), ("B", 1), ("é", 2), (None, 7), ("", 3), ("z", 8)]
    rows = [(1000 * g + i // 2, f"t{i}", lang, None if i % 3 else "s", i) for g, (lang, n) in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    made, got = found(docs, fanout, digits)
    want = by_hand([(r[0], r[2], leaf_of([r[0], r[3], r[2], r[4], r[1]])) for r in rows], fanout)
    assert got == want
    assert made.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(rows)


def test_odd_rows(odd):
    _, got = found(odd, 2, 3)
    want = by_hand([(r.doc_id, r.lang, leaf_of([r[c] for c in COLUMNS])) for r in odd.collect()], 2)
    assert got == want


def test_a_changed_row_is_found(spark):
    docs = spark.range(30).selectExpr("id AS doc_id", "cast(id AS string) AS text", "'x' AS lang", "'s' AS source", "id AS n")
    changed = merkle.digest(merkle.encoded("doc_id", "source", "lang", F.col("n") + 1, "text"))
    made, _ = found(docs, 2, 2, claimed=F.when(F.col("doc_id") % 7 == 0, changed))
    right = made.select("doc_id", (merkle.folded(F.col("claimed"), F.col("path")) == F.col("root")).alias("v")).collect()
    assert {r.doc_id for r in right if not r.v} == {0, 7, 14, 21, 28}


def test_one_row_and_none(spark, empty):
    docs = empty.withColumnRenamed("n_chars", "n")
    assert merkle.manifest(docs, "doc_id", "lang", COLUMNS, digits=2).count() == 0
    one = spark.createDataFrame([(1, "t", None, "s", 1)], docs.schema)
    row = merkle.manifest(one, "doc_id", "lang", COLUMNS, digits=2).first()
    assert row.root == row.subroot == row.leaf == leaf_of([1, "s", None, 1, "t"])
    assert row.path == []


def test_blocks_are_bounded(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'=x' AS grp")
    placed = merkle.ranked(docs, "grp", ["doc_id"])
    assert placed.where("rank = doc_id AND n = 2000").count() == 2000
    nodes = placed.select("grp", "n", "rank", F.struct(F.lit("h").alias("hash"), "rank").alias("node"))
    blocks = merkle._roll_up(nodes, 2, 5)
    assert blocks.count() == -(-2000 // 32)


def test_arguments(empty):
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(empty, "doc_id", "lang", ["doc_id"], fanout=1)
