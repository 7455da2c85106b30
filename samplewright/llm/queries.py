"""The registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import table
from . import (
    backoff_lm,
    exact_dedup,
    hard_negatives,
    html_tree,
    language,
    line_dedup,
    merkle,
    mixing,
    order_minhash,
    quality_rules,
    token_files,
    url_filter,
    winnowing,
)

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Registers a function under its own name."""

    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


_SQUEEZED = (
    "replace(replace(replace(replace(replace(replace(coalesce(text, ''), ' ', ''), chr(9), ''), chr(10), ''),"
    " chr(11), ''), chr(12), ''), chr(13), '')"
)


@query(f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256({_SQUEEZED}) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.exact_dedup(docs, "doc_id", "text", digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query(r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
q AS (
  SELECT doc_id, source, size,
         greatest(0.1, length(translate(t, '#$%&*|!+=<>{}[]~^@\', '')) / greatest(length(t), 1)) AS quality,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, chr(0)) || ':' || size), 1, 13))::BIGINT + 0.5)
           / 4503599627370496 AS u
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
w AS (SELECT source, source_size,
             ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5
                 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size,
             least(cap, w * coalesce((SELECT arg_min(level, ratio) FROM l AS x WHERE x.ratio >= x.level), 0)) AS target FROM l),
e AS (SELECT q.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-9) ELSE 0 END::BIGINT AS epochs,
             sum(size) OVER (PARTITION BY q.source ORDER BY -ln(u) / quality, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND upto - size / 2 <= target - epochs * source_size
                         THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
""")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, "doc_id", "text", "source", weights=(3, 1, 2), share=1.5, most_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


#: The rules of the contract, as (verdict, host/path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, "page_id", "url", RULES)


@query()
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = order_minhash.near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", "class_id", "group_size", "kept")


@query(r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.keep <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.keep IS NULL OR r.keep = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key)
GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.line_dedup(docs, "doc_id", "text", min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
n AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
       FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n.n, unnest(range(1, len(w) - n.n + 2)) AS p0,
              unnest(list_transform(range(1, len(w) - n.n + 2), lambda i: array_to_string(w[i:i + n.n - 1], ' '))) AS win
       FROM d, n WHERE len(w) >= n.n),
h AS (SELECT doc_id, p0, dw.n, item FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS pos FROM (SELECT DISTINCT doc_id, p0, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
""")
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = winnowing.decontaminate(docs, "doc_id", "text", items, "item_id", "text", span=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def held_out(divisor: int):
    """Whether a document is held out of training: crc32 of its id as text, modulo the divisor, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == 2, F.lit(False))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(4)), "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), "text", model, keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "rejected").select(
        "doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_tree.extract_text(pages, "page_id", "url", "html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = backoff_lm.fit(docs.where(~held_out(7)), "text")
    found = backoff_lm.score(docs, "doc_id", "text", model)
    return found.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The id that ends a document.
END_ID = 2


def tokenizer_file() -> str:
    """Where the public tokenizer of the contract lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.encode_and_read(docs, "doc_id", "text", tokenizer_file(), END_ID)


def _leaf_sql(chars: str) -> str:
    """The digest of a document, n_chars being given as an expression."""
    values = ["doc_id::VARCHAR", "source", "lang", f"({chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


@query(f"""
WITH RECURSIVE
c AS (  -- the 256 rests that CRC-32 looks up
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS rests
  FROM range(256) AS r(i)),
d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                   lambda x, y: xor(x >> 8, rests[(xor(x, y) & 255) + 1])), 4294967295) % 7 = 0
              THEN {_leaf_sql("n_chars + 1")} END AS claimed
  FROM documents, c),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM d),
t AS (
  SELECT grp, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL
  SELECT grp, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY grp, lvl, i // 2, n),
s AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, i, n, h FROM s
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
-- The steps of a proof: where the sibling stands, and the sibling.
p AS (
  SELECT l.grp, l.i, list(CASE WHEN (l.i >> m.lvl) % 2 = 1 THEN '<' ELSE '>' END || coalesce(t.h, '') ORDER BY m.lvl) AS steps
  FROM l JOIN (SELECT DISTINCT grp, lvl FROM t WHERE n > 1) AS m ON l.grp = m.grp
       LEFT JOIN t ON t.grp = l.grp AND t.lvl = m.lvl AND t.i = xor(l.i >> m.lvl, 1)
  GROUP BY l.grp, l.i),
q AS (
  SELECT s.grp, list(CASE WHEN (s.i >> m.lvl) % 2 = 1 THEN '<' ELSE '>' END || coalesce(u.h, '') ORDER BY m.lvl) AS steps
  FROM s, (SELECT DISTINCT lvl FROM u WHERE n > 1) AS m LEFT JOIN u ON u.lvl = m.lvl AND u.i = xor(s.i >> m.lvl, 1)
  GROUP BY s.grp),
f AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(l.claimed, l.leaf) AS given,
         coalesce(p.steps, []) || coalesce(q.steps, []) AS steps
  FROM l JOIN s USING (grp) LEFT JOIN p ON p.grp = l.grp AND p.i = l.i LEFT JOIN q ON q.grp = l.grp),
g AS (
  SELECT *, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256,
         list_reduce([given] || steps, lambda x, y: sha256(CASE WHEN y[1] = '<' THEN substr(y, 2) || x ELSE x || substr(y, 2) END)) AS folded_root
  FROM f)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.digest(merkle.encoded("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    found = merkle.manifest(docs, "doc_id", "lang", docs.columns, claimed=claimed)
    found = found.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("path")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _js_sql(a: str, b: str, bins: int) -> str:
    """The Jensen-Shannon distance between lists of counts."""

    def half(x: str, y: str) -> str:
        p, q = f"{x}[i] / greatest(list_sum({x}), 1)", f"{y}[i] / greatest(list_sum({y}), 1)"
        return f"list_sum(list_transform(range(1, {bins + 1}), lambda i: CASE WHEN {x}[i] > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END))"

    root = f"sqrt(least(1.0, greatest(0.0, ({half(a, b)} + {half(b, a)}) / 2)))"
    return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN {root} ELSE 0 END"


def _limit_sql(base: str, bins: int, size: str) -> str:
    value = quality_rules.LIMITS[base]
    return f"sqrt({value} * {value} + 2 * {bins - 1} / (8 * ln(2) * greatest({size}, 1)))"


def _without(characters: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{characters}', '', 'g'))"


_CLASS_SQL = [
    _without(c)
    for c in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?\x27\x22()\-]", r"[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]", r"[^\x00-\x7F]")
]
_BINS = 21
_EDGES_SQL = quality_rules.EDGES.replace("'", "''")


@query(rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT *, [{", ".join(_CLASS_SQL)}]::DOUBLE[] AS c, length(t) AS size FROM d),
g AS (SELECT lang FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum(size) >= 1000 ORDER BY sum(size) DESC, lang LIMIT 200),
e AS (SELECT c.*, g.lang AS ref FROM c LEFT JOIN g USING (lang)),
-- Every text counts for its language's reference and for that of all texts, which has no name.
r1 AS (
  SELECT ref, list(n ORDER BY k) AS r FROM (
    SELECT ref, k, sum(c[k]) AS n FROM (SELECT ref, c FROM e WHERE ref IS NOT NULL UNION ALL SELECT NULL, c FROM e), range(1, 8) AS x(k) GROUP BY ref, k)
  GROUP BY ref),
m1 AS (SELECT e.*, r, {_js_sql("c", "r", 7)} AS far FROM e JOIN r1 ON e.ref IS NOT DISTINCT FROM r1.ref),
near AS (SELECT * FROM m1 WHERE size < {quality_rules.LIMITS["class_chars"]} OR far <= {_limit_sql("class_limit", 7, "size")}),
both_refs AS (SELECT ref, c, w FROM near WHERE ref IS NOT NULL UNION ALL SELECT NULL, c, w FROM near),
r2 AS (SELECT ref, list(n ORDER BY k) AS r FROM (SELECT ref, k, sum(c[k]) AS n FROM both_refs, range(1, 8) AS x(k) GROUP BY ref, k) GROUP BY ref),
words AS (
  SELECT ref, translate(trim(word, '{_EDGES_SQL}'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, count(*) AS n
  FROM (SELECT ref, unnest(w) AS word FROM both_refs) GROUP BY ALL),
top AS (
  SELECT ref, key, n, row_number() OVER (PARTITION BY ref ORDER BY n DESC, key) AS k
  FROM words WHERE key <> '' QUALIFY k < {_BINS}),
w2 AS (
  SELECT ref, list(n ORDER BY k) AS r
  FROM (SELECT t.ref, x.k, coalesce(any_value(CASE WHEN x.k = {_BINS} THEN t.total - t.listed END), sum(top.n), 0)::DOUBLE AS n
        FROM (SELECT ref, sum(n) AS total, coalesce((SELECT sum(n) FROM top WHERE top.ref IS NOT DISTINCT FROM words.ref), 0) AS listed FROM words GROUP BY ref) AS t,
             range(1, {_BINS + 1}) AS x(k) LEFT JOIN top ON top.ref IS NOT DISTINCT FROM t.ref AND top.k = x.k
        GROUP BY t.ref, x.k)
  GROUP BY ref),
hist AS (
  SELECT doc_id, list(coalesce(top.k, {_BINS})) AS spots
  FROM (SELECT doc_id, ref, translate(trim(word, '{_EDGES_SQL}'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, ref, unnest(w) AS word FROM e)) AS x
       LEFT JOIN top ON top.ref IS NOT DISTINCT FROM x.ref AND top.key = x.key
  GROUP BY doc_id),
far AS (
  SELECT e.doc_id, e.size, len(e.w) AS n, {_js_sql("e.c", "r2.r", 7)} AS by_class,
         list_transform(range(1, {_BINS + 1}), lambda k: len(list_filter(coalesce(hist.spots, []), lambda s: s = k))::DOUBLE) AS h, w2.r AS wr
  FROM e LEFT JOIN r2 ON e.ref IS NOT DISTINCT FROM r2.ref LEFT JOIN hist USING (doc_id) LEFT JOIN w2 ON e.ref IS NOT DISTINCT FROM w2.ref),
odd AS (
  SELECT doc_id, (size >= {quality_rules.LIMITS["class_chars"]} AND by_class > {_limit_sql("class_limit", 7, "size")})
              OR (n >= {quality_rules.LIMITS["word_words"]} AND {_js_sql("h", "wr", _BINS)} > {_limit_sql("word_limit", _BINS, "n")}) AS odd
  FROM far),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM d),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows) WHERE times > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         ({_without("[#*$%&|<>]")})::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND NOT odd AS kept FROM f JOIN odd USING (doc_id)
""")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality_rules.judge(docs, "doc_id", "text", "lang", quality_rules.learn(docs, "text", "lang"))
    return found.drop("class_distance", "word_distance")


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v AS a, v WHERE a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
