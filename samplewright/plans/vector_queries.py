"""Queries on vectors and matrices: expressions, projections, class lookups, attention, singular value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import attention, classes, linalg, moments, raster, scoring, spectrum
from ..operators.checks import prefix_split, shape_report
from ..session import scratch_path, store
from ..streaming.moving import read_batches, start_moving_moments
from . import jobs
from .feed_queries import _normal_sql
from .registry import EMB, query, rounded, sql_hash, table


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _tall(df: DataFrame, vector: Column | str, *keep: str, value: str = "v") -> DataFrame:
    tall = df.select("vec_id", *keep, F.posexplode(vector).alias("pos", value))
    return tall.withColumn(value, rounded(F.col(value)))


# --- expressions ---------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, (value - 10.0) / 5.0 AS x FROM events)
SELECT event_id, round(greatest(x, 0.0), 6) + 0.0 AS relu, round(tanh(x), 6) + 0.0 AS tanh,
  round(ln(1 + exp(x)), 6) + 0.0 AS softplus, round(0.6 * x + 0.4 * abs(x), 6) + 0.0 AS lrelu
FROM e""")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("value") - 10.0) / 5.0
    return table(spark, sf_dir, "events").select(
        "event_id",
        rounded(A.relu(x)).alias("relu"),
        rounded(F.tanh(x)).alias("tanh"),
        rounded(A.softplus(x)).alias("softplus"),
        rounded(A.lrelu(x)).alias("lrelu"),
    )


def _stretched() -> Column:
    """Vectors of differing length: element j times j + 1."""
    return F.transform(A.doubles(F.col("embedding")), lambda x, j: x * (j + 1))


@query(f"""WITH {EMB}
SELECT vec_id, j::INTEGER AS pos,
  round(v * (j + 1) / (sqrt(sum(v * (j + 1) * v * (j + 1)) OVER (PARTITION BY vec_id)) + 1e-12), 6) + 0.0 AS v
FROM emb""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(_embeddings(spark, sf_dir), A.l2_normalize(_stretched()))


@query("""SELECT vec_id, pos::INTEGER AS pos, (pos = label)::INTEGER::DOUBLE AS v
FROM embeddings, (SELECT unnest(range(10)) AS pos)""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(_embeddings(spark, sf_dir), A.doubles(A.one_hot(F.col("label"), 10)))


@query(f"""WITH {EMB} SELECT vec_id, j::INTEGER AS pos, floor((v + 1.0) * 127.5)::INTEGER AS cut,
  floor((v + 1.0) * 127.5 + 0.5)::INTEGER AS nearest FROM emb""")
def to_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.col("embedding")
    both = F.arrays_zip(A.to_uint8(image).alias("cut"), A.to_uint8(image, rounding="nearest").alias("nearest"))
    return _embeddings(spark, sf_dir).select("vec_id", F.posexplode(both).alias("pos", "p")).select("vec_id", "pos", "p.*")


@query(f"""WITH {EMB} SELECT vec_id, j::INTEGER AS pos, round((v + 1.0) / 2.0, 6) + 0.0 AS v FROM emb""")
def to_unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(_embeddings(spark, sf_dir), A.to_unit_range(F.col("embedding")))


@query(f"""WITH {EMB}, s AS (SELECT *, v * (j + 1) AS x FROM emb),
e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, j::INTEGER AS pos, round(e / sum(e) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM e""")
def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(_embeddings(spark, sf_dir), A.softmax(_stretched()))


@query(f"""WITH {EMB} SELECT a.vec_id, a.j::INTEGER AS pos, round(a.v + 0.5 * b.v, 6) + 0.0 AS v
FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND b.j = 63 - a.j""")
def residual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(_embeddings(spark, sf_dir), A.add_scaled(F.col("embedding"), F.reverse("embedding"), 0.5))


# --- linear projection and model scoring ---------------------------------------------------------

WEIGHTS = [[((j * 7 + k * 3) % 11 - 5) / 10.0 for k in range(3)] for j in range(64)]
BIAS = [0.1, -0.2, 0.3]
WEIGHTS_SQL = """w AS (
  SELECT j, k, ((j * 7 + k * 3) % 11 - 5) / 10.0::DOUBLE AS w
  FROM (SELECT unnest(range(64)) AS j), (SELECT unnest(range(3)) AS k))"""


def _weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(WEIGHTS)), "row int, w array<double>")


_PROJECT_SQL = f"""WITH {EMB}, {WEIGHTS_SQL}
SELECT vec_id, k::INTEGER AS pos, round(sum(v * w) + CASE k WHEN 0 THEN 0.1 WHEN 1 THEN -0.2 ELSE 0.3 END, 6) + 0.0 AS v
FROM emb JOIN w USING (j) GROUP BY vec_id, k"""


@query(_PROJECT_SQL)
def linear_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linalg.linear_project(_embeddings(spark, sf_dir), "embedding", _weight_table(spark), "out", BIAS)
    return _tall(made, "out")


@query(_PROJECT_SQL)
def linear_project_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias = spark.createDataFrame(list(enumerate(BIAS)), "pos int, b double")
    vectors = _embeddings(spark, sf_dir)
    return _tall(linalg.project_by_join(vectors, "vec_id", "embedding", _weight_table(spark), "out", bias), "out")


def _make_classifier():
    weights = np.array(WEIGHTS)

    def predict(vectors):
        logits = vectors @ weights
        return {"pool": np.maximum(logits, 0.0), "logits": logits}

    return predict


def _make_generator():
    weights = np.array(WEIGHTS)

    def predict(z, class_id):
        return {"sample": np.tanh(z @ weights + class_id[:, None] / 10.0)}

    return predict


@query(f"""WITH {EMB}, {WEIGHTS_SQL}, o AS (SELECT vec_id, k, sum(v * w) AS x FROM emb JOIN w USING (j) GROUP BY vec_id, k)
SELECT vec_id, k::INTEGER AS pos, round(greatest(x, 0.0), 6) + 0.0 AS pool, round(x, 6) + 0.0 AS logit FROM o""")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    scored = scoring.score(vectors, _make_classifier, {"embedding": 64}, ["pool", "logits"])
    both = F.arrays_zip(F.col("pool"), F.col("logits").alias("logit"))
    tall = scored.select("vec_id", F.posexplode(both).alias("pos", "p"))
    return tall.select("vec_id", "pos", rounded("p.pool").alias("pool"), rounded("p.logit").alias("logit"))


@query(f"""WITH {_normal_sql("embeddings", "vec_id", 64, 31)}, {WEIGHTS_SQL},
o AS (SELECT row AS vec_id, k, sum(z * w) AS x FROM normal JOIN w ON normal.pos = w.j GROUP BY row, k),
c AS (SELECT vec_id, (({sql_hash("'31:class:' || vec_id", 8)} * 10) >> 32)::INTEGER AS class_id FROM embeddings)
SELECT vec_id, class_id, k::INTEGER AS pos, round(tanh(x + class_id / 10.0::DOUBLE), 6) + 0.0 AS v
FROM o JOIN c USING (vec_id)""")
def generate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    made = scoring.generate_samples(rows, "vec_id", _make_generator, 64, 10, ["sample"], seed=31)
    return _tall(made, "sample", "class_id")


# --- class lookups -------------------------------------------------------------------------------

CHANNELS = 4
# The classes in the table, each with gamma = 1 + class/10 + channel/100 and beta = class/100.
CLASS_SQL = "(1 + label / 10.0::DOUBLE + j % 4 / 100.0::DOUBLE)"


def _class_parameters(embeddings: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(CHANNELS - 1))
    return embeddings.select("label").distinct().select(
        "label",
        F.transform(places, lambda c: F.lit(1) + F.col("label") / 10.0 + c / 100.0).alias("gamma"),
        F.transform(places, lambda c: F.col("label") / 100.0).alias("beta"),
    )


def _channel_stats_sql(channel: str) -> str:
    return f"stats AS (SELECT {channel} AS channel, avg(v) AS m, var_pop(v) AS s FROM emb GROUP BY {channel})"


@query(f"""WITH {EMB}, {_channel_stats_sql("j % 4")}
SELECT vec_id, j::INTEGER AS pos,
  round((v - m) / sqrt(s + 1e-5) * {CLASS_SQL} + label / 100.0::DOUBLE, 6) + 0.0 AS v
FROM emb JOIN stats ON j % 4 = channel""")
def conditional_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    made = classes.conditional_normalize(vectors, "embedding", "label", _class_parameters(vectors), CHANNELS)
    return _tall(made, "normalized")


@query(f"""WITH {EMB}, {_channel_stats_sql("j % 4")}
SELECT vec_id, j::INTEGER AS pos,
  round((v - 0.1 * m) / sqrt(0.9 + 0.1 * s + 1e-5) * {CLASS_SQL} + label / 100.0::DOUBLE, 6) + 0.0 AS v
FROM emb JOIN stats ON j % 4 = channel""")
def conditional_normalize_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With moving moments instead: one update of decay 0.9 from mean 0, variance 1."""
    vectors = _embeddings(spark, sf_dir)
    moving = moments.channel_moments(vectors, "embedding", CHANNELS).select(
        "channel", (F.col("mean") * 0.1).alias("mean"), (F.col("variance") * 0.1 + 0.9).alias("variance")
    )
    parameters = _class_parameters(vectors)
    made = classes.conditional_normalize(vectors, "embedding", "label", parameters, CHANNELS, moving)
    return _tall(made, "normalized")


# Rows of a batch of the stream that keeps the moving statistics.
LIVE_BATCH = 32


@query(f"""WITH RECURSIVE {EMB},
stats AS (
  SELECT j % 4 AS channel, vec_id // {LIVE_BATCH} AS batch, avg(v) AS m, var_pop(v) AS s FROM emb GROUP BY ALL),
live AS (
  SELECT channel, batch, 0.1::DOUBLE * m AS mean, 0.9::DOUBLE + 0.1::DOUBLE * s AS variance FROM stats WHERE batch = 0
  UNION ALL
  SELECT s.channel, s.batch, 0.9::DOUBLE * l.mean + 0.1::DOUBLE * s.m, 0.9::DOUBLE * l.variance + 0.1::DOUBLE * s.s
  FROM live l JOIN stats s ON s.channel = l.channel AND s.batch = l.batch + 1),
-- A row at step vec_id sees the batches that are complete by then, and the first one in any case.
seen AS (SELECT vec_id, greatest((vec_id + 1) // {LIVE_BATCH} - 1, 0) AS batch FROM embeddings)
SELECT vec_id, j::INTEGER AS pos,
  round((v - mean) / sqrt(variance + 1e-5) * {CLASS_SQL} + label / 100.0::DOUBLE, 6) + 0.0 AS v
FROM emb JOIN seen USING (vec_id) JOIN live ON live.batch = seen.batch AND live.channel = j % 4""")
def conditional_normalize_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the moving statistics of a stream as they stood at each row's step, the first batch's for the rows in it.

    The state has one version after each batch, numbered by the step at which the batch is complete.
    """
    vectors = _embeddings(spark, sf_dir)
    stream = spark.readStream.schema(vectors.schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    values = stream.select(F.floor(F.col("vec_id") / LIVE_BATCH).alias("batch"), F.posexplode("embedding").alias("j", "value"))
    values = values.select((F.col("j") % CHANNELS).alias("channel"), "batch", "value")
    state, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live-checkpoint")
    start_moving_moments(values, ["channel"], "batch", "value", state, checkpoint).awaitTermination()
    versions = moments.moving_versions(read_batches(spark, state, ["channel"], "batch"), "batch", ["channel"], decay=0.9)
    complete = F.when(F.col("batch") == 0, 0).otherwise((F.col("batch") + 1) * LIVE_BATCH - 1)
    versions = store(versions.withColumn("vec_id", complete.cast("bigint")).drop("batch"), "versions")
    made = classes.conditional_normalize_as_of(vectors, "embedding", "label", _class_parameters(vectors), "vec_id", versions, CHANNELS)
    return _tall(made, "normalized")


@query(f"""WITH {EMB}, {_channel_stats_sql("j")}
SELECT vec_id, j::INTEGER AS pos, round((v - m) / sqrt(s + 1e-5), 6) + 0.0 AS v
FROM emb JOIN stats ON j = channel""")
def plain_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tall(classes.normalize(_embeddings(spark, sf_dir), "embedding", 64), "normalized")


@query(f"""WITH {EMB}, map AS (SELECT label, j, avg(v) AS e FROM emb GROUP BY label, j),
s AS (SELECT j, sum(e) AS s FROM map GROUP BY j),
u AS (SELECT j, s / (sqrt((SELECT sum(s * s) FROM s)) + 1e-12) AS u FROM s),
p AS (SELECT label, sum(e * u) AS p FROM map JOIN u USING (j) GROUP BY label),
n AS (SELECT sqrt(sum(p * p)) AS n FROM p)
SELECT vec_id, label, j::INTEGER AS pos, round(e / (n * n / (n + 1e-12)), 6) + 0.0 AS v
FROM embeddings JOIN map USING (label), n""")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's class vector, the map divided by its dominant singular value (start: ones)."""
    vectors = _embeddings(spark, sf_dir)
    class_map = linalg.aligned_vector_mean(vectors, "label", "embedding").select("label", F.col("mean").alias("vec"))
    # Rescaling reads the map several times; it has one row per class.
    class_map = store(class_map.withColumn("u", F.lit(1.0)), "class-map")
    rescaled = linalg.rescale_map(class_map, "vec", "u").select("label", "vec")
    return _tall(classes.lookup_class(vectors.select("vec_id", "label"), "label", rescaled), "vec", "label")


def _lookup_steps_sql(steps: int) -> str:
    parts = ["u0 AS (SELECT label, 1.0::DOUBLE AS u FROM map GROUP BY label)"]
    for i in range(1, steps + 1):
        parts.append(f"""s{i} AS (SELECT j, sum(e * u) AS s FROM map JOIN u{i - 1} USING (label) GROUP BY j),
v{i} AS (SELECT j, s / (sqrt((SELECT sum(s * s) FROM s{i})) + 1e-12) AS v FROM s{i}),
p{i} AS (SELECT label, sum(e * v) AS p FROM map JOIN v{i} USING (j) GROUP BY label),
n{i} AS (SELECT sqrt(sum(p * p)) AS n FROM p{i}),
u{i} AS (SELECT label, p / (n + 1e-12) AS u FROM p{i}, n{i})""")
    return ", ".join(parts)


@query(f"""WITH {EMB}, map AS (SELECT label, j, avg(v) AS e FROM emb GROUP BY label, j), {_lookup_steps_sql(3)}
SELECT label, j::INTEGER AS pos, round(e / (n * n / (n + 1e-12)), 6) + 0.0 AS v, round(u, 6) + 0.0 AS u
FROM map JOIN u3 USING (label), n3""")
def embedding_lookup_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class map after three power iterations."""
    vectors = _embeddings(spark, sf_dir)
    class_map = linalg.aligned_vector_mean(vectors, "label", "embedding").select("label", F.col("mean").alias("vec"))
    class_map = store(class_map.withColumn("u", F.lit(1.0)), "class-map")
    rescaled = linalg.rescale_map(class_map, "vec", "u", num_iters=3)
    tall = rescaled.select("label", rounded("u").alias("u"), F.posexplode("vec").alias("pos", "v"))
    return tall.withColumn("v", rounded("v"))


@query(f"""WITH {EMB}, h AS (SELECT vec_id, label, j % 4 AS c, sum(greatest(v, 0.0)) AS h FROM emb GROUP BY ALL),
map AS (SELECT label, j % 4 AS c, avg(v) AS e FROM emb GROUP BY label, j % 4)
SELECT vec_id, round(0.1 + sum(h * (e + CASE c WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 WHEN 2 THEN 0.125 ELSE 1.0 END)), 6) + 0.0 AS score
FROM h JOIN map USING (label, c) GROUP BY vec_id""")
def projection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    sums = vectors.select("label", raster.spatial_sum(F.col("embedding"), CHANNELS).alias("s"))
    per_class = linalg.aligned_vector_mean(sums, "label", "s")
    class_map = per_class.select("label", F.transform("mean", lambda x: x / (64 / CHANNELS)).alias("vec"))
    scored = classes.projection_score(vectors, "embedding", "label", class_map, "vec", [0.5, -0.25, 0.125, 1.0], 0.1)
    return scored.select("vec_id", rounded("score").alias("score"))


# --- attention -----------------------------------------------------------------------------------


_ATTENTION_SQL = f"""WITH {EMB},
dots AS (
  SELECT a.label, a.vec_id AS q, b.vec_id AS k, sum(a.v * b.v) AS s
  FROM emb a JOIN emb b ON a.label = b.label AND a.j = b.j GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY q)) AS e FROM dots),
a AS (SELECT q, k, e / sum(e) OVER (PARTITION BY q) AS a FROM e)
SELECT q AS vec_id, j::INTEGER AS pos, round(sum(a * v), 6) + 0.0 AS v
FROM a JOIN emb ON k = emb.vec_id GROUP BY q, j"""


@query(_ATTENTION_SQL)
def attention_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector attends to all vectors of its label."""
    return _attention(spark, sf_dir, attention.BLOCK_ROWS)


@query(_ATTENTION_SQL)
def attention_group_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks small enough to cut each label into several spans."""
    return _attention(spark, sf_dir, 16)


def _attention(spark: SparkSession, sf_dir: str, block_rows: int) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select(
        "label", "vec_id", F.col("embedding").alias("q"), F.col("embedding").alias("k"), F.col("embedding").alias("v")
    )
    return _tall(attention.softmax_attend(rows, rows, "label", "vec_id", "vec_id", block_rows=block_rows), "attended")


# Fixed 1x1 projections for 4 x 4 x 4 images: 4 -> 2, 4 -> 2, 4 -> 2, 2 -> 4.
THETA = np.array([[((c * 3 + k * 5) % 7 - 3) / 4.0 for k in range(2)] for c in range(4)])
PHI = np.array([[((c * 5 + k * 2) % 7 - 3) / 4.0 for k in range(2)] for c in range(4)])
G = np.array([[((c * 2 + k * 3) % 5 - 2) / 2.0 for k in range(2)] for c in range(4)])
OUT = np.array([[((k * 3 + c * 2) % 5 - 2) / 2.0 for c in range(4)] for k in range(2)])


@query(f"""WITH {EMB}, x AS (SELECT vec_id, j // 16 AS y, j // 4 % 4 AS x, j % 4 AS c, v FROM emb),
ks AS (SELECT unnest(range(2)) AS k),
paths AS (
  SELECT vec_id, y, x, k, sum(v * ((c * 3 + k * 5) % 7 - 3) / 4.0) AS theta,
    sum(v * ((c * 5 + k * 2) % 7 - 3) / 4.0) AS phi, sum(v * ((c * 2 + k * 3) % 5 - 2) / 2.0) AS g
  FROM x, ks GROUP BY ALL),
pooled AS (
  SELECT vec_id, y // 2 AS py, x // 2 AS px, k, max(phi) AS phi, max(g) AS g FROM paths GROUP BY ALL),
scores AS (
  SELECT vec_id, y, x, py, px, sum(theta * pooled.phi) AS s FROM paths JOIN pooled USING (vec_id, k) GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, y, x)) AS e FROM scores),
a AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, y, x) AS a FROM e),
seen AS (SELECT vec_id, y, x, k, sum(a * g) AS g FROM a JOIN pooled USING (vec_id, py, px) GROUP BY ALL),
back AS (
  SELECT vec_id, y, x, c, sum(g * ((k * 3 + c * 2) % 5 - 2) / 2.0) AS o
  FROM seen, (SELECT unnest(range(4)) AS c) GROUP BY ALL)
SELECT vec_id, ((y * 4 + x) * 4 + c)::INTEGER AS pos, round(v + 0.5 * o, 6) + 0.0 AS v
FROM x JOIN back USING (vec_id, y, x, c)""")
def self_attention_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    attended = attention.self_attention(F.col("embedding"), 4, 4, 4, THETA, PHI, G, OUT, sigma=0.5)
    return _tall(_embeddings(spark, sf_dir).select("vec_id", attended.alias("out")), "out")


# --- singular value, aligned mean, checks --------------------------------------------------------


@query(f"""WITH {EMB}, r AS (SELECT vec_id, sum(v) AS r FROM emb GROUP BY vec_id),
s AS (SELECT j, sum(r * v) AS s FROM emb JOIN r USING (vec_id) GROUP BY j),
vw AS (SELECT j, s / ((SELECT sqrt(sum(r * r)) FROM r) + 1e-12) AS s FROM s),
sigma AS (SELECT sum(s * s) / (sqrt(sum(s * s)) + 1e-12) AS sigma FROM vw)
SELECT vec_id, j::INTEGER AS pos, round(v / sigma, 6) + 0.0 AS v FROM emb, sigma""")
def spectral_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of all embeddings divided by its dominant singular value, one iteration from ones."""
    vectors = _embeddings(spark, sf_dir)
    return _tall(linalg.spectral_normalize(vectors, "embedding", A.vector_literal([1.0] * 64)), "embedding")


def _power_steps_sql(steps: int) -> str:
    parts = ["u0 AS (SELECT j, 1.0::DOUBLE AS u FROM emb GROUP BY j)"]
    for i in range(1, steps + 1):
        parts.append(f"""r{i} AS (SELECT vec_id, sum(v * u) AS r FROM emb JOIN u{i - 1} USING (j) GROUP BY vec_id),
w{i} AS (SELECT j, sum(r * v) / ((SELECT sqrt(sum(r * r)) FROM r{i}) + 1e-12) AS s FROM emb JOIN r{i} USING (vec_id) GROUP BY j),
u{i} AS (SELECT j, s / ((SELECT sqrt(sum(s * s)) FROM w{i}) + 1e-12) AS u FROM w{i})""")
    return ", ".join(parts)


@query(f"""WITH {EMB}, {_power_steps_sql(3)}
SELECT j::INTEGER AS pos, round(u, 6) + 0.0 AS u,
  (SELECT round(sum(s * u), 6) + 0.0 FROM w3 JOIN u3 USING (j)) AS sigma FROM u3""")
def spectral_norm_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u and sigma after three power iterations."""
    ones = F.array_repeat(F.lit(1.0), 64)
    made = linalg.dominant_singular_value(_embeddings(spark, sf_dir), "embedding", ones, num_iters=3)
    tall = made.select(rounded("sigma").alias("sigma"), F.posexplode("u").alias("pos", "u"))
    return tall.withColumn("u", rounded("u"))


@query(f"""WITH {EMB},
g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS g FROM emb a JOIN emb b USING (vec_id) GROUP BY a.j, b.j),
g2 AS (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j)
SELECT (SELECT count(DISTINCT j) FROM emb) AS n,
  round((SELECT sum(g) FROM g WHERE i = j), 4) + 0.0 AS squares,
  round((SELECT sum(g * g) FROM g), 2) + 0.0 AS fourth_powers,
  round((SELECT sum(a.g * b.g) FROM g a JOIN g2 b USING (i, j)), 0) + 0.0 AS sixth_powers""")
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All singular values of the matrix of embeddings, as sums of their powers: SQL has those as traces of the Gram matrix's."""
    made = spectrum.singular_values(_embeddings(spark, sf_dir), "embedding")
    power = lambda n, digits: rounded(F.sum(F.pow("value", F.lit(n))), digits)
    return made.agg(
        F.count("*").alias("n"), power(2, 4).alias("squares"), power(4, 2).alias("fourth_powers"), power(6, 0).alias("sixth_powers")
    )


# In 'update' mode call i goes on from u of call i - 1; 'frozen' and 'deferred' calls all start from the stored u, and the
# last deferred one is committed by the caller. (mode, call, version after it, power step of its sigma, stored u).
_STATE_CALLS = (
    [("update", i, i, i, i) for i in (1, 2, 3)]
    + [("frozen", i, 0, 1, 0) for i in (1, 2, 3)]
    + [("deferred", i, i // 3, 1, i // 3) for i in (1, 2, 3)]
)


@query(f"""WITH {EMB}, {_power_steps_sql(3)},
sigmas AS ({" UNION ALL ".join(f"SELECT {i} AS i, sum(s * u) AS sigma FROM w{i} JOIN u{i} USING (j)" for i in (1, 2, 3))}),
us AS ({" UNION ALL ".join(f"SELECT {i} AS i, j, u FROM u{i}" for i in range(4))}),
calls(mode, call, version, step, stored) AS (VALUES {", ".join(str(c) for c in _STATE_CALLS)})
SELECT mode, call::INTEGER AS call, version::INTEGER AS version, j::INTEGER AS pos, round(sigma, 6) + 0.0 AS sigma, round(u, 6) + 0.0 AS u
FROM calls JOIN sigmas ON sigmas.i = step JOIN us ON us.i = stored""")
def spectral_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls in each mode of the stored u: sigma, and the version and u that are stored after the call."""
    vectors = _embeddings(spark, sf_dir)
    rows = []
    for mode in ("update", "frozen", "deferred"):
        state = linalg.SpectralState(spark, scratch_path(spark, f"state-{mode}"), 64, start=[1.0] * 64)
        for call in (1, 2, 3):
            sigma, u = state.step(vectors, "embedding", mode=mode)
            if mode == "deferred" and call == 3:
                state.commit(u)
            rows.append((mode, call, state.version, sigma, state.current()))
    made = spark.createDataFrame(rows, "mode string, call int, version int, sigma double, u array<double>")
    tall = made.select("mode", "call", "version", rounded("sigma").alias("sigma"), F.posexplode("u").alias("pos", "u"))
    return tall.withColumn("u", rounded("u"))


@query(f"""WITH {EMB}, n AS (SELECT *, (CASE WHEN label < 5 THEN 'model/d_' ELSE 'model/g_' END) || label AS name FROM emb)
SELECT name, j::INTEGER AS pos, count(*) AS contributors, round(avg(v), 6) + 0.0 AS v FROM n GROUP BY name, j""")
def aligned_vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linalg.aligned_vector_mean(_named(spark, sf_dir), "name", "embedding")
    return made.select("name", "contributors", F.posexplode("mean").alias("pos", "v")).withColumn("v", rounded("v"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("label") < 5, "model/d_").otherwise("model/g_")
    return _embeddings(spark, sf_dir).withColumn("name", F.concat(side, F.col("label").cast("string")))


@query("""WITH n AS (SELECT vec_id, (CASE WHEN label < 5 THEN 'model/d_' ELSE 'model/g_' END) || label AS name FROM embeddings)
SELECT vec_id, name, 1::INTEGER AS matches, CASE WHEN name LIKE 'model/d_%' THEN 'd' ELSE 'g' END AS part,
  contains(name, '_7') AS tagged FROM n""")
def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _named(spark, sf_dir).select("vec_id", "name")
    return prefix_split(names, "name", {"d": "model/d_", "g": "model/g_"}, tag="_7")


@query("""SELECT label, count(*) AS rows, min(len(embedding))::INTEGER AS shortest, max(len(embedding))::INTEGER AS longest,
  0::BIGINT AS incomplete, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS ok FROM embeddings GROUP BY label""")
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_report(_embeddings(spark, sf_dir), "embedding", 64, keys=["label"])


@query()
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation job on all embeddings as 8 x 8 images; tests compare the job with NumPy."""
    weights = np.array([[((j * 7 + k * 3) % 11 - 5) / 10.0 for k in range(4)] for j in range(144)])

    def make_classifier():
        return lambda image: {"pool": np.tanh(image @ weights[:, :3]), "logits": image @ weights}

    def make_generator():
        return lambda z, class_id: {"image": np.tanh(z / 8.0 + class_id[:, None] / 100.0)}

    real = _embeddings(spark, sf_dir)
    made = jobs.evaluate(real, "vec_id", "embedding", (8, 8, 1), make_classifier, make_generator, 64, 10, classifier_size=12)
    return made.withColumn("value", rounded("value"))
