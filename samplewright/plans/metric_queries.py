"""Queries on losses, moments, quality metrics and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import metriclog, moments, quality
from ..operators.raster import spatial_sum as channel_sums
from ..session import scratch_path, store
from ..streaming.moving import read_moving_moments, start_moving_moments
from ..streaming.snapshots import SnapshotMetrics, read_metrics
from .registry import EMB, query, rounded, table

LOSS_NAMES = ["d_loss_real", "d_loss_fake", "d_loss", "g_loss", "logit_real", "logit_fake"]


def _critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_linestatus", "l_quantity")
    return rows.withColumn("score", F.col("l_quantity") / 25.0 - 1.0).withColumn("real", F.col("l_linestatus") == "F")


def _loss_sql(real: str, fake: str) -> str:
    return f"""avg({real}) FILTER (real) AS d_loss_real, avg({fake}) FILTER (NOT real) AS d_loss_fake,
  avg({real}) FILTER (real) + avg({fake}) FILTER (NOT real) AS d_loss, -avg(x) FILTER (NOT real) AS g_loss,
  avg(x) FILTER (real) AS logit_real, avg(x) FILTER (NOT real) AS logit_fake"""


HINGE_SQL = _loss_sql("greatest(1 - x, 0.0)", "greatest(1 + x, 0.0)")
KL_SQL = _loss_sql("ln(1 + exp(-x))", "ln(1 + exp(x))")
CRITIC_SQL = "critic AS (SELECT l_linenumber, l_quantity / 25.0 - 1.0 AS x, l_linestatus = 'F' AS real FROM lineitem)"
ROUNDED_SQL = ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in LOSS_NAMES)


def _rounded_losses(made: DataFrame) -> DataFrame:
    return made.select(*[rounded(name).alias(name) for name in LOSS_NAMES])


@query(f"WITH {CRITIC_SQL}, l AS (SELECT {HINGE_SQL} FROM critic) SELECT {ROUNDED_SQL} FROM l")
def hinge_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_losses(L.losses(_critic(spark, sf_dir), "score", F.col("real")))


@query(f"WITH {CRITIC_SQL}, l AS (SELECT {KL_SQL} FROM critic) SELECT {ROUNDED_SQL} FROM l")
def kl_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_losses(L.losses(_critic(spark, sf_dir), "score", F.col("real"), "kl_loss"))


@query(f"""WITH {CRITIC_SQL}, l AS (SELECT l_linenumber AS step, {HINGE_SQL} FROM critic GROUP BY l_linenumber)
SELECT step, name, round(value, 6) + 0.0 AS value FROM (UNPIVOT l ON {", ".join(LOSS_NAMES)} INTO NAME name VALUE value)""")
def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All losses per step (line number) as a tall metric table."""
    steps = _critic(spark, sf_dir).withColumnRenamed("l_linenumber", "step")
    wide = L.losses(steps, "score", F.col("real"), keys=["step"])
    return metriclog.metric_rows(wide, "step", LOSS_NAMES).withColumn("value", rounded("value"))


@query("""SELECT event_id AS step, event_type AS name, round(value, 6) + 0.0 AS value
FROM events WHERE event_id % 200 = 0 AND event_id < 2000000""")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a log of every 200th step keeps."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("name"), rounded("value").alias("value")
    )
    return metriclog.log_every(rows, "step", stop_at=2_000_000)


# --- moments -------------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ids stand for generated vectors, even ids for real ones."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.withColumn("is_generated", F.col("vec_id") % 2 == 1).withColumn(
        "halves", channel_sums(F.col("embedding"), 2)
    )


@query(f"""WITH {EMB} SELECT j::INTEGER AS channel, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS variance
FROM emb GROUP BY j""")
def channel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = moments.channel_moments(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return made.select("channel", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query(f"""WITH {EMB}, p AS (
  SELECT vec_id % 2 = 1 AS is_generated, j, avg(v) AS m, var_pop(v) AS s FROM emb GROUP BY ALL)
SELECT is_generated, round(avg(m), 6) + 0.0 AS mean, round(avg(s), 6) + 0.0 AS mean_variance FROM p GROUP BY is_generated""")
def batch_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = moments.batch_moments(_sides(spark, sf_dir), "embedding", ["is_generated"])
    return made.select("is_generated", rounded("mean").alias("mean"), rounded("mean_variance").alias("mean_variance"))


@query(f"""WITH {EMB}
SELECT a.vec_id % 2 = 1 AS is_generated, a.j::INTEGER AS i, b.j::INTEGER AS j, round(covar_samp(a.v, b.v), 8) + 0.0 AS cov
FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY ALL""")
def mean_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full covariance of both sides."""
    made = moments.vector_moments(_sides(spark, sf_dir), "embedding", ["is_generated"])
    return moments.covariances(made, ["is_generated"]).withColumn("cov", rounded("cov", 8))


_MOVING_SQL = """WITH days AS (
  SELECT event_type, ts::DATE AS day, avg(value) AS m, var_pop(value) AS s FROM events GROUP BY ALL),
t AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t, count(*) OVER (PARTITION BY event_type) AS n FROM days)
SELECT event_type, round(sum(m * 0.001 * power(0.999::DOUBLE, n - t)), 6) + 0.0 AS moving_mean,
  round(power(0.999::DOUBLE, max(n)) + sum(s * 0.001 * power(0.999::DOUBLE, n - t)), 6) + 0.0 AS moving_variance,
  max(n) AS batches
FROM t GROUP BY event_type"""


@query(_MOVING_SQL)
def moving_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean and variance per event type, folded in day order."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance")
    )
    made = moments.moving_moments(days, "day", ["event_type"])
    return made.select(
        "event_type", rounded("moving_mean").alias("moving_mean"), rounded("moving_variance").alias("moving_variance"), "batches"
    )


@query(_MOVING_SQL)
def moving_moments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the events that runs until it has read them all."""
    events = table(spark, sf_dir, "events")
    # The pattern makes a file source of a single file, too.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    daily = stream.select("event_type", F.unix_date(F.to_date("ts")).alias("day"), "value")
    state, checkpoint = scratch_path(spark, "moving"), scratch_path(spark, "moving-checkpoint")
    start_moving_moments(daily, ["event_type"], "day", "value", state, checkpoint).awaitTermination()
    made = read_moving_moments(spark, state, ["event_type"], "day")
    return made.select(
        "event_type", rounded("moving_mean").alias("moving_mean"), rounded("moving_variance").alias("moving_variance"), "batches"
    )


# --- quality -------------------------------------------------------------------------------------


def _frechet_sql(key: str) -> str:
    """Closed form in two dimensions: the sums over even and over odd positions."""
    return f"""halves AS (
  SELECT {key} AS key, vec_id, vec_id % 2 = 1 AS fake, sum(v) FILTER (j % 2 = 0) AS a, sum(v) FILTER (j % 2 = 1) AS b
  FROM emb GROUP BY ALL),
m AS (
  SELECT key, fake, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab
  FROM halves GROUP BY key, fake),
frechet AS (
  SELECT r.key, r.n AS n_real, g.n AS n_generated,
    (r.ma - g.ma) ** 2 + (r.mb - g.mb) ** 2 + r.aa + r.bb + g.aa + g.bb - 2 * sqrt(
      r.aa * g.aa + 2 * r.ab * g.ab + r.bb * g.bb
      + 2 * sqrt((r.aa * r.bb - r.ab * r.ab) * (g.aa * g.bb - g.ab * g.ab))) AS distance
  FROM m r JOIN m g ON r.key = g.key AND NOT r.fake AND g.fake)"""


_FRECHET_BY_LABEL = f"""WITH {EMB}, {_frechet_sql("label")}
SELECT key AS label, n_real, n_generated, round(distance, 6) + 0.0 AS frechet_distance FROM frechet"""


@query(_FRECHET_BY_LABEL)
def frechet_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _sides(spark, sf_dir).withColumns({"a": F.get("halves", F.lit(0)), "b": F.get("halves", F.lit(1))})
    made = quality.frechet_distance_2d(flat, "a", "b", "is_generated", ["label"])
    return made.withColumn("frechet_distance", rounded("frechet_distance"))


@query(_FRECHET_BY_LABEL)
def frechet_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general algorithm on the same two-dimensional data."""
    made = quality.frechet_distance(_sides(spark, sf_dir), "halves", "is_generated", ["label"])
    return made.withColumn("frechet_distance", rounded("frechet_distance"))


@query()
def frechet_distance_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On all 64 dimensions; SQL has no matrix root, so tests compare the operator with NumPy."""
    made = quality.frechet_distance(_sides(spark, sf_dir), "embedding", "is_generated")
    return made.withColumn("frechet_distance", rounded("frechet_distance"))


def _score_sql(key: str, where: str = "") -> str:
    return f"""p AS (
  SELECT {key} AS key, vec_id, j, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY vec_id) AS p
  FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS mx FROM emb {where})),
mean_p AS (SELECT key, j, avg(p) AS m FROM p GROUP BY key, j),
kl AS (SELECT key, vec_id, sum(p * (ln(p) - ln(m))) AS kl FROM p JOIN mean_p USING (key, j) GROUP BY key, vec_id),
scores AS (SELECT key, count(*) AS n, exp(avg(kl)) AS score FROM kl GROUP BY key)"""


@query(f"""WITH {EMB}, {_score_sql("label")}
SELECT key AS label, n, round(score, 6) + 0.0 AS classifier_score FROM scores""")
def classifier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.classifier_score(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return made.withColumn("classifier_score", rounded("classifier_score"))


# Neighbouring keys that are one number as doubles, beside a null key.
_BIG_KEY = "CASE WHEN label % 3 <> 2 THEN 9007199254740992 + label END"


def _with_big_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.when(F.col("label") % 3 != 2, F.lit(9007199254740992) + F.col("label")))


@query(f"""WITH {EMB}, {_frechet_sql(_BIG_KEY).replace("r.key = g.key", "r.key IS NOT DISTINCT FROM g.key")}
SELECT key, n_real, n_generated, round(distance, 6) + 0.0 AS frechet_distance FROM frechet""")
def frechet_distance_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.frechet_distance(_with_big_keys(_sides(spark, sf_dir)), "halves", "is_generated", ["key"])
    return made.withColumn("frechet_distance", rounded("frechet_distance"))


@query(f"""WITH {EMB}, {_score_sql(_BIG_KEY).replace("USING (key, j)", "ON p.j = mean_p.j AND p.key IS NOT DISTINCT FROM mean_p.key").replace("SELECT key, vec_id, sum(p * (ln(p)", "SELECT p.key, vec_id, sum(p * (ln(p)").replace("GROUP BY key, vec_id)", "GROUP BY p.key, vec_id)")}
SELECT key, n, round(score, 6) + 0.0 AS classifier_score FROM scores""")
def classifier_score_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_big_keys(table(spark, sf_dir, "embeddings"))
    made = quality.classifier_score(rows, "embedding", ["key"])
    return made.withColumn("classifier_score", rounded("classifier_score"))


@query(f"""WITH {EMB}, {_score_sql("vec_id % 3", "WHERE vec_id % 2 = 1")}, {_frechet_sql("vec_id % 3")}
SELECT f.key AS snapshot_id, n_real, n_generated, round(distance, 6) + 0.0 AS frechet_distance,
  round(score, 6) + 0.0 AS classifier_score
FROM frechet f JOIN scores USING (key)""")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metrics per snapshot (id modulo 3): the batch form of the snapshot stream."""
    rows = _sides(spark, sf_dir).withColumn("snapshot_id", F.col("vec_id") % 3)
    distance = quality.frechet_distance(rows, "halves", "is_generated", ["snapshot_id"])
    # The score is defined on generated rows only.
    score = quality.classifier_score(rows.filter("is_generated"), "embedding", ["snapshot_id"]).drop("n")
    return distance.join(score, "snapshot_id").select(
        "snapshot_id", "n_real", "n_generated",
        rounded("frechet_distance").alias("frechet_distance"), rounded("classifier_score").alias("classifier_score"),
    )


@query(f"""WITH {EMB}, {_score_sql("vec_id % 5", "WHERE vec_id % 2 = 1")}, {_frechet_sql("vec_id % 5")}
SELECT f.key AS snapshot_id, n_real, n_generated, round(distance, 6) + 0.0 AS frechet_distance,
  round(score, 6) + 0.0 AS classifier_score
FROM frechet f JOIN scores USING (key) ORDER BY f.key LIMIT 4""")
def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of scored samples that would run for ever, evaluated snapshot by snapshot (id modulo 5) and stopped after four.

    Each snapshot arrives in two files. The evaluation stops after two snapshots and is started again.
    """
    rows = _sides(spark, sf_dir).select(
        (F.col("vec_id") % 5).alias("snapshot_id"), "is_generated", "halves", "embedding",
        (F.col("vec_id") % 5 + F.floor(F.col("vec_id") / 5) % 2).alias("_file"),
    )
    rows = store(rows, "samples")
    source, out, checkpoint = (scratch_path(spark, f"snapshots-{name}") for name in ("in", "out", "checkpoint"))
    for file in range(6):
        rows.filter(F.col("_file") == file).drop("_file").coalesce(1).write.mode("append").parquet(source)
    expected = rows.groupBy("snapshot_id", "is_generated").agg(F.count("*").alias("expected"))
    for stop_after in (2, 4):
        samples = spark.readStream.schema(rows.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(source)
        live = SnapshotMetrics(samples, "snapshot_id", "halves", "embedding", expected, out, stop_after)
        live.run(checkpoint, {"processingTime": "100 milliseconds"})
    return read_metrics(spark, out).select(
        "snapshot_id", "n_real", "n_generated",
        rounded("frechet_distance").alias("frechet_distance"), rounded("classifier_score").alias("classifier_score"),
    )
