"""Quality metrics of each snapshot as its scored samples arrive."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.moments import tile_schema, merge_moments, vector_moments
from ..operators.quality import add_parts, frechet_from_moments, score_from_parts, score_parts
from .state import VersionedTable

SIDE = "is_generated"


class EvaluationsDone(RuntimeError):
    """Ends a stream, with its input left as it is, once the snapshots that were asked for are reported."""


class SnapshotMetrics:
    """Frechet distance and classifier score of a snapshot, once, when all of its samples are in.

    Input columns: a snapshot column, BOOLEAN ``is_generated``, a feature vector and logits (read for
    generated rows only). Each micro-batch adds its moments and score sums, not its vectors, to the
    state of its snapshots. A snapshot is complete at ``expected`` real and ``expected`` generated
    rows; it is then reported at ``<path>/metrics`` and its state dropped. More rows are an error.

    ``expected`` is a number, or a table (snapshot, is_generated, expected) of numbers; snapshots that the table lacks
    never are complete. With ``stop_after`` the evaluation ends once that many snapshots have been
    reported: of snapshots that are complete at the same time the smaller ones come first, and what arrives
    later is not read. :meth:`run` then stops the stream; with a larger number it can go on from there.
    """

    def __init__(
        self,
        samples: DataFrame,
        snapshot: str,
        features: str,
        logits: str,
        expected: int | DataFrame,
        path: str,
        stop_after: int | None = None,
    ):
        if stop_after is not None and stop_after < 1:
            raise ValueError("stop_after must be at least 1")
        self.samples, self.snapshot, self.features, self.logits = samples, snapshot, features, logits
        self.expected, self.path, self.stop_after = expected, path.rstrip("/"), stop_after
        spark = samples.sparkSession
        key = samples.schema[snapshot]
        # Number of snapshots reported so far, as far as this driver knows.
        self.reported = 0
        moment_schema = tile_schema(samples, [snapshot, SIDE])
        part_schema = T.StructType([
            key, T.StructField("class_id", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("p", T.DoubleType()), T.StructField("p_log_p", T.DoubleType()),
        ])
        self.moments = VersionedTable(spark, f"{self.path}/moments", moment_schema)
        self.parts = VersionedTable(spark, f"{self.path}/parts", part_schema)
        self.finished = VersionedTable(spark, f"{self.path}/finished", T.StructType([key]))

    def start(self, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = self.samples.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def run(self, checkpoint: str, trigger: dict | None = None, poll: float = 0.2) -> int:
        """Starts the stream and waits until it ends, or until ``stop_after`` snapshots are reported, and stops it then.

        Returns the number of snapshots reported. Run again with the same checkpoint and path it goes on where it
        stopped, also if it was stopped in the middle of a micro-batch.
        """
        query = self.start(checkpoint, trigger)
        try:
            while not query.awaitTermination(poll):
                if self._enough():
                    break
        except StreamingQueryException:
            if not self._enough():
                raise
        if query.isActive:
            query.stop()
        return self.reported

    def _enough(self) -> bool:
        return self.stop_after is not None and self.reported >= self.stop_after

    def _targets(self, counts: DataFrame) -> DataFrame:
        """counts (snapshot, side, n) with the number that is expected."""
        if isinstance(self.expected, int):
            return counts.withColumn("_expected", F.lit(self.expected).cast("bigint"))
        wanted = self.expected.select(self.snapshot, SIDE, F.col("expected").cast("bigint").alias("_expected"))
        return counts.join(wanted, [self.snapshot, SIDE], "left")

    def _named(self) -> str:
        return str(self.expected) if isinstance(self.expected, int) else "the expected"

    def add(self, batch: DataFrame, version: int) -> None:
        """One micro-batch; running it again for the same version changes nothing."""
        # Nothing is read or written here: the query may be stopping.
        if self._enough():
            raise EvaluationsDone(f"{self.reported} snapshots have been evaluated")
        key = self.snapshot
        # Finished snapshots are one row each; their state and metrics are not carried on.
        done = self.finished.read(version - 1)
        room = None
        if self.stop_after is not None:
            self.reported = done.count()
            room = self.stop_after - self.reported
            if room <= 0:
                raise EvaluationsDone(f"{self.reported} snapshots have been evaluated")
        batch = batch.persist()
        late = batch.join(done, key, "left_semi").limit(1).collect()
        if late:
            raise ValueError(f"more than {self._named()} samples for snapshot {late[0][key]!r}")
        open_moments = self.moments.read(version - 1).join(done, key, "left_anti")
        open_parts = self.parts.read(version - 1).join(done, key, "left_anti")
        fresh = vector_moments(batch, self.features, [key, SIDE])
        moments = self.moments.write(merge_moments(open_moments.unionByName(fresh), [key, SIDE]), version)
        new_parts = score_parts(batch.filter(F.col(SIDE)), self.logits, [key])
        parts = self.parts.write(add_parts(open_parts.unionByName(new_parts), [key]), version)

        counts = self._targets(moments.filter((F.col("ti") == 0) & (F.col("tj") == 0)).select(key, SIDE, "n")).groupBy(key).agg(
            F.count_if(F.col("n") == F.col("_expected")).alias("_full"), F.count_if(F.col("n") > F.col("_expected")).alias("_over")
        )
        over = counts.filter("_over > 0").limit(1).collect()
        if over:
            raise ValueError(f"more than {self._named()} samples for snapshot {over[0][key]!r}")
        ready = counts.filter(F.col("_full") == 2).select(key)
        if room is not None:
            ready = ready.orderBy(key).limit(room)
        distance = frechet_from_moments(moments.join(ready, key, "left_semi"), SIDE, [key])
        score = score_from_parts(parts.join(ready, key, "left_semi"), [key])
        distance.join(score.drop("n"), key).write.mode("overwrite").parquet(f"{self.path}/metrics/batch={version}")
        finished = self.finished.write(done.unionByName(ready), version)
        reported = finished.count() if self.stop_after is not None else 0
        batch.unpersist()
        # Last of all, since run() stops the query as soon as it sees the number.
        self.reported = reported


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/metrics")
