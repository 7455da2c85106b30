"""Small state tables written once per micro-batch.

Version n holds the state after micro-batch n. A micro-batch that runs again after a failure reads
version n-1 and overwrites version n, so its input counts once. Older versions are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def read(self, version: int) -> DataFrame:
        """State after micro-batch ``version``; empty before the first one."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._at(version))

    def write(self, state: DataFrame, version: int) -> DataFrame:
        state.write.mode("overwrite").parquet(self._at(version))
        if version >= 2:
            self._remove(self._at(version - 2))
        return self.read(version)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
