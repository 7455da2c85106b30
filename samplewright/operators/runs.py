"""A table that separate runs add their rows to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..commits import CommitConflict, CommitLog


class RunTable:
    """Rows by run id. A run that is appended again replaces its own part; readers see whole runs only.

    A run's rows are written to a folder of their own, and a commit then names the folder of every run. A reader that
    has read a commit sees the same rows until old folders are removed; a run that fails on the way leaves a folder
    that no commit names.
    """

    def __init__(self, spark: SparkSession, path: str, run: str = "run"):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _state(self) -> tuple[int, dict]:
        number = self.log.newest()
        return number, (self.log.read(number) if number >= 0 else {"schema": None, "runs": {}})

    def append(self, run_id: str, rows: DataFrame) -> int:
        """Adds a run, or puts its rows in place of those it had; returns the number of the commit.

        Columns are matched by name with those of earlier runs, which must be the same. The id is added as a
        column of its own on reading, so rows may not have one of that name.
        """
        if self.run in rows.columns:
            raise ValueError(f"rows have a column {self.run} of their own")
        _, state = self._state()
        known = T.StructType.fromJson(state["schema"]) if state["schema"] else None
        if known is not None:
            kinds = {f.name: f.dataType for f in rows.schema}
            if kinds != {f.name: f.dataType for f in known}:
                raise ValueError(f"columns {sorted(kinds)} differ in name or type from those of earlier runs, {sorted(known.names)}")
            rows = rows.select(*known.names)
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        while True:  # a run replaces nothing but its own part, so it may follow any commit
            number, state = self._state()
            schema = state["schema"] or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).jsonValue()
            if state["schema"] and {f["name"] for f in schema["fields"]} != set(rows.columns):
                raise ValueError("another first run has other columns")
            try:
                self.log.commit(number + 1, {"schema": schema, "runs": state["runs"] | {run_id: folder}})
                return number + 1
            except CommitConflict:
                continue

    def runs(self, number: int | None = None) -> list[str]:
        return sorted(self._state()[1]["runs"] if number is None else self.log.read(number)["runs"])

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of all runs, with the run's id, as of the newest commit or an earlier one."""
        state = self._state()[1] if number is None else self.log.read(number)
        if not state["runs"]:
            raise ValueError(f"no run has been appended to {self.path}")
        schema = T.StructType.fromJson(state["schema"])
        names = {folder: run for run, folder in state["runs"].items()}
        # One scan over all folders: a row's folder, next to its file, tells its run.
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in sorted(names)])
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        of = self.spark.createDataFrame(sorted(names.items()), f"_folder string, `{self.run}` string")
        return found.withColumn("_folder", folder).join(F.broadcast(of), "_folder").drop("_folder")  # a row for each run

    def vacuum(self) -> int:
        """Removes folders that the newest commit doesn't name; not to be called while runs are being written."""
        kept = set(self._state()[1]["runs"].values())
        gone = [f for f in self.log.folders(f"{self.path}/data") if f not in kept]
        for folder in gone:
            self.log.delete_folder(f"{self.path}/data/{folder}")
        return len(gone)
