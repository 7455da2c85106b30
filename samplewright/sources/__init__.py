"""Reading and writing record files."""

from pyspark.sql import SparkSession

from .tfrecord import TFRecordSource


def register(spark: SparkSession) -> None:
    """Makes ``format("tfrecord")`` known to the session."""
    spark.dataSource.register(TFRecordSource)
