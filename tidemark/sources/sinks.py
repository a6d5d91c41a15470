"""Writing results and reading them back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by=(), sort_by=()) -> None:
    """Parquet; ``sort_by`` orders rows within files so that readers can skip row groups."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add finished combinations to the metrics table, one folder per combination."""
    metrics.write.mode("append").partitionBy("combo_id").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics written so far; the combination id comes from the folder name."""
    return spark.read.parquet(path)


def finished_combinations(spark: SparkSession, path: str) -> DataFrame:
    """combo_id of every output that exists; the scan reads no column of the files."""
    return spark.read.parquet(path).select(F.col("combo_id").cast("string").alias("combo_id")).distinct()
