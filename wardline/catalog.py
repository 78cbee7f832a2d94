"""Parquet tables by name."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a dimension table whose size is checked before it reaches the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows and can't be held as a dimension table")
    return rows
