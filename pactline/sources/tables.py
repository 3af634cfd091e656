"""Sources and sinks: Parquet tables, JSON lines, and files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped and a broken line ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int = 32 << 20) -> DataFrame:
    """(path, length, content, accepted): binary files with the checks an upload has to pass."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    magic = F.substring("content", 1, 4).cast("string") == "%PDF"
    return files.select("path", "length", "content", (magic & (F.col("length") <= most_bytes)).alias("accepted"))
