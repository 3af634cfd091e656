"""Values that an expression uses more than once, computed once.

Spark finds common parts of expressions only outside of lambdas and of branches; within them a
value that is named twice is computed twice, and values of values many times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    The value is what a fold starts from and ``use`` its end. An element taken out of an array made
    for it would do as well, but taking one asks for its type, which goes through all of ``use`` for each row.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda own, _: own, use)


def filled(text: Column) -> Column:
    """A text that is not empty, else null."""
    return let(text, lambda s: F.when(s != "", s))


#: rows of a task at least, where there are enough tasks for all cores
TASK_ROWS = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key to all cores before much is computed of each: a small file is a single split.

    A task of a wide expression costs some tenths of a second before its first row, so few rows make no more tasks than cores need.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, min(most, df.count() // TASK_ROWS)), key)
