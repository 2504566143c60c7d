"""Places in an order over a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.network import Rounds


def numbered(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with the place, from 1, of each row in an order; rows that tie stand in any order.

    Rows are sorted by ranges and written once; then only the ranges' numbers of rows meet in one task.
    """
    placed = df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_o": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    written = Rounds(df).write(placed)
    sizes = written.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return written.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col("_b") + F.col("_o") + 1).drop("_p", "_q", "_o", "_b")
