"""Dense numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with a column `name` of whole numbers, gapless from `first` in the given order.

    Rows are dealt by ranges, and sorted and counted within each; only the counts, one for each range, are summed in
    one place. Rows that are equal in all of `order` are numbered in any order.
    """
    held = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long")
    return held.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, F.col("__place") + F.col("__before") + (first - 1)).drop("__part", "__place", "__before")
