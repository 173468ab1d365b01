"""Numbers in order of arrival, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A column ``name`` that numbers the rows 0, 1, .. in the order of ``order``.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the sizes of the partitions before (one row per partition).
    """
    place = F.monotonically_increasing_id()
    made = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ids")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    size = made.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return made.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn(name, (F.col("_offset") + row).cast("long")).drop("_part", "_place", "_offset")
