"""Dense numbers in a total order, by ranges.

Rows are dealt to ranges of the order and sorted inside each, and so written; a row's number is its place in its file
plus the rows of all files before. No task holds more than a range, and what comes to the driver is a count for each file.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import stored


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of the columns, nulls first. Rows that the order doesn't tell apart are numbered in any order."""
    spark = df.sparkSession
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranges")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r["_file"], r["n"]) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(f, s) for (f, _), s in zip(sizes, starts, strict=False)], "_file int, _start bigint")
    return rows.join(F.broadcast(offsets), "_file").withColumn(name, F.col("_start") + F.col("_row")).select(*df.columns, name)
