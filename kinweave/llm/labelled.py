"""Labelled rows for the classifiers: the fold, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each label from which a classifier is learned, at most: some 12 MB of text on the driver.
SAMPLE = {1: 1500, 0: 1500}
FOLDS = 5


def held_out(key: str) -> Column:
    """Whether a row belongs to the fold from which nothing is learned."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0


def sample(docs: DataFrame, labels: DataFrame, target: str, key: str = "doc_id", text: str = "text", bound: dict[int, int] | None = None) -> list[tuple[str, int]]:
    """(text, label) of at most ``bound`` rows of each label outside the held-out fold, by the order of a hash of the key. Which rows exist is seen first, over keys alone; the chosen keys, whose number is bounded, are then sent to all tasks. Of a key with several texts or labels the least is taken."""
    bound = bound or SAMPLE
    known = labels.where(F.col(target).isin(*bound) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(target).cast("int").alias("_y"))
    known = known.join(docs.select(key), key, "left_semi")
    chosen = None
    for label, most in bound.items():
        some = known.where(F.col("_y") == label).orderBy(F.xxhash64(key), key).limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = chosen.collect()  # at most the sum of the bounds
    if not ids:
        return []
    spark = docs.sparkSession
    few = spark.createDataFrame([(r[0], r[1]) for r in ids], chosen.schema)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_x")).join(F.broadcast(few), key).groupBy(key).agg(F.min("_x").alias("_x"), F.min("_y").alias("_y")).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: str(r[0]))]
