"""Pair predictions from clusters, and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(pairs: DataFrame, clusters: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """Pairs with pred: 1 where both ids lie in one cluster (or are equal). An id in no cluster is one by itself."""
    a = clusters.select(F.col("id").alias(left), F.col("cluster_id").alias("_lc"))
    b = clusters.select(F.col("id").alias(right), F.col("cluster_id").alias("_rc"))
    out = pairs.join(a, left, "left").join(b, right, "left")
    return out.withColumn("pred", (F.coalesce("_lc", left) == F.coalesce("_rc", right)).cast("int")).drop("_lc", "_rc")


def measures(rows: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """n, accuracy, precision, recall and f1 in one aggregation; 0 where a denominator is 0. Rounded to 6 places. ``by``: for each group of these columns."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    s = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("double")
    by = by or []
    t = rows.groupBy(*by).agg(F.count("*").alias("n"), s(y & p).alias("tp"), s(~y & p).alias("fp"), s(y & ~p).alias("fn"), s(~y & ~p).alias("tn"))
    r = lambda up, down: F.round(F.coalesce(F.try_divide(up, down), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(*by, "n", r(tp + tn, tp + fp + fn + tn).alias("accuracy"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))
