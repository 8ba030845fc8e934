"""Record tables and candidate pairs: reduction, first rows of repeated keys, enrichment, pair text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import pair_line, record_text, strip


def reduce_source(source: DataFrame, pairs: DataFrame, source_id: str = "id", pair_id: str = "ltable_id") -> DataFrame:
    """Rows whose id a pair names. A semi join: no distinct is needed, and only the ids of the pairs are read."""
    ids = pairs.select(F.col(pair_id).alias("_id"))
    return source.join(ids, source[source_id] == F.col("_id"), "left_semi")


def first_by_key(df: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with one key, the first in a total order. Pre-aggregates before it moves rows."""
    keys = [key] if isinstance(key, str) else key
    rank = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def numbered_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Repeated keys made distinct: the first row keeps its key, the k-th gets key#k."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat_ws("#", key, "_n"))).drop("_n")


def unmatched(pairs: DataFrame, a: DataFrame, b: DataFrame, left: str = "ltable_id", right: str = "rtable_id", key: str = "id") -> DataFrame:
    """(side, id) of ids that pairs name and tables lack."""
    l_ids = pairs.select(F.col(left).alias("id")).join(a.select(F.col(key).alias("id")), "id", "left_anti").select(F.lit("left").alias("side"), "id")
    r_ids = pairs.select(F.col(right).alias("id")).join(b.select(F.col(key).alias("id")), "id", "left_anti").select(F.lit("right").alias("side"), "id")
    return l_ids.unionByName(r_ids).distinct()


def enrich(pairs: DataFrame, a: DataFrame, b: DataFrame, left: str = "ltable_id", right: str = "rtable_id", key: str = "id", missing: str = "error") -> DataFrame:
    """Pairs with both records' attributes (l_*, r_*). A pair whose record is missing is an error, or, on request, left out (``drop``)."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns], F.lit(True).alias(f"_{prefix}there"))

    how = "inner" if missing == "drop" else "left"
    out = pairs.join(side(a, "l_"), F.col(left) == F.col(f"l_{key}"), how).join(side(b, "r_"), F.col(right) == F.col(f"r_{key}"), how)
    if missing != "drop":
        gone = F.col("_l_there").isNull() | F.col("_r_there").isNull()
        told = F.concat(F.lit("a pair names a record that is missing: "), F.coalesce(F.col(left), F.lit("null")), F.lit(", "), F.coalesce(F.col(right), F.lit("null")))
        out = out.withColumn(left, F.when(gone, F.raise_error(told).cast("string")).otherwise(F.col(left)))
    return out.drop("_l_there", "_r_there")


def pair_text(enriched: DataFrame, columns: list[str], label: Column | None = None, style: str = "training", clean: bool = True, with_id: bool = False, key: str = "id") -> DataFrame:
    """Adds ``line``: left TAB right TAB label."""
    names = ([key] if with_id else []) + [c for c in columns if c != key]
    lab = F.col("label") if label is None else label
    return enriched.withColumn("line", pair_line(record_text(names, "l_", style, clean), record_text(names, "r_", style, clean), lab))


def text_from_labels(labels: DataFrame, a: DataFrame, b: DataFrame, left: str = "ltable_id", right: str = "rtable_id", label: str = "label", key: str = "id", missing: str = "error") -> DataFrame:
    """(left, right, line) straight from a table of labels and the two record tables: ids are stripped, each side has all columns of its own table in their order, the key among them, values cleaned. The labels stay as they are; nulls are empty values, a null label makes no third field, repeated pairs repeated lines; a pair whose record is missing is an error or is dropped. Other columns of the labels aren't looked at."""
    ids = labels.select(strip(F.col(left)).alias(left), strip(F.col(right)).alias(right), F.col(label).alias("_label"))
    rows = enrich(ids, a, b, left, right, key, missing)
    sides = [record_text(df.columns, prefix) for df, prefix in ((a, "l_"), (b, "r_"))]
    return rows.select(left, right, pair_line(*sides, F.col("_label")).alias("line"))


def attributes_equal(columns: list[str]) -> Column:
    """All shared attributes equal, nulls being equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return out
