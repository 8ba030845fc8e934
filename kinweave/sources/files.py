"""CSV tables and pairs, pair-text files, and the normalised export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.text import strip
from kinweave.operators.components import stored
from kinweave.operators.context import context_to_primary, explode_context, hyperedges, resolved

_CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; only its first lines are read."""
    return spark.read.options(**_CSV, inferSchema="false").csv(path).columns


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty cells are empty, not null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header(spark, path)])
    return spark.read.options(**_CSV).schema(schema).csv(path).na.fill("")


def read_pairs(spark: SparkSession, path: str, left: str = "ltable_id", right: str = "rtable_id", label: str = "label") -> DataFrame:
    """Labelled pairs: ids as text without white space at their ends, the label as a number, further columns as text."""
    rows = read_records(spark, path)
    return rows.withColumn(left, strip(F.col(left))).withColumn(right, strip(F.col(right))).withColumn(label, F.col(label).cast("int"))


def read_pair_ids(spark: SparkSession, path: str, column: str = "ltable_id") -> DataFrame:
    """The ids of one pair column alone."""
    return read_records(spark, path).select(column)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types as they look; a second pass over the file."""
    return spark.read.options(**_CSV).option("inferSchema", "true").csv(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header="true", escape='"').csv(path)


def write_pair_text(lines: DataFrame, path: str, column: str = "line", mode: str = "errorifexists") -> None:
    """One line a pair, each ended by a line end."""
    lines.select(column).write.mode(mode).text(path)


def read_pair_text(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, label) of pair-text lines."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("left"), parts[1].alias("right"), parts[2].cast("int").alias("label"))


def normalised(table: DataFrame, field: str = "authors", separator: str = ",", key: str = "id", exact: bool = False) -> dict[str, DataFrame]:
    """The four tables of a record table with a list field: records without it, context entities with a name, records' entities, entities' records."""
    found = resolved(stored(explode_context(table, field, separator, key), "exploded"), key, exact)
    edges = hyperedges(found, key)
    return {
        "records": table.drop(field),
        "contexts": found.groupBy("ctx").agg(F.min("name").alias("name")),
        "record_to_contexts": edges.groupBy(key).agg(F.sort_array(F.collect_set("ctx")).alias("ctxs")),
        "context_to_records": context_to_primary(edges, key),
    }


def write_normalised(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
