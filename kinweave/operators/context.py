"""Context mentions, blocks, entities and hyperedges.

Two mentions of a block match where their canonical names are equal; the canonical name fixes the block and equality
is transitive, so that entities are groups of canonical names and no pair is ever compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import name_features
from kinweave.functions.text import list_items
from kinweave.operators.components import stored
from kinweave.operators.numbering import numbered

#: Parts in which the ids of one context are gathered and sorted before they meet in its row.
ID_PARTS = 32


def explode_context(df: DataFrame, field: str, separator: str = ",", key: str = "id") -> DataFrame:
    """(key, pos, name): a row for each item of a list field, positions from 1."""
    return df.select(key, F.posexplode(list_items(F.col(field), separator)).alias("pos", "name")).select(key, (F.col("pos") + 1).alias("pos"), "name")


def _mention_ids(exploded: DataFrame, key: str) -> DataFrame:
    return exploded.select(F.concat_ws("#", key, F.lpad(F.col("pos").cast("string"), 6, "0")).alias("mention_id"), key, "pos", "name")


def mentions(exploded: DataFrame, key: str = "id", exact: bool = False) -> DataFrame:
    """(mention_id, key, pos, name, features). Ids follow from key and position."""
    return _mention_ids(exploded, key).select("mention_id", key, "pos", "name", name_features(F.col("name"), exact).alias("f"))


def blocks(found: DataFrame) -> DataFrame:
    """(last, initial, n_mentions, n_names) of mentions with a last name."""
    usable = found.where(F.length("f.last_name") >= 2)
    return usable.groupBy(F.col("f.last_name").alias("last"), F.col("f.first_initial").alias("initial")).agg(F.count("*").alias("n_mentions"), F.countDistinct("f.canon_full").alias("n_names"))


def entities(found: DataFrame) -> DataFrame:
    """(mention_id, key..., ctx): a mention's entity is the least mention of its canonical name; without a last name, itself."""
    usable = F.length("f.last_name") >= 2
    least = found.where(usable).groupBy(F.col("f.canon_full").alias("canon")).agg(F.min("mention_id").alias("_least"))
    joined = found.withColumn("canon", F.when(usable, F.col("f.canon_full"))).join(least, "canon", "left")
    return joined.withColumn("ctx", F.coalesce("_least", "mention_id")).drop("_least", "canon")


def resolved(exploded: DataFrame, key: str = "id", exact: bool = False) -> DataFrame:
    """(mention_id, key, pos, name, ctx): the entities of ``mentions`` without its features, which are worked out once for each name. Where names are few, no mention moves."""
    found = _mention_ids(exploded, key)
    names = found.where("name IS NOT NULL").groupBy("name").agg(F.min("mention_id").alias("_first"))
    names = stored(names, "names").select("name", "_first", name_features(F.col("name"), exact).alias("f")).select("name", "_first", "f.last_name", "f.canon_full")
    names = stored(names.where(F.length("last_name") >= 2).select("name", "_first", F.col("canon_full").alias("canon")), "canonical")
    least = names.groupBy("canon").agg(F.min("_first").alias("_least"))
    placed = stored(names.join(least, "canon").select("name", "_least"), "entities")
    return found.join(placed, "name", "left").select("mention_id", key, "pos", "name", F.coalesce("_least", "mention_id").alias("ctx"))


def match_pairs(names: DataFrame, column: str = "canon_full") -> DataFrame:
    """(left_name, right_name) of distinct names that lie in one block and match: raw names of equal canonical form, the lesser first."""
    n = names.select("raw", F.col(column).alias("c"), "last_name").where(F.length("last_name") >= 2).distinct()
    a, b = n.select(F.col("raw").alias("left_name"), "c"), n.select(F.col("raw").alias("right_name"), "c")
    return a.join(b, "c").where("left_name < right_name").select("left_name", "right_name").distinct()


def hyperedges(placed: DataFrame, key: str = "id") -> DataFrame:
    """Distinct (key, ctx)."""
    return placed.select(key, "ctx").distinct()


def context_to_primary(edges: DataFrame, key: str = "id") -> DataFrame:
    """(ctx, n_ids, ids): the inverse map. The ids of a context are made distinct and sorted in ID_PARTS parts; the context's own row puts sorted parts together."""
    rows = edges.select("ctx", F.col(key).alias("_id"), F.pmod(F.xxhash64(key), F.lit(ID_PARTS)).alias("_part")).repartition("ctx", "_part")
    parts = rows.groupBy("ctx", "_part").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    found = parts.groupBy("ctx").agg(F.sort_array(F.flatten(F.collect_list("_ids"))).alias("ids"))
    return found.select("ctx", F.size("ids").cast("long").alias("n_ids"), "ids")


def merged_sides(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Both sides' rows; where a key stands on both, the right side's."""
    return left.join(right.select(key).distinct(), key, "left_anti").unionByName(right, allowMissingColumns=True)


def triples(df: DataFrame, field: str, separator: str = ",", relation: str = "isAuthor", key: str = "id") -> DataFrame:
    """(source, relation, target): item, relation, key of its own row."""
    return explode_context(df, field, separator, key).select(F.col("name").alias("source"), F.lit(relation).alias("relation"), F.col(key).alias("target"))


def typed_hyperedges(relations: DataFrame) -> DataFrame:
    """(edge_id, relation, source, ref): a row for each target of an edge; triples with one source and relation (null being a value) are an edge. Edges are numbered e0, e1, ... in the order of relation and source, nulls first, by ranges of both."""
    rows = stored(relations.select("source", "relation", F.col("target").alias("ref")).distinct(), "triples")
    # Stored: where edges are few, their numbers go to the triples and no hub's triples meet in a task.
    edges = stored(numbered(rows.select("relation", "source").distinct(), ["relation", "source"]).withColumnsRenamed({"relation": "_r", "source": "_s"}), "edges")
    met = rows.join(edges, F.col("relation").eqNullSafe(F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")))
    return met.select(F.concat(F.lit("e"), F.col("number")).alias("edge_id"), "relation", "source", "ref")
