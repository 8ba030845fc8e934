"""Clusters before any merge, and the graph of clusters as a table to start from.

Records that match exactly, or by k members of their hyperedges, can be joined before the merge; without matches every record
is a cluster. The quotient holds what the merge reads of clusters: their members, contexts and similar clusters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import components
from kinweave.operators.graph import neighbor_edges


def bootstrap(ids: DataFrame, *matches: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, cluster_id) of every id; ``matches`` are tables of (r1_id, r2_id). A cluster is named after its least id; matches of unknown ids count like others, but make no rows."""
    ids = ids.select("id").where("id IS NOT NULL").distinct()
    if not matches:
        return ids.withColumn("cluster_id", F.col("id"))
    edges = reduce(DataFrame.unionByName, [m.select(F.col("r1_id").alias("a"), F.col("r2_id").alias("b")) for m in matches])
    found = components(edges, "a", "b", folder).withColumnRenamed("node", "id")
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def quotient(clusters: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, cluster_id, other), one row for each fact: ``member`` (an id), ``context`` (a context of a member) and ``similar`` (a cluster with a member in one candidate pair with a member of this one; both directions)."""
    of = lambda c, n: clusters.select(F.col("id").alias(c), F.col("cluster_id").alias(n))
    row = lambda df, kind, other: df.select(F.lit(kind).alias("kind"), "cluster_id", F.col(other).alias("other"))
    contexts = edges.join(clusters.hint("shuffle_hash"), "id").select("cluster_id", "ctx").distinct()
    # Made distinct once pairs inside a cluster are gone. An id is one row of the clusters, which are the side to hold.
    p = pairs.select(F.col("ltable_id").alias("a"), F.col("rtable_id").alias("b")).where("a <> b")
    linked = p.join(of("a", "x").hint("shuffle_hash"), "a").join(of("b", "y").hint("shuffle_hash"), "b").where("x <> y")
    both = linked.select(F.col("x").alias("cluster_id"), "y").unionByName(linked.select(F.col("y").alias("cluster_id"), F.col("x").alias("y"))).distinct()
    return row(clusters, "member", "id").unionByName(row(contexts, "context", "ctx")).unionByName(row(both, "similar", "y"))


def members_of(table: DataFrame) -> DataFrame:
    """(id, cluster_id) of a stored quotient: what ``collective.clusters`` takes as ``start``."""
    return table.where("kind = 'member'").select(F.col("other").alias("id"), "cluster_id")


def neighbor_clusters(table: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of clusters of a quotient with a common context."""
    return neighbor_edges(table.where("kind = 'context'"), "cluster_id", "other")
