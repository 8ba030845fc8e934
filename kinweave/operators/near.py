"""Pairs of members that can matter to a merge, found without comparing all members.

A cluster pair is merged at (1 - alpha) * best + alpha * relational >= threshold, and the relational part is 1 at most. So
only pairs of members whose probability reaches ``least_probability`` can bring a merge; the others count as if they were
0. A scorer that knows how alike token sets of such pairs are at least (``least_jaccard``) finds them by a
prefix-filtered set join: tokens of a record in a fixed order, rare ones first; of two sets that are alike enough, the first few
of each must share one. Members with equal texts are one class and compared once, so that copies make no pairs.

The same pairs split large components: each merge joins two clusters by such a pair, so no cluster ever reaches beyond a
connected component of them (``cells``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import _held, components

#: Most frequent tokens, which come last in the order. It bounds what is sent along; any order gives the same pairs.
FREQUENT = 256
#: Members of a component up to which all its classes are compared, without tokens: fewer rows than classes by their tokens.
FEW = 16
#: What rounding may take from a probability.
SLACK = 1e-9


def least_probability(alpha: float, threshold: float) -> float:
    """The probability below which no pair of members brings a merge."""
    return float("inf") if alpha >= 1 else (threshold - alpha) / (1 - alpha) - SLACK


def classed(parts: DataFrame, records: DataFrame, identity: Column) -> DataFrame:
    """Members of components (component, id) with their class and record; equal ``identity`` is one class, a hash of 128 bits. A member without a record is a class by itself, which is near to nobody (``known`` is null)."""
    rows = parts.hint("shuffle_hash").join(records.withColumn("known", F.lit(True)), "id", "left")  # a member is one row, records may be many more
    return rows.withColumn("cls", F.when(F.col("known"), F.md5(F.coalesce(identity, F.lit("")))).otherwise(F.concat(F.lit("-"), "id")))


def _ranks(rows: DataFrame) -> Column:
    """Counts of the most frequent tokens, as a constant map."""
    often = rows.select(F.explode("_tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(FREQUENT).collect()
    return F.from_json(F.lit(json.dumps({r.t: r.n for r in often})), "map<string,bigint>")


def near_pairs(members: DataFrame, columns: list[str], tokens: Column, probability: Column, least: float, jaccard: float, ranked: bool = True, largest: int | None = None) -> DataFrame:
    """(component, a, b, p): classes of a component, a < b, and those of several members with themselves, whose probability is ``least`` or more and token Jaccard ``jaccard`` or more (any that isn't 0, where that is 0). ``members``: as of ``classed``. ``ranked``: frequent tokens come last; without, the order is the tokens' own, which does where components are small. ``largest``: members of the largest component, where known; where it is FEW at most, all classes of a component are compared."""
    few = largest is not None and largest <= FEW
    known = members.where("known")
    if few:
        known = known.select("component", "cls", *columns).repartition("component")  # classes are made and meet where they are
    rows = known.groupBy("component", "cls").agg(F.min(F.struct(*columns)).alias("_r"), F.count("*").alias("_m")).select("component", "cls", "_m", *[F.col(f"_r.{c}").alias(c) for c in columns])
    if few:
        one, two = (rows.select("component", F.col("cls").alias(c), F.col("_m").alias(f"{p}m"), *[F.col(x).alias(f"{p}{x}") for x in columns]) for p, c in (("l_", "a"), ("r_", "b")))
        met = one.hint("merge").join(two, "component").where("a < b OR a = b AND l_m > 1").select("component", "a", "b", probability.cast("double").alias("p"))
        return met.where((F.col("p") >= least) & (F.col("p") != 0))  # 0 is what pairs that aren't told count as
    rows = rows.withColumn("_tokens", tokens).withColumn("_n", F.size("_tokens"))
    ordered = F.sort_array("_tokens")
    if ranked:
        rank = _ranks(rows)
        ordered = F.transform(F.sort_array(F.transform("_tokens", lambda t: F.struct(F.coalesce(rank[t], F.lit(0)).alias("n"), t.alias("t")))), lambda x: x["t"])
    first = (F.col("_n") - F.ceil(F.col("_n") * (jaccard - SLACK)) + 1).cast("int") if jaccard > 0 else F.col("_n")
    rows = rows.where("_n > 0").select("component", "cls", "_m", *columns, "_n", F.slice(ordered, F.lit(1), F.greatest(F.lit(1), F.least(F.col("_n"), first))).alias("_prefix"))
    spread = rows.select("*", F.explode("_prefix").alias("_t"))
    side = lambda p, c: spread.select("component", "_t", F.col("cls").alias(c), F.col("_m").alias(f"{p}m"), F.col("_n").alias(f"{p}n"), F.col("_prefix").alias(f"{p}prefix"), *[F.col(x).alias(f"{p}{x}") for x in columns])
    met = side("l_", "a").join(side("r_", "b"), ["component", "_t"]).where("a < b OR a = b AND l_m > 1")
    if jaccard > 0:
        met = met.where((F.col("l_n") >= (jaccard - SLACK) * F.col("r_n")) & (F.col("r_n") >= (jaccard - SLACK) * F.col("l_n")))
    met = met.where(F.element_at(F.array_intersect("l_prefix", "r_prefix"), 1) == F.col("_t"))  # each pair once
    return met.select("component", "a", "b", probability.cast("double").alias("p")).where(F.col("p") >= least)


def cells(links: DataFrame, members: DataFrame, near: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, component): components split until each is connected by links and by near pairs alike. ``links``: component, a, b; ``members``: component, id, cls; ``near``: component, a, b (classes). Members of one class count as near."""
    at = _held(members.select("component", "id", "cls", F.col("component").alias("cell")), folder, "cells")
    count = at.select("cell").distinct().count()
    while True:
        node = lambda cell, cls: F.concat(F.lit("#"), F.length(cell).cast("string"), F.lit("#"), cell, cls)
        kinds = at.select("component", "cell", "cls").distinct()
        own = at.select(F.concat(F.lit("i"), "id").alias("a"), node(F.col("cell"), F.col("cls")).alias("b"))
        one, two = kinds.withColumnRenamed("cls", "a"), kinds.withColumnRenamed("cls", "b")
        met = near.where("a <> b").select("component", "a", "b").join(one, ["component", "a"]).join(two, ["component", "cell", "b"])
        alike = components(own.unionByName(met.select(node(F.col("cell"), F.col("a")).alias("a"), node(F.col("cell"), F.col("b")).alias("b"))), "a", "b", folder)
        alike = alike.where("node LIKE 'i%'").select(F.expr("substr(node, 2)").alias("id"), F.col("component").alias("group"))
        left, right = (alike.select(F.col("id").alias(c), F.col("group").alias(f"g{c}")) for c in "ab")
        going = links.join(left, "a").join(right, "b").where("ga = gb").select("a", "b")
        linked = components(going, "a", "b", folder).select(F.col("node").alias("id"), F.col("component").alias("new"))
        at = _held(at.drop("cell").join(linked, "id", "left").select("component", "id", "cls", F.coalesce("new", "id").alias("cell")), folder, "cells")
        now = at.select("cell").distinct().count()
        if now == count:
            return at.select("id", F.col("cell").alias("component"))
        count, links = now, _held(going.join(at.select(F.col("id").alias("a"), F.col("cell").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("cell").alias("cb")), "b").where("ca = cb").select("a", "b"), folder, "links")
