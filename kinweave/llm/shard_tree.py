"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row descends region, rack and shard. At each node every child draws -ln(u)/weight, u being a hash of the row's
key and the child's name, and the least draw wins: a child gets rows in proportion to its weight, and a change of
one child's weight moves rows only into it or out of it. Growth adds a region of one rack and one shard, so that
rows move into the new shard only (law ``key``: the key and the tree decide, nothing else).

Defined results: a null key is hashed like a text of its own; repeated rows share their shard and get slots of
their own; equal draws (ties) go to the first child; very long texts count whole, and one shard may get more bytes than
another; an empty table gives an empty table; columns other than the key and the text are not looked at, whatever their
names. A null text has size 1 and crc32 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import kept

#: A tree: weights of shards, by rack, by region.
Tree = list[list[list[float]]]

#: Rows of a shard that one task numbers.
SLOT_ROWS = 50_000


def tree_of(n_shards: int, base: int = 16, racks: int = 2, shards: int = 2) -> Tree:
    """Equal weights. Shards up to ``base`` fill regions of racks x shards; each later one is a region of its own."""
    first, tree = min(n_shards, base), []
    for at in range(0, first, racks * shards):
        here = min(racks * shards, first - at)
        tree.append([[1.0] * min(shards, here - r) for r in range(0, here, shards)])
    return tree + [[[1.0]] for _ in range(n_shards - first)]


def grown(tree: Tree) -> Tree:
    """The tree with one more shard, a region of its own, whatever the number of shards: ``grown_shard`` is the shard in this tree. From 16 shards on, and only there, it is also ``tree_of`` of one more."""
    return [*tree, [[1.0]]]


def _weight(node) -> float:
    return float(node) if not isinstance(node, list) else sum(map(_weight, node))


def draw(key: Column, name: Column | str, weight: float) -> Column:
    """-ln(u)/weight of a child; u in (0, 1) from 53 bits of a hash."""
    h = F.xxhash64(F.concat_ws("|", name if isinstance(name, Column) else F.lit(name), F.coalesce(key.cast("string"), F.lit("\0null"))))
    return -F.log((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)) / weight


def _winner(key: Column, prefix: str, weights: list[float]) -> Column:
    """Index of the child with the least draw; the first of equal ones."""
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(draw(key, f"{prefix}/{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]))["i"]


def descend(df: DataFrame, key: str, tree: Tree, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """Adds the three levels; the shard is numbered over the whole tree."""
    region, rack, shard = names

    def choose(cases: list[tuple[Column, Column]]) -> Column:
        if len(cases) == 1:
            return cases[0][1]
        out = F.when(*cases[0])
        for condition, value in cases[1:-1]:
            out = out.when(condition, value)
        return out.otherwise(cases[-1][1])

    k = F.col(key)
    df = df.withColumn(region, _winner(k, "", [_weight(r) for r in tree]))
    df = df.withColumn(rack, choose([(F.col(region) == i, _winner(k, f"/{i}", [_weight(x) for x in r])) for i, r in enumerate(tree)]))
    cases, number = [], 0
    for i, r in enumerate(tree):
        for j, x in enumerate(r):
            cases.append(((F.col(region) == i) & (F.col(rack) == j), F.lit(number) + _winner(k, f"/{i}/{j}", x)))
            number += len(x)
    return df.withColumn(shard, choose(cases).cast("int"))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 16, tree: Tree | None = None) -> DataFrame:
    """One row per row: key, size, text_crc32, law, region, rack, shard, slot (gapless from 0 in each shard), and grown_shard, the shard in the ``grown`` tree.

    Slots are numbered in two steps, so that no task orders a whole shard: rows are dealt to buckets of a shard,
    numbered there, and moved up by the sizes of the shard's earlier buckets. Rows that are equal in all go to
    several buckets too."""
    tree = tree or tree_of(n_shards)
    full = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), (F.octet_length(full).cast("long") + 1).alias("size"), F.crc32(full.cast("binary")).alias("text_crc32"))
    rows = descend(rows, key, tree)
    fresh = draw(F.col(key), f"/{len(tree)}", 1.0)
    best = F.array_min(F.array(*[draw(F.col(key), f"/{i}", _weight(r)) for i, r in enumerate(tree)]))
    n = sum(len(x) for r in tree for x in r)
    rows = kept(rows.withColumn("grown_shard", F.when(fresh < best, F.lit(n)).otherwise(F.col("shard")).cast("int")), "shards")
    buckets = max(16, math.ceil(rows.count() / n / SLOT_ROWS))
    # The place in the kept files parts equal rows; it is the same in every run over the same input.
    place = (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("_part"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.select("*", *place)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "text_crc32", "size", "_part", F.floor(F.col("_row") / SLOT_ROWS)), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(key), F.col("text_crc32"), F.col("size"), F.col("_part"), F.col("_row"))
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["shard", "_bucket"])
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
