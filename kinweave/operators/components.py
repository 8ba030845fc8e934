"""Connected components of an edge table, by alternating stars.

Each round turns the graph into flatter stars around smaller nodes: the large star links every larger neighbour of a
node to the least node in reach, the small star every smaller one. It takes a number of rounds that grows with the
logarithm of the longest path; edges never exceed their first number. Each round ends in the shared folder
(``checkpoint``), which cuts lineage and survives lost executors. Neighbours of a node are sorted together, each edge
moving once; where a node has more than HUB, they are joined to their least one, which adaptive execution splits.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edges that a task of a round writes, at most, where there are more than the cluster's cores share.
PART_EDGES = 1_000_000
#: Neighbours of a node that one task sorts, at most.
HUB = 1_000_000


def _state(edges: DataFrame) -> tuple[int, bool, int]:
    """Number of the edges (u > v, distinct), whether they are stars around least nodes, which no round changes (each upper end has one edge and is no lower end), and the most edges of a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    by = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("low").alias("low"))
    wrong = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") > 0))
    n, wrong, most = by.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max(wrong), F.lit(False)), F.coalesce(F.max(F.col("up") + F.col("low")), F.lit(0))).first()
    return n, not wrong, most


def _round(now: DataFrame, hub: bool) -> DataFrame:
    """The edges (u > v) after a large and a small star, distinct. ``hub``: a node has very many neighbours."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda df: df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u") if hub else df.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    small = least(large.distinct() if hub else large)
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of checkpoints: Spark's own, or spark.checkpoint.dir. Only where Spark is one local process and neither is set a local one is made."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="kinweave-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """The frame written below the folder of checkpoints and read again, so that its size is known to plans that use it."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(df: DataFrame, folder: str | None, round_: str, edges: int | None = None) -> DataFrame:
    """The frame in the shared folder; where the number of its edges is known, in no more files than they need, as each is made with several calls of the file system."""
    if edges is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-edges // PART_EDGES)))
    if folder is None:
        return stored(df, round_)
    path = f"{folder}/{round_}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of an edge but nulls; the component is its least node. Loops and repeated edges do no harm. Rounds go on until all are stars; where ``max_rounds`` is given and isn't enough, it raises."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.where("u = v").select("u", "v")
    now = _held(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, "edges")
    alone = loops.select(F.col("u").alias("node")).distinct()
    n, settled, most = _state(now)
    for round_ in itertools.count():
        if settled:
            break
        if round_ == max_rounds:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        now = _held(_round(now, most > HUB), folder, f"round{round_}", n)
        n, settled, most = _state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


#: Parts of a stored label table; an addition rewrites those that hold a changed component.
LABEL_PARTS = 64


class GrowingComponents:
    """Components to which edges are added in turn, as a stored table of labels (node, component).

    New edges are first contracted by the labels; rounds run over the contracted graph alone, so an addition costs its own
    edges and the joins with the labels. Labels lie in LABEL_PARTS parts by component; parts without a changed component stay
    as they are stored. Nulls take no part; a node of a loop alone is a component."""

    def __init__(self, spark: SparkSession, folder: str | None = None, kind: str = "string"):
        self.spark, self.kind = spark, kind
        self.folder = (folder or f"{checkpoint_root(spark)}/labels-{uuid.uuid4().hex}").rstrip("/")
        self._paths: dict[int, list[str]] = {}

    def _read(self, parts: list[int]) -> DataFrame:
        paths = [p for k in parts for p in self._paths.get(k, [])]
        schema = f"node {self.kind}, component {self.kind}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def labels(self) -> DataFrame:
        """(node, component) of every node so far."""
        return self._read(sorted(self._paths))

    def add(self, edges: DataFrame, a: str = "a", b: str = "b") -> GrowingComponents:
        pairs = edges.select(F.col(a).cast(self.kind).alias("u"), F.col(b).cast(self.kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
        labels = self.labels
        at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        met = _held(pairs.join(at("u"), "u", "left").join(at("v"), "v", "left"), None, "met")
        joined = met.select(F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b")).where("a <> b")
        moved = components(joined).select(F.col("node").alias("component"), F.col("component").alias("new")).where("component <> new")
        moved = _held(moved, None, "moved")
        fresh = met.where("cu IS NULL").select(F.col("u").alias("node")).unionByName(met.where("cv IS NULL").select(F.col("v").alias("node"))).distinct()
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(LABEL_PARTS)).cast("int")
        touched = sorted(r.part for r in moved.select(part("component").alias("part")).distinct().collect())  # LABEL_PARTS at most
        old = self._read(touched).unionByName(fresh.withColumn("component", F.col("node")))
        told = old.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        path = f"{self.folder}/{uuid.uuid4().hex}"
        told.withColumn("part", part("component")).write.partitionBy("part").parquet(path)
        for k in touched:
            self._paths.pop(k, None)
        written = self.spark.read.schema(f"node {self.kind}, component {self.kind}, part int").parquet(path).select("part").distinct().collect()
        for r in written:
            self._paths.setdefault(r.part, []).append(f"{path}/part={r.part}")
        return self

    def union(self, x, y) -> GrowingComponents:
        return self.add(self.spark.createDataFrame([(x, y)], f"a {self.kind}, b {self.kind}"))

    def find(self, nodes: DataFrame, column: str = "node") -> DataFrame:
        """Adds ``component`` to rows; null for nodes that aren't known."""
        return nodes.join(self.labels.withColumnRenamed("node", column), column, "left")

    def sets(self) -> DataFrame:
        """(component, n): the sets by their size; their members are the rows of ``labels``."""
        return self.labels.groupBy("component").agg(F.count("*").alias("n"))
