"""The forest of merges, and what clusters would be at other thresholds, from one run.

At a threshold a component's merge makes the merges of a run at any lower one, in their order, up to the first whose
similarity is under it. Similarities go up and down along the way, so a merge has a ``level``: the least similarity up to
and with it. The merges of a threshold are those whose level reaches it, whatever the number of thresholds asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.collective import MAX_COMPONENT, _solve, token_match
from kinweave.operators.components import _held
from kinweave.operators.metrics import measures


def merge_forest(pairs: DataFrame, records: DataFrame, edges: DataFrame, probability, alpha: float, threshold: float, strategy: str = "LATE_FUSION", text: str = "text", match=token_match, folder: str | None = None, max_component: int = MAX_COMPONENT, similarity: str = "jaccard_coefficient", field: str = "context", start: DataFrame | None = None) -> DataFrame:
    """(component, step, a, b, sim, level) of every merge of a run at ``threshold``; steps count from 1 in each component, b goes into a. Arguments as those of ``collective.clusters``; members of ``start`` are joined before and make no rows."""
    return _solve(pairs, records, edges, probability, alpha, threshold, strategy, text, match, folder, max_component, similarity, field, start, True)


def _roots(thresholds: list[float]) -> Callable:
    """Goes along the merges of components that stand one after the other, each in the order of its steps, and tells (id, clusters) of their ids: the cluster at each threshold."""
    falling = sorted({float(t) for t in thresholds}, reverse=True)
    at = [falling.index(float(t)) for t in thresholds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, merges = None, []

        def over() -> None:
            members, done = {x: [x] for a, b, _ in merges for x in (a, b)}, 0
            root = {x: x for x in members}
            told = {x: [] for x in members}
            for t in falling:
                while done < len(merges) and merges[done][2] >= t:
                    a, b, _ = merges[done]
                    gone = members.pop(b)
                    members[a] += gone
                    root.update(dict.fromkeys(gone, a))
                    done += 1
                for x, r in root.items():
                    told[x].append(r)
            ids.extend(told)
            clusters.extend([[x[i] for i in at] for x in told.values()])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(clusters, pa.list_(pa.string()))], names=["id", "clusters"])

        ids, clusters = [], []
        for batch in batches:
            for component, a, b, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != current:
                    if merges:
                        over()
                    current, merges = component, []
                merges.append((a, b, level))
            if ids:
                yield made()
                ids, clusters = [], []
        if merges:
            over()
            yield made()

    return run


def _placed(forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(id, clusters) of ids with a merge: the cluster at each threshold. A task holds the merges of a component, as the run did that made them; no components are sought."""
    rows = forest.select("component", "step", "a", "b", "level").repartition(F.xxhash64("component")).sortWithinPartitions("component", "step")
    return rows.select("component", "a", "b", "level").mapInArrow(_roots(thresholds), "id string, clusters array<string>")


def clusters_at(ids: DataFrame, forest: DataFrame, thresholds: list[float], folder: str | None = None) -> DataFrame:
    """(threshold, id, cluster_id) of each id at each threshold (none lower than the run's). One walk along the merges serves all thresholds."""
    rows = ids.select("id").join(_placed(forest, thresholds), "id", "left")
    own = lambda i: F.coalesce(F.col("clusters")[i], F.col("id"))
    every = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), own(i).alias("cluster_id")) for i, t in enumerate(thresholds)])
    return rows.select("id", F.explode(every).alias("x")).select("x.threshold", "id", "x.cluster_id")


def threshold_sweep(pairs: DataFrame, forest: DataFrame, thresholds: list[float], folder: str | None = None) -> DataFrame:
    """(threshold, n, accuracy, precision, recall, f1) of labelled pairs at each threshold. A pair moves once with its ids' clusters, not once for each threshold."""
    placed = _held(_placed(forest, thresholds), folder, "placed")
    rows = pairs.select("ltable_id", "rtable_id", "label").where("ltable_id IS NOT NULL AND rtable_id IS NOT NULL")
    for c, n in (("ltable_id", "_l"), ("rtable_id", "_r")):
        rows = rows.join(placed.select(F.col("id").alias(c), F.col("clusters").alias(n)), c, "left")
    same = lambda i: (F.coalesce(F.col("_l")[i], F.col("ltable_id")) == F.coalesce(F.col("_r")[i], F.col("rtable_id"))).cast("int")
    every = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), same(i).alias("pred")) for i, t in enumerate(thresholds)])
    told = rows.select("label", F.explode(every).alias("x")).select("x.threshold", "label", "x.pred")
    return measures(told, by=["threshold"])
