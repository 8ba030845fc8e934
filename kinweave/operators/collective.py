"""Collective clustering: bulk scores, then greedy merging inside each component of the candidate graph.

Similarity depends on the members of two clusters only and candidate links never leave a component, so that merging
each component by itself gives what one global queue gives. Scores are found in bulk by joins before; the ordered
merge is one grouped function. Ties go to the lesser ids, a cluster is named after its least member.

In a large component pairs of members are scored only when their clusters are compared: the grouped function merges as
far as it has scores, goes on by those it has to find what it will ask for, and comes back to the last sure state when
the answers are there. It sees no pair of members, only the best probability of two clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scores import RELATIONAL_SETS, fused, level_of, relational
from kinweave.operators.components import _held, components
from kinweave.operators.graph import candidate_edges, stored_contexts
from kinweave.operators.near import cells, classed, least_probability, near_pairs
from kinweave.operators.queue import AddressableQueue
from kinweave.operators.scorers import TextPairs

#: Members of a component above which ``clusters`` scores pairs only when they are compared, not all in advance.
MAX_COMPONENT = 5_000
#: Pairs of clusters of one component after which a round asks for scores instead of looking further ahead.
ASKED = 200_000


def initial_queue(pairs: DataFrame, probability: Column, alpha: float, similarity: str = "jaccard_coefficient") -> DataFrame:
    """Pairs (with l_ctxs and r_ctxs) with their attribute, relational and fused similarity: the queue before any merge."""
    relation = relational(similarity)(F.col("l_ctxs"), F.col("r_ctxs"))
    return pairs.withColumn("sim_a", probability).withColumn("sim_r", relation).withColumn("sim", fused(F.col("sim_a"), F.col("sim_r"), alpha))


def top_pairs(queue: DataFrame, n: int = 10, a: str = "ltable_id", b: str = "rtable_id") -> DataFrame:
    """The n best entries, not removed: a report."""
    return queue.orderBy(F.desc("sim"), a, b).limit(n)


def component_pairs(parts: DataFrame, records: DataFrame) -> DataFrame:
    """All unordered pairs of records (id, then attributes as l_*, r_*) within a component, the lesser id left."""
    rows = parts.join(records, "id")
    side = lambda p: rows.select("component", *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c != "component"])
    return side("l_").join(side("r_"), "component").where("l_id < r_id")


class _Clusters:
    """State of one component: members, contexts and similar clusters by root, best match probability by pair of roots."""

    def __init__(self, ids, contexts, candidates, probabilities, score: Callable):
        self.members = {i: [i] for i in ids}
        self.contexts = {i: frozenset(contexts.get(i, ())) for i in ids}
        self.similar = {i: set() for i in ids}
        for a, b in candidates:
            self.similar[a].add(b)
            self.similar[b].add(a)
        self.best: dict[str, dict[str, float]] = {i: {} for i in ids}
        for a, b, p in probabilities:
            self.best[a][b] = self.best[b][a] = max(p, self.best[a].get(b, 0.0))
        self.score = score

    def match(self, a: str, b: str) -> float:
        """The best match probability of two clusters."""
        return self.best[a].get(b, 0.0)

    def similarity(self, a: str, b: str) -> float:
        return self.score(self, *sorted((a, b)))

    def merge(self, a: str, b: str) -> str:
        """The lesser id stays the root."""
        a, b = sorted((a, b))
        self.members[a] = sorted(self.members[a] + self.members.pop(b))
        self.contexts[a] |= self.contexts.pop(b)
        for other in self.similar.pop(b):
            self.similar[other].discard(b)
            if other != a:
                self.similar[other].add(a)
                self.similar[a].add(other)
        for other, p in self.best.pop(b).items():
            self.best[other].pop(b, None)
            if other != a:
                self.best[a][other] = self.best[other][a] = max(p, self.best[a].get(other, 0.0))
        return a


class _Classes(_Clusters):
    """Clusters whose members stand for classes of equal texts: probabilities are by pair of classes, so that copies take no pairs."""

    def __init__(self, ids, contexts, candidates, near, score: Callable, kinds: dict[str, str]):
        super().__init__(ids, contexts, candidates, (), score)
        by: dict[str, dict[str, float]] = {}
        for x, y, p in near:
            by.setdefault(x, {})[y] = by.setdefault(y, {})[x] = p
        self.kinds = {i: {kinds[i]} for i in ids}
        self.near = {i: dict(by.get(kinds[i], ())) for i in ids}

    def match(self, a: str, b: str) -> float:
        kinds, near = self.kinds[b], self.near[a]
        if len(kinds) > len(near):
            return max((p for c, p in near.items() if c in kinds), default=0.0)
        return max((near[c] for c in kinds if c in near), default=0.0)

    def merge(self, a: str, b: str) -> str:
        root, gone = sorted((a, b))
        self.kinds[root] |= self.kinds.pop(gone)
        more, fewer = sorted((self.near[root], self.near.pop(gone)), key=len, reverse=True)
        for c, p in fewer.items():
            more[c] = max(p, more.get(c, 0.0))
        self.near[root] = more
        return super().merge(a, b)


class _Asking(_Clusters):
    """Clusters made of those a round starts with. ``asked`` collects pairs of the latter whose probability was needed and isn't known."""

    def __init__(self, ids, contexts, candidates, probabilities, score: Callable):
        super().__init__(ids, contexts, candidates, probabilities, score)
        self.given = {(a, b) for a, b, _ in probabilities} | {(b, a) for a, b, _ in probabilities}
        self.have: dict[str, dict[str, int]] = {i: dict.fromkeys(self.best[i], 1) for i in ids}
        self.asked: set[tuple[str, str]] = set()

    def whole(self, a: str, b: str) -> bool:
        """Whether nothing unknown can change the best probability; 1 is the highest there is."""
        return self.have[a].get(b, 0) == len(self.members[a]) * len(self.members[b]) or self.best[a].get(b, 0.0) >= 1.0

    def similarity(self, a: str, b: str) -> float:
        if not self.whole(a, b):
            pairs = ((min(m, n), max(m, n)) for m in self.members[a] for n in self.members[b])
            self.asked.update(p for p in pairs if p not in self.given)
            self.have[a][b] = self.have[b][a] = len(self.members[a]) * len(self.members[b])
        return super().similarity(a, b)

    def merge(self, a: str, b: str) -> str:
        a, b = sorted((a, b))
        for other, n in self.have.pop(b).items():
            self.have[other].pop(b, None)
            if other != a:
                self.have[a][other] = self.have[other][a] = n + self.have[a].get(other, 0)
        return super().merge(a, b)


def _merges(state: _Clusters, threshold: float, enough: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, str, float]]:
    """Merges the best pair of similar clusters while its similarity is the threshold or more, and tells each merge with it. The queue holds a pair of clusters once: it is changed with its similarity and leaves with either cluster."""
    queue = AddressableQueue()

    def put(a: str, b: str) -> None:
        a, b = sorted((a, b))
        s = state.similarity(a, b)
        if s >= threshold:
            queue.put((a, b), (-s, a, b))
        else:
            queue.remove((a, b))

    for a in list(state.members):
        for b in state.similar[a]:
            if a < b:
                put(a, b)
    while queue and not enough():
        (a, b), (negative, *_) = queue.pop()
        gone = max(a, b)
        for other in state.similar[gone]:
            queue.remove((min(gone, other), max(gone, other)))
        root = state.merge(a, b)
        for other in sorted(state.similar[root]):
            put(root, other)
        yield a, b, -negative


def _places(state: _Clusters) -> dict[str, str]:
    return {m: root for root, members in state.members.items() for m in members}


def merged(ids: list[str], contexts: dict, candidates: list[tuple[str, str]], probabilities: list[tuple[str, str, float]], threshold: float, score: Callable, kinds: dict[str, str] | None = None, start: dict[str, str] | None = None) -> tuple[dict[str, str], list[tuple[str, str, float]]]:
    """(id -> cluster of one component, its merges in their order). With ``kinds`` (id -> class) probabilities are of classes. ``start`` (id -> cluster) joins members before."""
    state = _Clusters(ids, contexts, candidates, probabilities, score) if kinds is None else _Classes(ids, contexts, candidates, probabilities, score, kinds)
    place = {i: i for i in ids}
    for i, first in sorted((start or {}).items()):
        a, b = _root(place, i), _root(place, first)
        if a != b:
            place[max(a, b)] = state.merge(a, b)
    merges = list(_merges(state, threshold))
    return _places(state), merges


def _root(place: dict[str, str], i: str) -> str:
    while place[i] != i:
        i = place[i]
    return i


def progress(ids: list[str], contexts: dict, candidates: list[tuple[str, str]], probabilities: list[tuple[str, str, float]], threshold: float, score: Callable, most: int = ASKED) -> tuple[dict[str, str], list[tuple[str, str]], list[tuple[str, str, float]], list[tuple[str, str]]]:
    """A round of the merge of clusters ``ids`` with what is known of their best probabilities: id -> cluster after all merges that are sure; of those clusters, the links, the known probabilities and the pairs whose probability is asked for. Nothing asked: the merge is over."""
    state, done, sure = _Asking(ids, contexts, candidates, probabilities, score), [], 0
    for a, b, _ in _merges(state, threshold, lambda: len(state.asked) >= most):
        done.append((a, b))
        if not state.asked:
            sure = len(done)
    asked = state.asked
    state = _Asking(ids, contexts, candidates, probabilities, score)
    for a, b in done[:sure]:
        state.merge(a, b)
    place = _places(state)
    links = [(a, b) for a in state.similar for b in state.similar[a] if a < b]
    known = [(a, b, p) for a in state.best for b, p in state.best[a].items() if a < b and state.whole(a, b)]
    return place, links, known, sorted({(min(x, y), max(x, y)) for x, y in ((place[a], place[b]) for a, b in asked)})


def late_fusion(alpha: float, similarity: str = "jaccard_coefficient") -> Callable:
    """(1 - alpha) * best match probability over member pairs + alpha * relational similarity of contexts."""
    relation = RELATIONAL_SETS[similarity]

    def score(state: _Clusters, a: str, b: str) -> float:
        return (1 - alpha) * state.match(a, b) + alpha * relation(state.contexts[a], state.contexts[b])

    return score


def context_tails(x: set[str], y: set[str], field: str, k: int = 5) -> tuple[str, str]:
    """What stands behind the texts of two clusters' members: the cluster's first contexts under ``field``, and how alike both clusters' are."""
    j = len(x & y) / len(x | y) if x and y else 0.0
    return tuple(f' , {field} : "{" | ".join(sorted(c)[:k])}" , pairwise_summary : "jac={level_of(j)}"' for c in (x, y))


def inline_encode(texts: dict[str, str], match: Callable[[str, str], float], k: int = 5, field: str = "context") -> Callable:
    """Best match over member pairs of texts (``inference`` style) that end in two columns more (``context_tails``), to 3 places; the lesser cluster stands left."""

    def score(state: _Clusters, a: str, b: str) -> float:
        tail = context_tails(state.contexts[a], state.contexts[b], field, k)
        return round(max((match(texts[m] + tail[0], texts[n] + tail[1]) for m in state.members[a] for n in state.members[b] if m != n), default=0.0), 3)

    return score


def token_match(left: str, right: str) -> float:
    """Jaccard of lower-case tokens, names of columns among them: the default scorer of texts."""
    a, b = set(left.lower().split()), set(right.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def _in_rounds(parts: DataFrame, records: DataFrame, linked: DataFrame, nodes: DataFrame, probability: Column, score: Callable, threshold: float, folder: str | None) -> DataFrame:
    """(id, cluster_id) of components whose pairs are scored when they are compared. The state has a row for each member (a: id, b: cluster), link (a, b) and known probability (a, b, p) of clusters; each round ends in the shared folder."""
    columns = "component string, kind string, a string, b string, p double"

    def step(state: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if state.empty:  # a component that is over
            return state
        rows = {kind: part for kind, part in state.groupby("kind")}
        some = lambda kind, names: list(zip(*(rows[kind][c] for c in names), strict=True)) if kind in rows else []
        place, around = dict(some("member", "ab")), {}
        for i, c in zip(members["id"], members["ctxs"], strict=True):
            around.setdefault(place[i], set()).update(c)
        root, links, known, asked = progress(sorted(set(place.values())), around, some("link", "ab"), some("known", "abp"), threshold, score)
        found = [("member", i, root[c], None) for i, c in place.items()] + [("link", a, b, None) for a, b in links] + [("known", a, b, p) for a, b, p in known] + [("asked", a, b, None) for a, b in asked]
        out = pd.DataFrame(found, columns=["kind", "a", "b", "p"]).astype({"p": "float64"})
        out.insert(0, "component", state["component"].iloc[0])
        return out

    def answered(asked: DataFrame, members: DataFrame) -> DataFrame:
        """The best probability of each asked pair of clusters, 0 where no pair of members has records. Of a pair of members the lesser id stands left."""
        one, two = members.select("component", F.col("b").alias("a"), F.col("a").alias("_m")), members.select("component", "b", F.col("a").alias("_n"))
        met = asked.select("component", "a", "b").join(one, ["component", "a"]).join(two, ["component", "b"])
        met = met.select("component", "a", "b", F.least("_m", "_n").alias("l_id"), F.greatest("_m", "_n").alias("r_id"))
        for p in ("l_", "r_"):
            met = met.join(records.select(*[F.col(c).alias(f"{p}{c}") for c in records.columns]), f"{p}id")
        best = met.select("component", "a", "b", probability.cast("double").alias("p")).groupBy("component", "a", "b").agg(F.max("p").alias("p"))
        return asked.select("component", "a", "b").join(best, ["component", "a", "b"], "left").select("component", F.lit("known").alias("kind"), "a", "b", F.coalesce("p", F.lit(0.0)).alias("p"))

    none = F.lit(None).cast("double")
    members = parts.select("component", F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), none.alias("p"))
    links = linked.select("component", F.lit("link").alias("kind"), "a", "b", none.alias("p"))
    state, over, round_ = _held(members.unionByName(links).unionByName(answered(linked, members)), folder, "asked"), [], 0
    while True:
        now = _held(state.groupBy("component").cogroup(nodes.groupBy("part")).applyInPandas(step, columns), folder, f"merge{round_}")
        asked, members = now.where("kind = 'asked'"), now.where("kind = 'member'")
        open_ = asked.select("component").distinct()
        over.append(members.join(open_, "component", "left_anti"))
        if asked.isEmpty():
            break
        going = now.where("kind <> 'asked'").join(open_, "component", "left_semi")
        state, round_ = _held(going.unionByName(answered(asked, members)), folder, f"asked{round_}"), round_ + 1
    return reduce(DataFrame.unionByName, over).select(F.col("a").alias("id"), F.col("b").alias("cluster_id"))


def _merge_runs(score_of: Callable[[dict], Callable], threshold: float, log: bool, classes: bool) -> Callable:
    """Merges components that stand one after the other in a partition, without the cost of a frame for each. A row is a member (a: id, b: its first cluster), a link (a, b) or a scored pair (a, b, p) of members, or, with ``classes``, of the classes that stand as members' texts; those of a component come in any order. ``log``: tells merges instead of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names = None, {}  # each id is held once
        contexts, texts, links, scored, start = {}, {}, [], [], {}

        def over() -> None:
            """What the component gives goes to the columns of ``found``."""
            place, merges = merged(sorted(contexts), contexts, links, scored, threshold, score_of(texts), texts if classes else None, start)
            if not log:
                some = place, place.values()
            elif merges:
                some = [current] * len(merges), range(1, len(merges) + 1), *zip(*merges, strict=True), accumulate((s for _, _, s in merges), min)
            else:
                return
            for column, values in zip(found, some, strict=True):
                column.extend(values)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names_)

        names_, kinds = (["component", "step", "a", "b", "sim", "level"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]) if log else (["id", "cluster_id"], [pa.string()] * 2)
        found = [[] for _ in kinds]
        for batch in batches:
            for component, kind, a, b, p, ctxs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != current:
                    if current is not None:
                        over()
                    current, names = component, {}
                    contexts, texts, links, scored, start = {}, {}, [], [], {}
                a, b = names.setdefault(a, a), names.setdefault(b, b)
                if kind == "member":
                    contexts[a], texts[a] = set(ctxs), names.setdefault(text, text)
                    if b is not None:
                        start[a] = b
                elif kind == "link":
                    links.append((a, b))
                else:
                    scored.append((a, b, p))
            if found[0]:
                yield told()  # a batch for many components
                found = [[] for _ in kinds]
        if current is not None:
            over()
            yield told()

    return run


_ROW = "component string, kind string, a string, b string, p double, ctxs array<string>, text string"


def _row(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    """Rows of ``_ROW``; what isn't given is null."""
    cells_ = [c.split(" ", 1) for c in _ROW.split(", ")]
    given = {"component": F.col("component"), "kind": F.lit(kind), **given}
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in cells_])


def _grouped(rows: DataFrame, score_of: Callable, threshold: float, log: bool, classes: bool = False) -> DataFrame:
    # Dealt by a hash of the component: a union whose parts are all dealt by the component itself is taken to be so too, and isn't once partitions are coalesced.
    told = "component string, step bigint, a string, b string, sim double, level double" if log else "id string, cluster_id string"
    return rows.repartition(F.xxhash64("component")).sortWithinPartitions("component").mapInArrow(_merge_runs(score_of, threshold, log, classes), told)


def _solve(pairs: DataFrame, records: DataFrame, edges: DataFrame, probability, alpha: float, threshold: float, strategy: str, text: str, match, folder: str | None, max_component: int, similarity: str, field: str, start: DataFrame | None, log: bool) -> DataFrame:
    """Clusters (id, cluster_id) of members of components, or their merges."""
    relational(similarity)  # an unknown one is told at once
    if strategy not in ("LATE_FUSION", "INLINE_ENCODE"):
        raise ValueError(f"unknown strategy: {strategy}")
    candidates = _held(candidate_edges(pairs), folder, "candidates")  # used by several plans, each of which would make the pairs again
    tied = candidates if start is None else candidates.unionByName(start.select(F.col("id").alias("a"), F.col("cluster_id").alias("b")).where("a <> b"))
    parts = components(tied, "a", "b", folder).withColumnRenamed("node", "id")
    of = lambda df, some, how: df if some is None else df.join(some, "component", how)
    sizes = parts.groupBy("component").agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    large = sizes.where(F.col("_n") > max_component).select("component") if largest > max_component else None
    fusion = late_fusion(alpha, similarity)
    if strategy == "LATE_FUSION":
        least = least_probability(alpha, threshold)
        scorer = not isinstance(probability, Column)
        column, likeness = probability.probability() if scorer else probability, None
        if scorer and hasattr(probability, "least_jaccard"):
            likeness = 1.0 if least > 1 else probability.least_jaccard(least)
        if likeness is not None:
            return _by_classes(parts, candidates, records, edges, probability, column, least, likeness, fusion, alpha, threshold, folder, large, start, log, largest)
        score_of = lambda _: fusion
    else:
        score_of = lambda texts: inline_encode(texts, match, field=field)
        if hasattr(match, "of_texts"):  # a model that takes batches: all components together, in rounds
            large = parts.select("component").distinct()
    linked = candidates.join(parts.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b")
    known = records.select("id", F.col(text).alias("text")) if strategy == "INLINE_ENCODE" else records.select("id", F.lit("").alias("text"))
    nodes = _members(parts, edges, start, folder).join(known, "id", "left")
    small = lambda df: of(df, large, "left_anti")
    rows = _row(small(nodes), "member", a=F.col("id"), b=F.col("first"), ctxs=F.col("ctxs"), text=F.coalesce("text", F.lit(""))).unionByName(_row(small(linked), "link", a=F.col("a"), b=F.col("b")))
    if strategy == "LATE_FUSION":
        every = component_pairs(small(parts), records).select("component", F.col("l_id").alias("a"), F.col("r_id").alias("b"), column.cast("double").alias("p"))
        rows = rows.unionByName(_row(every, "near", a=F.col("a"), b=F.col("b"), p=F.col("p")))
    found = _grouped(rows, score_of, threshold, log)
    if large is None:
        return found
    if log or start is not None:
        raise ValueError("merges of components in rounds aren't told, nor started from clusters: give a scorer that bounds token likeness, or a larger max_component")
    inner = lambda df: of(df, large, "left_semi")
    if strategy == "LATE_FUSION":
        some = inner(nodes).withColumnRenamed("component", "part").select("part", "id", "ctxs", F.coalesce("text", F.lit("")).alias("text"))
        return found.unionByName(_in_rounds(inner(parts), records, inner(linked), some, column, fusion, threshold, folder))
    from kinweave.operators.inline_rounds import in_rounds

    batched = match if hasattr(match, "of_texts") else TextPairs(match)
    rounds = in_rounds(inner(nodes), inner(linked), batched, threshold, field, folder)
    return rounds if hasattr(match, "of_texts") else found.unionByName(rounds)


def _members(parts: DataFrame, edges: DataFrame, start: DataFrame | None, folder: str | None) -> DataFrame:
    """component, id, ctxs and first (the cluster a member starts in, or null) of all members."""
    none = F.lit(None).cast("string")
    # Edges of members only, before contexts are gathered; a member is one row, so that its side is the one to hold.
    own = stored_contexts(edges.join(parts.select("id").hint("shuffle_hash"), "id", "left_semi"), folder)
    rows = parts.hint("shuffle_hash").join(own, "id", "left").withColumn("ctxs", F.coalesce("ctxs", F.array().cast("array<string>")))
    return rows.withColumn("first", none) if start is None else rows.join(start.select("id", F.col("cluster_id").alias("first")), "id", "left")


def _by_classes(parts: DataFrame, candidates: DataFrame, records: DataFrame, edges: DataFrame, scorer, column: Column, least: float, likeness: float, score: Callable, alpha: float, threshold: float, folder: str | None, large: DataFrame | None, start: DataFrame | None, log: bool, largest: int) -> DataFrame:
    """LATE_FUSION over near pairs of classes only. Large components are split first."""
    members = classed(parts, records.select("id", *scorer.columns), scorer.identity())
    if large is not None:
        members = _held(members, folder, "classes")
    near = near_pairs(members, scorer.columns, scorer.token_set(), column, least, likeness, large is not None, largest)
    kinds = members.select("component", "id", "cls")
    link = lambda parts: candidates.join(parts.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b")
    linked = link(parts)
    if large is not None and start is None and alpha < min(threshold, 1.0):  # else contexts alone can bring a merge
        near = _held(near, folder, "near")
        some = lambda df: df.join(large, "component", "left_semi")
        split = cells(some(linked), some(kinds), some(near), folder).select("id", F.col("component").alias("cell"))
        kinds = _held(kinds.join(split, "id", "left").select(F.col("component").alias("whole"), F.coalesce("cell", "component").alias("component"), "id", "cls"), folder, "placed")
        at = kinds.select("whole", "component", "cls").distinct()
        a, b = at.withColumnRenamed("cls", "a"), at.withColumnRenamed("cls", "b")
        near = near.withColumnRenamed("component", "whole").join(a, ["whole", "a"]).join(b, ["whole", "component", "b"]).select("component", "a", "b", "p")
        linked = link(kinds).join(kinds.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    nodes = _members(kinds, edges, start, folder)
    rows = _row(nodes, "member", a=F.col("id"), b=F.col("first"), ctxs=F.col("ctxs"), text=F.col("cls")).unionByName(_row(linked, "link", a=F.col("a"), b=F.col("b")))
    rows = rows.unionByName(_row(near, "near", a=F.col("a"), b=F.col("b"), p=F.col("p")))
    return _grouped(rows, lambda _: score, threshold, log, classes=True)


def clusters(pairs: DataFrame, records: DataFrame, edges: DataFrame, probability, alpha: float, threshold: float, strategy: str = "LATE_FUSION", text: str = "text", match=token_match, folder: str | None = None, max_component: int = MAX_COMPONENT, similarity: str = "jaccard_coefficient", field: str = "context", start: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id) of every id of a pair. ``records``: id and what ``probability`` needs; ``edges``: (id, ctx); ``start``: (id, cluster_id), members joined before (unknown ids and nulls are left out).

    LATE_FUSION: ``probability`` is a scorer or a column over l_* and r_* columns, 1 at most. Of a scorer that bounds token
    likeness only pairs that can bring a merge are found, and components of more than ``max_component`` members are split by
    them. For others all pairs inside a component are scored in advance, in a larger one when they are compared.

    INLINE_ENCODE: ``match`` is a function of two texts, or a model that takes batches (``of_texts``, as ``scorers.External``).
    The function runs as clusters are compared; models, and the function in larger components, answer in rounds."""
    relational(similarity)  # an unknown one is told at once
    pairs = _held(pairs.select("ltable_id", "rtable_id"), folder, "pairs")
    ids = pairs.select(F.col("ltable_id").alias("id")).unionByName(pairs.select(F.col("rtable_id").alias("id"))).distinct()
    if start is not None:
        start = _held(start.where("cluster_id IS NOT NULL").join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi"), folder, "start")
    found = _solve(pairs, records, edges, probability, alpha, threshold, strategy, text, match, folder, max_component, similarity, field, start, False)
    return ids.join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
