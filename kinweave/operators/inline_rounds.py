"""INLINE_ENCODE where answers come from a model in batches: the merge asks, Spark answers, until nothing is asked.

A similarity depends on both clusters' members alone, so an answer is known by the two sets (a sum of their members'
hashes each). In a round every open component is merged again from where it surely stands: with answers as far as there
are any, beyond them with the best answer about parts of the two clusters, which finds what will be asked for next. What was
merged before the first question is sure. Questions of all components go out together: members of both clusters meet, with
each cluster's contexts behind their texts; what the model said about two members and these contexts is remembered and
never asked twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.collective import _ROW, ASKED, _Clusters, _merges, _places, _row, context_tails
from kinweave.operators.components import _held

_BOUND = 1 << 128


def _hash(member: str) -> int:
    return int.from_bytes(hashlib.blake2b(member.encode(), digest_size=16).digest(), "big")


class Asking(_Clusters):
    """Clusters made of those a round starts with. ``asked``: key -> (clusters of the left, of the right, both tails)."""

    def __init__(self, members: dict[str, list[str]], contexts: dict[str, set], links, known: dict[str, float], field: str):
        super().__init__(sorted(members), contexts, links, (), None)
        self.sign = {c: sum(map(_hash, m)) % _BOUND for c, m in members.items()}
        self.size = {c: len(m) for c, m in members.items()}
        self.known, self.used, self.field = known, {}, field
        self.asked: dict[str, tuple] = {}
        self.weight = 0

    def similarity(self, a: str, b: str) -> float:
        a, b = sorted((a, b))
        key = f"{self.sign[a]:032x}{self.sign[b]:032x}"
        if key in self.known:
            self.used[key] = p = self.known[key]
            self.best[a][b] = self.best[b][a] = p
            return round(p, 3)
        if key not in self.asked:
            self.asked[key] = tuple(self.members[a]), tuple(self.members[b]), context_tails(self.contexts[a], self.contexts[b], self.field)
            self.weight += self.size[a] * self.size[b]
        return round(self.match(a, b), 3)

    def merge(self, a: str, b: str) -> str:
        root, gone = sorted((a, b))
        self.sign[root] = (self.sign[root] + self.sign.pop(gone)) % _BOUND
        self.size[root] += self.size.pop(gone)
        return super().merge(a, b)


def round_of(members: dict[str, list[str]], contexts: dict[str, set], links: list[tuple[str, str]], known: dict[str, float], threshold: float, field: str, most: int = ASKED) -> tuple[dict[str, str], list[tuple[str, str]], dict[str, float], list[tuple]]:
    """A round of one component: start cluster -> cluster after all sure merges, links of those, answers still of use, and questions (key, clusters of the left, of the right, tails). No question: the merge is over."""
    state, done, sure = Asking(members, contexts, links, known, field), [], 0

    def enough() -> bool:
        nonlocal sure
        if not state.asked:
            sure = len(done) + 1
        return state.weight >= most

    for a, b, _ in _merges(state, threshold, enough):
        done.append((a, b))
    asked, used = state.asked, state.used
    state = _Clusters(sorted(members), contexts, links, (), None)
    for a, b in done[:sure]:
        state.merge(a, b)
    place = _places(state)
    questions = [(key, sorted({place[x] for x in left}), sorted({place[x] for x in right}), tails) for key, (left, right, tails) in asked.items()]
    return place, [(a, b) for a in state.similar for b in state.similar[a] if a < b], used, questions


def _steps(threshold: float, field: str, most: int):
    """A round of components that stand one after the other in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        names = [c.split(" ", 1)[0] for c in _ROW.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string()]

        def over() -> pa.RecordBatch:
            of = [r for r in rows if r[0] == "member"]
            members, contexts = {}, {}
            for _, i, c, _, ctxs in of:
                members.setdefault(c, []).append(i)
                contexts.setdefault(c, set()).update(ctxs)
            known = {a: p for kind, a, _, p, _ in rows if kind == "known"}
            place, links, used, questions = round_of(members, contexts, [(a, b) for kind, a, b, _, _ in rows if kind == "link"], known, threshold, field, most)
            out = [("member", i, place[c], None, ctxs, None) for _, i, c, _, ctxs in of]
            if questions:
                out += [("link", a, b, None, None, None) for a, b in links] + [("known", a, None, p, None, None) for a, p in used.items()]
                for key, left, right, (x, y) in questions:
                    out += [("left", key, c, None, None, x) for c in left] + [("right", key, c, None, None, y) for c in right]
            return pa.RecordBatch.from_arrays([pa.array([current] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[1:], strict=True)]], names=names)

        for batch in batches:
            for component, *row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if component != current:
                    if current is not None:
                        yield over()
                    current, rows = component, []
                rows.append(row)
        if current is not None:
            yield over()

    return run


def in_rounds(nodes: DataFrame, linked: DataFrame, model, threshold: float, field: str, folder: str | None, most: int = ASKED) -> DataFrame:
    """(id, cluster_id). ``nodes``: component, id, ctxs, text (null: empty); ``linked``: component, a, b; ``model.of_texts(left, right)`` gives a column of probabilities."""
    text = nodes.select("component", "id", F.coalesce("text", F.lit("")).alias("line"))
    state = _row(nodes, "member", a=F.col("id"), b=F.col("id"), ctxs=F.col("ctxs")).unionByName(_row(linked, "link", a=F.col("a"), b=F.col("b")))
    memo: DataFrame | None = None
    over, round_ = None, 0
    names = ["l_id", "r_id", "l_tail", "r_tail"]
    while True:
        now = _held(state.repartition(F.xxhash64("component")).sortWithinPartitions("component").mapInArrow(_steps(threshold, field, most), _ROW), folder, f"inline{round_}")
        asked = now.where("kind = 'left'").select("component", F.col("a").alias("key"), F.col("b").alias("cluster"), F.col("text").alias("tail"))
        other = now.where("kind = 'right'").select("component", F.col("a").alias("key"), F.col("b").alias("cluster"), F.col("text").alias("tail"))
        members = now.where("kind = 'member'").select("component", F.col("a").alias("id"), F.col("b").alias("cluster_id"))
        open_ = asked.select("component").distinct()
        settled = members.join(open_, "component", "left_anti").select("id", "cluster_id")
        over = settled if over is None else over.unionByName(settled)
        if asked.isEmpty():
            return over
        lines = members.join(text, ["component", "id"]).select("component", F.col("cluster_id").alias("cluster"), "id", "line")
        side = lambda df, p: df.join(lines, ["component", "cluster"]).select("component", "key", F.col("id").alias(f"{p}_id"), F.md5("tail").alias(f"{p}_tail"), F.concat("line", "tail").alias(f"{p}_line"))  # noqa: E731, B023
        met = side(asked, "l").join(side(other, "r"), ["component", "key"])
        if memo is None:
            met = met.withColumn("p", F.lit(None).cast("double"))
        else:
            met = met.join(memo, names, "left")
        met = _held(met, folder, f"met{round_}")
        fresh = met.where("p IS NULL").groupBy(*names).agg(F.min("l_line").alias("l_line"), F.min("r_line").alias("r_line"))
        said = _held(fresh.select(*names, model.of_texts(F.col("l_line"), F.col("r_line")).alias("p")), folder, f"said{round_}")
        told = met.where("p IS NOT NULL").select("component", "key", "p").unionByName(met.where("p IS NULL").drop("p").join(said, names).select("component", "key", "p"))
        answers = told.groupBy("component", "key").agg(F.max("p").alias("p"))
        memo = said if memo is None else memo.unionByName(said)
        going = now.where("kind IN ('member', 'link', 'known')").join(open_, "component", "left_semi")
        state, round_ = going.unionByName(_row(answers, "known", a=F.col("key"), p=F.col("p"))), round_ + 1
