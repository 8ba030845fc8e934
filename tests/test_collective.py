"""Collective merging: pruned pairs, split components, inline encoding by models, the queue, the merge forest."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.functions.scores import LEVELS
from kinweave.operators import bootstrap, collective, context, forest, graph, inline_rounds, metrics, near, numbering, scorers
from kinweave.operators.components import GrowingComponents
from kinweave.operators.queue import AddressableQueue


@pytest.mark.parametrize("seed", range(30))
def test_queue_against_a_plain_list(seed):
    rng, queue, plain = random.Random(seed), AddressableQueue(), {}
    for _ in range(300):
        key = rng.randrange(25)
        what = rng.random()
        if what < 0.5:
            plain[key] = (rng.randrange(10), key)
            queue.put(key, plain[key])
        elif what < 0.75:
            assert queue.remove(key) == (plain.pop(key, None) is not None)
        elif plain:
            least = min(plain, key=plain.get)
            assert queue.top() == (least, plain[least]) and queue.pop() == (least, plain.pop(least))
        assert len(queue) == len(plain) and set(queue) == set(plain) and all(k in queue and queue.priority(k) == p for k, p in plain.items())
    assert queue.peak <= 25


def test_queue_of_a_merge_never_holds_more_than_the_links(monkeypatch):
    peaks = []

    class Watched(AddressableQueue):
        def put(self, key, priority):
            super().put(key, priority)
            peaks.append(len(self))

    monkeypatch.setattr(collective, "AddressableQueue", Watched)
    rng = random.Random(1)
    ids = [f"r{i:02}" for i in range(40)]
    links = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(120)})
    near_ = [(a, b, round(rng.random(), 2)) for a, b in itertools.combinations(ids, 2)]
    place, merges = collective.merged(ids, {}, links, near_, 0.3, collective.late_fusion(0.0))
    assert max(peaks) <= len(links) and len(merges) == len(ids) - len(set(place.values())) > 5


def _plain(ids, contexts, candidates, probability, threshold, alpha):
    groups, linked = {i: {i} for i in ids}, {frozenset(c) for c in candidates}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            if not any(frozenset((x, y)) in linked for x in groups[a] for y in groups[b]):
                continue
            p = max(probability(x, y) for x in groups[a] for y in groups[b])
            s, t = (set().union(*(contexts.get(x, set()) for x in groups[g])) for g in (a, b))
            sim = (1 - alpha) * p + alpha * (len(s & t) / len(s | t) if s and t else 0.0)
            if sim >= threshold and (best is None or (-sim, a, b) < best):
                best = (-sim, a, b)
        if best is None:
            return {x: g for g, members in groups.items() for x in members}
        groups[best[1]] |= groups.pop(best[2])


def _jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def _graph(seed, n=26, copies=6):
    rng = random.Random(seed)
    ids = [f"r{i:02}" for i in range(n)]
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))) for i in ids[1:]}  # one has no record
    texts |= {i: texts[ids[1]] for i in ids[2 : 2 + copies]}
    contexts = {i: {rng.choice("uvwxyz") for _ in range(rng.randint(0, 2))} for i in ids}
    links = [tuple(rng.sample(ids[:20], 2)) for _ in range(26)] + [tuple(rng.sample(ids[20:], 2)) for _ in range(4)] + [(ids[0], ids[0])]
    return ids, texts, contexts, links


def _frames(spark, texts, contexts, links):
    records = spark.createDataFrame(sorted(texts.items()), "id string, text string")
    edges = spark.createDataFrame([(i, c) for i, cs in contexts.items() for c in cs] or [("none", "none")], "id string, ctx string")
    return spark.createDataFrame(links, "ltable_id string, rtable_id string"), records, edges


@pytest.mark.parametrize("seed, alpha, threshold", [(1, 0.2, 0.45), (2, 0.0, 0.3), (3, 0.5, 0.4), (5, 1.0, 0.5), (6, 0.1, 1.5)])
def test_pruned_pairs_give_the_clusters_of_all_pairs(spark, seed, alpha, threshold):
    ids, texts, contexts, links = _graph(seed)
    scorer = scorers.TokenJaccard(["text"])
    told = _plain(sorted({x for p in links for x in p}), contexts, links, lambda x, y: _jaccard(texts.get(x, ""), texts.get(y, "")), threshold, alpha)
    frames = _frames(spark, texts, contexts, links)
    for most in (6, 1_000) if seed == 1 else (1_000,):  # split, whole
        found = collective.clusters(*frames, scorer, alpha, threshold, max_component=most)
        assert {r.id: r.cluster_id for r in found.collect()} == told
    if seed == 5:
        assert {r.id: r.cluster_id for r in collective.clusters(*frames, scorer.probability(), alpha, threshold).collect()} == told


def test_only_near_pairs_are_scored_and_copies_once(spark):
    ids, texts, _, _ = _graph(7, 40, 15)
    parts = spark.createDataFrame([(i, "c") for i in ids], "id string, component string")
    records = spark.createDataFrame(sorted(texts.items()), "id string, text string")
    scorer = scorers.TokenJaccard(["text"])
    members = near.classed(parts, records, scorer.identity())
    kinds = {r.id: r.cls for r in members.where("known").collect()}
    for least in (0.0, 0.34, 0.5, 1.0):
        found = {(r.a, r.b): r.p for r in near.near_pairs(members, ["text"], scorer.token_set(), scorer.probability(), least - near.SLACK, max(least - near.SLACK, 0.0)).collect()}
        told = {}
        for x, y in itertools.combinations(sorted(texts), 2):
            p = _jaccard(texts[x], texts[y])
            if p >= least and (x != y):
                told[tuple(sorted((kinds[x], kinds[y])))] = p
        assert {k: v for k, v in found.items() if v > 0} == pytest.approx({k: v for k, v in told.items() if v > 0})
        assert len(found) <= len(set(kinds.values())) * (len(set(kinds.values())) + 1) / 2


def test_cells_split_where_nobody_is_near(spark):
    ids = [f"r{i:03}" for i in range(30)]
    texts = {i: f"t{k // 10} u{k // 10} v{k % 3}" for k, i in enumerate(ids)}
    links = list(itertools.pairwise(ids))
    frames = _frames(spark, texts, {}, links)
    members = near.classed(spark.createDataFrame([(i, "r000") for i in ids], "id string, component string"), frames[1], scorers.TokenJaccard(["text"]).identity())
    scorer = scorers.TokenJaccard(["text"])
    pairs = near.near_pairs(members, ["text"], scorer.token_set(), scorer.probability(), 0.5, 0.5)
    linked = spark.createDataFrame([("r000", a, b) for a, b in links], "component string, a string, b string")
    found = {r.id: r.component for r in near.cells(linked, members, pairs).collect()}
    assert found == {i: ids[k // 10 * 10] for k, i in enumerate(ids)}


def test_logistic_bounds_token_likeness(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "l_t string, r_t string")
    for weights, intercept, least in (([6.0, 1.0], -3.0, 0.6), ([5.0, -1.0], -2.0, 0.5), ([1.0, 4.0], -3.0, 0.5), ([-1.0, 2.0], 0.0, 0.5)):
        scorer = scorers.Logistic(["t"], weights, intercept)
        bound = scorer.least_jaccard(least)
        if bound is None:
            continue
        j = scorers.TokenJaccard(["t"]).probability()
        assert rows.where((scorer.probability() >= least) & (j < bound - 1e-9)).count() == 0 and bound > 0
    assert scorers.Logistic(["t"], [6.0, 1.0], -3.0).least_jaccard(0.6) is not None and scorers.Logistic(["t"], [-1.0, 2.0], 0.0).least_jaccard(0.5) is None


# --- inline encoding -------------------------------------------------------------------------------------------


def _plain_inline(ids, texts, contexts, links, threshold, match, field="context", k=5):
    groups, linked = {i: {i} for i in ids}, {frozenset(c) for c in links}

    def sim(a, b):
        x, y = (set().union(*(contexts.get(m, set()) for m in groups[g])) for g in (a, b))
        j = len(x & y) / len(x | y) if x and y else 0.0
        level = "zero" if j == 0 else next((n for n, e in LEVELS if j < e), "high")
        tail = [f' , {field} : "{" | ".join(sorted(c)[:k])}" , pairwise_summary : "jac={level}"' for c in (x, y)]
        return round(max(match(texts.get(m, "") + tail[0], texts.get(n, "") + tail[1]) for m in groups[a] for n in groups[b]), 3)

    while True:
        best = min(((-sim(a, b), a, b) for a, b in itertools.combinations(sorted(groups), 2) if any(frozenset((x, y)) in linked for x in groups[a] for y in groups[b])), default=None)
        if best is None or -best[0] < threshold:
            return {x: g for g, members in groups.items() for x in members}
        groups[best[1]] |= groups.pop(best[2])


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("most", [1, 10**9])
def test_inline_rounds_against_a_plain_loop(seed, most):
    rng = random.Random(seed)
    ids = [f"r{i}" for i in range(rng.randint(2, 9))]
    texts = {i: " ".join(rng.choice("abcde") for _ in range(3)) for i in ids}
    contexts = {i: {rng.choice("uvwxyz") for _ in range(rng.randint(0, 3))} for i in ids}
    links = [p for p in itertools.combinations(ids, 2) if rng.random() < 0.5]
    threshold = rng.choice((0.2, 0.5, 0.7))
    place, known, now, asked_before = {i: i for i in ids}, {}, links, set()
    for _ in range(200):
        members = {}
        for i, c in place.items():
            members.setdefault(c, []).append(i)
        around = {c: set().union(*(contexts[i] for i in m)) for c, m in members.items()}
        root, now, used, questions = inline_rounds.round_of(members, around, now, known, threshold, "context", most)
        place = {i: root[c] for i, c in place.items()}
        if not questions:
            break
        known = dict(used)
        for key, left, right, tails in questions:
            met = [(m, n) for m in ids for n in ids if place[m] in left and place[n] in right]
            known[key] = max(collective.token_match(texts[m] + tails[0], texts[n] + tails[1]) for m, n in met)
            asked_before.add(key)
    assert place == _plain_inline(ids, texts, contexts, links, threshold, collective.token_match)


def _bags():
    return lambda lines: [(0.0, 8 * _jaccard(*line.split("\t")[:2]) - 4) for line in lines]


def test_inline_encoding_by_an_external_model(spark):
    ids, texts, contexts, links = _graph(9)
    links = links[:9] + links[-2:]
    frames = _frames(spark, texts, contexts, links)
    import math

    match = lambda a, b: 1 / (1 + math.exp(4 - 8 * _jaccard(a, b)))
    told = _plain_inline(sorted({x for p in links for x in p}), texts, contexts, links, 0.3, match)
    found = collective.clusters(*frames, None, 0.2, 0.3, "INLINE_ENCODE", match=scorers.External(["text"], _bags))
    assert {r.id: r.cluster_id for r in found.collect()} == told and 1 < len(set(told.values())) < len(told)
    plain = collective.clusters(*frames, None, 0.2, 0.55, "INLINE_ENCODE")
    rounds = collective.clusters(*frames, None, 0.2, 0.55, "INLINE_ENCODE", max_component=3)
    assert sorted(plain.collect()) == sorted(rounds.collect())


def test_external_text_is_the_record_as_it_is_with_its_id(spark):
    seen = spark.createDataFrame([("1", "nan  x", None, "2", " Y ", "z")], "l_id string, l_t string, l_u string, r_id string, r_t string, r_u string")
    told = 'id : "1" , t : "nan  x"\tid : "2" , t : " Y " , u : "z"\t0'
    scorer = scorers.External(["t", "u"], lambda: lambda lines: [(0.0, 50.0 if line == told else -50.0) for line in lines])
    assert seen.select(scorer.probability().alias("p")).first().p > 0.99


def test_members_joined_before_start_together(spark):
    rows = [("a", "b"), ("c", "d")]
    frames = _frames(spark, {"a": "x", "b": "y", "c": "x", "d": "x"}, {}, rows)
    start = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", None), ("unknown", "a")], "id string, cluster_id string")
    found = collective.clusters(*frames, scorers.TokenJaccard(["text"]), 0.0, 0.9, start=start)
    assert {r.id: r.cluster_id for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a"}
    assert {r.id: r.cluster_id for r in collective.clusters(*frames, scorers.TokenJaccard(["text"]), 0.0, 0.9).collect()} == {"a": "a", "b": "b", "c": "c", "d": "c"}


# --- forest, growing components, numbering, bootstrap ----------------------------------------------------------


def test_a_forest_cut_anywhere_is_a_run_at_that_threshold(spark):
    rng = random.Random(12)
    ids, texts, contexts, links = _graph(11, 40)
    frames = _frames(spark, texts, contexts, links)
    scorer = scorers.TokenJaccard(["text"])
    found = forest.merge_forest(*frames, scorer, 0.3, 0.2).cache()
    by = {}
    for r in sorted(found.collect()):
        by.setdefault(r.component, []).append(r)
    assert any(b.sim > a.sim for rows in by.values() for a, b in itertools.pairwise(rows))  # up and down along the way
    for rows in by.values():
        assert [r.step for r in rows] == list(range(1, len(rows) + 1)) and [r.level for r in rows] == list(itertools.accumulate((r.sim for r in rows), min))
    asked = [0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]
    nodes = sorted({x for p in links for x in p})
    placed = {}
    for r in forest.clusters_at(spark.createDataFrame([(i,) for i in nodes], "id string"), found, asked).collect():
        placed.setdefault(r.threshold, {})[r.id] = r.cluster_id
    labelled = [(a, b, rng.randrange(2)) for a, b in itertools.combinations(nodes, 2)]
    pairs = spark.createDataFrame(labelled, "ltable_id string, rtable_id string, label int")
    swept = {r.threshold: tuple(r)[1:] for r in forest.threshold_sweep(pairs, found, asked).collect()}
    for t in asked:
        told = _plain(nodes, contexts, links, lambda x, y: _jaccard(texts.get(x, ""), texts.get(y, "")), t, 0.3)
        assert placed[t] == told
        tp = sum(y for a, b, y in labelled if told[a] == told[b])
        assert swept[t][0] == len(labelled) and swept[t][3] == pytest.approx(tp / sum(y for _, _, y in labelled), abs=1e-6)
    assert swept[0.2] == tuple(metrics.measures(metrics.predictions(pairs, collective.clusters(*frames, scorer, 0.3, 0.2))).first())


def _counted(spark, frame):
    """(the frame, a counter of its rows each time they are made)."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), seen


@pytest.mark.parametrize("of", ["clusters", "forest"])
def test_candidates_are_made_once(spark, of):
    _, texts, contexts, links = _graph(5, 30)
    pairs, *rest = _frames(spark, texts, contexts, links)
    told = pairs.count()
    pairs, seen = _counted(spark, pairs)
    (collective.clusters if of == "clusters" else forest.merge_forest)(pairs, *rest, scorers.TokenJaccard(["text"]), 0.3, 0.5).collect()
    assert seen.value == told


def test_a_sweep_seeks_no_components(spark, monkeypatch):
    from kinweave.operators import components

    merges = spark.createDataFrame([("a", 1, "a", "b", 0.9, 0.9), ("a", 2, "c", "d", 0.5, 0.5), ("a", 3, "a", "c", 0.7, 0.5)], "component string, step long, a string, b string, sim double, level double")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "d", 1), ("d", "z", 0), (None, "a", 1)], "ltable_id string, rtable_id string, label int")
    monkeypatch.setattr(components, "_state", lambda *_: pytest.fail("components are sought"))
    assert sorted((r.threshold, r.n, r.recall) for r in forest.threshold_sweep(pairs, merges, [0.5, 0.95, 0.6]).collect()) == [(0.5, 3, 1.0), (0.6, 3, 0.5), (0.95, 3, 0.0)]


def test_classes_of_few_members_are_compared_without_tokens(spark):
    rng = random.Random(8)
    rows = [(f"c{i // 5}", f"i{i}", " ".join(rng.choices("abcde", k=rng.randrange(4)))) for i in range(60)]
    records = spark.createDataFrame([r[1:] for r in rows], "id string, text string")
    scorer = scorers.TokenJaccard(["text"])
    members = near.classed(spark.createDataFrame([r[:2] for r in rows], "component string, id string"), records, scorer.identity())
    for least in (0.0, 0.3):
        told = [sorted(map(tuple, near.near_pairs(members, ["text"], scorer.token_set(), scorer.probability(), least, least, False, n).collect())) for n in (None, 5)]
        assert told[0] == told[1] and len(told[0]) > 10


def test_components_that_grow(spark):
    rng = random.Random(6)
    grown, edges = GrowingComponents(spark), []
    for n in (0, 30, 40):
        more = [(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(n)]
        edges += more
        grown.add(spark.createDataFrame([*more, (None, "n1"), ("n2", None)], "a string, b string"))
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        told = {x: find(x) for x in root}
        assert {r.node: r.component for r in grown.labels.collect()} == told and grown.labels.count() == len(told)
    grown.union("alone", "n999")
    assert {r.node: r.component for r in grown.find(spark.createDataFrame([("n999",), ("never",)], "node string")).collect()} == {"n999": "alone", "never": None}
    assert {r.component: r.n for r in grown.sets().collect()} == {c: list(told.values()).count(c) for c in set(told.values())} | {"alone": 2}


def test_an_addition_leaves_other_parts_as_they_are(spark):
    grown = GrowingComponents(spark).add(spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(60)], "a string, b string"))
    before = {p for paths in grown._paths.values() for p in paths}
    grown.union("a1", "a2")
    kept = before & {p for paths in grown._paths.values() for p in paths}
    assert len(before) - len(kept) == 1 and grown.labels.count() == 120


def test_numbers_by_ranges(spark):
    rows = [("x", f"{i:04}") for i in range(500)] + [(None, "a"), (None, None), ("y", None)]
    df = spark.createDataFrame(rows, "r string, s string").repartition(7)
    found = sorted((r.number, r.r, r.s) for r in numbering.numbered(df, ["r", "s"]).collect())
    assert [n for n, *_ in found] == list(range(len(rows))) and [x for _, *x in found] == sorted(map(list, rows), key=lambda x: [(c is not None, c or "") for c in x])
    assert numbering.numbered(df.where("false"), ["r"]).collect() == []


def _exchanges(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_move_no_pairs_but_those_of_wide_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "WIDE", 3)
    rng = random.Random(seed)
    rows = [(f"i{rng.randrange(25)}", f"c{rng.randrange(12)}") for _ in range(60)] + [(f"h{k}", f"c{c}") for k in range(2) for c in range(12)] + [("i1", None), (None, "c1"), ("i1", "c1"), ("i1", "c1")]
    edges = spark.createDataFrame(rows, "id string, ctx string")
    by = {}
    for i, c in rows:
        if i is not None and c is not None:
            by.setdefault(i, set()).add(c)
    told = sorted((a, b) for a in by for b in by if a < b and by[a] & by[b])
    assert sorted(map(tuple, graph.neighbor_edges(edges).collect())) == told
    classes = graph.context_classes(edges)
    at = {r.id: r.class_id for r in classes.collect()}
    for cell in (2, 2_000):
        found = sorted(map(tuple, graph.neighbor_classes(edges, classes, cell=cell).collect()))
        reps = sorted(set(at.values()))
        assert found == sorted((a, b, len(by[a] & by[b])) for a in reps for b in reps if by[a] & by[b] and (a < b or a == b and sum(c == a for c in at.values()) > 1))


def test_pairs_of_neighbours_are_not_shuffled(spark):
    rows = [(f"i{k}", c) for k in range(60) for c in ("c1", "c2", f"d{k % 4}")]
    pairs, _ = graph._met(*(graph._carried(spark.createDataFrame(rows, "id string, c string").distinct()).select(F.col("id").alias(i), "c", F.col("before").alias(x)) for i, x in ("ax", "by")), ["c"])
    assert pairs.count() == 60 * 59 // 2 and not any("(a" in x for x in _exchanges(pairs.select("a", "b")))


def test_ids_of_a_context_meet_in_parts(spark):
    rows = [(f"{i}", c) for i in range(300) for c in ("hub", f"c{i % 7}")] + [("1", "hub"), (None, "hub"), (None, "none"), ("2", None)]
    found = context.context_to_primary(spark.createDataFrame(rows, "id string, ctx string"))
    told = {}
    for i, c in rows:
        told.setdefault(c, set()).update([] if i is None else [i])
    assert {r.ctx: (r.n_ids, r.ids) for r in found.collect()} == {c: (len(s), sorted(s)) for c, s in told.items()}
    assert any("ctx" in x and "_part" in x for x in _exchanges(found))


def test_resolved_names_are_worked_out_once_each(spark):
    names = ["A. Lovelace", "a lovelace", "B Lovelace", "X", None, "", "Ada, Lovelace"]
    rows = [(f"r{k}", k % 3 + 1, names[k % len(names)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, pos int, name string").repartition(5)
    found = context.resolved(df)
    plain = context.entities(context.mentions(df)).select(found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "hashpartitioning(name" not in plan  # no mention is taken apart, none moves
    assert context.resolved(df.where("false")).count() == 0


def test_typed_hyperedges_keep_null_relations_and_deal_one_relation_to_ranges(spark):
    rows = [("s1", "wrote", "p1"), ("s1", "wrote", "p1"), ("s1", None, "p2"), (None, "wrote", "p3"), ("s1", "wrote", "p2"), (None, None, None)]
    found = sorted(map(tuple, context.typed_hyperedges(spark.createDataFrame(rows, "source string, relation string, target string")).collect()), key=repr)
    assert found == sorted([("e0", None, None, None), ("e1", None, "s1", "p2"), ("e2", "wrote", None, "p3"), ("e3", "wrote", "s1", "p1"), ("e3", "wrote", "s1", "p2")], key=repr)
    one = spark.createDataFrame([("s%d" % i, "wrote", "p") for i in range(400)], "source string, relation string, target string").repartition(4)
    assert {r.edge_id for r in context.typed_hyperedges(one).collect()} == {f"e{i}" for i in range(400)}
    ranged = numbering.stored(one.repartitionByRange(4, "relation", "source"), "ranges")
    assert ranged.select(F.input_file_name()).distinct().count() == 4


def test_bootstrap_and_quotient(spark):
    ids = spark.createDataFrame([(x,) for x in "abcdef"] + [("a",), (None,)], "id string")
    exact = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "f")], "r1_id string, r2_id string")
    by_k = spark.createDataFrame([("d", "e")], "r1_id string, r2_id string")
    joined = bootstrap.bootstrap(ids, exact, by_k)
    assert {r.id: r.cluster_id for r in joined.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r.id: r.cluster_id for r in bootstrap.bootstrap(ids).collect()} == {x: x for x in "abcdef"}
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "a"), ("f", "f")], "ltable_id string, rtable_id string")
    edges = spark.createDataFrame([("a", "u"), ("c", "u"), ("d", "u"), ("f", "v")], "id string, ctx string")
    table = bootstrap.quotient(joined, pairs, edges)
    rows = sorted(map(tuple, table.collect()))
    assert [r for r in rows if r[0] != "member"] == [("context", "a", "u"), ("context", "d", "u"), ("context", "f", "v"), ("similar", "a", "d"), ("similar", "d", "a")]
    assert sorted(map(tuple, bootstrap.members_of(table).collect())) == sorted(map(tuple, joined.collect()))
    assert [tuple(r) for r in bootstrap.neighbor_clusters(table).collect()] == [("a", "d")]


def test_the_quotient_query_makes_clusters_once(spark, monkeypatch):
    from kinweave.plans import queries

    seen, sf = spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = queries.fixture(spark, sf, "er_pairs")
    alone = found.selectExpr("ltable_id AS id").union(found.selectExpr("rtable_id")).distinct().selectExpr("id", "id AS cluster_id")
    monkeypatch.setattr(queries, "_bootstrapped", lambda *_: alone.mapInArrow(count, alone.schema))
    kinds = {r.kind: r["count"] for r in queries.quotient_graph(spark, sf).groupBy("kind").count().collect()}
    assert set(kinds) == {"member", "context", "similar"} and seen.value == kinds["member"]


def test_links_of_classes_are_told_by_blocks_of_pairs(monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 3)
    rng = random.Random(5)
    sets = {f"i{k:02}": sorted(rng.sample([f"c{x}" for x in range(9)], rng.randint(1, 4))) for k in range(20)}
    sets["wide"] = [f"c{x}" for x in range(9)]
    rows = sorted((c, 0, 0, i, 0, *((None, None) if i == "wide" else (s[:k], s[k + 1 :]))) for i, s in sets.items() for k, c in enumerate(s))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("c", "i", "j", "class_id", "at", "before", "after"), r, strict=True)) for r in rows[k : k + 7]], pa.schema([("c", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("class_id", pa.string()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])) for k in range(0, len(rows), 7)]
    told = {wide: [tuple(r.values()) for b in graph._links(wide)(iter(batches)) for r in b.to_pylist()] for wide in (False, True)}
    common = {(a, b): len(set(sets[a]) & set(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if set(sets[a]) & set(sets[b])}
    assert sorted(told[False]) == sorted((a, b, n) for (a, b), n in common.items() if b != "wide")
    assert sorted(told[True]) == sorted((a, b, 1) for (a, b), n in common.items() if b == "wide" for _ in range(n))


def test_neighbour_classes_say_what_pairs_of_ids_do(spark):
    rng = random.Random(3)
    rows = [(f"r{i:02}", rng.choice("uvwxyz")) for i in range(40) for _ in range(rng.randint(0, 2))]
    rows += [(f"h{i:02}", "hub") for i in range(30)] + [(f"h{i:02}", f"own{i}") for i in range(10)] + [("r01", "hub"), (None, "hub"), ("r02", None), ("r00", "u"), ("r00", "u")]
    edges = spark.createDataFrame(rows, "id string, ctx string")
    classes = graph.context_classes(edges)
    member = {r.id: r.class_id for r in classes.collect()}
    sets = {}
    for i, c in rows:
        if i is not None and c is not None:
            sets.setdefault(i, set()).add(c)
    assert member == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    told = {tuple(sorted((i, j))) for i, j in itertools.combinations(sets, 2) if sets[i] & sets[j]}
    for cell in (1, 7, 2_000):
        links = {(r.a, r.b): r.n for r in graph.neighbor_classes(edges.where("id IS NOT NULL AND ctx IS NOT NULL"), classes, cell=cell).collect()}
        assert all(n == len(sets[a] & sets[b]) for (a, b), n in links.items())
        assert {(i, j) for i, j in told} == {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if tuple(sorted((member[i], member[j]))) in links}
    assert told == {tuple(r) for r in graph.neighbor_edges(edges.where("id IS NOT NULL")).collect()}


def test_a_learned_matcher_beats_two_features(spark):
    """Titles whose last words mean the same match, others don't: likeness of tokens or characters can't tell."""
    rng = random.Random(4)
    same = [("car", "automobile"), ("big", "large"), ("street", "road"), ("begin", "start")]
    rows = []
    for i in range(900):
        words = [rng.choice(("graph", "data", "query", "index", "stream", "cloud")) for _ in range(3)]
        left, match = rng.randrange(4), i % 2
        right = left if match else (left + 1 + rng.randrange(3)) % 4
        rows.append((" ".join([*words, same[left][0]]), " ".join([*words, same[right][1]]), match, ("train", "valid", "test")[i % 3]))
    df = spark.createDataFrame(rows, "l_t string, r_t string, label int, split string").cache()
    of = lambda s: df.where(F.col("split") == s)
    learned = scorers.TextMatcher.fit(of("train"), of("valid"), ["t"], bits=10)
    plain = scorers.Logistic.fit(of("train"), ["t"])
    f1 = lambda m: metrics.measures(of("test").withColumn("pred", (m.probability() >= 0.5).cast("int"))).first().f1
    assert f1(learned) > 0.95 > f1(plain)
    with pytest.raises(ValueError):
        scorers.TextMatcher.fit(df.where("label = 1"), of("valid"), ["t"])
