"""Operators against hand rows, plain restatements and DuckDB."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.functions import scores, text
from kinweave.functions.names import name_features, strip_diacritics
from kinweave.operators import collective, context, graph, metrics, pairs, scorers
from kinweave.operators.components import components
from kinweave.plans import registry
from kinweave.sources import config, files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    told = con.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    assert found == sorted(map(repr, told.select(*columns).fetchall()))


def test_flagship(spark):
    (row,) = registry.entry(spark, SF).collect()
    assert row.n > 0 and 0 <= row.f1 <= 1


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, out", [("nan", ""), (None, ""), ("a\t\n b", "a b"), ("  a ", "a"), ("nano", "nano"), ("a b", "a b")])
def test_sanitize(spark, value, out):
    assert _one(spark, text.sanitize, value) == out


@pytest.mark.parametrize("value, out", [("A B, ,C D,", ["A B", "C D"]), (None, []), ("", []), (" ,", [])])
def test_list_items(spark, value, out):
    assert _one(spark, text.list_items, value) == out


def test_list_separator_is_no_pattern(spark):
    assert _one(spark, lambda c: text.list_items(c, "|"), "a|b.c") == ["a", "b.c"]


NAMES = {
    "E Rahm": ("rahm", "e", "rahm e"),
    "Erhard Rahm": ("rahm", "e", "rahm erhard"),
    "J. D. Ullman": ("ullman", "j", "ullman j"),
    "J Ullman": ("ullman", "j", "ullman j"),
    "rahm": ("", "r", "rahm"),
    "A B": ("", "a", "a"),
    "Sørensen X": ("rensen", "s", "rensen s"),
    "": ("", "", ""),
    None: ("", "", ""),
}


@pytest.mark.parametrize("name", NAMES)
def test_name_features(spark, name):
    f = _one(spark, name_features, name)
    assert (f.last_name, f.first_initial, f.canon_full) == NAMES[name]


def test_middle_initial_is_the_second_letter_of_the_first_token(spark):
    assert _one(spark, name_features, "Erhard Rahm").middle_initial == "r"


def test_exact_decomposition(spark):
    assert _one(spark, lambda c: strip_diacritics(c, exact=True), "ﬁ é ß") == "fi e ß"
    assert _one(spark, strip_diacritics, "é Ä ñ ß ø") == "e A n ß ø"


def test_exact_decomposition_of_all_characters(spark):
    import sys
    import unicodedata

    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rng = random.Random(1)
    rare = [c for c in every if unicodedata.normalize("NFKD", c) != c]
    rows = ["".join(every[i : i + 4_096]) for i in range(0, len(every), 4_096)] + ["".join(rng.choice(rare + list("ab \n")) for _ in range(30)) for _ in range(300)] + ["", None]
    told = [None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", strip_diacritics(F.col("x"), exact=True).alias("y"))
    assert [r.y for r in sorted(df.collect())] == told
    assert "Python" not in df._jdf.queryExecution().toString()


def test_buckets_and_empty_sets(spark):
    rows = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,), (0.29,), (float("nan"),)], "x double").select(scores.bucket(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["zero", "medium", "high", "high", "low", "high"]
    empty = spark.createDataFrame([([], []), (["a"], []), (None, ["a"]), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r.y for r in empty.select(scores.jaccard(F.col("a"), F.col("b")).alias("y")).collect()] == [0.0, 0.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        scores.relational("none")


def test_softmax_does_not_overflow(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1000.0, -1000.0), (-1000.0, 1000.0)], "a double, b double")
    assert [r.y for r in rows.select(scores.match_probability(F.col("a"), F.col("b")).alias("y")).collect()] == [0.5, 0.0, 1.0]


def test_missing_pair_ids_are_an_error_and_repeated_keys_keep_the_first(spark):
    table = spark.createDataFrame([("1", "x", 1), ("1", "y", 0), ("2", "z", 2)], "id string, t string, pos int")
    first = pairs.first_by_key(table, "id", ["pos"])
    assert {(r.id, r.t) for r in first.collect()} == {("1", "y"), ("2", "z")}
    assert {r.id for r in pairs.numbered_keys(table, "id", ["pos"]).collect()} == {"1", "1#2", "2"}
    wrong = spark.createDataFrame([("1", "9", 1)], "ltable_id string, rtable_id string, label int")
    with pytest.raises(Exception, match="missing"):
        pairs.enrich(wrong, first, first).collect()
    assert pairs.enrich(wrong, first, first, missing="drop").count() == 0
    assert {tuple(r) for r in pairs.unmatched(wrong, first, first).collect()} == {("right", "9")}


def test_right_side_wins_and_triples_take_their_own_id(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, ctx string")
    b = spark.createDataFrame([("2", "z")], "id string, ctx string")
    assert {tuple(r) for r in context.merged_sides(a, b).collect()} == {("1", "x"), ("2", "z")}
    table = spark.createDataFrame([("7", "A, B")], "id string, authors string")
    assert {tuple(r) for r in context.triples(table, "authors").collect()} == {("A", "isAuthor", "7"), ("B", "isAuthor", "7")}


def _plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + ([(i, i + 1) for i in range(100, 140)] if seed else [])
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == _plain_components(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_write_no_more_files_than_edges_need(spark, tmp_path):
    """Every file costs calls of the file system, for each of which the local one starts a process."""
    edges = [(i, i + 1 + i % 7) for i in range(2000)]
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), folder=f"file://{tmp_path}").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == _plain_components(edges)
    rounds = list(tmp_path.glob("round*"))
    assert rounds and all(len(list(r.glob("part-*"))) <= spark.sparkContext.defaultParallelism for r in rounds)


def test_components_of_stars_take_no_round(spark, tmp_path):
    rounds = lambda name: sorted(p.name.split("-")[0] for p in (tmp_path / name).iterdir())
    star = spark.createDataFrame([("b", "a"), ("a", "c"), ("a", "d"), ("e", "f")], "a string, b string")
    assert sorted(map(tuple, components(star, folder=str(tmp_path / "star")).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")]
    assert rounds("star") == ["edges"]
    clique = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    assert sorted(map(tuple, components(clique, folder=str(tmp_path / "clique")).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert rounds("clique") == ["edges", "round0"]


def test_components_that_have_not_settled_are_not_told(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        components(chain, max_rounds=2)
    assert {r.component for r in components(chain).collect()} == {0}


def _plain_merge(ids, contexts, candidates, probability, threshold, alpha):
    """A global loop that scores all similar cluster pairs anew in each step."""
    groups = {i: {i} for i in ids}
    linked = {frozenset(c) for c in candidates}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            if not any(frozenset((x, y)) in linked for x in groups[a] for y in groups[b]):
                continue
            p = max(probability.get(frozenset((x, y)), 0.0) for x in groups[a] for y in groups[b])
            s, t = (set().union(*(contexts[x] for x in groups[g])) for g in (a, b))
            sim = (1 - alpha) * p + alpha * (len(s & t) / len(s | t) if s and t else 0.0)
            if sim >= threshold and (best is None or (-sim, a, b) < best):
                best = (-sim, a, b)
        if best is None:
            return {x: g for g, members in groups.items() for x in members}
        _, a, b = best
        groups[a] |= groups.pop(b)


@pytest.mark.parametrize("seed", range(60))
def test_merge_against_a_global_loop(seed):
    rng = random.Random(seed)
    ids = [f"r{i}" for i in range(rng.randint(1, 9))]
    every = list(itertools.combinations(ids, 2))
    candidates = [p for p in every if rng.random() < 0.4]
    digits = rng.choice((1, 6))
    probability = {frozenset(p): round(rng.random(), digits) for p in every}
    contexts = {i: {rng.choice("abcde") for _ in range(rng.randint(0, 3))} for i in ids}
    alpha, threshold = rng.choice((0.0, 0.3)), rng.choice((0.4, 0.6, 0.8))
    found = collective.merged(ids, contexts, candidates, [(a, b, probability[frozenset((a, b))]) for a, b in every], threshold, collective.late_fusion(alpha))[0]
    assert found == _plain_merge(ids, contexts, candidates, probability, threshold, alpha)


def test_bridge_of_a_pair_that_is_no_candidate():
    found = collective.merged(["r1", "r2", "r3"], {}, [("r1", "r2"), ("r2", "r3")], [("r1", "r2", 0.9), ("r2", "r3", 0.1), ("r1", "r3", 0.95)], 0.5, collective.late_fusion(0.0))[0]
    assert set(found.values()) == {"r1"}


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("most", [1, 10**9])
def test_merge_in_rounds_against_a_global_loop(seed, most):
    rng = random.Random(seed)
    ids = [f"r{i}" for i in range(rng.randint(1, 9))]
    every = list(itertools.combinations(ids, 2))
    candidates = [p for p in every if rng.random() < 0.4]
    digits = rng.choice((1, 6))
    probability = {frozenset(p): round(rng.random(), digits) for p in every}
    contexts = {i: {rng.choice("abcde") for _ in range(rng.randint(0, 3))} for i in ids}
    alpha, threshold = rng.choice((0.0, 0.3)), rng.choice((0.4, 0.6, 0.8))
    place, links, known, used = {i: i for i in ids}, candidates, [], set()
    while True:
        around = {r: set().union(*(contexts[i] for i in ids if place[i] == r)) for r in set(place.values())}
        root, links, known, asked = collective.progress(sorted(around), around, links, known, threshold, collective.late_fusion(alpha), most)
        place = {i: root[place[i]] for i in ids}
        if not asked:
            break
        for a, b in asked:
            assert not any({a, b} == {x, y} for x, y, _ in known)
            met = [frozenset((x, y)) for x in ids for y in ids if place[x] == a and place[y] == b]
            used.update(met)
            known.append((a, b, max(probability[p] for p in met)))
    assert place == _plain_merge(ids, contexts, candidates, probability, threshold, alpha)
    assert used <= set(probability)


def test_large_components_are_clustered_like_small_ones(spark):
    rng = random.Random(4)
    ids = [f"r{i:02}" for i in range(40)]
    records = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(4))) for i in ids[1:]], "id string, text string")  # one has no record
    edges = spark.createDataFrame([(i, rng.choice("uvwxyz")) for i in ids for _ in range(2)], "id string, ctx string")
    chain = [(a, b) for a, b in zip(ids[:25], ids[1:25], strict=False)] + [tuple(rng.sample(ids[:25], 2)) for _ in range(20)]
    found = spark.createDataFrame(chain + [(ids[30], ids[31]), (ids[35], ids[35])], "ltable_id string, rtable_id string")
    for strategy in ("LATE_FUSION", "INLINE_ENCODE"):
        of = lambda n: {r.id: r.cluster_id for r in collective.clusters(found, records, edges, scorers.TokenJaccard(["text"]).probability(), 0.2, 0.45, strategy, max_component=n).collect()}  # noqa: E731, B023
        told = of(1000)
        assert of(3) == told and of(1) == told and 1 < len(set(told.values())) < len(told)


def test_clusters_measures_and_order_of_rows(spark):
    rows = [("a1", "b1", 1), ("a1", "b2", 0), ("a2", "b2", 1)]
    found = spark.createDataFrame(rows, "ltable_id string, rtable_id string, label int")
    records = spark.createDataFrame([("a1", "red car"), ("b1", "red car"), ("a2", "blue boat"), ("b2", "blue boat")], "id string, text string")
    edges = spark.createDataFrame([("a1", "x"), ("b1", "x")], "id string, ctx string")
    for order in (found, found.orderBy(F.desc("rtable_id"))):
        for strategy in ("LATE_FUSION", "INLINE_ENCODE"):
            got = collective.clusters(order, records, edges, scorers.TokenJaccard(["text"]).probability(), 0.1, 0.5, strategy)
            assert {r.id: r.cluster_id for r in got.collect()} == {"a1": "a1", "b1": "a1", "a2": "a2", "b2": "a2"}
            (m,) = metrics.measures(metrics.predictions(found, got)).collect()
            assert (m.n, m.accuracy, m.f1) == (3, 1.0, 1.0)
    none = found.where("label > 1")
    assert collective.clusters(none, records, edges, scorers.TokenJaccard(["text"]).probability(), 0.1, 0.5).count() == 0
    (m,) = metrics.measures(none.withColumn("pred", F.lit(1))).collect()
    assert (m.n, m.precision, m.f1) == (0, 0.0, 0.0)


def test_external_scorer_loads_once_a_task(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "y")], "l_t string, r_t string")
    scorer = scorers.strategy("EXTERNAL", ["t"], lambda: lambda lines: [(0.0, 5.0 if a.split("\t")[0] == a.split("\t")[1] else -5.0) for a in lines])
    assert [round(r.p, 2) for r in rows.select(scorer.probability().alias("p")).collect()] == [0.99, 0.01]
    with pytest.raises(ValueError):
        scorers.strategy("NONE")


def test_gold_similarity_and_neighbourhoods(spark):
    p = spark.createDataFrame([("b", "a", 1), ("b", "c", 0)], "ltable_id string, rtable_id string, label int")
    assert {tuple(r) for r in graph.gold_similarity(p, p.where("label = 1")).collect()} == {("a", "b", 1.0), ("b", "c", 0.0)}
    parts = graph.gold_components(p)
    assert {tuple(r) for r in parts.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    edges = spark.createDataFrame([("a", "z"), ("b", "y"), ("b", "z")], "id string, ctx string")
    (row,) = graph.component_neighborhood(parts, edges, 1).where("component = 'a'").collect()
    assert (row.ctxs, row.top) == (["y", "z"], ["z"])


def test_csv_pair_text_and_export(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,title,authors,year\n1,"A ""q"", b","E Rahm,H Do",\n2,B,"E Rahm",1999\n')
    (tmp_path / "p.csv").write_text("ltable_id,rtable_id,label\n1,2,1\n")
    table = files.read_records(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in table.orderBy("id").collect()] == [("1", 'A "q", b', "E Rahm,H Do", ""), ("2", "B", "E Rahm", "1999")]
    found = files.read_pairs(spark, str(tmp_path / "p.csv"))
    assert found.dtypes == [("ltable_id", "string"), ("rtable_id", "string"), ("label", "int")] and files.read_pair_ids(spark, str(tmp_path / "p.csv")).columns == ["ltable_id"]
    files.write_records(table, str(tmp_path / "out"))
    assert files.read_records(spark, str(tmp_path / "out")).count() == 2
    lines = pairs.pair_text(pairs.enrich(found, table, table), ["title", "year"])
    files.write_pair_text(lines, str(tmp_path / "lines"))
    (line,) = files.read_pair_text(spark, str(tmp_path / "lines")).collect()
    assert line.left == 'COL title VAL A "q", b COL year VAL ' and line.label == 1
    tables = files.normalised(table)
    files.write_normalised(tables, str(tmp_path / "norm"))
    assert {len(r.ids) for r in spark.read.parquet(str(tmp_path / "norm/context_to_records")).collect()} == {1, 2}


def test_whole_run_with_both_namespaces(spark, tmp_path):
    from kinweave.plans.pipeline import read_split, run

    root = tmp_path / "toy"
    root.mkdir()
    (root / "tableA.csv").write_text('id,title,authors\n7,red car,"E Rahm"\n8,blue boat,"H Do"\n')
    (root / "tableB.csv").write_text('id,title,authors\n7,green house,"A Li"\n9,red car,"E Rahm"\n')
    (root / "test.csv").write_text("ltable_id,rtable_id,label\n7,9,1\n7,7,0\n")
    base = {"dataset": {"name": "toy", "data_dir": str(tmp_path)}, "run": {}, "algo": {"alpha": "0.1"}}
    shared = config.from_dict(base)
    sided = config.from_dict({**base, "dataset": {**base["dataset"], "id_namespace": "sided"}})
    (m,) = run(sided, read_split(spark, sided, "test"))[1].collect()
    assert m.accuracy == 1.0
    (m,) = run(shared, read_split(spark, shared, "test"))[1].collect()
    assert m.accuracy == 0.5  # equal ids of both sides are one record


def test_configuration_and_run_folders(tmp_path):
    with pytest.raises(ValueError, match="missing"):
        config.from_dict({"dataset": {"name": "x"}})
    with pytest.raises(ValueError, match="unknown"):
        config.from_dict({"dataset": {"name": "x"}, "run": {}, "algo": {"beta": 1}})
    c = config.from_dict({"dataset": {"name": "x"}, "run": {}, "algo": {}, "finetune": {"lr": "3e-5"}})
    assert c.finetune.lr == 3e-5 and c.table_path("a") == "data/x/tableA.csv" and c.algo.threshold == 0.5
    (tmp_path / "c.json").write_text('{"dataset": {"name": "x"}, "run": {}, "algo": {}}')
    assert config.load(str(tmp_path / "c.json")).dataset.name == "x"
    tasks = str(tmp_path / "tasks.json")
    assert config.register_task(tasks, {"name": "a"}) and not config.register_task(tasks, {"name": "a"})
    assert config.next_run(str(tmp_path)) == 0
    (tmp_path / "4").mkdir()
    assert config.next_run(str(tmp_path)) == 5
    assert config.run_log_name(0.3, 0.5).startswith("alpha_0_3_t_0_5_")
    assert config.run_logger("kinweave-test", str(tmp_path / "logs")).handlers


EXPERIMENT = """
dataset:
  dataset_dir: {root}/toy
  splits: [train, valid, test]
  split_ext: csv
  left_id_col: ltable_id
  right_id_col: rtable_id
  label_col: label
  prim_id_col: id
  context_field: authors
  context_sep: ","
  context_name_field: name
  table_configs:
    - [a, ltable_id]
    - [b, rtable_id]
run:
  run_name: toy_run
  output_root: {root}/out
  reduced_root: {root}/reduced
  logs_root: {root}/logs
  checkpoints_root: {root}/models
  ditto_configs_path: {root}/models/configs.json
  splits_dirname: splits
  model_filename: model.pt
algo:
  alpha: 0.3
  threshold: 0.6
  k: 2
  strategy: {strategy}
  rel_similarity: jaccard_coefficient
  is_relations_triples: true
  use_gpu: true
  fp16: true
finetune:
  enabled: true
  task: toy
  batch_size: 32
  lr: 3e-5
  n_epochs: 1
"""


@pytest.mark.parametrize("strategy", ["LATE_FUSION", "INLINE_ENCODE"])
def test_experiment_from_the_command_line(spark, tmp_path, strategy):
    pytest.importorskip("yaml")
    from kinweave.__main__ import main

    root = tmp_path / "toy"
    root.mkdir()
    (root / "tableA.csv").write_text('id,title,authors\n1,red car,"E Rahm"\n2,blue boat,"H Do"\n5,unused,"X Yz"\n')
    (root / "tableB.csv").write_text('id,title,authors\n3,red car,"Erhard Rahm, E Rahm"\n4,green house,"A Li"\n')
    for split in ("train", "valid", "test"):
        (root / f"{split}.csv").write_text("ltable_id,rtable_id,label\n 1 ,3,1\n2,4,0\n")
    (tmp_path / "e.yaml").write_text(EXPERIMENT.format(root=tmp_path, strategy=strategy))
    found = main(["--config", str(tmp_path / "e.yaml")])
    assert (found["accuracy"], found["f1"]) == (1.0, 1.0)
    assert {r.id for r in files.read_records(spark, str(tmp_path / "reduced/test_a.csv")).collect()} == {"1", "2"}
    lines = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / f"out/splits/toy_run/{name}.txt")).collect())
    assert lines("test") == ["COL title VAL blue boat\tCOL title VAL green house\t0", "COL title VAL red car\tCOL title VAL red car\t1"]
    if strategy == "INLINE_ENCODE":
        assert all(side.count(" COL authors VAL ") == 1 for line in lines("train") for side in line.split("\t")[:2])
        assert [line.count(" COL pairwise_summary VAL jac=high") for line in lines("train")] == [0, 2]
    else:
        assert lines("train") == lines("test")
    assert "f1: 1.00" in next((tmp_path / "logs").iterdir()).read_text()
    assert "testset" in (tmp_path / "models/configs.json").read_text()


def test_gold_similarity_of_clusters(spark):
    members = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "d"), ("4", "e")], "id string, cluster_id string")
    positives = spark.createDataFrame([("3", "2")], "ltable_id string, rtable_id string")
    asked = spark.createDataFrame([("c", "d"), ("d", "e")], "ltable_id string, rtable_id string")
    assert sorted(map(tuple, graph.gold_cluster_similarity(asked, members, positives).collect())) == [("c", "d", 1.0), ("d", "e", 0.0)]


def test_unknown_similarity_and_keys_under_two_names():
    with pytest.raises(ValueError, match="similarity"):
        collective.clusters(None, None, None, None, 0.1, 0.5, similarity="cosine")
    with pytest.raises(ValueError, match="two names"):
        config.from_dict({"dataset": {"name": "x"}, "run": {}, "algo": {"similarity": "a", "rel_similarity": "b"}})
    with pytest.raises(ValueError, match="tables"):
        config.from_dict({"dataset": {"name": "x", "tables": [["a", "other"], ["b", "rtable_id"]]}, "run": {}, "algo": {}})


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    told = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for corpus in (True, False):
        if not corpus:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-B", "-c", told], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def _k_match_rows(rng, attrs):
    records = [(str(i), rng.choice(attrs)) for i in range(60)]
    edges = [(str(rng.randrange(60)), f"e{rng.randrange(12)}") for _ in range(150)] * 2
    pairs = [(str(rng.randrange(62)), str(rng.randrange(62))) for _ in range(200)]
    return records, edges, pairs


@pytest.mark.parametrize("attrs", [["x", "y", "z", None], [f"a{i}" for i in range(90)]])
def test_k_match_against_brute_force(spark, monkeypatch, attrs):
    monkeypatch.setattr(graph, "BITS", 2)
    records, edges, pairs = _k_match_rows(random.Random(len(attrs)), attrs)
    attr, members, of = dict(records), {}, {}
    for i, e in set(edges):
        members.setdefault(e, []).append(i)
        of.setdefault(i, []).append(e)
    frames = spark.createDataFrame(pairs, "ltable_id string, rtable_id string"), spark.createDataFrame(records, "id string, attr string"), spark.createDataFrame(edges, "id string, edge string")
    for k in (1, 2, 4):
        told = {(a, b) for a, b in pairs if any(sum(m != n and attr[m] is not None and attr[m] == attr[n] for m in members[x] for n in members[y]) >= k for x in of.get(a, ()) for y in of.get(b, ()))}
        found = [(r.r1_id, r.r2_id) for r in graph.hyperedge_k_match(*frames, k).collect()]
        assert sorted(found) == sorted(told)


def test_k_match_counts_only_what_masks_leave_open(spark, monkeypatch):
    asked = []
    count = graph._k_common
    monkeypatch.setattr(graph, "_k_common", lambda a, *rest: asked.append(a.count()) or count(a, *rest))
    records, edges, pairs = _k_match_rows(random.Random(3), ["x", "y"])
    frames = spark.createDataFrame(pairs, "ltable_id string, rtable_id string"), spark.createDataFrame(records, "id string, attr string"), spark.createDataFrame(edges, "id string, edge string")
    met = {(x, y) for a, b in pairs for i, x in edges if i == a for j, y in edges if j == b}
    assert graph.hyperedge_k_match(*frames, 2).count() > 100 and asked[0] * 5 < len(met)


def test_k_match_is_proved_by_members_of_one_parity(spark, monkeypatch):
    asked = []
    count = graph._k_common
    monkeypatch.setattr(graph, "_k_common", lambda a, *rest: asked.append(a.count()) or count(a, *rest))
    hashed = [(r.id, r.h % 4) for r in spark.range(60).selectExpr("CAST(id AS STRING) AS id", "xxhash64(CAST(id AS STRING)) AS h").collect()]
    left, right = ([i for i, h in hashed if h == x][:4] for x in (0, 2))
    records = [(i, f"a{k}") for side in (left, right) for k, i in enumerate(side)]
    edges = [(i, "e") for i in left] + [(i, "f") for i in right]
    frames = spark.createDataFrame([(left[0], right[0])], "ltable_id string, rtable_id string"), spark.createDataFrame(records, "id string, attr string"), spark.createDataFrame(edges, "id string, edge string")
    assert graph.hyperedge_k_match(*frames, 4).count() == 1 and asked == [0]
    assert graph.hyperedge_k_match(*frames, 5).count() == 0 and asked == [0, 1]


def test_k_match_reads_edges_once_and_tells_equal_pairs(spark):
    records, edges, asked = _k_match_rows(random.Random(4), ["x", "y", "z", None])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    asked, edges = spark.createDataFrame(asked, "ltable_id string, rtable_id string"), spark.createDataFrame(edges, "id string, edge string")
    known = spark.createDataFrame(records, "id string, attr string").withColumn("t", F.col("attr"))
    members = known.select("id", "t")
    equal = graph.exact_match(pairs.enrich(asked, members, members, missing="drop"), ["t"])
    told = {tuple(r) for r in graph.hyperedge_k_match(asked, known, edges, 4).unionByName(equal).collect()}
    found = graph.hyperedge_k_match(asked, known, edges.mapInArrow(count, edges.schema), 4, same=["t"]).collect()
    assert sorted(map(tuple, found)) == sorted(told) and seen.value == edges.count()


@pytest.mark.parametrize("hub", [1, 1_000_000])
def test_a_round_of_components_joins_only_where_a_node_is_a_hub(spark, monkeypatch, hub):
    from kinweave.operators import components as module

    monkeypatch.setattr(module, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == _plain_components(edges)
    plan = module._round(frame.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v"), hub == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (hub == 1)


def test_k_match_proves_by_more_attributes_than_a_word_holds(spark, monkeypatch):
    asked = []
    count = graph._k_common
    monkeypatch.setattr(graph, "_k_common", lambda a, *rest: asked.append(a.count()) or count(a, *rest))
    hashed = [(r.id, r.h) for r in spark.range(60).selectExpr("CAST(id AS STRING) AS id", "pmod(xxhash64(CAST(id AS STRING)), 4) AS h").collect()]
    left, right = ([i for i, h in hashed if h == x][:4] for x in (0, 2))
    records = [(i, f"z{k}") for side in (left, right) for k, i in enumerate(side)] + [(f"o{k}", f"a{k % 96}") for k in range(288)]
    edges = [(i, "e") for i in left] + [(i, "f") for i in right]
    frames = spark.createDataFrame([(left[0], right[0])], "ltable_id string, rtable_id string"), spark.createDataFrame(records, "id string, attr string"), spark.createDataFrame(edges, "id string, edge string")
    assert graph.hyperedge_k_match(*frames, 4).count() == 1 and asked == [0]
    assert graph.hyperedge_k_match(*frames, 5).count() == 0


def test_pair_text_straight_from_labels(spark):
    a = spark.createDataFrame([("1", "x  y", None), ("2", None, "z")], "id string, title string, line string")
    b = spark.createDataFrame([("7", "Wü\tt")], "id string, name string")
    labels = spark.createDataFrame([(" 1\t", "7 ", 1, "k"), ("2", "7", None, "k"), ("2", "7", None, "k"), ("3", "7", 0, "k")], "ltable_id string, rtable_id string, label int, l_id string")
    rows = [(r.ltable_id, r.rtable_id, r.line) for r in pairs.text_from_labels(labels, a, b, missing="drop").collect()]
    right, second = "COL id VAL 7 COL name VAL Wü t", "COL id VAL 2 COL title VAL  COL line VAL z"
    assert sorted(rows) == [("1", "7", f"COL id VAL 1 COL title VAL x y COL line VAL \t{right}\t1"), *[("2", "7", f"{second}\t{right}")] * 2]
    with pytest.raises(Exception, match="a pair names a record that is missing"):
        pairs.text_from_labels(labels, a, b).collect()
    assert pairs.text_from_labels(labels.limit(0), a, b).count() == 0
