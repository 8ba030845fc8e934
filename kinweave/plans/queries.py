"""The registered queries: one for each operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scores, text
from kinweave.functions.names import name_features
from kinweave.operators import bootstrap, collective, context, forest, graph, metrics, pairs, scorers
from kinweave.operators.components import GrowingComponents, checkpoint_root, stored
from kinweave.plans.fixtures import fixture, with_fixtures
from kinweave.plans.registry import query
from kinweave.sources import files, positions

ALPHA, THRESHOLD = 0.3, 0.5
ATTRIBUTES = ["title", "venue", "year"]


def _fx(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, sf_dir, n) for n in names]


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = _fx(spark, sf_dir, "er_primary", "er_pairs")
    records = records.drop("side")
    return pairs.enrich(found, records, records)


_E = """e AS (SELECT p.*, a.title AS l_title, a.venue AS l_venue, a.year AS l_year, b.title AS r_title, b.venue AS r_venue, b.year AS r_year
    FROM er_pairs p JOIN er_primary a ON a.id = p.ltable_id JOIN er_primary b ON b.id = p.rtable_id)"""
_TOKENS = "list_distinct(string_split(lower(concat_ws(' ', {0}title, {0}venue, {0}year)), ' '))"
_L, _R = _TOKENS.format("l_"), _TOKENS.format("r_")
_JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_PROB = _JACCARD.format(_L, _R)


# --- reduction, enrichment, text -------------------------------------------------------------------------------


@query("reduce_semi_join", with_fixtures("SELECT id, title, venue, year FROM er_primary WHERE id IN (SELECT ltable_id FROM er_pairs WHERE split = 'test')"))
def reduce_semi_join(spark, sf_dir):
    records, found = _fx(spark, sf_dir, "er_primary", "er_pairs")
    return pairs.reduce_source(records, found.where("split = 'test'")).select("id", *ATTRIBUTES)


@query("enrich_pairs", with_fixtures("SELECT ltable_id, rtable_id, label, split, l_title, l_venue, l_year, r_title, r_venue, r_year FROM e", _E))
def enrich_pairs(spark, sf_dir):
    return _enriched(spark, sf_dir).drop("l_id", "r_id")


@query(
    "unmatched_pairs",
    with_fixtures(
        "SELECT DISTINCT side, id FROM (SELECT 'left' AS side, ltable_id AS id FROM er_pairs WHERE ltable_id NOT IN (SELECT id FROM er_primary WHERE side = 'a') UNION ALL SELECT 'right', rtable_id FROM er_pairs WHERE rtable_id NOT IN (SELECT id FROM er_primary WHERE side = 'b')) AS u"
    ),
)
def unmatched_pairs(spark, sf_dir):
    records, found = _fx(spark, sf_dir, "er_primary", "er_pairs")
    return pairs.unmatched(found, records.where("side = 'a'"), records.where("side = 'b'"))


def _training(p: str) -> str:
    return " || ' ' || ".join(f"'COL {c} VAL ' || trim(regexp_replace({p}{c}, '\\s+', ' ', 'g'))" for c in ATTRIBUTES)


@query("pair_text", with_fixtures(f"SELECT ltable_id, rtable_id, {_training('l_')} || chr(9) || {_training('r_')} || chr(9) || CAST(label AS VARCHAR) AS line FROM e", _E))
def pair_text(spark, sf_dir):
    return pairs.pair_text(_enriched(spark, sf_dir), ATTRIBUTES).select("ltable_id", "rtable_id", "line")


_with_id = lambda p: f"'COL id VAL ' || trim(regexp_replace({'ltable_id' if p == 'l_' else 'rtable_id'}, '\\s+', ' ', 'g')) || ' ' || {_training(p)}"


@query("pair_text_from_labels", with_fixtures(f"SELECT ltable_id, rtable_id, {_with_id('l_')} || chr(9) || {_with_id('r_')} || chr(9) || CAST(label AS VARCHAR) AS line FROM e", _E))
def pair_text_from_labels(spark, sf_dir):
    records, labels = _fx(spark, sf_dir, "er_primary", "er_pairs")
    records = records.select("id", *ATTRIBUTES)
    padded = labels.withColumn("ltable_id", F.concat(F.lit(" "), "ltable_id", F.lit("\t")))
    return pairs.text_from_labels(padded, records, records)


def _inference(p: str, key: str) -> str:
    return " || ' , ' || ".join([f"'id : \"' || {key} || '\"'", *(f"'{c} : \"' || {p}{c} || '\"'" for c in ATTRIBUTES)])


@query("inference_text", with_fixtures(f"SELECT ltable_id, rtable_id, {_inference('l_', 'ltable_id')} || chr(9) || {_inference('r_', 'rtable_id')} || chr(9) || '0' AS line FROM e", _E))
def inference_text(spark, sf_dir):
    return pairs.pair_text(_enriched(spark, sf_dir), ATTRIBUTES, F.lit("0"), "inference", clean=False, with_id=True).select("ltable_id", "rtable_id", "line")


_MEASURES = """SELECT count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
    FROM (SELECT *, CAST(sum(label * pred) OVER () AS DOUBLE) AS tp, CAST(sum((1 - label) * pred) OVER () AS DOUBLE) AS fp, CAST(sum(label * (1 - pred)) OVER () AS DOUBLE) AS fn FROM x) AS m GROUP BY tp, fp, fn"""


@query("baseline_pairwise", with_fixtures(_MEASURES, _E, f"x AS (SELECT label, CAST({_PROB} >= 0.5 AS INT) AS pred FROM e WHERE split = 'test')"))
def baseline_pairwise(spark, sf_dir):
    rows = scorers.pairwise_baseline(_enriched(spark, sf_dir).where("split = 'test'"), scorers.TokenJaccard(ATTRIBUTES))
    return metrics.measures(rows)


@query("edit_distance_scores", with_fixtures("SELECT ltable_id, rtable_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS prob FROM (SELECT *, lower(concat_ws(' ', l_title, l_venue, l_year)) AS a, lower(concat_ws(' ', r_title, r_venue, r_year)) AS b FROM e) AS t", _E))
def edit_distance_scores(spark, sf_dir):
    return _enriched(spark, sf_dir).select("ltable_id", "rtable_id", F.round(scorers.EditDistance(ATTRIBUTES).probability(), 6).alias("prob"))


# --- contexts --------------------------------------------------------------------------------------------------


@query("explode_context", "SELECT doc_id, pos, name FROM (SELECT doc_id, unnest(l) AS name, CAST(unnest(range(1, len(l) + 1)) AS INT) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) AS s) AS t")
def explode_context(spark, sf_dir):
    return context.explode_context(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ".", "doc_id")


_FEATURES = """f AS (SELECT doc_id, name, norm, parts[1] AS initials, substr(parts[1], 1, 1) AS first_initial, substr(parts[1], 2, 1) AS middle_initial, coalesce(list_filter(parts[2:], lambda x: length(x) >= 2)[-1], '') AS last_name
    FROM (SELECT *, string_split(norm, ' ') AS parts FROM (SELECT doc_id, name, trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(name, ''))), '[^a-z]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM {0}) AS a) AS b)"""


@query(
    "context_name_features",
    with_fixtures("SELECT doc_id, norm, initials, first_initial, middle_initial, last_name, trim(last_name || ' ' || initials) AS canon_full, trim(regexp_replace(concat_ws(' ', last_name, first_initial, middle_initial), ' +', ' ', 'g')) AS canon_init FROM f", _FEATURES.format("er_names")),
)
def context_name_features(spark, sf_dir):
    (names,) = _fx(spark, sf_dir, "er_names")
    return names.select("doc_id", name_features(F.col("name")).alias("f")).select("doc_id", *[f"f.{c}" for c in ("norm", "initials", "first_initial", "middle_initial", "last_name", "canon_full", "canon_init")])


@query("dedup_first_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) AS t WHERE n = 1")
def dedup_first_key(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return pairs.first_by_key(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("repeat_safe_keys", "SELECT CASE WHEN n = 1 THEN k ELSE k || '#' || CAST(n AS VARCHAR) END AS id, l_linenumber, l_partkey FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) AS t")
def repeat_safe_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    return pairs.numbered_keys(lines, "id", ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


def _mentions(spark, sf_dir) -> DataFrame:
    return context.mentions(fixture(spark, sf_dir, "er_mentions"))


_M = """m AS (SELECT id, pos, id || '#' || lpad(CAST(pos AS VARCHAR), 6, '0') AS mention_id, name, parts[1] AS initials, coalesce(list_filter(parts[2:], lambda x: length(x) >= 2)[-1], '') AS last_name
    FROM (SELECT *, string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS parts FROM er_mentions) AS a)"""
_C = "c AS (SELECT *, CASE WHEN last_name <> '' THEN min(mention_id) OVER (PARTITION BY last_name, initials) ELSE mention_id END AS ctx FROM m)"
_H = "h AS (SELECT DISTINCT id, ctx FROM c)"


@query("context_blocks", with_fixtures("SELECT last_name AS last, substr(initials, 1, 1) AS initial, count(*) AS n_mentions, count(DISTINCT last_name || ' ' || initials) AS n_names FROM m WHERE last_name <> '' GROUP BY 1, 2", _M))
def context_blocks(spark, sf_dir):
    return context.blocks(_mentions(spark, sf_dir))


@query("context_entities", with_fixtures("SELECT mention_id, id, pos, ctx FROM c", _M, _C))
def context_entities(spark, sf_dir):
    return context.resolved(fixture(spark, sf_dir, "er_mentions")).select("mention_id", "id", "pos", "ctx")


def _edges(spark, sf_dir) -> DataFrame:
    return context.hyperedges(context.resolved(fixture(spark, sf_dir, "er_mentions")))


@query("hyperedges", with_fixtures("SELECT id, ctx FROM h", _M, _C, _H))
def hyperedges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("context_to_primary", with_fixtures("SELECT ctx, count(*) AS n_ids, string_agg(id, ',' ORDER BY id) AS ids FROM h GROUP BY ctx", _M, _C, _H))
def context_to_primary(spark, sf_dir):
    return context.context_to_primary(_edges(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


@query("context_match_pairs", with_fixtures("SELECT DISTINCT a.name AS left_name, b.name AS right_name FROM (SELECT DISTINCT doc_id, name, last_name, initials FROM f WHERE last_name <> '') AS a JOIN (SELECT DISTINCT doc_id, name, last_name, initials FROM f WHERE last_name <> '') AS b ON a.last_name = b.last_name AND a.initials = b.initials AND a.name < b.name", _FEATURES.format("er_names")))
def context_match_pairs(spark, sf_dir):
    names = fixture(spark, sf_dir, "er_names").select(name_features(F.col("name")).alias("f"))
    return context.match_pairs(names.select("f.raw", "f.canon_full", "f.last_name"))


@query("merged_sides", with_fixtures("SELECT id, ctx FROM (SELECT * FROM er_orders_parts WHERE id NOT IN (SELECT ltable_id FROM er_pairs) UNION ALL SELECT DISTINCT ltable_id, rtable_id FROM er_pairs) AS t"))
def merged_sides(spark, sf_dir):
    edges, found = _fx(spark, sf_dir, "er_orders_parts", "er_pairs")
    return context.merged_sides(edges, found.select(F.col("ltable_id").alias("id"), F.col("rtable_id").alias("ctx")).distinct())


@query("typed_hyperedges", with_fixtures("SELECT 'e' || CAST(n AS VARCHAR) AS edge_id, relation, source, ref FROM (SELECT *, dense_rank() OVER (ORDER BY relation, source) - 1 AS n FROM (SELECT DISTINCT name AS source, 'isAuthor' AS relation, id AS ref FROM er_mentions) AS t) AS u"))
def typed_hyperedges(spark, sf_dir):
    found = fixture(spark, sf_dir, "er_mentions").groupBy("id").agg(F.array_join(F.collect_list("name"), ",").alias("authors"))
    return context.typed_hyperedges(context.triples(found, "authors"))


# --- the graph -------------------------------------------------------------------------------------------------


@query("references", with_fixtures("SELECT id, title, venue, year FROM er_primary WHERE id IN (SELECT ltable_id FROM er_pairs UNION SELECT rtable_id FROM er_pairs)"))
def references(spark, sf_dir):
    return graph.references(_enriched(spark, sf_dir), ATTRIBUTES, ["ltable_id", "rtable_id"])


@query("similar_edges", with_fixtures("SELECT ltable_id AS a, rtable_id AS b FROM er_pairs UNION SELECT rtable_id, ltable_id FROM er_pairs"))
def similar_edges(spark, sf_dir):
    return graph.similar_edges(fixture(spark, sf_dir, "er_pairs"))


@query("neighbor_edges", with_fixtures("SELECT DISTINCT x.id AS a, y.id AS b FROM er_orders_parts x JOIN er_orders_parts y ON x.ctx = y.ctx AND x.id < y.id"))
def neighbor_edges(spark, sf_dir):
    return graph.neighbor_edges(fixture(spark, sf_dir, "er_orders_parts"))


_CLASSES = """t AS (SELECT id, string_agg(ctx, ',' ORDER BY ctx) AS s FROM {0} GROUP BY id), k AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS m FROM t),
    r AS (SELECT DISTINCT class_id, m, ctx FROM {0} JOIN k USING (id))"""
_LINKED = "SELECT 'member' AS kind, id AS a, class_id AS b, CAST(1 AS BIGINT) AS n FROM k UNION ALL SELECT 'link', x.class_id, y.class_id, count(*) FROM r x JOIN r y ON x.ctx = y.ctx AND (x.class_id < y.class_id OR x.class_id = y.class_id AND x.m > 1) GROUP BY x.class_id, y.class_id"


@query("neighbor_classes", with_fixtures(_LINKED, _CLASSES.format("er_orders_parts")))
def neighbor_classes(spark, sf_dir):
    edges = fixture(spark, sf_dir, "er_order_lines")  # lines as they stand: both steps make them distinct where they are
    classes = stored(graph.context_classes(edges), "context-classes")
    member = classes.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("class_id").alias("b"), F.lit(1).cast("long").alias("n"))
    return member.unionByName(graph.neighbor_classes(edges, classes).select(F.lit("link").alias("kind"), "a", "b", "n"))


def _pairs_with_contexts(spark, sf_dir) -> DataFrame:
    edges, found = _fx(spark, sf_dir, "er_orders_parts", "er_pairs")
    return graph.with_contexts(found, graph.contexts_of(edges))


_X = """n AS (SELECT id, list(ctx ORDER BY ctx) AS ctxs FROM er_orders_parts GROUP BY id),
    w AS (SELECT p.*, coalesce(a.ctxs, []) AS l, coalesce(b.ctxs, []) AS r FROM er_pairs p LEFT JOIN n a ON a.id = p.ltable_id LEFT JOIN n b ON b.id = p.rtable_id),
    j AS (SELECT *, len(list_intersect(l, r)) AS i, CASE WHEN len(l) > 0 AND len(r) > 0 THEN len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) ELSE 0.0 END AS jac FROM w)"""
_BUCKET = "CASE WHEN jac = 0 THEN 'zero' WHEN jac < 0.3 THEN 'low' WHEN jac < 0.6 THEN 'medium' ELSE 'high' END"


@query("relational_jaccard", with_fixtures("SELECT ltable_id, rtable_id, round(jac, 6) AS jaccard FROM j", _X))
def relational_jaccard(spark, sf_dir):
    return _pairs_with_contexts(spark, sf_dir).select("ltable_id", "rtable_id", F.round(scores.jaccard(F.col("l_ctxs"), F.col("r_ctxs")), 6).alias("jaccard"))


@query("overlap_features", with_fixtures("SELECT ltable_id, rtable_id, round(coalesce(i / nullif(least(len(l), len(r)), 0), 0), 6) AS overlap, round(coalesce(i / nullif(len(l), 0), 0), 6) AS contain_l, round(coalesce(i / nullif(len(r), 0), 0), 6) AS contain_r FROM j", _X))
def overlap_features(spark, sf_dir):
    a, b = F.col("l_ctxs"), F.col("r_ctxs")
    return _pairs_with_contexts(spark, sf_dir).select("ltable_id", "rtable_id", F.round(scores.overlap(a, b), 6).alias("overlap"), F.round(scores.contained_left(a, b), 6).alias("contain_l"), F.round(scores.contained_right(a, b), 6).alias("contain_r"))


@query("neighborhood_summary", with_fixtures(f"SELECT ltable_id, rtable_id, array_to_string(l[1:5], ' | ') AS l_top, array_to_string(r[1:5], ' | ') AS r_top, 'jac=' || {_BUCKET} AS summary FROM j", _X))
def neighborhood_summary(spark, sf_dir):
    j = scores.jaccard(F.col("l_ctxs"), F.col("r_ctxs"))
    top = lambda c: F.array_join(scores.first_distinct(F.col(c)), " | ")
    return _pairs_with_contexts(spark, sf_dir).select("ltable_id", "rtable_id", top("l_ctxs").alias("l_top"), top("r_ctxs").alias("r_top"), scores.pairwise_summary(j).alias("summary"))


_GOLD = """s AS (SELECT ltable_id AS x, rtable_id AS y FROM er_pairs WHERE label = 1 UNION SELECT rtable_id, ltable_id FROM er_pairs WHERE label = 1),
    g AS (SELECT ltable_id AS id, ltable_id AS o FROM er_pairs UNION SELECT rtable_id, rtable_id FROM er_pairs UNION SELECT g.id, s.y FROM g JOIN s ON g.o = s.x),
    k AS (SELECT id, min(o) AS component FROM g GROUP BY id)"""


def _gold(spark, sf_dir) -> DataFrame:
    return graph.gold_components(fixture(spark, sf_dir, "er_pairs"))


@query("gold_components", with_fixtures("SELECT id, component FROM k", _GOLD))
def gold_components(spark, sf_dir):
    return _gold(spark, sf_dir)


@query("gold_neighborhoods", with_fixtures("SELECT component, array_to_string(list_sort(list_distinct(list(ctx))), ',') AS ctxs FROM k JOIN er_orders_parts e ON e.id = k.id GROUP BY component", _GOLD))
def gold_neighborhoods(spark, sf_dir):
    return graph.component_neighborhood(_gold(spark, sf_dir), fixture(spark, sf_dir, "er_orders_parts")).select("component", F.array_join("ctxs", ",").alias("ctxs"))


_TOP = """o AS (SELECT component, e.id, ctx, row_number() OVER (PARTITION BY component, ctx ORDER BY e.id) AS f FROM k JOIN er_orders_parts e ON e.id = k.id),
    t AS (SELECT component, list(ctx ORDER BY id, ctx)[1:5] AS top, list(ctx) AS every FROM o WHERE f = 1 GROUP BY component),
    z AS (SELECT e.*, coalesce(tl.top, []) AS l_top, coalesce(tr.top, []) AS r_top, CASE WHEN tl.every IS NULL OR tr.every IS NULL THEN 0.0 ELSE len(list_intersect(tl.every, tr.every)) / len(list_distinct(list_concat(tl.every, tr.every))) END AS jac
        FROM e JOIN k kl ON kl.id = e.ltable_id JOIN k kr ON kr.id = e.rtable_id LEFT JOIN t tl ON tl.component = kl.component LEFT JOIN t tr ON tr.component = kr.component WHERE split = 'train')"""


def _inline(p: str) -> str:
    return f"{_training(p)} || ' COL context VAL ' || array_to_string({p}top, ' | ') || ' COL pairwise_summary VAL jac=' || {_BUCKET}"


@query("inline_training_text", with_fixtures(f"SELECT ltable_id, rtable_id, {_inline('l_')} || chr(9) || {_inline('r_')} || chr(9) || CAST(label AS VARCHAR) AS line FROM z", _E, _GOLD, _TOP))
def inline_training_text(spark, sf_dir):
    from kinweave.plans.pipeline import inline_text

    return inline_text(_enriched(spark, sf_dir).where("split = 'train'"), _gold(spark, sf_dir), fixture(spark, sf_dir, "er_orders_parts"), ATTRIBUTES).select("ltable_id", "rtable_id", "line")


@query("exact_match", with_fixtures("SELECT DISTINCT ltable_id AS r1_id, rtable_id AS r2_id FROM e WHERE l_title = r_title AND l_venue = r_venue AND l_year = r_year AND ltable_id <> rtable_id", _E))
def exact_match(spark, sf_dir):
    return graph.exact_match(_enriched(spark, sf_dir), ATTRIBUTES)


@query(
    "hyperedge_k_match",
    with_fixtures(
        "SELECT DISTINCT ltable_id AS r1_id, rtable_id AS r2_id FROM u WHERE c >= 2",
        "a AS (SELECT h.ctx AS edge, h.id AS member, p.title || '|' || p.venue || '|' || p.year AS attr FROM er_orders_parts h JOIN er_primary p ON p.id = h.id)",
        "u AS (SELECT q.ltable_id, q.rtable_id, x.ctx, y.ctx, count(*) AS c FROM er_pairs q JOIN er_orders_parts x ON x.id = q.ltable_id JOIN er_orders_parts y ON y.id = q.rtable_id JOIN a m ON m.edge = x.ctx JOIN a n ON n.edge = y.ctx AND n.attr = m.attr AND n.member <> m.member GROUP BY 1, 2, 3, 4)",
    ),
)
def hyperedge_k_match(spark, sf_dir):
    # Lines as they stand: the operator takes edges with repeated rows, which needn't move to be made distinct.
    records, found, lines = _fx(spark, sf_dir, "er_primary", "er_pairs", "er_order_lines")
    attr = F.concat(*[x for c in ATTRIBUTES for x in (F.lit("|"), F.col(c))][1:])
    return graph.hyperedge_k_match(found, records.select("id", attr.alias("attr")), lines.select("id", F.col("ctx").alias("edge")), 2)


@query("gold_similarity", with_fixtures("SELECT least(ltable_id, rtable_id) AS a, greatest(ltable_id, rtable_id) AS b, CAST(max(label) AS DOUBLE) AS sim FROM er_pairs GROUP BY 1, 2"))
def gold_similarity(spark, sf_dir):
    found = fixture(spark, sf_dir, "er_pairs")
    return graph.gold_similarity(found, found.where("label = 1"))


# --- collective matching ---------------------------------------------------------------------------------------


def _queue(spark, sf_dir) -> DataFrame:
    rows = graph.with_contexts(_enriched(spark, sf_dir), graph.contexts_of(fixture(spark, sf_dir, "er_orders_parts")))
    return collective.initial_queue(rows, scorers.TokenJaccard(ATTRIBUTES).probability(), ALPHA)


_Q = f"q AS (SELECT e.ltable_id, e.rtable_id, {_PROB} AS sim_a, j.jac AS sim_r, 0.7 * ({_PROB}) + 0.3 * j.jac AS sim FROM e JOIN j ON j.ltable_id = e.ltable_id AND j.rtable_id = e.rtable_id)"


@query("late_fusion_scores", with_fixtures("SELECT ltable_id, rtable_id, round(sim_a, 6) AS sim_a, round(sim_r, 6) AS sim_r, round(sim, 6) AS sim FROM q", _E, _X, _Q))
def late_fusion_scores(spark, sf_dir):
    return _queue(spark, sf_dir).select("ltable_id", "rtable_id", *[F.round(c, 6).alias(c) for c in ("sim_a", "sim_r", "sim")])


@query("softmax_scores", with_fixtures("SELECT ltable_id, rtable_id, round(1 / (1 + exp((1 - 2 * p) * 4)), 6) AS prob FROM (SELECT ltable_id, rtable_id, " + _PROB + " AS p FROM e) AS t", _E))
def softmax_scores(spark, sf_dir):
    p = scorers.TokenJaccard(ATTRIBUTES).probability()
    return _enriched(spark, sf_dir).select("ltable_id", "rtable_id", F.round(scores.match_probability(4 - 4 * p, 4 * p), 6).alias("prob"))


@query("top_pairs", with_fixtures("SELECT ltable_id, rtable_id, round(s, 6) AS sim FROM (SELECT ltable_id, rtable_id, round(sim, 9) AS s FROM q) AS t ORDER BY s DESC, ltable_id, rtable_id LIMIT 10", _E, _X, _Q))
def top_pairs(spark, sf_dir):
    return collective.top_pairs(_queue(spark, sf_dir).withColumn("sim", F.round("sim", 9))).select("ltable_id", "rtable_id", F.round("sim", 6).alias("sim"))


def _clusters(spark, sf_dir, name: str) -> DataFrame:
    records, found, edges = _fx(spark, sf_dir, "er_primary", "er_pairs", "er_order_lines")  # the merge takes sets of contexts
    records = records.withColumn("text", text.record_text(["id", *ATTRIBUTES], style="inference", clean=False))
    return collective.clusters(found.where("split = 'test'"), records, edges, scorers.TokenJaccard(ATTRIBUTES), ALPHA, THRESHOLD, name)


@query("collective_clusters")
def collective_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir, "LATE_FUSION")


@query("inline_clusters")
def inline_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir, "INLINE_ENCODE")


@query("pair_predictions", with_fixtures("SELECT ltable_id, rtable_id, label, CAST(a.component = b.component AS INT) AS pred FROM er_pairs p JOIN k a ON a.id = p.ltable_id JOIN k b ON b.id = p.rtable_id", _GOLD))
def pair_predictions(spark, sf_dir):
    found = fixture(spark, sf_dir, "er_pairs")
    return metrics.predictions(found, _gold(spark, sf_dir).withColumnRenamed("component", "cluster_id")).select("ltable_id", "rtable_id", "label", "pred")


@query("pair_metrics", with_fixtures(_MEASURES, _GOLD, "x AS (SELECT label, CAST(a.component = b.component AS INT) AS pred FROM er_pairs p JOIN k a ON a.id = p.ltable_id JOIN k b ON b.id = p.rtable_id)"))
def pair_metrics(spark, sf_dir):
    found = fixture(spark, sf_dir, "er_pairs")
    return metrics.measures(metrics.predictions(found, _gold(spark, sf_dir).withColumnRenamed("component", "cluster_id")))


@query("collective_metrics")
def collective_metrics(spark, sf_dir):
    """The flagship: clusters of the test split, then the four measures."""
    found = fixture(spark, sf_dir, "er_pairs").where("split = 'test'")
    return metrics.measures(metrics.predictions(found, _clusters(spark, sf_dir, "LATE_FUSION")))


@query("trained_scorer")
def trained_scorer(spark, sf_dir):
    # Stored: learning goes over the rows again and again, and the queue is made by joins.
    rows = stored(_queue(spark, sf_dir).select("ltable_id", "rtable_id", "sim_a", "sim_r", "label", "split"), "scored")
    model = scorers.trained(rows.where("split = 'train'").select("sim_a", "sim_r", "label"), ["sim_a", "sim_r"])
    return model.transform(rows.where("split = 'test'").drop("split")).select("ltable_id", "rtable_id", "label", F.col("prediction").cast("int").alias("pred"))


# --- what the merge starts from, and what it leaves -----------------------------------------------------------


@query("growing_components", with_fixtures("SELECT id, component FROM k WHERE id IN (SELECT ltable_id FROM er_pairs WHERE label = 1 UNION SELECT rtable_id FROM er_pairs WHERE label = 1)", _GOLD))
def growing_components(spark, sf_dir):
    found, grown = fixture(spark, sf_dir, "er_pairs").where("label = 1"), GrowingComponents(spark)
    for split in ("train", "valid", "test"):
        grown.add(found.where(F.col("split") == split), "ltable_id", "rtable_id")
    return grown.labels.select(F.col("node").alias("id"), "component")


#: Exact and k-matches, and the least id in reach of each id.
_BOOT = """a AS (SELECT h.ctx AS edge, h.id AS member, p.title || '|' || p.venue || '|' || p.year AS attr FROM er_orders_parts h JOIN er_primary p ON p.id = h.id),
    u AS (SELECT q.ltable_id, q.rtable_id, count(*) AS c FROM er_pairs q JOIN er_orders_parts x ON x.id = q.ltable_id JOIN er_orders_parts y ON y.id = q.rtable_id JOIN a m ON m.edge = x.ctx JOIN a n ON n.edge = y.ctx AND n.attr = m.attr AND n.member <> m.member GROUP BY q.ltable_id, q.rtable_id, x.ctx, y.ctx),
    h AS (SELECT ltable_id AS x, rtable_id AS y FROM e WHERE l_title = r_title AND l_venue = r_venue AND l_year = r_year AND ltable_id <> rtable_id UNION SELECT ltable_id, rtable_id FROM u WHERE c >= {k}),
    s AS (SELECT x, y FROM h UNION SELECT y, x FROM h),
    g AS (SELECT ltable_id AS id, ltable_id AS o FROM er_pairs UNION SELECT rtable_id, rtable_id FROM er_pairs UNION SELECT g.id, s.y FROM g JOIN s ON g.o = s.x),
    k AS (SELECT id, min(o) AS cluster_id FROM g GROUP BY id)""".replace("{k}", "4")


def _bootstrapped(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    records, lines = _fx(spark, sf_dir, "er_primary", "er_order_lines")
    if found is None:
        found = stored(fixture(spark, sf_dir, "er_pairs").select("ltable_id", "rtable_id"), "pairs")
    attr = F.concat(*[x for c in ATTRIBUTES for x in (F.lit("|"), F.col(c))][1:])
    matches = graph.hyperedge_k_match(found, records.select("id", attr.alias("attr"), *ATTRIBUTES), lines.select("id", F.col("ctx").alias("edge")), 4, same=ATTRIBUTES, repeats=True)
    ids = found.select(F.col("ltable_id").alias("id")).unionByName(found.select(F.col("rtable_id").alias("id")))
    return bootstrap.bootstrap(ids, matches)


@query("bootstrap_clusters", with_fixtures("SELECT id, cluster_id FROM k", _E, _BOOT))
def bootstrap_clusters(spark, sf_dir):
    return _bootstrapped(spark, sf_dir)


@query(
    "quotient_graph",
    with_fixtures(
        """SELECT 'member' AS kind, cluster_id, id AS other FROM k UNION SELECT 'context', cluster_id, ctx FROM k JOIN er_orders_parts USING (id)
        UNION SELECT 'similar', x.cluster_id, y.cluster_id FROM (SELECT ltable_id AS l, rtable_id AS r FROM er_pairs UNION SELECT rtable_id, ltable_id FROM er_pairs) AS p JOIN k x ON x.id = p.l JOIN k y ON y.id = p.r WHERE x.cluster_id <> y.cluster_id""",
        _E,
        _BOOT,
    ),
)
def quotient_graph(spark, sf_dir):
    found, lines = _fx(spark, sf_dir, "er_pairs", "er_order_lines")  # the quotient makes contexts distinct
    found = stored(found.select("ltable_id", "rtable_id"), "pairs")
    clusters = stored(_bootstrapped(spark, sf_dir, found), "clusters")  # read for each kind of fact
    return bootstrap.quotient(clusters, found, lines)


@query("bootstrapped_merge")
def bootstrapped_merge(spark, sf_dir):
    """Clusters of the test split, whose merge starts from the quotient's members."""
    records, found, edges = _fx(spark, sf_dir, "er_primary", "er_pairs", "er_order_lines")
    found = stored(found.select("ltable_id", "rtable_id", "split"), "pairs")  # several plans go over them
    start = bootstrap.members_of(bootstrap.quotient(_bootstrapped(spark, sf_dir, found), found, edges))
    return collective.clusters(found.where("split = 'test'"), records, edges, scorers.TokenJaccard(ATTRIBUTES), ALPHA, THRESHOLD, start=start)


#: Thresholds of a sweep; the run is at the lowest.
SWEEP = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9]


def _forest(spark, sf_dir) -> DataFrame:
    records, found, edges = _fx(spark, sf_dir, "er_primary", "er_pairs", "er_order_lines")
    return forest.merge_forest(found.where("split = 'test'"), records, edges, scorers.TokenJaccard(ATTRIBUTES), ALPHA, SWEEP[0])


@query("merge_forest")
def merge_forest(spark, sf_dir):
    return _forest(spark, sf_dir)


@query("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    return forest.threshold_sweep(fixture(spark, sf_dir, "er_pairs").where("split = 'test'"), _forest(spark, sf_dir), SWEEP)


# --- files written and read again ------------------------------------------------------------------------------


def _folder(spark, tag: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_LINES = "SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag || chr(10) || '\"' || l_linestatus || ',' AS note FROM lineitem"


def _lines_file(spark, sf_dir) -> DataFrame:
    """The lines as CSV whose cells hold line ends, quotes and commas, in the order of order, line (descending), part and supplier; read with positions."""
    rows, path = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _folder(spark, "lines")
    text = lambda c: F.col(c).cast("string")
    rows = rows.orderBy("l_orderkey", F.desc("l_linenumber"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    files.write_records(rows.select(text("l_orderkey").alias("id"), text("l_linenumber").alias("line"), text("l_partkey").alias("part"), text("l_suppkey").alias("supplier"), F.concat("l_returnflag", F.lit('\n"'), "l_linestatus", F.lit(",")).alias("note")), path)
    return positions.read_positioned(spark, path)


@query("csv_positions", _LINES)
def csv_positions(spark, sf_dir):
    return _lines_file(spark, sf_dir).drop(*positions.POSITION)


@query("csv_first_rows", f"SELECT id, line, part, supplier, note FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(line AS INT) DESC, CAST(part AS BIGINT), CAST(supplier AS BIGINT), note) AS n FROM ({_LINES}) AS l) AS t WHERE n = 1")
def csv_first_rows(spark, sf_dir):
    return positions.first_rows(_lines_file(spark, sf_dir), "id")


@query("csv_records", with_fixtures("SELECT id, title, venue, year FROM er_primary"))
def csv_records(spark, sf_dir):
    path = _folder(spark, "records")
    files.write_records(fixture(spark, sf_dir, "er_primary").drop("side"), path)
    return files.read_records(spark, path)


@query("csv_pairs", with_fixtures("SELECT ltable_id, rtable_id, label, split FROM er_pairs"))
def csv_pairs(spark, sf_dir):
    path = _folder(spark, "pairs")
    found = fixture(spark, sf_dir, "er_pairs")
    files.write_records(found.withColumn("ltable_id", F.concat(F.lit(" "), "ltable_id", F.lit("\t"))), path)
    return files.read_pairs(spark, path)


@query("csv_pair_ids", with_fixtures("SELECT ltable_id, count(*) AS n FROM er_pairs GROUP BY ltable_id"))
def csv_pair_ids(spark, sf_dir):
    path = _folder(spark, "pair-ids")
    files.write_records(fixture(spark, sf_dir, "er_pairs"), path)
    return files.read_pair_ids(spark, path).groupBy("ltable_id").agg(F.count("*").alias("n"))


@query("csv_inferred", with_fixtures("SELECT CAST(ltable_id AS INT) AS ltable_id, CAST(rtable_id AS INT) AS rtable_id, label, split FROM er_pairs"))
def csv_inferred(spark, sf_dir):
    path = _folder(spark, "inferred")
    files.write_records(fixture(spark, sf_dir, "er_pairs"), path)
    return files.read_inferred(spark, path)


@query("pair_text_file", with_fixtures(f"SELECT {_training('l_')} AS left_text, {_training('r_')} AS right_text, label FROM e", _E))
def pair_text_file(spark, sf_dir):
    path = _folder(spark, "pair-text")
    files.write_pair_text(pairs.pair_text(_enriched(spark, sf_dir), ATTRIBUTES), path)
    return files.read_pair_text(spark, path).select(F.col("left").alias("left_text"), F.col("right").alias("right_text"), "label")


@query("normalised_export", with_fixtures("SELECT 'record' AS kind, id AS a, ctx AS b FROM h UNION ALL SELECT 'context', ctx, id FROM h UNION ALL SELECT 'name', ctx, min(name) FROM c GROUP BY ctx UNION ALL SELECT 'title', id, title FROM er_primary WHERE id IN (SELECT id FROM er_mentions)", _M, _C, _H))
def normalised_export(spark, sf_dir):
    path = _folder(spark, "normalised")
    authors = fixture(spark, sf_dir, "er_mentions").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("authors"))
    files.write_normalised(files.normalised(fixture(spark, sf_dir, "er_primary").drop("side").join(authors, "id")), path)
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"))
    out = row(read("record_to_contexts"), "record", "id", F.explode("ctxs")).unionByName(row(read("context_to_records"), "context", "ctx", F.explode("ids")))
    return out.unionByName(row(read("contexts"), "name", "ctx", F.col("name"))).unionByName(row(read("records"), "title", "id", F.col("title")))
