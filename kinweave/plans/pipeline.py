"""The whole run: tables and pairs in, clusters and measures out."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.scores import jaccard, pairwise_summary
from kinweave.functions.text import pair_line, record_text
from kinweave.operators import collective, context, graph, metrics, pairs, scorers
from kinweave.sources.config import Config, register_task
from kinweave.sources.files import read_pairs, write_pair_text, write_records
from kinweave.sources.positions import POSITION, first_rows, read_positioned


@dataclass
class Split:
    """What one split's preprocessing gives."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame
    edges: DataFrame
    enriched: DataFrame
    reduced: tuple[DataFrame, DataFrame]
    mentions: DataFrame


def _sided(df: DataFrame, config: Config, columns: tuple[str, ...], side: str) -> DataFrame:
    """Ids as they are, or, where sides have namespaces of their own, with the side in front."""
    if config.dataset.id_namespace == "sided":
        for c in columns:
            df = df.withColumn(c, F.concat(F.lit(f"{side}:"), F.col(c)))
    return df


def preprocess(config: Config, found: DataFrame, a: DataFrame, b: DataFrame) -> Split:
    """Reduced sides, normalised contexts and enriched pairs of one split. Nothing is read before an action."""
    d = config.dataset
    found = found.select(F.col(d.left_id_col).alias("ltable_id"), F.col(d.right_id_col).alias("rtable_id"), F.col(d.label_col).alias("label"))
    found = _sided(_sided(found, config, ("ltable_id",), "a"), config, ("rtable_id",), "b")
    sides = []
    for df, side, column in ((a, "a", "ltable_id"), (b, "b", "rtable_id")):
        df = _sided(df.withColumnRenamed(d.prim_id_col, "id"), config, ("id",), side)
        placed_rows = set(POSITION) <= set(df.columns)  # else there is no first row, and the least one stays
        df = first_rows(df, "id") if placed_rows else pairs.first_by_key(df, "id", [F.struct(*[c for c in df.columns if c != "id"])])
        sides.append(pairs.reduce_source(df, found, "id", column))
    exploded = [context.explode_context(s, d.context_field, d.context_separator) for s in sides]
    placed = context.entities(context.mentions(context.merged_sides(*exploded)))
    left, right = (s.drop(d.context_field) for s in sides)
    return Split(found, left, right, context.hyperedges(placed), pairs.enrich(found, left, right), tuple(sides), placed.select("mention_id", "ctx"))


def read_split(spark: SparkSession, config: Config, split: str) -> Split:
    d = config.dataset
    return preprocess(config, read_pairs(spark, config.pairs_path(split), d.left_id_col, d.right_id_col, d.label_col), *[read_positioned(spark, config.table_path(side)) for side, _ in config.sides()])


def attributes_of(split: Split) -> list[str]:
    return [c for c in split.left.columns if c != "id"]


def write_split(config: Config, name: str, split: Split) -> None:
    """The split's reduced tables and its pair text. With INLINE_ENCODE, the text of all splits but the last, which is matched, carries gold neighbourhoods. Each is a folder of part files."""
    for (side, _), rows in zip(config.sides(), split.reduced, strict=True):
        write_records(rows, config.reduced_path(name, side), "overwrite")
    if config.algo.strategy == "INLINE_ENCODE" and name != config.dataset.split_names[-1]:
        lines = inline_text(split.enriched, graph.gold_components(split.pairs), split.edges, attributes_of(split), field=config.dataset.context_field)
    else:
        lines = pairs.pair_text(split.enriched, attributes_of(split))
    write_pair_text(lines, config.text_path(name), mode="overwrite")


def experiment(spark: SparkSession, config: Config, log: logging.Logger, scorer=None) -> dict[str, float]:
    """All splits read and written, a scorer fitted on the first where that is asked for and none is given, the last split matched and measured. The task list names the written texts, for a scorer trained outside."""
    names = config.dataset.split_names
    splits = {name: read_split(spark, config, name) for name in names}
    for name, split in splits.items():
        write_split(config, name, split)
        log.info("split %s written", name)
    last = splits[names[-1]]
    if config.finetune.enabled:
        texts = {f"{name}set": config.text_path(name) for name in names}
        register_task(config.run.tasks_file, {"name": config.finetune.task, "task_type": "classification", "vocab": ["0", "1"], **texts})
        if scorer is None:
            scorer = _learned(config, splits, log)
    counts = last.mentions.agg(F.count("*").alias("before"), F.countDistinct("ctx").alias("after")).first()
    log.info("context entities before matching: %d, after: %d", counts.before, counts.after)
    found = run(config, last, scorer)[1].first().asDict()
    log.info("threshold: %s, alpha: %s", config.algo.threshold, config.algo.alpha)
    for measure in ("accuracy", "precision", "recall", "f1"):
        log.info("%s: %.2f", measure, found[measure])
    return found


def _learned(config: Config, splits: dict[str, Split], log: logging.Logger):
    """A text matcher from the first split, with the second as the stop; it reads what the merge will show it: with INLINE_ENCODE, texts that end in contexts and their likeness. Without labels of both kinds, None."""
    first, second = [*splits.values()][0], [*splits.values()][min(1, len(splits) - 1)]
    attributes = attributes_of(first)
    try:
        if config.algo.strategy == "INLINE_ENCODE":
            shown = [inline_text(s.enriched, graph.gold_components(s.pairs), s.edges, attributes, field=config.dataset.context_field, style="inference") for s in (first, second)]
            sides = [F.element_at(F.split("line", "\t"), i) for i in (1, 2)]
            fitted = scorers.TextMatcher.fit_texts(*shown, attributes, *sides)
        else:
            fitted = scorers.TextMatcher.fit(first.enriched, second.enriched, attributes)
    except ValueError as e:
        log.info("nothing learned: %s", e)
        return None
    log.info("fitted: %d weights, intercept %s", len(fitted.weights), fitted.intercept)
    return fitted


def run(config: Config, split: Split, scorer=None) -> tuple[DataFrame, DataFrame]:
    """(clusters, measures) of a split. ``scorer``: a scorer of pairs or a column of probabilities; with INLINE_ENCODE one of texts (``scorers.External``)."""
    attributes = attributes_of(split)
    records = context.merged_sides(split.right, split.left).withColumn("text", record_text(["id", *attributes], style="inference", clean=False))
    score = scorer if scorer is not None else scorers.TokenJaccard(attributes)
    match = scorer if hasattr(type(scorer), "of_texts") else collective.token_match
    found = collective.clusters(split.pairs, records, split.edges, score, config.algo.alpha, config.algo.threshold, config.algo.strategy, match=match, similarity=config.algo.similarity, field=config.dataset.context_field)
    return found, metrics.measures(metrics.predictions(split.pairs, found))


def inline_text(enriched: DataFrame, parts: DataFrame, edges: DataFrame, attributes: list[str], k: int = 5, field: str = "context", style: str = "training") -> DataFrame:
    """Adds ``line``: pair text (``inference`` style: without ids) whose records end in two columns more, the first contexts of their gold cluster (under ``field``) and how alike both neighbourhoods are."""
    around = parts.join(graph.component_neighborhood(parts, edges, k), "component", "left").select("id", "ctxs", "top")
    side = lambda p: around.select(F.col("id").alias(f"{p}table_id"), F.coalesce("ctxs", F.array().cast("array<string>")).alias(f"{p}_ctxs"), F.array_join(F.coalesce("top", F.array().cast("array<string>")), " | ").alias(f"{p}_top"))
    rows = enriched.join(side("l"), "ltable_id", "left").join(side("r"), "rtable_id", "left")
    summary = pairwise_summary(jaccard(F.col("l_ctxs"), F.col("r_ctxs")))
    top = lambda p: F.coalesce(f"{p}_top", F.lit(""))
    if style == "training":
        line = lambda p: F.concat(record_text(attributes, f"{p}_"), F.lit(f" COL {field} VAL "), top(p), F.lit(" COL pairwise_summary VAL "), summary)
    else:
        line = lambda p: F.concat(record_text(attributes, f"{p}_", style, clean=False), F.lit(f' , {field} : "'), top(p), F.lit('" , pairwise_summary : "'), summary, F.lit('"'))
    return rows.withColumn("line", pair_line(line("l"), line("r"), F.col("label")))
