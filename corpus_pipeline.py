"""A training corpus from raw documents, in five stages; each stage's rows are written and read again by the next.

In all stages a null text has no words and rows with a null key are rows like others, repeated rows are judged each by
itself (equal ones as near-duplicates), very long texts are read whole, an empty table gives an empty table, and all columns
of the documents but the text and its length stay as they are, whatever their names. What a stage decides at a tie is in its own line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontam, jaccard_tiles, level_dedup, sp_lattice, toxic_kernel
from kinweave.llm.common import shared_folder
from kinweave.llm.queries import tokenizer_file

#: A document is toxic from this score.
TOXIC = 0.5
#: Rows of a batch that Spark hands to Python, at most: texts of a batch lie in the executor's memory outside its heap and in the worker's.
BATCH_ROWS = 2_000


def _lean(spark: SparkSession) -> None:
    """Has the session make batches of BATCH_ROWS at most from now on; smaller ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _cleaned(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, with the cleaned text and its length."""
    made = {"doc_id": F.col("doc_id"), "text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(made[c] if c in made else F.col("carried")[c]).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a score of TOXIC itself is rejected. Without labels of both kinds nothing is."""
    _lean(spark)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    model = toxic_kernel.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_kernel.score(docs, model, "text", name).where(F.col(name) < TOXIC).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least key, of equal keys any one. Documents without words stay."""
    _lean(spark)
    return jaccard_tiles.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere; a document of which nothing is left goes. One without words stays."""
    _lean(spark)
    rows = level_dedup.dedup(docs, carry=_rest(docs))
    return _cleaned(rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that consists of them by more than half goes; by half, it stays."""
    _lean(spark)
    rows = decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=_rest(docs))
    return _cleaned(rows.where(~F.col("dropped")), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_equal and ids of each document."""
    _lean(spark)
    return sp_lattice.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Training and vocabularies have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
