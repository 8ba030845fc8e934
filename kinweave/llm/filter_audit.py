"""What each filter of a chain removes, in every order of the filters, by products with incidence matrices.

A document is known by the set of filters it fails: a mask of five bits. Of each part (source) three histograms over
the 32 masks are stacked as rows: documents, good ones and toxic ones. What any step of any order keeps, removes, finds
removed already or alone removes is the sum of some masks, so a 32-by-600 matrix of zeros and ones (a column for each
order and step) gives all of it in one integer product; ``shapley`` is one more matrix of the same shape.

Texts are read once. Copies are found by their SHA-256; only digests, keys and masks move.

Defined results: a null text is empty; a null part is the empty string; a document without a label counts as neither
good nor toxic, of several labels each counts that is set. A null key has no label, is no copy of anything and makes no
copies. Equal rows (key and text) are no copies of each other, as neither key is smaller. Limits that are met exactly
don't fail. Very long texts cost what their words cost. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import WordHashes, kept, placed_hashes, slices, tidy, word_places
from kinweave.llm.weak_rules import CAPITALS

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
MASKS = 1 << len(FILTERS)
#: All orders, in alphabetical order.
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
#: Parts whose rows a task makes at a time.
PARTS = 64


_SIGN = [bytes(int(test(x)) for x in range(256)) for test in (lambda x: chr(x) in CAPITALS, lambda x: chr(x) in SYMBOLS, lambda x: x & 0xC0 != 0x80)]


def masks(texts: list[bytes], longer: WordHashes) -> np.ndarray:
    """The filters that each text fails by itself, A to D as the lowest bits. Equal words of one text are found by 64-bit hashes."""
    data, starts, ends, counts = word_places(texts)
    hashes = placed_hashes(data, starts, ends, longer)
    at = np.concatenate(([0], np.cumsum(counts)))
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    # A text's bytes and one blank behind it; there is one more in front of the first.
    begins = np.cumsum([1, *[len(t) + 1 for t in texts[:-1]]])
    body = data[: begins[-1] + len(texts[-1]) + 1]
    capitals, symbols, chars = (np.add.reduceat(np.frombuffer(body.translate(sign), np.uint8), begins, dtype=np.int64) for sign in _SIGN)
    fails = (counts < 200, 100 * distinct < 50 * counts, 100 * capitals > 2 * (chars - 1), symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failures(df: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """(key, part, digest, mask) of each row; a task holds some megabytes of text at a time."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"), F.lit(0).alias("block"))
    kind = rows.schema["key"].dataType.simpleString()

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        longer = WordHashes()
        for _, (keys, parts), texts in slices(batches):
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, parts, digests, pa.array(masks(texts, longer), pa.int32())], names=["key", "part", "digest", "mask"])

    return rows.mapInArrow(tidy(read), f"key {kind}, part string, digest binary, mask int")


def histograms(df: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic). The first of equal texts is found by a minimum for each digest and met again by digest and key together, so that a large group of copies is never one key of a join."""
    rows = kept(failures(df, key, part, text), "failures")
    keyed = rows.where("key IS NOT NULL")
    first = keyed.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    met = keyed.join(first, ["key", "digest"], "left").join(known, "key", "left")
    copies = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    zero = F.lit(0)
    met = met.select("part", (F.col("mask") + copies).alias("mask"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    every = met.unionByName(rows.where("key IS NULL").select("part", "mask", zero.alias("good"), zero.alias("toxic")))
    return every.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def matrices() -> dict[str, np.ndarray]:
    """Masks by (order, step): what the step keeps, removes, finds removed already, and what fails its filter alone; and how many orders let its filter remove a mask."""
    out = {k: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    masks = np.arange(MASKS)
    for i, order in enumerate(ORDERS):
        before = 0
        for j, name in enumerate(order):
            bit, at = 1 << FILTERS.index(name), i * len(FILTERS) + j
            fails = masks & bit > 0
            out["kept"][:, at] = masks & (before | bit) == 0
            out["removed"][:, at] = fails & (masks & before == 0)
            out["redundant"][:, at] = fails & (masks & before > 0)
            out["unique_fails"][:, at] = masks == bit
            before |= bit
    names = np.array([name for order in ORDERS for name in order])
    for name in FILTERS:
        of = names == name
        out["shapley"][:, of] = out["removed"][:, of].sum(axis=1, keepdims=True)
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """A row for each part, order and step."""
    cells = histograms(df, labels, key, part, text)
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(MASKS)])
    stacked = cells.groupBy("part").agg(of("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))

    def product(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by = matrices()
        orders = pa.array([o for o in ORDERS for _ in FILTERS])
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        width = len(steps)
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                p = some.num_rows
                rows = np.concatenate([some.column(c).flatten().to_numpy().reshape(p, MASKS) for c in ("n", "good", "toxic")])
                removed = rows @ by["removed"]
                found = {"removed": removed[:p], "good_lost": removed[p : 2 * p], "toxic_lost": removed[2 * p :]}
                found |= {k: rows[:p] @ by[k] for k in ("kept", "redundant", "unique_fails", "shapley")}
                parts = some.column("part").take(pa.array(np.repeat(np.arange(p), width)))
                yield pa.RecordBatch.from_arrays([parts, pa.concat_arrays([orders] * p), pa.concat_arrays([steps] * p), *[pa.array(found[c].ravel()) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return stacked.mapInArrow(tidy(product), "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
