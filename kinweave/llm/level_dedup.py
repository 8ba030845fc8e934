"""Removal of repeated passages, by level-wise doubling.

A passage of 35 words that occurs twice also has, at every shorter length, a window that occurs twice. So windows of
9 words are compared first; places where they repeat are extended to 18 words, and what survives there to 35. At a
level below the last, not every window is compared but the one with the least hash within each passage: equal
passages choose equal windows, wherever they stand, so that nothing is lost and a fraction of the hashes move.

Hashes move, texts don't: a task sends each block's distinct hashes, dealt by value, with those that occur twice in
the block sent twice; each bucket answers every block with those that occur twice anywhere. The next level reads the
texts again and looks the answers up. A hash that a third of all rows share is one number a block.

Earlier levels compare windows by 64-bit hashes, which can only let too many windows through; the last one, which
decides, by pairs of hashes of 64 bits each, made of words hashed twice by different seeds. Where a level finds nothing
repeated, the levels after it aren't run.

Defined results: a null or empty text has no words; texts under 35 words keep all of theirs; very long texts are read
whole; repeated rows lose every passage, and there are no other ties: a passage repeats or doesn't; rows with a null key
are rows like others; an empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import NO_PAIRS, ONE_BLANK, Replies, WordHashes, bucket_count, contained, contained_pairs, dealt, mixed, ordered_pairs, placed_hashes, shared_folder, slices, sliding, tidy, windows, with_blocks, word_places

WINDOW, FIRST = 35, 9
#: Hashes that a task holds before it sends them, and bytes of input whose hashes meet in a bucket.
HELD, BUCKET_BYTES = 1_000_000, 12 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Seed of the second hashes.
SECOND = 0x5851F42D4C957F2D


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """first, twice that, and so on, the last being the window."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Passages:
    """The passages of several texts, one text after the other."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, window: int, second: WordHashes | None = None):
        self.data, self.starts, self.stops, self.sizes = word_places(texts)
        self.ends = np.cumsum(self.sizes)
        self.hashes = placed_hashes(self.data, self.starts, self.stops, hashes)
        self.window, self.second = window, WordHashes(SECOND) if second is None else second
        n = max(0, len(self.hashes) - window + 1)
        text = np.repeat(np.arange(len(texts)), self.sizes)
        self.alive = text[:n] == text[window - 1 :] if n else np.zeros(0, bool)  # passages within one text

    def _covered(self) -> np.ndarray:
        """Which words a passage alive covers."""
        steps = np.zeros(len(self.hashes) + 1, np.int32)
        at = np.flatnonzero(self.alive)
        steps[at] += 1
        np.subtract.at(steps, at + self.window, 1)
        return np.cumsum(steps[:-1]) > 0

    def whole(self) -> np.ndarray:
        """Two hashes of each passage alive; only words that such passages cover are hashed again."""
        if not self.alive.any():
            return NO_PAIRS
        covered = self._covered()
        at = np.cumsum(covered)[np.flatnonzero(self.alive)] - 1  # a passage's words stay neighbours
        again = placed_hashes(self.data, self.starts[covered], self.stops[covered], self.second)
        return np.column_stack((mixed(windows(self.hashes[covered], self.window)[at]), windows(again, self.window)[at]))

    def least(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the windows, the least of them in each passage)."""
        grams = windows(self.hashes, length) | np.uint64(1)
        return grams, sliding(np.minimum, grams, self.window - length + 1)

    def keep(self, length: int, repeated: np.ndarray) -> None:
        """Only passages stay alive of which the compared window repeats."""
        if not self.alive.any():
            return
        if length == self.window:
            self.alive[self.alive] = contained_pairs(self.whole(), repeated)
            return
        _, low = self.least(length)
        heads = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        self.alive &= np.repeat(contained(mixed(low[heads]), repeated), np.diff(np.append(heads, len(low))))

    def compared(self, length: int) -> np.ndarray:
        """Hashes of the windows to compare, one (at the last level a pair) for each place in a text. They are the least of their passages; scrambled, they go to all buckets alike."""
        if length == self.window:
            return self.whole()
        if not self.alive.any():
            return np.empty(0, np.uint64)
        grams, low = self.least(length)
        span = self.window - length
        edge = np.zeros(span, np.uint64)
        return mixed(grams[sliding(np.maximum, np.concatenate((edge, np.where(self.alive, low, np.uint64(0)), edge)), span + 1) == grams])

    def removed(self) -> list[np.ndarray]:
        """For each text, which of its words a passage alive covers."""
        return np.split(self._covered(), self.ends[:-1])

    def kept(self, gone: list[np.ndarray]) -> list[bytes]:
        """Of each text the words that aren't marked, joined by single blanks."""
        stay = ~np.concatenate(gone) if gone else np.zeros(0, bool)
        steps = np.zeros(len(self.data) + 1, np.int8)
        steps[self.starts[stay]] = 1
        steps[self.stops[stay] + 1] -= 1  # each word with a blank behind
        out = np.frombuffer(self.data.translate(ONE_BLANK), np.uint8)[np.cumsum(steps[:-1], dtype=np.int8).view(bool)].tobytes()
        sizes = np.concatenate(([0], np.cumsum(np.where(stay, self.stops - self.starts + 1, 0))))
        at = sizes[np.concatenate(([0], self.ends))].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def _values(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct hashes or pairs of hashes in ascending order, how often each stands)."""
    every = np.concatenate(arrays)
    return np.unique(every, return_counts=True) if every.ndim == 1 else ordered_pairs(every)


def _answers(addresses: list[str], lengths: list[int], window: int):
    """A function that gives a block's answers so far; those of the last block are held."""
    readers, held = [Replies(a) for a in addresses], {}

    def of(block: int) -> list[tuple[int, np.ndarray]]:
        if block not in held:
            held.clear()
            held[block] = [(n, r.pairs(block) if n == window else r.hashes(block)) for n, r in zip(lengths, readers, strict=False)]
        return held[block]

    return of


def _compare(rows: DataFrame, answers: list[str], lengths: list[int], window: int, buckets: int) -> str:
    """One level: sends hashes, counts them and writes the answers; returns the answers' address."""
    level = lengths[len(answers)]
    last = level == window

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, hashes, second = _answers(answers, lengths, window), WordHashes(), WordHashes(SECOND)
        held, size, current = [], 0, None

        def flush():
            nonlocal held, size
            if held:
                values, counts = _values(held)
                sent = np.repeat(values, np.minimum(counts, 2), axis=0)
                parts = list(dealt(sent[:, 0] if last else sent, buckets, sent))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([current] * len(parts), pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["bucket", "block", "blob"])
            held, size = [], 0

        for block, _, texts in slices(batches):
            if block != current or size > HELD:
                yield from flush()
                current = block
            passages = Passages(texts, hashes, window, second)
            for length, repeated in answer(block):
                passages.keep(length, repeated)
            held.append(passages.compared(level))
            size += len(held[-1])
        yield from flush()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(x, np.uint64).reshape((-1, 2) if last else -1) for x in part["blob"]]
        values, counts = _values(arrays)
        values, among = values[counts > 1], contained_pairs if last else contained
        found = [(b, _values([x[among(x, values)]])[0]) for b, x in zip(part["block"], arrays, strict=True)]
        found = [(b, x.tobytes()) for b, x in found if len(x)]
        return pd.DataFrame({"block": pd.Series([b for b, _ in found], dtype="int64"), "blob": pd.Series([x for _, x in found], dtype=object)})

    sent = rows.mapInArrow(tidy(send), "bucket int, block bigint, blob binary")
    found = sent.groupBy("bucket").applyInPandas(count, "block bigint, blob binary")
    address = shared_folder(rows.sparkSession, f"repeats{level}")
    found.repartition(F.col("block")).write.partitionBy("block").parquet(address)
    return address


def _any(spark: SparkSession, address: str) -> bool:
    """Whether some block has answers; the folder's names are read up to the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(address)
    names = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(folder)
    while names.hasNext():
        if names.next().getPath().getName().startswith("block="):
            return True
    return False


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked; between words that stay neighbours, what stood there."""
    out, last, joined = [], 0, True
    for m, drop in zip(_WORD.finditer(text), gone.tolist(), strict=True):
        if drop:
            joined = False
        else:
            out.append(text[last : m.start()] if joined else b" " if out else b"")
            out.append(m[0])
            joined = True
        last = m.end()
    return b"".join(out)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, first: int = FIRST, cleaned: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: key, n_words, n_removed, kept_sha256 (of the kept words joined by single blanks), where ``cleaned`` clean_text (the text as it was but for the words removed), and, where columns are to be carried, the struct ``carried`` of them."""
    carried = [F.struct(*carry).alias("carried")] if carry else []
    more = ["carried"] * len(carried)
    rows = with_blocks(docs, [F.col(key), *carried, F.col(text).alias("_t")])
    lengths, answers = levels(window, first), []
    buckets = bucket_count(docs, BUCKET_BYTES, rows)
    for _ in lengths:
        answers.append(_compare(rows.select("_t", "_block"), answers, lengths, window, buckets))
        if not _any(docs.sparkSession, answers[-1]):
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, hashes, second = _answers(answers, lengths, window), WordHashes(), WordHashes(SECOND)
        for block, (keys, *others), texts in slices(batches):
            passages = Passages(texts, hashes, window, second)
            for length, repeated in answer(block):
                passages.keep(length, repeated)
            gone = passages.removed()
            sums = [hashlib.sha256(x).hexdigest() for x in passages.kept(gone)]
            removed = np.array([np.count_nonzero(g) for g in gone], np.int64)
            clean = [(cut(t, g) if n else t).decode() for t, g, n in zip(texts, gone, removed.tolist(), strict=True)] if cleaned else []
            columns = [keys, pa.array(passages.sizes), pa.array(removed), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(clean, pa.string())] * cleaned, *others], names=[key, "n_words", "n_removed", "kept_sha256", *["clean_text"] * cleaned, *more])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *more)]
    return rows.mapInArrow(tidy(run), ", ".join([kinds[0], "n_words bigint, n_removed bigint, kept_sha256 string", *["clean_text string"] * cleaned, *kinds[1:]]))
