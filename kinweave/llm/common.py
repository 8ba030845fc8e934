"""What the operators share: the folder all executors see, stable blocks of rows, replies kept by block."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one input file that make a block. A block's reply is held by one task at a time.
BLOCK_ROWS = 16_384


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's address under spark.checkpoint.dir. Only where that is unset and Spark is one local process (tests, a laptop) a local one is made; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root.rstrip('/')}/kinweave/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and no later reader computes it anew."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(address: str):
    """(pyarrow file system, path) of an address of the shared folder."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def with_blocks(df: DataFrame, columns: list, rows: int = BLOCK_ROWS, row_id: str | None = None) -> DataFrame:
    """Adds ``_block``: a number for each run of ``rows`` rows of a file, and, where named, a number for each row. They depend on the stored rows alone, not on how a scan is split, so that every scan (and every retry after a lost executor) sees the same ones. A frame that isn't a plain scan is first written to the shared folder."""
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    numbers = [F.xxhash64(path, F.floor(index / rows)).alias("_block"), *([F.xxhash64(path, index).alias(row_id)] if row_id else [])]
    try:
        return df.select(*columns, *numbers)
    except AnalysisException:
        return kept(df.select(*columns), "rows").select("*", *numbers)


class Replies:
    """Reads, in a task, what was kept for a block: a column of a Parquet folder that is partitioned by ``block``."""

    def __init__(self, address: str):
        self.address = address

    def __call__(self, block: int, columns: list[str]):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = file_system(self.address)
        found = system.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True))
        tables = [pq.ParquetFile(f).read(columns=columns) for x in found if x.path.endswith(".parquet") for f in [system.open_input_file(x.path)]]
        return pa.concat_tables(tables) if tables else None

    def pairs(self, block: int) -> np.ndarray:
        """All pairs of numbers in the block's ``blob`` rows, each once, in ascending order."""
        table = self(block, ["blob"])
        return ordered_pairs(np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in (table["blob"] if table is not None else ())] or [NO_PAIRS]))[0]

    def hashes(self, block: int) -> np.ndarray:
        """All numbers in the block's ``blob`` rows, in ascending order."""
        table = self(block, ["blob"])
        if table is None:
            return np.empty(0, np.uint64)
        return np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["blob"]] or [np.empty(0, np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def given_back(collect: bool = True) -> None:
    """Gives this process's freed memory back to the system: the C library keeps much of it below blocks that are still in use. Without glibc nothing happens."""
    if collect:
        gc.collect()
    if (arrow := sys.modules.get("pyarrow")) is not None:
        arrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task):
    """A task's function that gives its memory back when it has ended: Python workers stay for later tasks, beside an executor's heap."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            given_back(False)

    return run


def slim(batches, rows: int = 2_048):
    """The batches in slices of so many rows, so that what is made of one isn't held for thousands of texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def released(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps left, in Python and in the JVM. Spark frees a broadcast or a shuffle when the JVM's collector meets it, and collects by itself only when the heap is full."""
    given_back()
    spark.sparkContext._jvm.System.gc()


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound. Other seeds give other hashes."""

    BOUND = 400_000

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eight(data: bytes, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes of ``data`` from each place on, as little-endian numbers; bytes beyond the ``left`` ones are zero. Seven bytes at least follow the last place."""
    return np.ndarray(len(data) - 7, "<u8", data, 0, (1,))[at] & _BELOW[np.minimum(left, 8)]


#: 1 for bytes of words, 0 for the six blanks; and those blanks as one.
_INSIDE = bytes(0 if x in b" \t\n\v\f\r" else 1 for x in range(256))
ONE_BLANK = bytes(x if _INSIDE[x] else 32 for x in range(256))


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts, one after the other with blanks between, a blank in front and eight behind; starts and ends of their words; words of each text)."""
    data = b"".join((b" ", b" ".join(texts), b" " * 8))
    inside = np.frombuffer(data.translate(_INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds))


#: Bytes of a word that is hashed by numbers of eight bytes each; of longer ones there are few.
LONG_WORD = 64


def placed_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, longer: WordHashes) -> np.ndarray:
    """64-bit hashes of the words at places, by the seed of ``longer``; eight bytes of all words are taken in at a time. Those of over LONG_WORD bytes are hashed one by one."""
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 ^ longer.seed))
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + eight(data, starts, sizes))
        for at in range(8, LONG_WORD, 8):
            some = np.flatnonzero(sizes > at)
            if not len(some):
                break
            out[some] = mixed(out[some] * np.uint64(0xD6E8FEB86659FD93) + eight(data, starts[some] + at, sizes[some] - at))
    some = np.flatnonzero(sizes > LONG_WORD)
    if len(some):
        out[some] = longer.of([data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive words; built by doubling, so it takes about log2(n) passes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        have, at, length, left, offset = hashes, None, 1, n, 0
        while left:
            if left & 1:
                part = have[offset : offset + len(hashes) - n + 1]
                at = part if at is None else mixed(at * np.uint64(0x9E3779B97F4A7C15) + part)
                offset += length
            left >>= 1
            if left:
                have = mixed(have[: len(have) - length] * np.uint64(0xD6E8FEB86659FD93) + have[length:])
                length *= 2
    return at


#: Bytes of text that a task takes at a time.
SLICE_BYTES = 2 << 20


def slices(batches, n_columns: int = 2):
    """Runs of rows of one block with a bounded number of text bytes: (block, columns before the text as lists, texts as bytes; null is empty). The batches' last column is the block, the one before it the text."""
    import pyarrow as pa

    for batch in batches:
        *others, texts, blocks = batch.columns
        texts, blocks = texts.cast(pa.binary()), blocks.to_pylist()
        start = 0
        while start < len(blocks):
            end, size = start, 0
            held = []
            while end < len(blocks) and blocks[end] == blocks[start] and size < SLICE_BYTES:
                held.append(texts[end].as_py() or b"")
                size += len(held[-1])
                end += 1
            yield blocks[start], [c.slice(start, end - start) for c in others], held
            start = end


def sliding(op, x: np.ndarray, k: int) -> np.ndarray:
    """The least or greatest of each k neighbours, in about log2(k) passes."""
    length = 1
    while 2 * length <= k:
        x = op(x[:-length], x[length:])
        length *= 2
    return op(x[: len(x) - (k - length)], x[k - length :]) if k > length else x


def contained(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values stand in the ordered array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


NO_PAIRS = np.empty((0, 2), np.uint64)


def ordered_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct pairs in ascending order, how often each stands)."""
    if not len(pairs):
        return NO_PAIRS, np.empty(0, np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    heads = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
    return pairs[heads], np.diff(np.append(heads, len(pairs)))


def contained_pairs(pairs: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the pairs stand among the ordered ones."""
    found = np.zeros(len(pairs), bool)
    at, left = np.searchsorted(ordered[:, 0], pairs[:, 0]), np.arange(len(pairs))
    while len(left):  # a second time only where two ordered pairs begin alike
        left = left[at[left] < len(ordered)]
        left = left[ordered[at[left], 0] == pairs[left, 0]]
        same = ordered[at[left], 1] == pairs[left, 1]
        found[left[same]] = True
        left = left[~same]
        at[left] += 1
    return found


def plan_bytes(df: DataFrame) -> int:
    """What Spark takes the frame's size to be: for a scan, its files' bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Buckets that a driver keeps track of without effort. Beyond as many times ``per_bucket`` bytes of input, buckets grow (to some hundred MB at 100 TB).
MOST_BUCKETS = 100_000


def bucket_count(df: DataFrame, per_bucket: int, stored: DataFrame | None = None) -> int:
    """Of a frame whose size Spark doesn't know (no scan), that of what was ``stored`` of it counts. Buckets for numbers that are dealt by value: enough that one holds at most about ``per_bucket`` bytes of the input, up to MOST_BUCKETS, and twice the shuffle partitions at least."""
    df = stored if stored is not None and plan_bytes(df) >= 1 << 60 else df
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-min(plan_bytes(df), 1 << 50) // per_bucket)))


def dealt(hashes: np.ndarray, buckets: int, rows: np.ndarray | None = None):
    """(bucket, slice) of ascending 64-bit hashes, or of rows that belong to them, dealt by ranges of value; empty slices are left out."""
    rows = hashes if rows is None else rows
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    at = np.concatenate(([0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, rows[at[k] : at[k + 1]]


def runs(batches, keys: list[str]):
    """Rows with equal keys that stand one after the other, as a dict of lists: groups of a partition that is ordered by its keys, without the cost of a frame for each."""
    carry: dict[str, list] | None = None
    for batch in batches:
        now = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if carry is not None:
            now = {n: carry[n] + x for n, x in now.items()}
        marks = list(zip(*(now[k] for k in keys), strict=True))
        if not marks:
            continue
        start = 0
        for at in range(1, len(marks)):
            if marks[at] != marks[start]:
                yield {n: x[start:at] for n, x in now.items()}
                start = at
        carry = {n: x[start:] for n, x in now.items()}
    if carry is not None and carry[keys[0]]:
        yield carry


def gathered(rows, names: list[str], kinds: list, most: int = 10_000):
    """Record batches of tuples."""
    import pyarrow as pa

    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    if held:
        yield batch()
