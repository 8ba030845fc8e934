"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

Benchmark items come in blocks of at most BLOCK_WORDS words (an item longer than that is cut into pieces that overlap by
a window less one word); each block becomes one automaton over word numbers. Training texts stream through it and the
length of the longest match that ends at each word is tracked: where it reaches the window, the words of the window
are hit. Items shorter than a window are hit where they occur whole. A benchmark of one block is sent to the executors
and texts are read once, without a shuffle. A larger one is taken a block at a time: a pass over the texts for each,
whose hits are kept by blocks of rows, and one more that puts them together. Neither the driver nor a worker ever holds
more than one block.

Defined results: a null or empty text, and one without words, has no hits; very long texts are read whole; an item
without words or text is no window; items without an id hit words like others, count as one item together and have no
name; equal items count once each; a document of which exactly ``max_coverage`` is hit isn't dropped; repeated rows get
equal rows; an empty table gives an empty table, and an empty benchmark no hits; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Replies, kept, shared_folder, slim, tidy, with_blocks

#: Bytes of words stay (ASCII letters in lower case, digits, and all bytes of what is beyond ASCII); every other byte becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
WINDOW = 10
#: Words of items in one automaton: some 300 MB in a Python worker at most.
BLOCK_WORDS = 500_000


def words(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8: runs of ASCII letters, digits and anything beyond ASCII, A to Z lower-cased."""
    return data.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences. ``numbers`` maps words to transition labels."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        ends: list[tuple[int, int]] = []
        for name, sequence in items:
            if not sequence:
                continue
            last = 0
            for word in sequence:
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers)))
                self.items[last].add(name)
            if len(sequence) < window:
                ends.append((last, len(sequence)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.items[self.link[state]] |= self.items[state]
        self.items[0] = set()
        # Of short items, the lengths that are suffixes of a state's strings; whole[state][n]: the items of length n.
        self.whole: list[dict[int, set[str]]] = [{} for _ in self.length]
        names = {}
        for name, sequence in items:
            if 0 < len(sequence) < window:
                names.setdefault(tuple(sequence), set()).add(name)
        for sequence, found in names.items():
            state = 0
            for word in sequence:
                state = self.next[state][self.numbers[word]]
            self.whole[state][len(sequence)] = found
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if above := self.whole[self.link[state]]:
                self.whole[state] = above | self.whole[state]
        self.shortest = min([window, *(n for _, n in ends)]) if self.numbers else 0

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, label: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p != -1 and self.next[p].get(label) == q:
            self.next[p][label] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, label: int) -> int:
        if (q := self.next[last].get(label)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, label)
        new, p = self._state(self.length[last] + 1), last
        while p != -1 and label not in self.next[p]:
            self.next[p][label] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][label]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, label)
        return new

    def hits(self, sequence: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """(a flag for each word, names of the items of which a window occurs). Words outside the benchmark reset the match, so that only runs of known words are walked."""
        if not self.numbers or len(sequence) < self.shortest:
            return None, set()
        labels = np.fromiter(map(self.numbers.get, sequence, [-1] * len(sequence)), np.int64, len(sequence))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (labels >= 0).view(np.int8), [0]))))
        flags, found = None, set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue
            state = length = 0
            for at, label in enumerate(labels[start:end].tolist(), start):
                while state and label not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if (to := self.next[state].get(label)) is None:
                    continue
                state, length = to, length + 1
                take = 0
                if length >= self.window:
                    take, top = self.window, state
                    while self.length[self.link[top]] >= self.window:
                        top = self.link[top]
                    found |= self.items[top]
                for n, names in self.whole[state].items():
                    if n <= length:
                        take = max(take, n)
                        found |= names
                if take:
                    if flags is None:
                        flags = np.zeros(len(sequence), bool)
                    flags[at + 1 - take : at + 1] = True
        return flags, found


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
    """Built once in a worker, which holds one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def read_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of a bounded number of words, one block after the other; the driver holds one partition and one block."""
    most = max(block_words, 2 * window)
    block, size = [], 0
    for name, value in benchmark.select(item, text).toLocalIterator():
        sequence = words((value or "").encode())
        # Each window of a long item stands in one piece at least, and no piece is shorter than a window.
        starts = range(0, len(sequence) - window + 1, most - window + 1) if len(sequence) > most else [0] if sequence else []
        for at in starts:
            piece = sequence[at : at + most]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((None if name is None else str(name), piece))
            size += len(piece)
    if block:
        yield block


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut(data: bytes, flags: np.ndarray, least: int) -> bytes:
    """The text without the hit spans of at least so many words, from a span's first word to its last."""
    at = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    out, last = [], 0
    for a, b in _spans(flags):
        if b - a >= least:
            out.append(data[last : at[a][0]])
            last = at[b - 1][1]
    return b"".join([*out, data[last:]])


def _hits(rows: DataFrame, items: list, window: int) -> DataFrame:
    """(block, row, spans, names) of texts that one block of items hits."""
    tag, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tag, sent.value, window)
        for batch in slim(batches):
            found = []
            for value, block, row in zip(batch.column(0).cast(pa.binary()), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                flags, names = automaton.hits(words(value.as_py() or b""))
                if flags is not None:
                    found.append((block, row, [x for span in _spans(flags) for x in span], list(names)))
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "row", "spans", "names"])

    return rows.select("_t", "_block", "_row").mapInArrow(tidy(run), "block bigint, row bigint, spans array<int>, names array<string>")


def _kept_hits(address: str, block: int) -> dict[int, list[tuple[list[int], list[str | None]]]]:
    """What the passes found in a block of rows, by row."""
    out, table = defaultdict(list), Replies(address)(block, ["row", "spans", "names"])
    if table is not None:
        for row, spans, names in zip(*(c.to_pylist() for c in table.columns), strict=True):
            out[row].append((spans, names))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, cleaned: bool = True, carry: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row: key, n_words, n_hit, n_items, items (names as text, sorted, comma-joined), contaminated, spans (of words: "start-end", space-joined), coverage, dropped (coverage over the limit) and, where ``cleaned``, clean_text (the text without hit spans of min_span words or more), and, where columns are to be carried, the struct ``carried`` of them."""
    spark = docs.sparkSession
    blocks = read_items(benchmark, window=window, block_words=block_words)
    first, second = next(blocks, []), next(blocks, None)
    columns = [F.col(key), F.col(text).alias("_t"), *([F.struct(*carry).alias("carried")] if carry else [])]
    more = ["carried"] * bool(carry)
    tag, sent, address = uuid.uuid4().hex, None, None
    if second is None:
        rows = docs.select(*columns)
        sent = spark.sparkContext.broadcast(first)
    else:
        rows = with_blocks(docs, columns, row_id="_row").select(key, "_t", "_block", "_row", *more)
        address, passes = shared_folder(spark, "hits"), []
        while first:
            passes.append(kept(_hits(rows, first, window), "pass"))
            first, second = second, next(blocks, None)
        found = passes[0]
        for df in passes[1:]:
            found = found.unionByName(df)
        found.repartition("block").write.partitionBy("block").parquet(address)
    fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string()), ("coverage", pa.float64()), ("dropped", pa.bool_()), ("clean_text", pa.string())]
    fields = fields if cleaned else fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = None if sent is None else _automaton(tag, sent.value, window), (None, {})
        for batch in slim(batches):
            out = {name: [] for name, _ in fields}
            places = [c.to_pylist() for c in batch.columns[2:4]] if sent is None else None
            for at, value in enumerate(batch.column(1).cast(pa.binary())):
                value = value.as_py() or b""
                sequence = words(value)
                if automaton is not None:
                    flags, found = automaton.hits(sequence)
                else:
                    block, row = places[0][at], places[1][at]
                    if block != held[0]:
                        held = block, _kept_hits(address, block)
                    flags, found = None, set()
                    for spans, names in held[1].get(row, ()):
                        flags = np.zeros(len(sequence), bool) if flags is None else flags
                        for a, b in zip(spans[::2], spans[1::2], strict=True):
                            flags[a:b] = True
                        found.update(names)
                n_hit = 0 if flags is None else int(flags.sum())
                coverage = n_hit / len(sequence) if sequence else 0.0
                named = ",".join(sorted(x for x in found if x is not None))
                result = (len(sequence), n_hit, len(found), named, n_hit > 0, "" if flags is None else " ".join(f"{a}-{b}" for a, b in _spans(flags)), coverage, coverage > max_coverage)
                if cleaned:
                    result += ((value if flags is None else cut(value, flags, min_span)).decode(),)
                for (name, _), x in zip(fields, result, strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], t) for n, t in fields), *batch.columns[2 if sent is not None else 4 :]], names=[key, *out, *more])

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    kind = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(key), *(f"{n} {kinds[t]}" for n, t in fields), *map(kind, more)])
    return rows.mapInArrow(tidy(run), schema)
