"""SentencePiece encoding as a relational lattice, and decoding.

A text is cut into units between neighbouring characters that no piece of the vocabulary holds side by side, so that
no piece crosses a cut and each unit is encoded by itself. Each block of rows sends its distinct units once, and a
cohort of some COHORT blocks brings equal ones together, so that a unit has one row a cohort. Over
these the lattice is a join: all substrings of up to the longest piece's length are exploded and equi-joined to the
table of pieces; the edges found are grouped by unit and folded by a higher-order aggregate. The folded path, a few
numbers a unit, is kept under the number of each block that holds it, and the texts, read again, are put together from
the paths. A unit meets itself at most once a block of its cohort, however often it stands anywhere, so that no unit is
a hot key.

Two folds are there. ``viterbi`` finds the path of the greatest sum of scores, as unigram vocabularies ask for.
``merges`` is for BPE vocabularies, whose scores are ranks (a best path over ranks gives other ids than the library):
the edges are passed once from the best rank to the worst, of equal ones from left to right, and each joins two
neighbouring segments where these make it up. One pass is enough where every piece in the unit is itself made by merges
in that order, since then no merge makes an earlier one possible later.

Two kinds of units aren't exploded: those of more than LONGEST characters, the boundaries of which don't fit a 64-bit
mask and of which all substrings would be more than a row should grow to, and those that hold a piece made by merges in
another order (of the 32,000 pieces of the supplied vocabulary, one: a run of sixteen blanks). They get their ids from
the same vocabulary by a heap (or a plain best path), in the pass that puts the texts together. The ids are the
library's in both ways, and nothing is cut short.

Defined results: a null or empty text has no ids; characters without a piece become bytes; texts and units of any
length are encoded whole; repeated rows get equal ids; an empty table gives an empty table; other columns are not
looked at, whatever their names. Decoding gives the text back, but for U+2581, which is the library's sign for a blank.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import Replies, bucket_count, shared_folder, slim, tidy, with_blocks
from kinweave.llm.repair_codec import Words

BLANK = "▁"
#: Characters of a unit whose boundaries fit a 64-bit mask.
LONGEST = 60
#: Rows of a block, whose distinct units a task holds at a time with their ids, bytes of input whose units meet in a task, and distinct units of a block that are dealt together.
BLOCK_ROWS, BUCKET_BYTES, DEALT = 4096, 1 << 20, 8192
#: Blocks, on average, whose equal units are encoded once.
COHORT = 16
#: Characters of texts whose units are looked up at once.
CHUNK = 1 << 17
#: Ids that are decoded at once.
DECODED = 1 << 16
#: Units of a block whose paths become ids at a time; a task remembers some eight times as many.
UNITS = 1 << 15
#: Groups that an aggregate over objects holds before it sorts them; a task has some tens of thousands.
_GROUPS = ("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(1 << 20))


class Vocabulary:
    """Pieces of a model file: (piece, id, score) that text can match, ids of bytes, what each id decodes to, and which characters stand side by side in pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        self._of([(model.id_to_piece(i), i, model.get_score(i)) for i in ids if not special[i] and not model.is_byte(i)])
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.text = [b"" if special[i] else bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(BLANK, " ").encode() for i in ids]
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary without pieces for all bytes")

    def _of(self, pieces: list[tuple[str, int, float]]) -> None:
        if len(pieces) >= 1 << 20:
            raise ValueError("a vocabulary of more than a million pieces")
        self.pieces = pieces
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
        #: piece: (rank of its score, id, score)
        self.known = {p: (ranks[s], i, s) for p, i, s in pieces}
        self.longest = max(map(len, self.known))
        if self.longest >= 64:
            raise ValueError("a piece of more than 63 characters")
        #: The id of a character that is a piece, by its code point; else -1.
        self.single = np.full(0x110000, -1, np.int32)
        for p, (_, i, _) in self.known.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        chars = sorted({c for p in self.known if len(p) > 1 for c in p})
        self._width = len(chars) + 1
        self._class = np.zeros(0x110000, np.int32)
        for at, c in enumerate(chars, 1):
            self._class[ord(c)] = at
        self._apart = np.ones(self._width**2, bool)
        for p in self.known:
            at = self._class[[ord(c) for c in p]]
            self._apart[at[:-1] * self._width + at[1:]] = False

    def irregular(self) -> list[str]:
        """Pieces made by merges of which a later one precedes an earlier one in the order of rank and start, so that one pass over edges can miss them."""
        out = []
        for piece in self.known:
            made = [(rank, s, e) for rank, s, _, e in _merges(len(piece), self.edges(piece))]
            if made != sorted(made):
                out.append(piece)
        return out

    def edges(self, unit: str) -> list[tuple[int, int, int]]:
        """(rank, start, end) of the pieces of two characters or more in a unit."""
        n, known = len(unit), self.known
        return [(known[p][0], s, e) for s in range(n) for e in range(s + 2, min(n, s + self.longest) + 1) if (p := unit[s:e]) in known]

    def cut(self, text: str) -> list[str]:
        """The units of a text that isn't empty, blanks written as U+2581 and one in front."""
        text = BLANK + text.replace(" ", BLANK)
        kind, name = np.uint16, "utf-16-le"
        codes = np.frombuffer(text.encode(name, "surrogatepass"), kind)
        if len(codes) != len(text):  # characters of two units each
            kind, name = np.uint32, "utf-32-le"
            codes = np.frombuffer(text.encode(name, "surrogatepass"), kind)
        at = self._class[codes]
        apart = self._apart[at[:-1] * self._width + at[1:]]
        # A blank, of which there is none left, goes between units, and the library's own split does the rest.
        places = np.arange(len(codes), dtype=np.int32)
        places[1:] += np.cumsum(apart, dtype=np.int32)
        out = np.full(places[-1] + 1, 32, kind)
        out[places] = codes
        return out.tobytes().decode(name, "surrogatepass").split(" ")

    def places(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(texts that aren't empty in UTF-8, blanks written as U+2581 and one in front of each; starts and ends of their units; the first unit of each text)."""
        joined = " ".join([BLANK + t.replace(" ", BLANK) for t in texts])  # of blanks none are left, so that they part the texts
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = self._class[codes]
        edges = np.flatnonzero(self._apart[at[:-1] * self._width + at[1:]]) + 1
        size = (codes >= 0x80).astype(np.int64)
        size += codes >= 0x800
        size += codes >= 0x10000
        ends = np.cumsum(size + 1)
        edges = np.concatenate(([0], edges, [len(codes)]))
        within = codes[edges[:-1]] != 32  # a blank is a unit by itself, as no piece holds one
        bounds = np.concatenate(([0], ends))[edges]
        starts = bounds[:-1][within]
        first = np.searchsorted(starts, np.concatenate(([0], ends[codes == 32])))
        return joined.encode("utf-8", "surrogatepass") + bytes(16), starts, bounds[1:][within], first

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: as many rows as the vocabulary has pieces, whatever the corpus."""
        return spark.createDataFrame([(p, r, i, s) for p, (r, i, s) in self.known.items()], "piece string, rank long, id long, score double")

    def ids_of(self, unit: str, fold: str) -> list[int]:
        """Ids of a unit of any length, without the relational lattice."""
        at = merged(len(unit), self.edges(unit)) if fold == "merges" else self._best(unit)
        return [i for a, b in zip(at, at[1:], strict=False) for i in self._spelled(unit[a:b])]

    def _spelled(self, segment: str) -> list[int]:
        found = self.known.get(segment)
        return [found[1]] if found else [self.bytes[x] for x in segment.encode("utf-8", "surrogatepass")]

    def ids_along(self, unit: str, path: list[int]) -> list[int]:
        """Ids of a unit along a path (starts, lengths and ids, see _EDGE); characters beside it stand for themselves."""
        out, at = [], 0
        for x in path:
            s = x >> 26
            for c in unit[at:s]:
                out += self._spelled(c)
            out.append(x & 0xFFFFF)
            at = s + (x >> 20 & 63)
        for c in unit[at:]:
            out += self._spelled(c)
        return out

    def _best(self, unit: str) -> list[int]:
        best, back = [0.0], [0]
        for e in range(1, len(unit) + 1):
            found = [(best[s] + self.known[p][2], s) for s in range(max(0, e - self.longest), e) if (p := unit[s:e]) in self.known]
            score, s = max([*found, (best[e - 1] - 1e12, e - 1)])
            best.append(score)
            back.append(s)
        at = [len(unit)]
        while at[-1]:
            at.append(back[at[-1]])
        return at[::-1]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what all ids decode to, one after the other; where each begins; its bytes)."""
        sizes = np.array([len(x) for x in self.text], np.int32)
        return np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(sizes, dtype=np.int32) - sizes, sizes

    def decode(self, ids) -> str:
        data = b"".join([self.text[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


# --- units -----------------------------------------------------------------------------------------------------


def _merges(n: int, edges: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """The merges of a unit in their order, by a heap: (rank, start, middle, end). Edges are (rank, start, end) of pieces of two characters or more."""
    rank = {(s, e): r for r, s, e in edges}
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the segment that starts at i: its end, the start of the one before
    alive = [True] * n
    heap = [(rank[i, i + 2], i, i + 2) for i in range(n - 1) if (i, i + 2) in rank]
    heapq.heapify(heap)
    while heap:
        r, s, e = heapq.heappop(heap)
        if not alive[s]:
            continue
        middle = after[s]
        if middle >= e or middle >= n or not alive[middle] or after[middle] != e:
            continue
        yield r, s, middle, e
        alive[middle] = False
        after[s] = e
        if e < n:
            before[e] = s
            if (s, after[e]) in rank:
                heapq.heappush(heap, (rank[s, after[e]], s, after[e]))
        b = before[s]
        if b >= 0 and (b, e) in rank:
            heapq.heappush(heap, (rank[b, e], b, e))


def merged(n: int, edges: list[tuple[int, int, int]]) -> list[int]:
    """Boundaries after all merges."""
    gone = {middle for _, _, middle, _ in _merges(n, edges)}
    return [i for i in range(n) if i not in gone] + [n]


# An edge is a number: rank, start, length and id, from the highest bits to the lowest, so that edges are ordered by rank, then by start. The lower half, without the rank, is a step of a path.
_EDGE = "shiftleft(rank, 32) | shiftleft(CAST(s AS BIGINT), 26) | shiftleft(CAST(e - s AS BIGINT), 20) | id"
_S, _L = "CAST(shiftright(x, 26) & 63 AS INT)", "CAST(shiftright(x, 20) & 63 AS INT)"
#: Added to a step to make it a 32-bit integer with a sign.
_SIGNED = -(1 << 31)


#: The steps of the edges that are segments of the boundaries in the mask b. It stands in the folds' last functions, where b is a variable: as a column, the optimiser would put the whole fold into the filter's function.
_PATH = f"""sort_array(array_distinct(transform(
        filter(edges, x -> (shiftrightunsigned(b, {_S}) & 1L) = 1L AND (shiftrightunsigned(b, {_S}) & (shiftleft(2L, {_L}) - 1L)) = shiftleft(1L, {_L}) + 1L),
        x -> CAST((x & 4294967295L) + {_SIGNED}L AS INT))))"""


def _path_by_merges() -> Column:
    """An edge joins two segments where its ends are boundaries and one boundary lies between."""
    within = f"shiftrightunsigned(b, {_S}) & (shiftleft(2L, {_L}) - 1L)"
    return F.expr(f"""aggregate(sort_array(edges), shiftleft(1L, n + 1) - 1L,
        (b, x) -> if((shiftrightunsigned(b, {_S}) & 1L) = 1L AND bit_count({within}) = 3 AND (shiftrightunsigned(b, {_S} + {_L}) & 1L) = 1L,
            b & ~shiftleft(shiftleft(1L, {_L}) - 2L, {_S}), b),
        b -> {_PATH})""")


def _path_by_viterbi() -> Column:
    """The path of the greatest sum of scores; of equal ones the shorter last piece. A character without a piece costs more than any path of pieces."""
    return F.expr(f"""aggregate(sequence(1, n), array(named_struct('score', 0D, 's', -1)), (best, k) ->
        concat(best, array(array_max(concat(
            transform(filter(scored, x -> x.e = k), x -> named_struct('score', best[x.s].score + x.score, 's', x.s)),
            array(named_struct('score', best[k - 1].score - 1e12D, 's', k - 1)))))),
        best -> aggregate(sequence(1, n), named_struct('at', n, 'b', shiftleft(1L, n)),
            (a, i) -> if(a.at > 0, named_struct('at', best[a.at].s, 'b', a.b | shiftleft(1L, best[a.at].s)), a),
            a -> aggregate(array(a.b), array(0), (none, b) -> {_PATH})))""")


def encode_units(units: DataFrame, vocabulary: Vocabulary, fold: str = "merges") -> DataFrame:
    """block, unit and path of (block, sub, unit) rows that are dealt by sub; the groupings keep that dealing, so that nothing moves. A row that stands twice (two tasks may read parts of a block) counts once. A path is an array of steps (with a sign, see _SIGNED) by their starts; characters that no step covers stand for themselves. A unit without any edge has no row."""
    table = F.broadcast(vocabulary.table(units.sparkSession))  # fixed by the vocabulary
    rows = units.where(F.length("unit") <= LONGEST).groupBy("unit", "sub").agg(F.collect_set("block").alias("blocks")).withColumn("n", F.length("unit"))
    # Characters by themselves merge nothing; only the best path asks for their scores.
    least = 1 if fold == "viterbi" else 2
    starts = rows.where(F.col("n") >= least).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.col("s") + least, F.least(F.col("n"), F.col("s") + vocabulary.longest))).alias("e"))
    found = spans.select("blocks", "sub", "unit", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("piece")).join(table, "piece")
    lists = [F.first("blocks").alias("blocks"), F.collect_list(F.expr(_EDGE)).alias("edges")]
    if fold == "viterbi":
        lists.append(F.collect_list(F.struct("s", "e", "score")).alias("scored"))
    grouped = found.groupBy("unit", "sub").agg(*lists).withColumn("n", F.length("unit"))
    folded = grouped.select("blocks", "unit", (_path_by_viterbi() if fold == "viterbi" else _path_by_merges()).alias("path"))
    return folded.select(F.explode("blocks").alias("block"), "unit", "path")


# --- texts -----------------------------------------------------------------------------------------------------


def _send(batches: Iterator[pa.RecordBatch], cut, irregular: list[str]) -> Iterator[pa.RecordBatch]:
    """Distinct units of each block, blanks between, dealt by hash to as many parts as there are DEALT of them (the next power of two, so that blocks of like size have as many); those that the lattice doesn't take stay behind."""
    seen: set[str] = set()
    current = None

    def flush():
        short = [u for u in seen if len(u) <= LONGEST]
        for p in irregular:
            short = [u for u in short if p not in u]
        parts = 1 << max(0, -(-len(short) // DEALT) - 1).bit_length()
        dealt: list[list[str]] = [[] for _ in range(parts)]
        for unit in short:
            dealt[zlib.crc32(unit.encode("utf-8", "surrogatepass")) % parts].append(unit)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([current] * parts, pa.int64()), pa.array([parts] * parts, pa.int32()), pa.array(range(parts), pa.int32()), pa.array([" ".join(u) for u in dealt], pa.string())], names=["block", "parts", "part", "units"])

    for batch in batches:
        for text, block in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if block != current:
                if seen:
                    yield flush()
                current = block
            if text := text.as_py():
                seen.update(cut(text))
    if seen:
        yield flush()


def _answers(vocabulary: Vocabulary, units: pa.Array, paths: pa.Array) -> dict[str, bytes]:
    """Units with their ids as bytes, from the paths: a number for each character, of which those inside a step go."""
    steps, ends = paths.flatten().to_numpy().astype(np.int64) - _SIGNED, paths.offsets.to_numpy().astype(np.int64)
    names = units.to_pylist()
    starts = np.concatenate(([0], np.cumsum([len(x) for x in names])))
    at, length = np.repeat(starts[:-1], np.diff(ends)) + (steps >> 26), (steps >> 20) & 63
    inside = np.zeros(starts[-1] + 1, np.int32)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + length, -1)
    out = vocabulary.single[np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)]
    covered = np.cumsum(inside[:-1]) > 0
    spelled = np.concatenate(([0], np.cumsum(~covered & (out < 0))))[starts]
    out[covered] = -1
    out[at] = steps & 0xFFFFF
    kept = (4 * np.concatenate(([0], np.cumsum(out >= 0)))[starts]).tolist()
    data = out[out >= 0].astype("<i4").tobytes()
    found = dict(zip(names, [data[a:b] for a, b in zip(kept, kept[1:], strict=False)], strict=True))
    # Units with characters that have no piece, and become bytes.
    for i in np.flatnonzero(np.diff(spelled)).tolist():
        found[names[i]] = np.array(vocabulary.ids_along(names[i], steps[ends[i] - ends[0] : ends[i + 1] - ends[0]].tolist()), "<i4").tobytes()
    return found


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", fold: str = "merges", ids: bool = True) -> DataFrame:
    """One row per row: key, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_equal (whether decoding gives the text back) and, where asked for, ids."""
    spark, vocabulary = docs.sparkSession, Vocabulary(path)
    irregular = vocabulary.irregular() if fold == "merges" else []
    rows = with_blocks(docs, [F.col(key), F.col(text).alias("_t")], BLOCK_ROWS)
    sent = spark.sparkContext.broadcast(vocabulary)
    cohorts = max(1, -(-rows.select("_block").distinct().count() // COHORT))  # a scan of no columns
    units = rows.select("_t", "_block").mapInArrow(tidy(lambda b: _send(b, sent.value.cut, irregular)), "block bigint, parts int, part int, units string")
    units = units.select("block", F.xxhash64(F.pmod("block", F.lit(cohorts)), "parts", "part").alias("sub"), "units").repartition(bucket_count(docs, BUCKET_BYTES, rows), "sub")
    units = units.select("block", "sub", F.explode(F.split("units", " ")).alias("unit"))
    address = shared_folder(spark, "answers")
    before = spark.conf.get(_GROUPS[0], None)
    spark.conf.set(*_GROUPS)
    try:
        encode_units(units, vocabulary, fold).write.partitionBy("block").parquet(address)
    finally:
        spark.conf.unset(_GROUPS[0]) if before is None else spark.conf.set(_GROUPS[0], before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, v, current, known = Replies(address), sent.value, None, {}
        cut, (flat, places, sizes) = v.cut, v.flat()

        class Found(dict):
            """Ids of the block's units as bytes; of those that the lattice didn't take, or without an edge, when they are met."""

            def __missing__(self, unit: str) -> bytes:
                self[unit] = x = np.array(v.ids_of(unit, fold), "<i4").tobytes()
                return x

        def made(units: list[bytes], bare: list[bool]) -> tuple[np.ndarray, list[int]]:
            found = [known[u.decode("utf-8", "surrogatepass")] for u in units]
            return np.frombuffer(b"".join(found), "<i4"), [len(x) // 4 for x in found]

        words = Words(made, np.dtype("<i4"))
        words.BOUND = 8 * UNITS

        def encoded(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """(ids of texts of one block, their number for each)."""
            full = [i for i, t in enumerate(held) if t]
            counts = np.zeros(len(held), np.int64)
            if not full:
                return np.empty(0, "<i4"), counts
            if len(held) == 1 and len(held[0]) > CHUNK:
                found = np.frombuffer(b"".join(map(known.__getitem__, cut(held[0]))), "<i4")
                return found, np.array([len(found)])
            data, starts, ends, first = v.places([held[i] for i in full])
            at = words.find(data, starts, ends, np.zeros(len(starts), bool))
            n = words.n[at].astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(n)))
            counts[full] = np.diff(sums[np.append(first, len(starts))])
            return words.ids[np.repeat(words.at[at] - sums[:-1], n) + np.arange(sums[-1])], counts

        def decoded(found: np.ndarray) -> Iterator[np.ndarray]:
            """The bytes of ids, some at a time."""
            for at in range(0, len(found), DECODED):
                some = found[at : at + DECODED]
                n = sizes[some]
                sums = np.cumsum(n, dtype=np.int32)
                yield flat[np.repeat(places[some] - sums + n, n) + np.arange(sums[-1], dtype=np.int32)]

        def alike(found: np.ndarray, counts: np.ndarray, held: list[str]) -> list[bool]:
            """Whether the ids of each text decode to it."""
            got = b"".join(x.tobytes() for x in decoded(found))
            told = [(" " + t).replace(BLANK, " ").encode("utf-8", "surrogatepass") if t else b"" for t in held]
            ends = np.concatenate(([0], np.cumsum(sizes[found], dtype=np.int64)))[np.cumsum(counts)].tolist()
            return [got[a:b] == t for a, b, t in zip([0, *ends], ends, told, strict=False)]

        for batch in slim(batches):
            values, blocks, out, equal = [x or "" for x in batch.column(1).to_pylist()], batch.column(2).to_pylist(), [], []
            start = 0
            while start < len(values):
                block = blocks[start]
                if block != current:
                    current, known = block, Found()
                    table = reader(block, ["unit", "path"])
                    for part in table.to_batches(UNITS) if table is not None else ():
                        known.update(_answers(v, *part.columns))
                    table = None
                end, size = start, 0
                while end < len(values) and blocks[end] == block and (end == start or size + len(values[end]) <= CHUNK):
                    size += len(values[end])
                    end += 1
                out.append(encoded(values[start:end]))
                equal += alike(*out[-1], values[start:end])
                start = end
            counts = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
            every = np.concatenate([x[0] for x in out]) if out else np.empty(0, "<i4")
            offsets = np.concatenate(([0], np.cumsum(counts)))
            data, at = every.tobytes(), (4 * offsets).tolist()
            sums = [zlib.crc32(memoryview(data)[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [batch.column(0), pa.array(counts), pa.array(sums, pa.int64()), pa.array(equal, pa.bool_())]
            names = [key, "n_pieces", "ids_crc32", "decoded_equal"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(every)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, decoded_equal boolean" + ", ids array<int>" * ids)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the texts of arrays of ids."""
    vocabulary = Vocabulary(path)

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else vocabulary.decode(x) for x in values])

    return rows.withColumn(into, of(F.col(ids)))
