"""Near-duplicate classes by an exact n-gram Jaccard join.

1. A document's set is the 64-bit hashes of its distinct shingles of five words. Documents with equal sets become one
   class (by a 128-bit digest), of which one row goes on.
2. Two sets whose Jaccard similarity is 0.75 or more share a shingle among the first quarter (and one) of each, in any
   one order of all shingles. The order puts shingles that are frequent in some block of documents last. Only these
   first shingles move; documents that share one form a group, named after its least row, and groups with the same
   name are one. Nothing is capped: a group that shares a shingle is kept whole.
3. A group of up to TILE members is a tile; a larger one is cut into tiles by bands of set size (only neighbouring
   bands can link) and, where a band is large, by hash. In a tile, too, only members of the same or the next band are
   compared. A tile's members carry bitmaps of their hashed shingles. What one bitmap has and the other lacks bounds
   the overlap from above; pairs that the bound rules out are dropped.
4. Pairs that remain are compared exactly, by the intersection of sorted arrays, in two rounds: first stars around
   the members with most possible partners, which is linear in a tile's members; then every possible pair whose
   members are still in different components. Pairs inside a component can't change the classes. For the second round
   a tile names its members with such a partner, their sets meet in the tile, and only links that join components
   leave it, so that no row stands for a pair that is merely possible.

Bitmaps are stored when texts are first read; texts are read anew where shingles themselves are needed (for the first
ones, and for exact intersections), and only what is asked for moves. Defined results: a null or empty text, or one
without words, has an empty set and is a class of its own; one under five words has its whole sequence as its only
shingle; texts of any length are compared whole; repeated rows fall into one class; of rows with equal keys the one
that stands first in its file's order of row numbers is kept; an empty table gives an empty table; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Replies, WordHashes, bucket_count, contained, dealt, gathered, kept, mixed, released, runs, shared_folder, slices, tidy, windows, with_blocks
from kinweave.operators.components import components

WORDS, SIMILARITY = 5, (3, 4)
#: Shingles over which a task counts frequent ones, and in how many of the documents a frequent one stands.
COUNTED, FREQUENT = 2_000_000, 8
#: Frequent shingles that are sent to all tasks, at most (16 bytes each); the rest are ordered like rare ones.
KNOWN = 500_000
HELD, BUCKET_BYTES = 1_000_000, 8 << 20
#: Members of a tile, or of a band's part of one.
TILE = 4096
CHUNK = 256
#: Hashes of a tile's sets that a task holds at once, from each of two parts.
SETS = 4_000_000


def sets_of(texts: list[bytes], hashes: WordHashes, n: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    numbers = hashes.of([w for x in words for w in x])
    grams, out, at = windows(numbers, n), [], 0
    for w in words:
        if len(w) >= n:
            out.append(np.unique(grams[at : at + len(w) - n + 1]))
        elif w:
            out.append(windows(numbers[at : at + len(w)], len(w)) ^ np.uint64(len(w)))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(w)
    return out


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each shingle's hash; two bits or more a shingle, a power of two, so that wide ones fold into narrow ones."""
    bits = max(512, 1 << int(2 * len(values) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(values >> np.uint64(7)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _matrix(bitmaps: list[bytes], width: int) -> np.ndarray:
    rows = np.empty((len(bitmaps), width // 8), np.uint64)
    for i, x in enumerate(bitmaps):
        rows[i] = np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), 0)
    return rows


def possible(left: list[bytes], nl: np.ndarray, right: list[bytes], nr: np.ndarray) -> np.ndarray:
    """Which pairs the bitmaps don't rule out: a matrix of flags. The overlap is at most a set's size less the bits that only its own bitmap has."""
    width = min(map(len, [*left, *right]))
    a, b = _matrix(left, width), _matrix(right, width)
    pa_, pb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    out = np.empty((len(a), len(b)), bool)
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        common = np.bitwise_count(a[i : i + step, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        most = np.minimum(nl[i : i + step, None] - (pa_[i : i + step, None] - common), nr[None, :] - (pb[None, :] - common))
        out[i : i + step] = linked(most, nl[i : i + step, None], nr[None, :])
    return out


def linked(overlap, a, b):
    """Whether sets of these sizes with this overlap are similar enough."""
    up, down = SIMILARITY
    return (overlap > 0) & (down * overlap >= up * (a + b - overlap))


def band(n: np.ndarray) -> np.ndarray:
    """Sets that can link are in the same band of size or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(SIMILARITY[1] / SIMILARITY[0]) + 1e-9).astype(np.int64)


def possible_within(bits: list[bytes], n: np.ndarray) -> np.ndarray:
    """The possible pairs of one tile's members, a band with itself and with the next."""
    flags, bands = np.zeros((len(bits), len(bits)), bool), band(n)
    for b in np.unique(bands).tolist():
        left, right = np.flatnonzero(bands == b), np.flatnonzero((bands == b) | (bands == b + 1))
        flags[np.ix_(left, right)] = possible([bits[i] for i in left], n[left], [bits[i] for i in right], n[right])
    flags |= flags.T
    np.fill_diagonal(flags, False)
    return flags


def _stars(flags: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (hub, other): the member with most possible partners, then the next one that isn't reached, tied to one that is."""
    degree, reached, out = flags.sum(1), np.zeros(len(flags), bool), []
    for hub in np.argsort(-degree, kind="stable").tolist():
        if not degree[hub]:
            break
        if reached[hub]:
            continue
        near = np.flatnonzero(flags[hub])
        fresh = near[~reached[near]]
        tie = near[reached[near]][:1]
        out += [(hub, x) for x in [*fresh.tolist(), *tie.tolist()]]
        reached[hub] = True
        reached[fresh] = True
    return out


def _signatures(rows: DataFrame, key: str, n: int) -> DataFrame:
    """For each row rid, key, block, size, digest and bitmap of its set; in rows without rid, frequent shingles and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        key_type = None

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            return values[often].tobytes(), counts[often].astype("<i8").tobytes()

        def batch_of(rids, keys, blocks, sizes, digests, bits, values, counts):
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), keys, pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(values, pa.binary()), pa.array(counts, pa.binary())], names=["rid", "key", "block", "n", "digest", "bits", "frequent", "counts"])

        for block, (rids, keys), texts in slices(batches):
            sets = sets_of(texts, hashes, n)
            key_type = keys.type
            held.append(np.concatenate(sets))
            size += len(held[-1])
            count = len(sets)
            yield batch_of(rids, keys, [block] * count, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [bitmap(s) for s in sets], [None] * count, [None] * count)
            if size >= COUNTED:
                values, counts = frequent()
                yield batch_of([None], pa.nulls(1, key_type), [None], [None], [None], [None], [values], [counts])
                held, size = [], 0
        if held:
            values, counts = frequent()
            yield batch_of([None], pa.nulls(1, key_type), [None], [None], [None], [None], [values], [counts])

    return kept(rows.mapInArrow(tidy(run), f"rid bigint, key {dict(rows.dtypes)['key']}, block bigint, n bigint, digest binary, bits binary, frequent binary, counts binary"), "sets")


def _frequent(signatures: DataFrame) -> np.ndarray:
    """The most frequent shingles, in ascending order of (count, hash); at most KNOWN of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(values.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["h", "c"])

    found = signatures.where("rid IS NULL").select("frequent", "counts").mapInArrow(tidy(spread), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    rows = found.orderBy(F.desc("c"), "h").limit(KNOWN).toPandas()  # at most KNOWN numbers
    rows = rows.sort_values(["c", "h"])
    return rows["h"].to_numpy(np.int64).view(np.uint64)


def _asked(requests: DataFrame, tag: str) -> str:
    """Writes requests (block, rid, ...) by block; returns their address."""
    address = shared_folder(requests.sparkSession, tag)
    requests.repartition(F.col("block")).write.partitionBy("block").parquet(address)
    return address


def _first_shingles(rows: DataFrame, copies: str, frequent: np.ndarray, n: int, buckets: int) -> DataFrame:
    """(bucket, blob): the first shingles of each set that stands for its class, with rid and size."""
    spark = rows.sparkSession
    order = np.argsort(frequent)
    sent = spark.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, reader, current, skip = WordHashes(), Replies(copies), None, set()
        known, place = sent.value
        held, size = [], 0

        def flush():
            nonlocal held, size
            h, rid, m = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, rid, m = h[order], rid[order], m[order]
            rows, at = [], 0
            for k, part in dealt(h, buckets):
                end = at + len(part)
                rows.append((k, part.astype("<u4").tobytes() + rid[at:end].tobytes() + m[at:end].tobytes()))
                at = end
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        # A set's first shingles are its least hashes; scrambled, they go to all buckets alike.
        for block, (rids,), texts in slices(batches):
            if block != current:
                table = reader(block, ["rid"])
                current, skip = block, set(table["rid"].to_pylist()) if table is not None else set()
            numbers = rids.to_numpy()
            wanted = [i for i, r in enumerate(numbers.tolist()) if r not in skip]
            sets = sets_of([texts[i] for i in wanted], hashes, n)
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            often = contained(every, known)
            ends = np.cumsum(sizes)
            for i, s, e in zip(wanted, sets, ends.tolist(), strict=True):
                if not len(s):
                    continue
                first = len(s) - (SIMILARITY[0] * len(s) + SIMILARITY[1] - 1) // SIMILARITY[1] + 1
                f = often[e - len(s) : e]
                if f.any():
                    rare = s[~f]
                    if len(rare) < first:
                        common = s[f]
                        common = common[np.argsort(place[np.searchsorted(known, common)])]
                        rare = np.concatenate((rare, common[: first - len(rare)]))
                    s, m = rare[:first], len(s)
                else:
                    s, m = s[:first], len(s)
                held.append((mixed(s), np.full(len(s), numbers[i], np.int64), np.full(len(s), m, "<i4")))
                size += len(s)
            if size >= HELD:
                yield flush()
        if held:
            yield flush()

    return rows.select("rid", "_t", "_block").mapInArrow(tidy(run), "bucket int, blob binary")


def _groups(tokens: DataFrame) -> DataFrame:
    """Distinct (lead, rid, n): rows that share a first shingle, under the least of them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        h, rid, m = [], [], []
        for blob in part["blob"]:
            k = len(blob) // 16
            h.append(np.frombuffer(blob, "<u4", k))
            rid.append(np.frombuffer(blob, np.int64, k, 4 * k))
            m.append(np.frombuffer(blob, "<i4", k, 12 * k))
        h, rid, m = np.concatenate(h), np.concatenate(rid), np.concatenate(m)
        order = np.lexsort((rid, h))
        h, rid, m = h[order], rid[order], m[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(starts, len(h)))
        lead = np.repeat(rid[starts], sizes)
        shared = np.repeat(sizes > 1, sizes)
        found = pd.DataFrame({"lead": lead[shared], "rid": rid[shared], "n": m[shared].astype(np.int64)})
        return found.drop_duplicates(["lead", "rid"])

    return tokens.groupBy("bucket").applyInPandas(run, "lead bigint, rid bigint, n bigint").distinct()


def _tiles(groups: DataFrame) -> DataFrame:
    """(tile, side, rid, own): the members of each group in tiles. Side 0 of a tile is compared with side 1, or, in a tile of its own, with itself."""
    hot = kept(groups.groupBy("lead").agg(F.count("*").alias("k")).where(F.col("k") > TILE).select("lead"), "hot")
    whole = groups.join(hot, "lead", "left_anti").select(F.xxhash64("lead").alias("tile"), F.lit(0).alias("side"), "rid", F.lit(True).alias("own"))
    return whole.unionByName(_cut_tiles(groups.join(hot, "lead", "left_semi")))


def _cut_tiles(groups: DataFrame) -> DataFrame:
    """Each member of large groups in the tiles of its band with itself and with the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIMILARITY[1] / SIMILARITY[0])) + 1e-9).cast("int")
    members = groups.withColumn("band", band)
    parts = members.groupBy("lead", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    up, down = parts.select("lead", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")), parts.select("lead", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    members = members.join(parts.join(up, ["lead", "band"], "left").join(down, ["lead", "band"], "left"), ["lead", "band"])
    members = members.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    b, p = F.col("band"), F.col("part")
    until = lambda a, e: F.when(e >= a, F.sequence(a, e)).otherwise(F.array().cast("array<int>"))
    here = lambda side, b1, p1, b2, p2: F.struct(F.lit(side).alias("side"), b1.cast("int").alias("b1"), p1.cast("int").alias("p1"), b2.cast("int").alias("b2"), p2.cast("int").alias("p2"))
    zero = F.lit(0)
    places = F.concat(
        F.transform(until(p, F.col("parts") - 1), lambda q: here(0, b, p, b, q)),
        F.transform(until(zero, p - 1), lambda q: here(1, b, q, b, p)),
        F.transform(until(zero, F.coalesce("above", zero) - 1), lambda q: here(0, b, p, b + 1, q)),
        F.transform(until(zero, F.coalesce("below", zero) - 1), lambda q: here(1, b - 1, q, b, p)),
    )
    spread = members.select("lead", "rid", F.explode(places).alias("x"))
    placed = spread.select(F.xxhash64("lead", "x.b1", "x.p1", "x.b2", "x.p2").alias("tile"), F.col("x.side").alias("side"), "rid", (F.col("x.b1").eqNullSafe(F.col("x.b2")) & F.col("x.p1").eqNullSafe(F.col("x.p2"))).alias("own"))
    # A member alone in a tile, or a tile without its other side, has nobody to meet.
    met = placed.groupBy("tile").agg(F.count("*").alias("k"), F.min("side").alias("x"), F.max("side").alias("y"), F.max("own").alias("o")).where("k > 1 AND (o OR x <> y)").select("tile")
    return placed.join(met, "tile", "left_semi")


def _members(maps: DataFrame, tiles: DataFrame, blocks: DataFrame, parts: DataFrame | None, tag: str) -> DataFrame:
    """The tiles' members with component (their own number where none is given), size and bitmap, each tile's rows one after the other."""
    asked = tiles.join(blocks, "rid")
    if parts is not None:
        asked = asked.join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    else:
        asked = asked.withColumn("component", F.col("rid"))
    columns = ["rid", "tile", "side", "own", "component"]
    address = _asked(asked.select("block", *columns), tag)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, wanted = Replies(address), None, {}
        for block, (rids, sizes), maps in slices(batches):
            if block != current:
                current, wanted = block, _requests(reader(block, columns), columns)
            rows = [(t, s, o, r, c, m, x) for r, m, x in zip(rids.to_pylist(), sizes.to_pylist(), maps, strict=True) for t, s, o, c in wanted.get(r, ())]
            if not rows:
                continue
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["tile", "side", "own", "rid", "component", "n", "bits"])

    members = maps.mapInArrow(tidy(carry), "tile bigint, side int, own boolean, rid bigint, component bigint, n bigint, bits binary")
    return members.repartition(F.col("tile")).sortWithinPartitions("tile", "rid")


def _flags(part: dict) -> np.ndarray | None:
    """The possible pairs of a tile's members: in a tile of its own all, else those of the two sides."""
    n, side = np.array(part["n"], np.int64), np.array(part["side"])
    if part["own"][0]:
        return possible_within(part["bits"], n) if len(n) > 1 else None
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return None
    flags = np.zeros((len(n),) * 2, bool)
    flags[np.ix_(left, right)] = possible([part["bits"][i] for i in left], n[left], [part["bits"][i] for i in right], n[right])
    return flags | flags.T


def _pairs(maps: DataFrame, tiles: DataFrame, blocks: DataFrame, tag: str) -> DataFrame:
    """Possible pairs (a, b, chunk) of the tiles, as stars."""

    def tile_pairs(part: dict) -> Iterator[tuple]:
        flags = _flags(part)
        if flags is None:
            return
        seen: dict[int, int] = {}
        for i, j in _stars(flags):
            a = part["rid"][i]
            k = seen[a] = seen.get(a, -1) + 1
            yield a, part["rid"][j], part["tile"][0], k // CHUNK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for part in runs(batches, ["tile"]) for row in tile_pairs(part))
        yield from gathered(found, ["a", "b", "tile", "chunk"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()])

    found = _members(maps, tiles, blocks, None, tag).mapInArrow(tidy(compare), "a bigint, b bigint, tile bigint, chunk int")
    # A pair that stands in several tiles is compared once; it stays with the tile that comes first, under its hub.
    once = found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("tile", "chunk", "a", "b")).alias("s"))
    return kept(once.select("s.a", "s.b", F.xxhash64("s.tile", "s.chunk").alias("chunk")), f"{tag}-pairs")


def _open(maps: DataFrame, tiles: DataFrame, blocks: DataFrame, parts: DataFrame, tag: str) -> DataFrame:
    """The tiles' members (tile, side, own, rid, component, n) that have a possible partner in another component."""
    names, kinds = ["tile", "side", "own", "rid", "component", "n"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def tile_members(part: dict) -> Iterator[tuple]:
        flags = _flags(part)
        if flags is not None:
            component = np.array(part["component"], np.int64)
            for i in np.flatnonzero((flags & (component[:, None] != component[None, :])).any(1)).tolist():
                yield tuple(part[c][i] for c in names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered((row for part in runs(batches, ["tile"]) for row in tile_members(part)), names, kinds)

    found = _members(maps, tiles, blocks, parts, tag).mapInArrow(tidy(compare), "tile bigint, side int, own boolean, rid bigint, component bigint, n bigint")
    return kept(found, f"{tag}-open")


def cell_links(rid: list[int], component: list[int], sets: list[np.ndarray], flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (a, b) among the flagged pairs of a cell's members that join two components, by exact intersections. A pair that earlier links have put into one component is passed over, so that there are fewer links than members."""
    n = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    numbers = np.split(at, np.cumsum(n)[:-1])
    _, part = np.unique(np.array(component, np.int64), return_inverse=True)
    held = np.zeros(int(at.max()) + 1, bool)
    flags = flags.copy()
    for hub in np.argsort(-flags.sum(1), kind="stable").tolist():
        others = np.flatnonzero(flags[hub] & (part != part[hub]))
        flags[:, hub] = False
        if not len(others):
            continue
        held[numbers[hub]] = True
        for i in range(0, len(others), CHUNK):
            some = others[i : i + CHUNK]
            overlap = np.add.reduceat(held[np.concatenate([numbers[j] for j in some])], np.concatenate(([0], np.cumsum(n[some])[:-1])), dtype=np.int64)
            for j in some[linked(overlap, n[hub], n[some])].tolist():
                if part[j] != part[hub]:
                    part[part == part[j]] = part[hub]
                    yield rid[hub], rid[j]
        held[numbers[hub]] = False


def _joining(rows: DataFrame, members: DataFrame, blocks: DataFrame, n: int, tag: str) -> DataFrame:
    """The links (a, b) that join components, of the open members of tiles. Sets meet by tile, once a member; where a tile's sets have more than SETS hashes they are dealt to parts, and each two parts meet in a cell of their own."""
    sizes = members.groupBy("tile").agg(F.ceil(F.sum("n") / SETS).cast("int").alias("parts"))
    dealt_ = members.join(sizes, "tile").withColumn("p", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("p", q).alias("a"), F.greatest("p", q).alias("b")))
    spread = dealt_.select("tile", "side", "own", "rid", "component", "p", F.explode(cells).alias("x"))
    asked = spread.select("rid", F.xxhash64("tile", "x.a", "x.b").alias("cell"), (F.col("x.a") != F.col("x.b")).alias("cross"), "side", "own", "p", "component").join(blocks, "rid")
    columns = ["rid", "cell", "cross", "side", "own", "p", "component"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
    address = _asked(asked.select("block", *columns), f"{tag}-sets")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, wanted in _wanted(batches, address, columns, n):
            rows = [(r, *x, v.tobytes()) for r, v in sets for x in wanted[r]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=[*columns, "values"])

    def links(part: dict) -> Iterator[tuple]:
        sets = [np.frombuffer(x, np.uint64) for x in part["values"]]
        flags = _flags({"n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets], "side": part["side"], "own": part["own"]})
        if flags is None:
            return
        if part["cross"][0]:
            p = np.array(part["p"])
            flags &= p[:, None] != p[None, :]
        yield from cell_links(part["rid"], part["component"], sets, flags)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered((row for part in runs(batches, ["cell"]) for row in links(part)), ["a", "b"], [pa.int64(), pa.int64()])

    carried = rows.select("rid", "_t", "_block").mapInArrow(tidy(carry), "rid bigint, cell bigint, cross boolean, side int, own boolean, p int, component bigint, values binary")
    return kept(carried.repartition("cell").sortWithinPartitions("cell", "rid").mapInArrow(tidy(meet), "a bigint, b bigint"), f"{tag}-links")


def _requests(table: pa.Table | None, columns: list[str]) -> dict[int, list]:
    """A block's requests by the first column, rid."""
    wanted: dict[int, list] = {}
    if table is not None:
        for r, *rest in zip(*(table[c].to_pylist() for c in columns), strict=True):
            wanted.setdefault(r, []).append(rest)
    return wanted


def _wanted(batches, address: str, columns: list[str], n: int):
    """Sets of the rows that a block's requests name, with the requests by rid. Texts that nobody asks for are passed over."""
    reader, hashes, current, wanted = Replies(address), WordHashes(), None, {}
    for block, (rids,), texts in slices(batches):
        if block != current:
            current, wanted = block, _requests(reader(block, columns), columns)
        if not wanted:
            continue
        chosen = [(r, t) for r, t in zip(rids.to_pylist(), texts, strict=True) if r in wanted]
        for i in range(0, len(chosen), 64):
            some = chosen[i : i + 64]
            yield list(zip([r for r, _ in some], sets_of([t for _, t in some], hashes, n), strict=True)), wanted


def _verified(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, n: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection. A hub's partners come in chunks."""
    hubs = pairs.select(F.col("a").alias("rid"), "a", "chunk", F.lit(0).alias("side")).distinct()
    asked = hubs.unionByName(pairs.select(F.col("b").alias("rid"), "a", "chunk", F.lit(1).alias("side"))).join(blocks, "rid")
    address = _asked(asked.select("block", "rid", "a", "chunk", "side"), f"{tag}-sets")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, wanted in _wanted(batches, address, ["rid", "a", "chunk", "side"], n):
            rows = [(a, c, s, r, v.tobytes()) for r, v in sets for a, c, s in wanted[r]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["a", "chunk", "side", "rid", "values"])

    def links(part: dict) -> Iterator[tuple]:
        if part["side"][0] != 0:
            raise ValueError("a chunk without its hub")
        hub, a = np.frombuffer(part["values"][0], np.uint64), part["a"][0]
        for side, b, values in zip(part["side"], part["rid"], part["values"], strict=True):
            other = np.frombuffer(values, np.uint64)
            if side and linked(len(np.intersect1d(hub, other, assume_unique=True)), len(hub), len(other)):
                yield a, b

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered((row for part in runs(batches, ["a", "chunk"]) for row in links(part)), ["a", "b"], [pa.int64(), pa.int64()])

    carried = rows.select("rid", "_t", "_block").mapInArrow(tidy(carry), "a bigint, chunk bigint, side int, rid bigint, values binary")
    return kept(carried.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(tidy(meet), "a bigint, b bigint"), f"{tag}-links")


def _placed(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """rid, key, n, class and copies of each row; of each class that is not a row by itself, its component's first (key, rid) and least key. Rows never meet by component: what is joined by it has a row for each class, and what is joined by class is a stored table, so that a large one can be split."""
    rows = with_blocks(docs, [F.col(key).alias("key"), F.col(text).alias("_t")], row_id="rid").select("rid", "key", "_t", "_block")
    buckets = bucket_count(docs, BUCKET_BYTES)
    signatures = _signatures(rows, "key", n)
    frequent = _frequent(signatures)
    signed = signatures.where("rid IS NOT NULL").select("rid", "key", "block", "n", "digest")
    maps = signatures.where("n > 0").select("rid", "n", "bits", "block")
    # Stored, so that the join's side of rows with one digest can be split.
    same = kept(signed.where("n > 0").groupBy("digest").agg(F.min("rid").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "same")
    members = signed.join(same, "digest", "left").select("rid", "key", "block", "n", F.coalesce("first", "rid").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = kept(members, "members")
    copies = _asked(members.where("rid <> class").select("block", "rid"), "copies")
    blocks = members.where("rid = class").select("rid", "block")
    groups = kept(_groups(_first_shingles(rows, copies, frequent, n, buckets)), "groups")
    tiles = kept(_tiles(groups), "tiles")
    released(docs.sparkSession)
    links = _verified(rows, _pairs(maps, tiles, blocks, "stars"), blocks, n, "stars")
    released(docs.sparkSession)
    folder = shared_folder(docs.sparkSession, "components")
    parts = kept(components(links, folder=folder), "parts")
    released(docs.sparkSession)
    # Tiles whose members all lie in one component can't change anything.
    open_ = tiles.join(parts.withColumnRenamed("node", "rid"), "rid", "left").groupBy("tile").agg(F.min(F.coalesce("component", "rid")).alias("x"), F.max(F.coalesce("component", "rid")).alias("y")).where("x <> y").select("tile")
    rest = _joining(rows, _open(maps, tiles.join(open_, "tile", "left_semi"), blocks, parts, "rest"), blocks, n, "rest")
    released(docs.sparkSession)
    parts = components(links.unionByName(rest), folder=folder).select(F.col("node").alias("class"), "component")
    released(docs.sparkSession)
    own = members.where("n > 0").groupBy("class").agg(F.min(F.struct("key", "rid")).alias("first"), F.min("key").alias("least"), F.count("*").alias("k"))
    own = kept(own.join(parts, "class", "left").where("component IS NOT NULL OR k > 1"), "classes")
    of = own.where("component IS NOT NULL")
    least = kept(of.groupBy("component").agg(F.min("first").alias("first"), F.min("least").alias("least")), "least")
    linked = of.select("class", "component").join(least, "component").select("class", "first", "least")
    return members, kept(linked.unionByName(own.where("component IS NULL").select("class", "first", "least")), "labels")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """One row per row: key, n_shingles, component_id (the least key of its component, its own for an empty set) and n_copies (rows with an equal set)."""
    members, labels = _placed(docs, key, text, n)
    found = members.join(labels, "class", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"), F.col("copies").alias("n_copies"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """The rows without those that a row of their component with a lesser key (of equal keys, a lesser number) makes needless. Rows with empty sets stay."""
    name = "_rid"
    while name in docs.columns:
        name += "_"
    number = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name)
    try:
        rows = docs.select("*", number)
    except AnalysisException:
        docs = kept(docs, "rows")
        rows = docs.select("*", number)
    members, labels = _placed(docs, key, text, n)
    needless = members.where("n > 0").join(labels, "class").where(F.col("rid") != F.col("first.rid")).select(F.col("rid").alias(name))
    return rows.join(needless, name, "left_anti").select(*docs.columns)
