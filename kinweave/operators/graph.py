"""The graph of references: nodes, similar and neighbour edges, dead-code matchers kept as operators, neighbourhoods."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scores import first_distinct
from kinweave.operators.components import _held, components, stored
from kinweave.operators.pairs import attributes_equal, first_by_key


def references(enriched: DataFrame, attributes: list[str], order: list[str], left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """(id, attributes): every id of a pair once, with the attributes of its first occurrence; in one pair the left comes first."""
    sides = [enriched.select(F.col(i).alias("id"), *[F.col(f"{p}{c}").alias(c) for c in attributes], *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], F.lit(n).alias("_side")) for n, (i, p) in enumerate(((left, "l_"), (right, "r_")))]
    both = sides[0].unionByName(sides[1])
    return first_by_key(both, "id", [*[f"_o{k}" for k in range(len(order))], "_side"]).select("id", *attributes)


def similar_edges(pairs: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """Distinct (a, b) in both directions, no loops."""
    p = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def candidate_edges(pairs: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """Distinct unordered pairs: a < b."""
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()


#: Contexts that an id's rows carry, at most; ids of more are wide, and their pairs are made distinct by a shuffle.
WIDE = 64


def _carried(edges: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after`` to distinct (id, c): the id's contexts on either side of c in their order; null for wide ids."""
    own = Window.partitionBy("id")
    some = lambda first, last: F.when(F.count("*").over(own) <= WIDE, F.collect_list("c").over(own.orderBy("c").rowsBetween(first, last)))
    return edges.select("*", some(-WIDE, -1).alias("before"), some(1, WIDE).alias("after"))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (a, x) and (b, y) that meet, a < b, x and y being contexts before this one: those that share none of them, and those with a wide side."""
    right = right.hint("merge")  # a small table makes very many pairs: sent whole to its tasks, few would make them all
    pairs = left.join(right, on).where("a < b").where("x IS NOT NULL AND y IS NOT NULL").where(~F.arrays_overlap("x", "y"))
    wide = left.where("x IS NULL").join(right, on).unionByName(left.where("x IS NOT NULL").join(right.where("y IS NULL"), on))
    return pairs, wide.where("a < b")


def neighbor_edges(edges: DataFrame, key: str = "id", ctx: str = "ctx") -> DataFrame:
    """Distinct (a, b), a < b, of ids with a common context. The result itself holds every such pair. A pair is told at its least common context, so that pairs needn't move to be made distinct."""
    e = edges.select(F.col(key).alias("id"), F.col(ctx).alias("c")).where("id IS NOT NULL AND c IS NOT NULL").distinct()
    e = _carried(e)
    left, right = e.select(F.col("id").alias("a"), "c", F.col("before").alias("x")), e.select(F.col("id").alias("b"), "c", F.col("before").alias("y"))
    pairs, wide = _met(left, right, ["c"])
    return pairs.select("a", "b").unionByName(wide.select("a", "b").distinct())


#: Classes of one context that meet in a task; more are dealt to cells on both sides.
CELL = 2_000


def context_classes(edges: DataFrame, key: str = "id", ctx: str = "ctx") -> DataFrame:
    """(id, class_id): ids with equal sets of contexts, under the least of them. Sets are compared by their size and two sums of 64-bit hashes, which need no set in one row; halves are summed apart, so that none overflows."""
    e = edges.select(F.col(key).alias("id"), F.col(ctx).alias("c")).where("id IS NOT NULL AND c IS NOT NULL").repartition("id").distinct()  # moved once
    high, low = lambda h: F.sum(F.shiftright(h, 32)), lambda h: F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = [half(h).alias(f"s{k}{half_}") for k, h in enumerate((F.xxhash64("c"), F.xxhash64(F.lit(1), "c"))) for half_, half in enumerate((high, low))]
    signs = e.groupBy("id").agg(F.struct(F.count("*").alias("n"), *sums).alias("sign"))
    return signs.join(signs.groupBy("sign").agg(F.min("id").alias("class_id")), "sign").select("id", "class_id")


#: Pairs of a batch that a task makes.
PAIRS = 100_000


def _runs(first: np.ndarray) -> np.ndarray:
    """How many rows of its run stand behind each row; ``first``: whether a row begins a run."""
    at = np.append(np.flatnonzero(first), len(first))
    return np.repeat(at[1:], np.diff(at)) - np.arange(len(first)) - 1


def _behind(rows: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the rows beside each of the ``many`` rows behind it."""
    left = np.repeat(rows, many)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)


def _changes(t: pa.Table) -> np.ndarray:
    """Whether a row is the first of its context and cell."""
    first = np.ones(len(t), bool)
    first[1:] = False
    for name in ("c", "i", "j"):
        x = t[name].combine_chunks()
        first[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return first


def _tell(t: pa.Table, wide: bool) -> Iterator[pa.RecordBatch]:
    """Links of whole contexts and cells: what two classes share besides is found by sorting their other contexts, not pair by pair."""
    column = lambda name: t[name].combine_chunks()
    first, ids = _changes(t), column("class_id")
    many, group = _runs(first), np.cumsum(first)
    apart, at = column("i").to_numpy() != column("j").to_numpy(), column("at").to_numpy()
    lists = [column(name) for name in ("before", "after")]
    is_wide = lists[0].is_null().to_numpy(zero_copy_only=False)
    rows = [np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in lists]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    code, before, row = codes.indices.to_numpy().astype(np.int64), np.arange(len(codes)) < len(rows[0]), np.concatenate(rows)
    place = group[row] * (len(codes.dictionary) + 1) + code
    order = np.argsort(place, kind="stable")  # rows of a run stay in their order
    place, row, before = place[order], row[order], before[order]
    shared = _runs(np.append(True, place[1:] != place[:-1])[: len(place)])
    total = np.append(0, np.cumsum(many))
    lo = 0
    while lo < len(t):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        left, right = _behind(np.arange(lo, hi), many[lo:hi])
        own = np.flatnonzero((row >= lo) & (row < hi) & (shared > 0))
        x, y = _behind(own, shared[own])
        index = total[row[x]] - total[lo] + row[y] - row[x] - 1
        keep = (~apart[left] | (at[left] != at[right])) & ((is_wide[left] | is_wide[right]) == wide)
        keep[index[before[x]]] = False  # told at a lesser context
        n = 1 + np.bincount(index[~before[x]], minlength=len(left))
        if keep.any():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[keep])), ids.take(pa.array(right[keep])), pa.array(n[keep], pa.int64())], names=["a", "b", "n"])
        lo = hi


def _links(wide: bool) -> Callable:
    """Makes pairs of the classes that stand one after the other under a context and cell, ordered. ``wide``: those with a wide side, each at each context; else the others, at their least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(np.flatnonzero(_changes(t))[-1])  # it may go on in the next batch
            if last:
                yield from _tell(t.slice(0, last), wide)
            held = t.slice(last)
        if held is not None:
            yield from _tell(held, wide)

    return run


def _linked(reps: DataFrame, sizes: DataFrame, wide: bool) -> DataFrame:
    """(a, b, n) of ``_links``; each row of a context moves once, of a hub once for each cell of its own part."""
    met = reps.join(sizes, "c", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("class_id"), F.col("g")).cast("int"))
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("i", F.least("at", "t")).withColumn("j", F.greatest("at", "t"))
    rows = met.select("c", "i", "j", "class_id", "at", "before", "after").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "class_id")
    kind = reps.schema["class_id"].dataType.simpleString()
    return rows.mapInArrow(_links(wide), f"a {kind}, b {kind}, n long")


def neighbor_classes(edges: DataFrame, classes: DataFrame, key: str = "id", ctx: str = "ctx", cell: int = CELL) -> DataFrame:
    """(a, b, n), a <= b: classes with n common contexts; a class of several ids stands with itself. Together with ``context_classes`` it says what ``neighbor_edges`` does, without a pair for each two ids of large classes."""
    own = classes.groupBy("class_id").agg(F.count("*").alias("m"))
    e = edges.select(F.col(key).alias("id"), F.col(ctx).alias("c")).where("id IS NOT NULL AND c IS NOT NULL").repartition("id").distinct()
    e = e.join(own.withColumnRenamed("class_id", "id").hint("shuffle_hash"), "id")
    reps = stored(_carried(e).withColumnRenamed("id", "class_id"), "classes")
    sizes = stored(reps.groupBy("c").agg(F.count("*").alias("_n")).where(F.col("_n") > cell).select("c", F.ceil(F.col("_n") / cell).cast("int").alias("g")), "hubs")
    linked = _linked(reps, sizes, False)
    wide = reps.where("before IS NULL").select("c")
    if not wide.isEmpty():
        linked = linked.unionByName(_linked(reps.join(wide, "c", "left_semi"), sizes, True).groupBy("a", "b").agg(F.sum("n").alias("n")))
    return linked.unionByName(reps.where("m > 1").groupBy(F.col("class_id").alias("a"), F.col("class_id").alias("b")).agg(F.count("*").alias("n")))


def contexts_of(edges: DataFrame, key: str = "id", ctx: str = "ctx") -> DataFrame:
    """(id, ctxs): ordered distinct contexts of each id."""
    return edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(ctx)).alias("ctxs"))


#: Groups that an aggregate over objects holds before it sorts them: ids of one task whose contexts are gathered.
_GROUPS = ("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(1 << 18))


def stored_contexts(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``contexts_of``, stored."""
    conf = edges.sparkSession.conf
    before = conf.get(_GROUPS[0], None)
    conf.set(*_GROUPS)
    try:
        return _held(contexts_of(edges), folder, "contexts")
    finally:
        conf.unset(_GROUPS[0]) if before is None else conf.set(_GROUPS[0], before)


def with_contexts(pairs: DataFrame, contexts: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """Pairs with l_ctxs and r_ctxs; ids without contexts have empty ones."""
    none = F.array().cast("array<string>")
    a = contexts.select(F.col("id").alias(left), F.col("ctxs").alias("l_ctxs"))
    b = contexts.select(F.col("id").alias(right), F.col("ctxs").alias("r_ctxs"))
    return pairs.join(a, left, "left").join(b, right, "left").withColumn("l_ctxs", F.coalesce("l_ctxs", none)).withColumn("r_ctxs", F.coalesce("r_ctxs", none))


def exact_match(enriched: DataFrame, attributes: list[str], left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """(r1_id, r2_id) of pairs equal on all attributes, ids apart."""
    return enriched.where(attributes_equal(attributes) & (F.col(left) != F.col(right))).select(F.col(left).alias("r1_id"), F.col(right).alias("r2_id")).distinct()


def hyperedge_k_match(pairs: DataFrame, records: DataFrame, edges: DataFrame, k: int = 2, left: str = "ltable_id", right: str = "rtable_id", same: list[str] | None = None, repeats: bool = False) -> DataFrame:
    """Distinct pairs of which some hyperedge of the left and some of the right hold k or more pairs of members with equal attributes and different ids. ``records``: (id, attr), attr standing for all attributes (null equals nothing); ``edges``: (id, edge). ``same``: columns of ``records``; pairs equal on them (as of ``exact_match``) are told too, so that they aren't tried by edges. ``repeats``: a pair may be told more than once, which spares a shuffle.

    Each edge has a mask of its most frequent attributes. A pair is tried by two edges of each side, then by all of them; for what
    is open still, equal members are counted per pair of edges."""
    p = pairs.select(F.col(left).alias("l"), F.col(right).alias("r"))
    members = stored(_coded(records, edges), "k-match-members")
    masks = stored(_masks(members), "k-match-masks")
    e = members.select("id", "edge")
    none = F.struct(*[F.lit(0).cast("long").alias(w) for w in WORDS])
    masked = lambda df, at, name: df.join(masks.select(F.col("edge").alias(at), F.col("mask").alias(name)), at, "left").withColumn(name, F.coalesce(name, none))
    two = masked(masked(e.groupBy("id").agg(F.min("edge").alias("a"), F.max("edge").alias("b")), "a", "m"), "b", "n").select("id", "m", "n")
    side = lambda i, m, prefix: two.select(F.col("id").alias(i), F.col("m").alias(f"{m}1"), F.col("n").alias(f"{m}2"), *[F.col(c).alias(f"{prefix}{c}") for c in same or ()])
    likely = reduce(Column.__or__, [_apart(F.col(u), F.col(v)) >= k for u in ("x1", "x2") for v in ("y1", "y2")])
    if same:
        two = records.select("id", *same).join(two.hint("shuffle_hash"), "id", "left").withColumns({m: F.coalesce(m, none) for m in "mn"})
        likely = likely | (attributes_equal(same) & (F.col("l") != F.col("r")))
    # An id stands once on these sides, which are the ones to hold. An id without edges has no match by them.
    tried = p.join(side("l", "x", "l_").hint("shuffle_hash"), "l").join(side("r", "y", "r_").hint("shuffle_hash"), "r")
    tried = stored(tried.select("l", "r", likely.alias("proved")), "k-match", "proved")
    rest = tried.where("NOT proved").select("l", "r").distinct()
    near = e.join(rest.select(F.col("l").alias("id")).unionByName(rest.select(F.col("r").alias("id"))), "id", "left_semi").distinct()
    met = rest.join(near.select(F.col("id").alias("l"), F.col("edge").alias("e1")), "l").join(near.select(F.col("id").alias("r"), F.col("edge").alias("e2")), "r")
    proved = (_apart(F.col("x"), F.col("y")) >= k).alias("proved")
    met = stored(masked(masked(met, "e1", "x"), "e2", "y").select("l", "r", "e1", "e2", proved), "k-match-edges", "proved")
    sure = met.where("proved").select("l", "r")
    open_ = met.where("NOT proved").select("l", "r", "e1", "e2").join(sure, ["l", "r"], "left_anti")
    counted = _k_common(stored(open_.select("e1", "e2").distinct(), "k-match-open"), records, e, k)
    found = open_.join(counted, ["e1", "e2"], "left_semi").select("l", "r")
    told = tried.where("proved").select("l", "r").unionByName(sure).unionByName(found)
    return (told if repeats else told.distinct()).select(F.col("l").alias("r1_id"), F.col("r").alias("r2_id"))


#: Attributes that have a bit. It bounds what is proved at once, not what is found.
BITS = 128
#: Words of a mask: parts of 64 attributes for each of four hashes; a member's bit stands in the word of its attribute's part and its own hash.
HASHES = 4
WORDS = [f"w{i}{j}" for i in range(HASHES) for j in range(2)]


def _apart(u: Column, v: Column) -> Column:
    """Bits that two masks have in words of different hashes, each with each: so many pairs of members at least have equal attributes and different ids."""
    return reduce(Column.__add__, [F.bit_count(u[a].bitwiseAND(v[b])) for a in WORDS for b in WORDS if a[1] != b[1] and a[2] == b[2]])


def _coded(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, edge, bit, word) of each row of the edges: the bit of the id's attribute and its word, null where the attribute isn't frequent. Members move as a number each, not with their attributes, and once: what is dealt by ids is dealt for all that follows."""
    often = records.where("attr IS NOT NULL").groupBy("attr").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attr").limit(BITS).collect()
    place = F.from_json(F.lit(json.dumps({r.attr: i for i, r in enumerate(often)})), "map<string,int>")[F.col("attr")]
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(HASHES)).cast("string"), F.floor(F.col("place") / 64).cast("string"))
    coded = records.select("id", place.alias("place")).where("place IS NOT NULL").select("id", F.expr("shiftleft(1L, place % 64)").alias("bit"), word.alias("word"))
    return edges.select("id", "edge").where("edge IS NOT NULL").join(coded.hint("shuffle_hash"), "id", "left").select("id", "edge", "bit", "word")


def _masks(members: DataFrame) -> DataFrame:
    """(edge, mask) of edges with a member of a frequent attribute. The most frequent attributes have a bit each, set in one of the mask's words by the hash of a member with it: members whose bits are in words of different hashes have different ids."""
    seen = members.where("bit IS NOT NULL").select("edge", *[F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long")).alias(w) for w in WORDS])
    return seen.groupBy("edge").agg(*[F.bit_or(w).alias(w) for w in WORDS]).select("edge", F.struct(*WORDS).alias("mask"))


def _k_common(asked: DataFrame, records: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The (e1, e2) asked for with k or more pairs of members with equal attributes and different ids. Equal members are counted per pair of edges once."""
    edges = edges.join(asked.select(F.col("e1").alias("edge")).unionByName(asked.select(F.col("e2").alias("edge"))), "edge", "left_semi")
    m = edges.join(records.where("attr IS NOT NULL").select("id", "attr"), "id").select("edge", F.col("id").alias("member"), "attr").distinct()
    by = m.groupBy("edge", "attr").agg(F.count("*").alias("n"))
    a, b = by.select(F.col("edge").alias("e1"), "attr", F.col("n").alias("n1")), by.select(F.col("edge").alias("e2"), "attr", F.col("n").alias("n2"))
    common = asked.join(a, "e1").join(b, ["e2", "attr"]).groupBy("e1", "e2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))
    one, two = m.select(F.col("edge").alias("e1"), "member", "attr"), m.select(F.col("edge").alias("e2"), "member", "attr")
    same = asked.join(one, "e1").join(two, ["e2", "member", "attr"]).groupBy("e1", "e2").agg(F.count("*").alias("s"))
    return common.join(same, ["e1", "e2"], "left").where(F.col("n") - F.coalesce("s", F.lit(0)) >= k).select("e1", "e2")


def gold_similarity(pairs: DataFrame, positives: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """a, b, sim of each unordered pair: 1 where it (or its reverse) is positive, else 0."""
    gold = candidate_edges(positives, left, right).withColumn("_g", F.lit(1.0))
    return candidate_edges(pairs, left, right).join(gold, ["a", "b"], "left").select("a", "b", F.coalesce("_g", F.lit(0.0)).alias("sim"))


def gold_cluster_similarity(pairs: DataFrame, members: DataFrame, positives: DataFrame, left: str = "ltable_id", right: str = "rtable_id") -> DataFrame:
    """a, b, sim of each unordered pair of clusters: 1 where a positive pair has a member in each, else 0. ``members``: (id, cluster_id). Positive pairs move, never pairs of members."""
    place = lambda c: members.select(F.col("id").alias(c), F.col("cluster_id").alias(f"{c}_cluster"))
    met = candidate_edges(positives, left, right).join(place("a"), "a").join(place("b"), "b")
    return gold_similarity(pairs, met.select(F.col("a_cluster").alias(left), F.col("b_cluster").alias(right)), left, right)


def gold_components(pairs: DataFrame, left: str = "ltable_id", right: str = "rtable_id", label: str = "label", folder: str | None = None) -> DataFrame:
    """(id, component): every id of a pair, joined by positive pairs; the component is its least id."""
    ids = pairs.select(F.col(left).alias("id")).unionByName(pairs.select(F.col(right).alias("id"))).distinct()
    found = components(pairs.where(F.col(label) == 1), left, right, folder)
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_neighborhood(parts: DataFrame, edges: DataFrame, k: int = 5, key: str = "id", ctx: str = "ctx") -> DataFrame:
    """(component, ctxs, top): all contexts of a component's members, and the first k distinct in the order of (member, context)."""
    rows = parts.join(edges.select(F.col(key).alias("id"), F.col(ctx).alias("ctx")).distinct(), "id").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("id", "ctx"))).alias("_m"))
    every = F.transform("_m", lambda x: x["ctx"])
    return rows.select("component", F.sort_array(F.array_distinct(every)).alias("ctxs"), first_distinct(every, k).alias("top"))
