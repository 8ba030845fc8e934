"""Clustering, filter audit and license scans against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import dual_tree, filter_audit, license_rules
from kinweave.llm.license_table import RULES, Rule

# --- 11 --------------------------------------------------------------------------------------------------------


def _nearest(points, centroids):
    return ((points[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(2).argmin(1)


def _points(rng, n, dim):
    kind = rng.integers(4)
    if kind == 0:
        return rng.integers(-5, 6, (n, dim))
    if kind == 1:
        return (rng.normal(size=(n, dim)) * 100).astype(np.int64)
    if kind == 2:
        return np.zeros((n, dim), np.int64) + rng.integers(0, 2)
    return rng.integers(0, 4, (n, 1)) * 1000 + rng.integers(-20, 20, (n, dim))


@pytest.mark.parametrize("seed", range(80))
def test_walk_of_two_trees_against_all_distances(seed):
    rng = np.random.default_rng(seed)
    points = _points(rng, int(rng.integers(1, 300)), int(rng.integers(1, 8)))
    centroids = points[rng.integers(0, len(points), rng.integers(1, 17))] + (rng.integers(0, 2, points.shape[1]) if seed % 2 else 0)
    tree, over = dual_tree.cover_tree(points, int(rng.integers(1, 20))), dual_tree.cover_tree(centroids, 1)
    told = _nearest(tree.points, centroids)
    assert (dual_tree.labels(tree, centroids, over) == told).all()
    count, total = dual_tree.sums(tree, centroids, over)
    for c in range(len(centroids)):
        assert count[c] == (told == c).sum() and (total[c] == tree.points[told == c].sum(0)).all()


@pytest.mark.parametrize("seed", range(20))
def test_a_cover_tree_covers_and_separates(seed):
    rng = np.random.default_rng(seed)
    points = _points(rng, int(rng.integers(2, 300)), 3)
    tree = dual_tree.cover_tree(points, 2)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (points[tree.order] == tree.points).all()
    centres = tree.points[tree.begin].astype(float)
    for i in range(len(centres)):
        children = tree.child[tree.first[i] : tree.first[i + 1]]
        ranges = sorted([(tree.begin[i], tree.own[i]), *((tree.begin[c], tree.end[c]) for c in children)])
        assert ranges[0][0] == tree.begin[i] and ranges[-1][1] == tree.end[i] and all(a[1] == b[0] for a, b in itertools.pairwise(ranges))
        away = np.sqrt(((tree.points[tree.begin[i] : tree.end[i]] - tree.points[tree.begin[i]]).astype(float) ** 2).sum(1))
        assert away.max() == tree.radius[i]
        if i:  # farther from all centres before it than its level's scale; its parent is within twice of it
            s = np.sqrt(((centres[:i] - centres[i]) ** 2).sum(1)).min()
            (parent,) = [p for p in range(len(centres)) if i in tree.child[tree.first[p] : tree.first[p + 1]]]
            assert parent < i and np.sqrt(((centres[parent] - centres[i]) ** 2).sum()) <= 2 * 2 ** np.floor(np.log2(s)) + 1e-9


def test_nodes_far_from_other_centroids_are_not_compared():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 8, (2000, 1)) * 10_000 + rng.integers(-30, 30, (2000, 6))
    centroids = np.repeat(np.arange(8)[:, None] * 10_000, 6, axis=1)
    found, whole = dual_tree.nearest(dual_tree.cover_tree(points), centroids, dual_tree.cover_tree(centroids, 1))
    assert sum(b - a for a, b, _ in whole) == 2000 and (found == -1).all()


def _lloyd(vectors, k, rounds, seed, dim, scale):
    taken = [(key, [int(np.floor(scale * float(x))) for x in v]) for key, v in vectors if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in taken if key is not None)[:k]
    centroids = [v for _, v in start]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in taken:
            groups.setdefault(of(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    rows = [(key, of(v)) for key, v in taken]
    inertia = {c: sum(d for _, (d, e) in rows if e == c) for c in range(k)}
    return sorted((str(key), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for key, (d, c) in rows)


@pytest.mark.parametrize("block", [3, 4_096])
def test_clusters_of_awkward_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(dual_tree.forest, "__defaults__", (block, 2))
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice((-1.5, 0.0, 2.0)) + rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, [9.0] * 4), (None, [0.5] * 4), (60, None), (61, []), (62, [1.0] * 3), (63, [1.0] * 5), (64, [1.0, None, 1.0, 1.0]), (65, [nan] * 4), (66, [1.0, inf, 0.0, 0.0]), (67, [-0.001, 0.001, 1e-9, -1e-9])]
    rows += [(70 + i, [3.0] * 4) for i in range(30)]  # a third of all are equal
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("k", "v", "cluster", "keys", "points")})
    for k in (1, 5, 200):
        found = sorted((str(r[0]), *r[1:]) for r in dual_tree.cluster(df, k, 3, 1, 4, 64).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
        assert found == _lloyd(rows, k, 3, 1, 4, 64)


def test_clusters_of_no_vectors_and_of_too_large_ones(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        dual_tree.cluster(df, 2, dim=2).count()
    assert dual_tree.cluster(df.where("false"), 2, dim=2).collect() == [] and dual_tree.cluster(df).columns[0] == "vec_id"
    huge = spark.createDataFrame([(1, [2.0e6, 0.0]), (2, [-2.0e6, 0.0])], "vec_id long, embedding array<double>")
    assert {r.distance for r in dual_tree.cluster(huge, 1, 1, dim=2).collect()} == {(2_000_000 * 64) ** 2}


# --- 12 --------------------------------------------------------------------------------------------------------

_BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def _fails(rows):
    first = {}
    for key, _, t in rows:
        if key is not None:
            first[t or ""] = min(key, first.get(t or "", key))
    for key, part, t in rows:
        t = t or ""
        w = _BLANK.findall(t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        yield key, part or "", out + "E" * (key is not None and key > first[t])


def _audited(rows, labels):
    good, toxic = ({k for k, q, x in labels if (q, x)[i] == 1 and k is not None} for i in (0, 1))
    docs, out = list(_fails(rows)), {}
    for part in {p for _, p, _ in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, name in enumerate(order, 1):
                cut = [d for d in left if name in d[2]]
                redundant = sum(name in d[2] for d in gone)
                left, gone = [d for d in left if name not in d[2]], gone + cut
                shapley[name] += len(cut)
                out[part, order, step] = [len(left), len(cut), redundant, sum(d[2] == name for d in docs if d[1] == part), sum(d[0] in good for d in cut), sum(d[0] in toxic for d in cut), name]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return out


def test_filter_audit(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    rows = []
    for i in range(90):
        t = " ".join([word() for _ in range(rng.choice((150, 199, 200, 260)))])
        if rng.random() < 0.3:
            t = " ".join(["a b"] * 101 + [word()])
        if rng.random() < 0.3:
            t = t.replace("a", "A") + " größe 漢字"
        if rng.random() < 0.3:
            t += "\n" + rng.choice("#$%&*|")
        rows.append((i, rng.choice(("s", None, "", "t")), t))
    rows += [(100 + i, "s", rows[0][2]) for i in range(40)] + [(3, "t", rows[3][2]), (None, "s", rows[0][2]), (None, None, None), (201, "s", None), (202, "s", ""), (203, "t", "x" * 50_000), (204, "t", "wort " * 5_000), (205, "t", "Aa" + "a" * 97 + "\x00"), (206, "t", "AA" + "a" * 98), (207, "t", "AAA" + "a" * 97)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 150, 2)] + [(0, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("key", "part", "mask", "digest", "n", "first")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("key", "good", "part")})
    found = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(df, known).collect()}
    assert found == _audited(rows, labels) and len(found) == 3 * 600
    assert filter_audit.audit(df.where("false"), known).count() == 0
    none = filter_audit.audit(df, known.where("false"))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_matrices_are_of_integers_and_share_out_every_removal():
    by = filter_audit.matrices()
    assert {m.shape for m in by.values()} == {(32, 600)} and all(m.dtype == np.int64 for m in by.values())
    assert (by["removed"].reshape(32, 120, 5).sum(2) + by["kept"].reshape(32, 120, 5)[:, :, 4] == 1).all()


# --- 13 --------------------------------------------------------------------------------------------------------

_LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _scanned(text, rules=RULES):
    w = _LICENSE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    norm = " " + " ".join(w) + " "
    claims = []
    for r in rules:
        if set(r.keywords) & set(w):
            for m in re.finditer(r.regex, norm):
                a = norm[: m.start()].count(" ")
                claims.append((a, a + m.group().count(" "), r))
    before = lambda e, d: (-e[2].priority, e[0] - e[1], e[2].number) < (-d[2].priority, d[0] - d[1], d[2].number)
    stay = [d for d in claims if not any(e is not d and e[0] <= d[0] and d[1] <= e[1] and before(e, d) for e in claims)]
    base = [(i, label) for phrase, label in license_rules.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return {
        "n_words": len(w),
        "n_base": len(base),
        "first_word": min((i for i, _ in base), default=None),
        "last_word": max((i for i, _ in base), default=None),
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted({label for _, label in base} | {r.label for _, _, r in stay})),
        "score": max([r.weight for _, _, r in stay] + [license_rules.BASE_WEIGHT] * bool(base), default=0.0),
        "n_claims": len(claims),
        "n_stay": len(stay),
    }


TEXTS = [
    None,
    "",
    " .,;\n",
    "The MIT License",
    "!Released under the MIT License.",
    "the-mit license, the mit license; the MIT licensee the mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache license version 2 apache license version 20 apache license version 2",
    "CC BY-NC 4.0 and CC-BY-NC-SA 4.0 and cc by, CC BY NC",
    "GNU General Public License v3.0 or later; GPLv2, gpl-2.0-or-later. LGPL 2.1",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT",
    "Creative Commons Attribution-ShareAlike 4.0 International; creative commons",
    "Copyright 2020 Jemand und Söhne. All rights reserved. Alle Rechte vorbehalten. droits réservés tous droits réservés",
    "mit freundlichen grüßen mit lizenz mit der mit-lizenz unter der MIT Lizenz",
    "redistribution and use in source and binary forms, with or without modification, are permitted. neither the name of the university nor the names of its contributors may be used to endorse",
    "bsd license bsd license bsd license bsd license",
    "the mit license " * 300,
    "word " * 20_000 + "the MIT license" + " x" * 20_000,
    "Größe İ the MİT license",
]


def test_license_scan_against_a_plain_one(spark):
    rng = random.Random(2)
    vocabulary = sorted({k for r in RULES for k in r.keywords} | set("the mit cc by nc nd sa 1 2 3 4 0 v2 v3 version public general under or later clause free software only".split()))
    texts = TEXTS + [rng.choice((" ", ", ")).join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(None, "cc by nc"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "base", "claims", "stay", "_w", "labels", "rule")})
    found = [r.asDict() for r in license_rules.scan(df).collect()]
    told = [{"doc_id": k, **_scanned(t)} for k, t in rows]
    order = lambda x: sorted(x, key=repr)
    assert order(found) == order(told)
    assert license_rules.scan(df.where("false")).count() == 0
    spans = {(r.start, r.stop, r.label): r.carried.key for r in license_rules.detections(df.where("doc_id = 10"), carry=("key",)).collect()}
    assert spans == {(3, 10, "gpl"): 1, (6, 12, "gpl-3.0"): 1}


def test_a_text_of_very_many_claims_takes_no_square_of_them(spark):
    df = spark.createDataFrame([(1, "the mit license " * 60_000)], "doc_id long, text string")
    license_rules.scan(df.where("false")).count()  # the session is up before the clock starts
    begun = time.monotonic()
    (r,) = license_rules.scan(df).collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.n_stay) == (180_000, 60_000, 0, 179_997, "mit", 60_000)
    assert time.monotonic() - begun < 30


def test_priority_and_held_intervals(spark):
    table = [("long", 2, "a b c d"), ("high", 3, "b c"), ("low", 1, "b"), ("tie", 2, "a b c d"), ("over", 2, "d e"), ("held", 2, "a b")]
    rules = [Rule(i, ("a",), label, p, 0.1 * (i + 1), f" (?:{x})(?= )") for i, (label, p, x) in enumerate(table)]
    df = spark.createDataFrame([(1, "A b c d e"), (2, "b c d e")], "doc_id long, text string")
    found = {r.doc_id: r for r in license_rules.scan(df, rules=rules).collect()}
    assert found[1].labels == "high,long,over" and (found[1].n_claims, found[1].n_stay) == (6, 3) and found[1].score == pytest.approx(0.5)
    assert found[2].labels == "" and found[2].n_claims == 0  # no keyword, no rule


def test_every_rule_needs_a_keyword_and_the_table_is_whole():
    assert len(RULES) > 300 and [r.number for r in RULES] == list(range(len(RULES)))
    for r in RULES:
        assert r.keywords and 1 <= r.priority <= 5 and 0 < r.weight <= 1
        assert re.compile(r.regex).search(" ") is None
