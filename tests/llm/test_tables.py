"""The operators on small tables with awkward rows, against plain versions; and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import decontam, jaccard_tiles, labelled, level_dedup, mil_quality, repair_codec, shard_tree, sp_lattice, toxic_kernel, warc_zst, weak_rules
from kinweave.llm import queries
from kinweave.llm.queries import tokenizer_file

#: Columns whose names the operators use themselves.
CLASHES = {c: i for i, c in enumerate(("score", "shard", "n_words", "key", "rid", "bucket", "clean_text", "component", "ids", "size", "kept", "block"))}


def _sentence(rng, n):
    return " ".join(rng.choice(("ba", "do", "ki", "lu", "me", "so", "ta", "vi")) + rng.choice(("r", "n", "st", "m")) + rng.choice(("a", "e", "i", "o")) for _ in range(n))


def _rows():
    rng = random.Random(11)
    base, passage = _sentence(rng, 120), _sentence(rng, 50)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (5, base), (6, near), (7, "Kurz, nur vier Wörter"), (8, "KURZ, nur vier Wörter"), (9, f"{_sentence(rng, 60)}\n{passage} {_sentence(rng, 30)}"), (10, f"{passage} {_sentence(rng, 70)} größe ﬁ 漢字 ▁x"), (11, "x" * 3000 + " " + _sentence(rng, 4000)), (12, "a a a a " * 30), (None, "text without a number, twelve words long as it happens to be so"), (13, "!!! ### $$$ %%%\n" * 5), (14, "ends with blank  "), (15, "Line one\n\nLine one\n two  blanks")]
    return rows + [(20 + i, _sentence(rng, 8 + 3 * i)) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame(_rows(), "doc_id long, text string").select("*", F.lit(None).cast("string").alias("lang"), *[F.lit(v).alias(k) for k, v in CLASHES.items()])
    df.coalesce(2).write.parquet(path + "/full")
    df.where("false").write.parquet(path + "/none")
    return spark.read.parquet(path + "/full"), spark.read.parquet(path + "/none")


def _plain(rows):
    return [(k, t or "") for k, t in rows]


def test_token_files(spark, docs):
    path = tokenizer_file("byte_bpe_50k.json")
    full = docs[0].where("doc_id IS NOT NULL")
    shards = repair_codec.write(full, path, shard_ids=500)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in repair_codec.read(spark, shards).collect())
    library, at = repair_codec.Encoder(path).led.library, 0
    told = sorted((k, zlib.crc32(t.encode()), t) for k, t in _plain(_rows()) if k is not None)
    assert len(found) == len(told) and shards.count() > 1
    for (start, key, n, crc, ids), (k, _, t) in zip(found, told, strict=True):
        want = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (start, key, n, crc, ids) == (at, k, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        at += n
    assert repair_codec.read(spark, repair_codec.write(docs[1], path)).count() == 0


def test_token_files_of_rows_without_a_key(spark, docs):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = [(None, "b"), (0, "a"), (None, None), (-5, "c"), (None, "b")]
    shards = repair_codec.write(spark.createDataFrame(rows, "doc_id long, text string"), path)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in repair_codec.read(spark, shards).collect())
    assert [(k, n) for _, k, n in found] == [(None, 1), (None, 2), (None, 2), (-5, 2), (0, 2)]
    every = repair_codec.read(spark, repair_codec.write(docs[0], path, shard_ids=500)).collect()
    assert sorted(map(str, (r.doc_id for r in every))) == sorted(str(k) for k, _ in _rows())


def test_archives(spark):
    big = "<html>" + "grüße " * 300
    rows = [(1, "u", big), (2, None, big), (3, "v\r\nX: 1", big), (4, "w", "small"), (5, "w", "small"), (6, "w", None), (7, "w", ""), (8, "w", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    archives = warc_zst.write(pages, archive_bytes=200)
    found = {int(r.page): r for r in warc_zst.read(spark, archives).collect()}
    assert len(found) == 8 and archives.agg(F.sum("n_records")).first()[0] == 8
    for page, _, html in rows:
        body, r = (html or "").encode(), found[page]
        revisit = html == big and page != 3
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", "3" if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else body)
    assert warc_zst.read(spark, warc_zst.write(pages.where("false"))).count() == 0


def test_archives_of_rows_without_a_key(spark):
    big = "<p>" * 500
    pages = spark.createDataFrame([(None, "u", big), (None, "u", big), (4, "u", big), (4, "v", big), (2, "w", big), (None, "x", "a" * 1200)], "page_id long, url string, html string")
    found = Counter((r.page, r.record_type, r.refers_to) for r in warc_zst.read(spark, warc_zst.write(pages)).collect())
    assert found == {(None, "revisit", "4"): 2, ("4", "response", None): 2, ("2", "revisit", "4"): 1, (None, "response", None): 1}


def test_decontamination(spark, docs):
    text = dict(_plain(_rows()))
    item = " ".join(text[9].split()[5:25]).upper()
    bench = spark.createDataFrame([(1, item), (2, None), (3, "..."), (4, "nur vier"), (4, "nur vier")], "item_id long, text string")
    found = defaultdict(list)
    for r in decontam.scan(docs[0], bench, carry=("n_words", "lang")).collect():
        found[r.doc_id].append(r)
    assert len(found[5]) == 2 and found[5][0] == found[5][1]
    assert (found[9][0].n_hit, found[9][0].items, found[9][0].dropped) == (20, "1", False)
    assert item.lower() not in found[9][0].clean_text and found[9][0].carried.n_words == CLASHES["n_words"]
    assert (found[7][0].n_hit, found[7][0].clean_text, found[8][0].items) == (2, "Kurz,  Wörter", "4")
    assert found[1][0].n_words == 0 and found[1][0].clean_text == "" and not found[4][0].contaminated
    assert decontam.scan(docs[1], bench).count() == 0
    assert decontam.scan(docs[0], bench.where("false")).where("contaminated").count() == 0
    assert [len(b) for b in decontam.read_items(bench, block_words=1)] == [1, 1, 1]


def test_a_benchmark_of_many_blocks_is_taken_block_by_block(spark, docs, monkeypatch):
    """As one block gives, with items that are longer than a block, items without an id and items of one name in several blocks."""
    words = [w for _, t in _plain(_rows()) for w in decontam.words(t.encode())]
    texts = [b" ".join(words[a : a + n]).decode() for a, n in ((0, 70), (10, 12), (30, 3), (90, 25), (200, 10), (260, 45), (30, 3))]
    bench = spark.createDataFrame([*zip([1, 2, None, 4, None, 2, 7], texts, strict=True), (8, None), (9, "?")], "item_id long, text string")
    sizes = [[sum(len(w) for _, w in b) for b in decontam.read_items(bench, block_words=n)] for n in (25, 10**6)]
    assert len(sizes[0]) > 5 and max(sizes[0]) <= 25 and len(sizes[1]) == 1
    told = Counter(map(str, decontam.scan(docs[0], bench, carry=("n_words", "lang")).collect()))
    passes, kept = [], decontam._hits
    monkeypatch.setattr(decontam, "_hits", lambda rows, items, window: passes.append(sum(len(w) for _, w in items)) or kept(rows, items, window))
    assert Counter(map(str, decontam.scan(docs[0], bench, carry=("n_words", "lang"), block_words=25).collect())) == told
    assert passes == sizes[0]
    few = spark.createDataFrame([(1, "only three words, and four")], "doc_id long, text string")
    nameless = spark.createDataFrame([(None, "three words"), (None, "and four"), (5, "words and")], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.items) for n in (1, 10**6) for r in decontam.scan(few, nameless, block_words=n).collect()] == [(4, 2, "5")] * 2
    assert decontam.scan(docs[1], bench, block_words=25).count() == 0


def test_lattice_against_the_library(spark, docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sp_lattice.encode(docs[0], path)
    text = dict(_plain(_rows()))
    for r in rows.collect():
        assert r.ids == model.encode(text[r.doc_id]), text[r.doc_id]
        assert r.decoded_equal and r.n_pieces == len(r.ids)
    assert {r.doc_id: r.back for r in sp_lattice.decode(rows.where("doc_id IN (9, 15)"), path, into="back").collect()} == {9: text[9], 15: text[15]}
    assert sp_lattice.encode(docs[1], path).count() == 0


def test_texts_put_together_wrongly_are_told(spark, monkeypatch):
    """Each text's own ids are decoded: with ids of one unit for another, the texts that hold it aren't equal."""
    table = spark.createDataFrame([(1, "two words"), (2, "two others"), (3, "none of them"), (4, "words" + sp_lattice.BLANK), (5, None), (6, "many words " * 30_000)], "doc_id long, text string")
    path = tokenizer_file("piece_bpe_32k.model")
    assert all(r.decoded_equal for r in sp_lattice.encode(table, path).collect())
    made = sp_lattice.Vocabulary.__init__

    def wrong(self, path):
        made(self, path)
        self.text[self.text.index(b" two")] = b" too"

    monkeypatch.setattr(sp_lattice.Vocabulary, "__init__", wrong)
    assert {r.doc_id: r.decoded_equal for r in sp_lattice.encode(table, path).collect()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}


def test_lattice_query_returns_all_ids(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op4_sentencepiece_lattice(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert r.ids == model.encode(text[r.doc_id])
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.decoded_equal


def test_lattice_on_runs_of_blanks_and_units_at_the_mask_s_limit(spark, tmp_path):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    texts = [" " * k + "w" for k in range(1, 64)] + ["".join(rng.choice("aeionrst") for _ in range(n)) for n in range(50, 70) for _ in range(3)] + ["ab" * 40_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    for r in sp_lattice.encode(spark.read.parquet(str(tmp_path / "d")), path).collect():
        assert r.ids == model.encode(texts[r.doc_id]), texts[r.doc_id]


def test_viterbi_against_plain_search(spark):
    small = sp_lattice.Vocabulary.__new__(sp_lattice.Vocabulary)
    small._of([("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -1.2), ("ba", 3, -2.0), ("aba", 4, -2.6), ("bb", 5, -4.0)])
    small.bytes = {b: 10 + b for b in range(256)}
    rng = random.Random(2)
    units = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)} - {"c" * n for n in range(8)})  # without an edge, no row
    found = {r.unit: small.ids_along(r.unit, [x - sp_lattice._SIGNED for x in r.path]) for r in sp_lattice.encode_units(spark.createDataFrame([(0, 0, u) for u in units], "block long, sub int, unit string"), small, "viterbi").collect()}
    assert all(small.ids_of(u, "viterbi") == found[u] for u in units)
    score = {p: s for p, _, s in small.pieces}
    number = {p: i for p, i, _ in small.pieces}

    def best(u):
        if not u:
            return 0.0
        return max([score[u[-k:]] + best(u[:-k]) for k in (1, 2, 3) if u[-k:] in score and k <= len(u)] + [best(u[:-1]) - 1e12])

    value = {i: score[p] for p, i in number.items()}
    for u in units:
        assert sum(value.get(i, -1e12) for i in found[u]) == pytest.approx(best(u))
        assert "".join({i: p for p, i in number.items()}.get(i, chr(max(0, i - 10))) for i in found[u]) == u


def test_growth_is_a_region_of_its_own_for_any_number_of_shards(spark, docs):
    tree = shard_tree.tree_of(5)
    before = {r.doc_id: (r.shard, r.grown_shard) for r in shard_tree.assign(docs[0], n_shards=5).collect()}
    after = {r.doc_id: r.shard for r in shard_tree.assign(docs[0], tree=shard_tree.grown(tree)).collect()}
    assert {k: x for k, (_, x) in before.items()} == after and all(x in (s, 5) for s, x in before.values())


def test_sharding(spark, docs):
    rows = shard_tree.assign(docs[0]).collect()
    assert len(rows) == len(_rows()) and {r.law for r in rows} == {"key"}

    def draw(key, name, w):
        h = xxhash.xxh64_intdigest(f"{name}|{key}".encode(), 42)
        return -np.log(((h >> 11) + 0.5) / 2**53) / w

    slots = defaultdict(list)
    text = Counter()
    for r in rows:
        key = "\0null" if r.doc_id is None else r.doc_id
        region = min(range(4), key=lambda i: draw(key, f"/{i}", 4))
        rack = min(range(2), key=lambda i: draw(key, f"/{region}/{i}", 2))
        leaf = min(range(2), key=lambda i: draw(key, f"/{region}/{rack}/{i}", 1))
        shard = region * 4 + rack * 2 + leaf
        grown = 16 if draw(key, "/4", 1) < draw(key, f"/{region}", 4) else shard
        assert (r.region, r.rack, r.shard, r.grown_shard) == (region, rack, shard, grown)
        slots[r.shard].append(r.slot)
        text[r.doc_id, r.size, r.text_crc32] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert text == Counter((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in _plain(_rows()))
    assert shard_tree.assign(docs[1]).count() == 0


def test_growth_and_weights_move_rows_only_where_they_should(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    of = lambda tree: {r.doc_id: r for r in shard_tree.descend(ids, "doc_id", tree).collect()}
    a, b = of(shard_tree.tree_of(16)), of(shard_tree.tree_of(17))
    assert all(b[k].shard in (a[k].shard, 16) for k in a) and 150 < sum(r.shard == 16 for r in b.values()) < 330
    tree = shard_tree.tree_of(16)
    tree[2][1][0] = 3.0
    c = of(tree)
    moved = [k for k in a if a[k].shard != c[k].shard]
    assert moved and all(c[k].region == 2 for k in moved)
    assert max(Counter(r.shard for r in a.values()).values()) < 1.4 * 250


def _shingles(text):
    w = text.translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_classes(spark, docs):
    rows = [(k, t) for k, t in _plain(_rows()) if k is not None]
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    told = Counter((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))
    full = docs[0].where("doc_id IS NOT NULL")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_tiles.classes(full).collect()) == told
    stay = Counter(r.doc_id for r in jaccard_tiles.keep_one(docs[0]).collect())
    assert stay[4] == 1 and stay[5] == stay[6] == stay[8] == 0 and stay[1] == stay[2] == stay[3] == 1 and stay[7] == 1
    assert jaccard_tiles.classes(docs[1]).count() == 0 and jaccard_tiles.keep_one(docs[1]).count() == 0


def test_tiles_of_large_groups_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_tiles, "TILE", 3)
    monkeypatch.setattr(jaccard_tiles, "CHUNK", 2)
    rng = random.Random(9)
    base = _sentence(rng, 90).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(90)] = f"edit{rng.randrange(6)}"
        rows.append((i, " ".join(w[: rng.choice((90, 80, 70))])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = [_shingles(t) for _, t in rows]
    root = list(range(40))
    for i in range(40):
        for j in range(40):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found = {r.doc_id: r.component_id for r in jaccard_tiles.classes(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found == dict(enumerate(root)) and len(set(root)) > 1


@pytest.mark.parametrize("sets", [1 << 22, 400])
def test_second_round_makes_no_row_for_a_possible_pair(spark, tmp_path, monkeypatch, sets):
    monkeypatch.setattr(jaccard_tiles, "SETS", sets)
    rng = random.Random(21)
    base = _sentence(rng, 100).split()
    texts = []
    for i in range(60):  # likeness of about 0.7 to each other, too little for a link, and close to what bitmaps can tell
        at = 14 + rng.randrange(5)
        texts.append(" ".join([*base[:80], *(f"{i}own{j}" for j in range(at))]))
    texts += [t.rsplit(" ", 1)[0] for t in texts[:3]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    shingles, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    made = []
    once = jaccard_tiles.kept
    monkeypatch.setattr(jaccard_tiles, "kept", lambda df, tag: (out := once(df, tag), tag.startswith("rest") and made.append((tag, out.count())))[0])
    found = {r.doc_id: r.component_id for r in jaccard_tiles.classes(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found == dict(enumerate(root)) and len(set(root)) > 5
    tiles = 2 * len(texts)  # a member stands in few tiles
    assert made and all(k <= tiles for _, k in made), made


def test_passages(spark, docs):
    words = [t.split() for _, t in _plain(_rows())]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    told = Counter()
    for (k, _), w in zip(_plain(_rows()), words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        told[k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    rows = level_dedup.dedup(docs[0], carry=("n_words", "score")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == told
    text = dict(_plain(_rows()))
    assert all(r.clean_text == text[r.doc_id] and r.carried.score == 0 for r in rows if not r.n_removed)
    assert next(r.clean_text for r in rows if r.doc_id == 4) == ""
    assert level_dedup.dedup(docs[1]).count() == 0


def test_no_level_runs_after_one_without_repeats(spark, monkeypatch):
    ran, compare = [], level_dedup._compare
    monkeypatch.setattr(level_dedup, "_compare", lambda rows, answers, *rest: ran.append(len(answers)) or compare(rows, answers, *rest))
    words = [f"w{i}" for i in range(200)]
    far = spark.createDataFrame([(1, " ".join(words[:60]), 5), (2, " ".join(words[60:120] + words[:8]), 5), (None, " ".join(words[120:]), 6)], "doc_id long, text string, n_removed int")
    assert [(r.n_words, r.n_removed) for r in level_dedup.dedup(far).orderBy("doc_id").collect()] == [(80, 0), (60, 0), (68, 0)] and ran == [0]
    near = spark.createDataFrame([(1, " ".join(words[:60])), (2, " ".join(words[60:120] + words[:40]))], "doc_id long, text string")
    assert [r.n_removed for r in level_dedup.dedup(near).collect()] == [40, 40] and ran == [0, 0, 1, 2]


def test_quality_rules(spark, docs):
    rows = weak_rules.judge(docs[0]).collect()
    told = Counter()
    for k, t in _plain(_rows()):
        w, lines = t.split(), [x for x in t.split("\n") if x.split()]
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        told[k, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == told
    assert not any(r.kept for r in rows if r.base_failed) and next(r.kept for r in rows if r.doc_id == 9)
    assert weak_rules.judge(docs[1]).count() == 0


def test_labelled_sample_and_classifiers(spark, docs):
    rng = random.Random(6)
    rows = [(i, _sentence(rng, 40) + (" you idiot " if i % 3 == 0 else " ") + _sentence(rng, 20) if i % 5 else "BUY!! NOW!! " * 30) for i in range(120)]
    table = spark.createDataFrame(rows + [(0, None), (7, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 3 == 0 and i % 5 != 0)) for i in range(120)] + [(500, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in table.where(labelled.held_out("doc_id")).collect()} == held
    sample = labelled.sample(table, labels, "toxic", bound={1: 5, 0: 7})
    texts = {t for i, t in rows if i not in held} | {""}
    assert Counter(y for _, y in sample) == {1: 5, 0: 7} and all(t in texts for t, _ in sample)
    found = toxic_kernel.judge(table, labels).collect()
    assert len(found) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id in held) for r in found)
    quality = mil_quality.judge(table, labels).collect()
    wrong = sum(r.predicted != int(r.doc_id % 5 != 0) for r in quality if r.held_out and r.doc_id not in (0, 7))
    assert wrong <= 2 and all(0 <= r.score <= 1 for r in quality)
    for judge in (toxic_kernel.judge, mil_quality.judge):
        assert judge(docs[0], labels.where("false")).count() == len(_rows()) and judge(docs[1], labels).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs[0].write.parquet(str(tmp_path / "documents.parquet"))
    text = dict(_plain(_rows()))
    spark.createDataFrame([(1, " ".join(text[20 + 11].split()[3:23]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # No labels: nothing is toxic. 4, 5, 6 and 8, 7 are near-duplicates; 9 and 10 share a passage; 31 holds a benchmark item.
    assert {1, 2, 3, 4, 7, 9, 10, 11, 13, 14, 15, None} <= set(found) and not {5, 6, 8} & set(found)
    model = {k: sp_lattice.Vocabulary(tokenizer_file("piece_bpe_32k.model")).decode(r.ids) for k, r in found.items()}
    passage = text[9].split()[60:110]
    assert " ".join(passage[:35]) not in model[9] and " ".join(passage[:35]) not in model[10]
    assert " ".join(text[31].split()[3:23]) not in model.get(31, "") and model[14] == text[14]


def test_pipeline_keeps_columns_of_its_own_names_and_takes_empty_tables(spark, docs, tmp_path):
    clashing = docs[0].select("*", F.lit("mine").alias("_toxicity"), F.lit("too").alias("_toxicity_"), F.lit(7).alias("_rid"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    for path, rows in (("full", clashing), ("none", clashing.where("false"))):
        folder = str(tmp_path / path)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, out, folder).write.parquet(f"{folder}/{name}")
            out = spark.read.parquet(f"{folder}/{name}")
            assert out.columns == clashing.columns
            assert {(r._toxicity, r._toxicity_, r._rid, r.score) for r in out.collect()} == ({("mine", "too", 7, CLASHES["score"])} if path == "full" else set())
        assert corpus_pipeline.STAGES[-1][0] == names[-1] and corpus_pipeline.STAGES[-1][1](spark, out, folder).count() == out.count()


def _plain_pipeline(rows, items, toxic):
    """The five stages on (doc_id, text) in plain Python; ``toxic`` judges a text. The ids are the library's."""
    import sentencepiece

    rows = [(k, t) for k, t in rows if not toxic(t)]
    sets, root = [_shingles(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    order, first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)), {}
    for i in order:
        first.setdefault(root[i], i)
    rows = [(k, t or "") for i, (k, t) in enumerate(rows) if not sets[i] or first[root[i]] == i]
    count, out = Counter(tuple(w[i : i + 35]) for w in (t.split() for _, t in rows) for i in range(len(w) - 34)), []
    for k, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if not gone:
            out.append((k, t))
        elif len(gone) < len(w):
            clean, last = "", None
            for i, m in enumerate(re.finditer(r"\S+", t)):
                if i not in gone:
                    clean += (t[: m.start()] if i == 0 else t[last[1] : m.start()] if last and last[0] == i - 1 else " " if clean else "") + m[0]
                    last = i, m.end()
            out.append((k, clean))
    rows, out = out, []
    plain = lambda t: [(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    windows = set()
    for item in items:
        w = [x for x, *_ in plain(item)]
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    for k, t in rows:
        w = plain(t)
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(x for x, *_ in w[i : i + n]) in windows for j in range(i, i + n)}
        if 2 * len(hit) > len(w):
            continue
        clean, last = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                clean += t[last : w[i][1]]
            last = w[i][2]
        out.append((k, clean + t[last:]))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    return [(k, tuple(model.encode(t))) for k, t in out]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(8)
    judged = [(1000 + i, _sentence(rng, 40) + (" you idiot " if i % 3 == 0 else " ") + _sentence(rng, 20)) for i in range(120)]
    rows = [*_rows(), *judged]
    text = dict(_plain(rows))
    items = [" ".join(text[31].split()[3:23]), text[22].upper(), "nur vier", None, "..."]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxic_kernel.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    scores = toxic_kernel.Scores(model)
    toxic = lambda t: 1 / (1 + np.exp(-np.clip(model["slope"] * scores.documents([t])[0] + model["shift"], -30, 30))) >= corpus_pipeline.TOXIC
    gone = {k for k, t in rows if toxic(t)}
    assert {1000 + i for i in range(0, 120, 3)} <= gone and len(gone) < 80
    told = _plain_pipeline(rows, items, toxic)
    assert 22 not in dict(told) and 5 not in dict(told) and 31 in dict(told)
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(told)
