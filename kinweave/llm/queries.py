"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontam, dual_tree, filter_audit, jaccard_tiles, level_dedup, license_rules, mil_quality, repair_codec, shard_tree, sp_lattice, toxic_kernel, warc_zst, weak_rules

_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair_codec.write(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return repair_codec.read(spark, shards, ids=False)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zst.write(_table(spark, sf_dir, "pages"))
    records = warc_zst.read(spark, archives, payloads=False)
    return records.select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


_SQL["op2_warc_archives"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.payload_bytes >= 1000 AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.payload_bytes >= 1000 AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def op3_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), cleaned=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


_SQL["op3_suffix_automaton_decontamination"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, g.n, i, item_id FROM d, (SELECT DISTINCT n FROM g) AS s, unnest(range(1, len(w) - s.n + 2)) AS t(i), g WHERE g.n = s.n AND g.k = array_to_string(w[i : i + s.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM x) AS y, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) AS y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def op4_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_lattice.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign(_table(spark, sf_dir, "documents"), n_shards=16)


def op7_jaccard_tile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tiles.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_SQL["op7_jaccard_tile_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM o JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) AS c ON c.x = d.doc_id
"""


def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_kernel.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_level_wise_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_dedup.dedup(_table(spark, sf_dir, "documents"), cleaned=False)


_SQL["op9_level_wise_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, j FROM p JOIN r ON p.k = r.k, unnest(range(i, i + 35)) AS t(j)),
h AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT d.doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
s AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.j = g.j WHERE g.j IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


def op10_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(_table(spark, sf_dir, "documents"))


def op11_dual_tree_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(_table(spark, sf_dir, "embeddings"))


def _lloyd(rounds: int) -> str:
    """The rounds as parts of a WITH clause: a<i> assigns by the centroids c<i>, which are a table of (c, w)."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS d FROM q CROSS JOIN c{i}),
a{i} AS (SELECT r, CAST(min(c) AS INTEGER) AS cluster, min(d) AS distance FROM (SELECT r, c, d, min(d) OVER (PARTITION BY r) AS m FROM d{i}) AS t WHERE d = m GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN q USING (r), unnest(range(1, 65)) AS t(j) GROUP BY cluster, j),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS w FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} ON c = cluster)""")
    return ",\n".join(parts)


_SQL["op11_dual_tree_clustering"] = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM k),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v AS w FROM q WHERE vec_id IS NOT NULL QUALIFY c < 16),
{_lloyd(3)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(w, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a3 JOIN q USING (r) JOIN c3 ON c = cluster
"""


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_SQL["op12_filter_interactions"] = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN f.doc_id > first_id THEN 'E' ELSE '' END AS fails FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, unnest(range(1, 6)) AS t(step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failed, translate(fails, earlier, '') <> fails AS gone FROM h, s),
g AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return _SQL
