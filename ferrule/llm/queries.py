"""The corpus operators as queries over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import cover_topk, decontamination, exact_dedup, html_text, kd_clusters, language_id, merkle, mixing, ngram_join, packing, pii, secrets_crf, sharding
from .common import table


def op1_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, least=85).select(
        "doc_id", "n_shingles", "component_id", "n_copies", "component_size"
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "map_version"
    )


def op3_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_ngram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_crf.digest_columns(secrets_crf.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op8_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op10_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a corpus sets a key of its own; without one, the test key gives results that anyone can repeat
    secret = spark.conf.get("spark.ferrule.pii.key", "corpus-1")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), secret=secret)


def op11_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_coordinate_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_prefix_jaccard": op1_prefix_jaccard,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_url_differencing": op3_url_differencing,
    "op4_source_mix": op4_source_mix,
    "op5_dual_tree_topk": op5_dual_tree_topk,
    "op6_ngram_bayes": op6_ngram_bayes,
    "op7_crf_secrets": op7_crf_secrets,
    "op8_tiered_packing": op8_tiered_packing,
    "op9_tree_merge_dedup": op9_tree_merge_dedup,
    "op10_keyed_surrogates": op10_keyed_surrogates,
    "op11_ngram_decontamination": op11_ngram_decontamination,
    "op12_coordinate_proofs": op12_coordinate_proofs,
    "op13_kd_clusters": op13_kd_clusters,
    "pipeline": corpus_pipeline.run,
}

#: SQL of the rounds of clustering: each makes the centroids of the next.
_ROUNDS = ",\n".join(
    f"""d{i} AS MATERIALIZED (SELECT row, c, row_number() OVER (PARTITION BY row ORDER BY q - 2 * list_dot_product(v.v, c{i}.v) + c{i}.q2, c) AS place,
  q - 2 * list_dot_product(v.v, c{i}.v) + c{i}.q2 AS d FROM v, (SELECT c, v, list_dot_product(v, v) AS q2 FROM k{i}) c{i}),
s{i} AS (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM d{i} JOIN v USING (row) WHERE place = 1) GROUP BY c, k),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY k) AS v FROM s{i} GROUP BY c),
k{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, k{i}.v) AS v FROM k{i} LEFT JOIN m{i} USING (c))"""
    for i in range(10)
)

ORACLES = {
    "op11_ngram_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM g) l, unnest(range(1, len(w) + 1)) AS t(i) WHERE i + n - 1 <= len(w)),
h AS (SELECT row, i, dw.n, item FROM dw JOIN g ON g.g = dw.g AND g.n = dw.n),
p AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row) LEFT JOIN t USING (row)""",
    "op12_coordinate_proofs": r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS crc
  FROM documents),
l AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed FROM f),
p AS (SELECT row_number() OVER () AS row, *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (
  SELECT g, 0 AS level, pos AS idx, leaf AS digest, n FROM p
  UNION ALL SELECT g, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY g, level, idx // 8),
s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos AS idx, subroot AS digest, n FROM s
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY level, idx // 8),
c AS (
  SELECT row, level, p.g, pos // (8 ** level)::BIGINT AS own FROM p JOIN (SELECT DISTINCT g, level FROM t WHERE n > 1) v ON v.g = p.g),
e AS (
  SELECT row, c.level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < own), '') AS lft, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > own), '') AS rgt
  FROM c JOIN t ON t.g = c.g AND t.level = c.level AND t.idx // 8 = own // 8 GROUP BY row, c.level
  UNION ALL
  SELECT row, 100 + y.level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < own), ''), coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > own), '')
  FROM (SELECT p.row, v.level, s.pos // (8 ** v.level)::BIGINT AS own FROM p JOIN s ON s.g = p.g, (SELECT DISTINCT level FROM u WHERE n > 1) v) y
  JOIN u ON u.level = y.level AND u.idx // 8 = own // 8 GROUP BY row, y.level),
o AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS k FROM e),
w AS (SELECT row, 1 AS k, claimed AS digest FROM p UNION ALL SELECT w.row, w.k + 1, sha256(lft || digest || rgt) FROM w JOIN o ON o.row = w.row AND o.k = w.k),
z AS (SELECT row, arg_max(digest, k) AS folded_root FROM w GROUP BY row),
q AS (SELECT row, string_agg(lft || rgt, '' ORDER BY k) AS proof FROM o GROUP BY row)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT digest FROM u WHERE n = 1) AS verified
FROM p JOIN s ON s.g = p.g JOIN z ON z.row = p.row LEFT JOIN q ON q.row = p.row""",
    "op13_kd_clusters": f"""
WITH x AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS q FROM x),
k0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 8),
{_ROUNDS},
a AS (SELECT row, c, place, q - 2 * list_dot_product(v.v, k.v) + k.q2 AS d FROM (
    SELECT row, c, row_number() OVER (PARTITION BY row ORDER BY v.q - 2 * list_dot_product(v.v, k10.v) + list_dot_product(k10.v, k10.v), c) AS place FROM v, k10) z
  JOIN v USING (row) JOIN (SELECT c, v, list_dot_product(v, v) AS q2 FROM k10) k USING (c) WHERE place = 1)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT for x in k10.v], ',')) AS centroid_sha256
FROM a JOIN v USING (row) JOIN k10 USING (c)""",
    "op1_prefix_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT row, doc_id, s, len(s) AS n FROM s),
u AS (SELECT row, n, unnest(s) AS t FROM n),
l AS (
  SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.t = b.t AND a.row <> b.row AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT a AS row, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.row),
c AS (SELECT r.row, min(n.doc_id) AS top, count(*) AS size FROM r JOIN n ON n.row = r.root GROUP BY r.row),
e AS (SELECT row, count(*) OVER (PARTITION BY list_sort(s)) AS copies FROM n)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(c.top, n.doc_id) AS component_id,
  (CASE WHEN n.n > 0 THEN e.copies ELSE 1 END)::BIGINT AS n_copies, coalesce(c.size, 1)::BIGINT AS component_size
FROM n JOIN e ON e.row = n.row LEFT JOIN c ON c.row = n.row""",
    "op4_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0 * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS reach,
        (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= reach) * w)::DOUBLE AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target, round(g.target)::BIGINT AS budget,
        (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begins
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
     + greatest(0, least(size, budget - (budget // source_size) * source_size - begins)) ELSE 0 END)::BIGINT AS taken
FROM p""",
    "op5_dual_tree_topk": r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_tree_merge_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER () AS rid,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER g AS keep_id,
  count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  row_number() OVER g = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, rid)""",
}
