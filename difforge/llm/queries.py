"""The registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .best_fit import pack_best_fit
from .exact_dedup import exact_groups
from .fixity import audit, records
from .language import identify
from .mixing import balance
from .ngram_join import near_groups
from .packing import pack
from .prefix_trie import conversation_trie
from .quality import score_quality
from .sharding import assign_shards
from .spelling import variants
from .substring import repeated_passages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_read(spark, sf_dir, "documents"), 40)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), buckets=16, token_budget=65536)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_read(spark, sf_dir, "documents"))


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica with faults at fixed places: some bodies changed, some records lost."""
    pages = _read(spark, sf_dir, "pages")
    mark = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2)
    replica = pages.where(F.coalesce(mark != "ff", F.lit(True))).withColumn("html", F.when(mark == "00", F.concat("html", F.lit("~"))).otherwise(F.col("html")))
    return audit(records(pages), records(replica))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_read(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_best_fit(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_ngram_jaccard_join, op4_collision_ann, op5_substring_dedup, op6_mixing, op7_language_id, op8_merkle_fixity, op9_quality, op10_exact_dedup, op11_spelling_variants, op12_best_fit_packing, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
  n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
  r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id""",
        "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
        "op8_merkle_fixity": r"""
WITH r AS (SELECT page_id, page_id // 1000 AS file, page_id % 1000 AS slot,
    substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) AS mark,
    E'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:' || page_id || E'>\r\nWARC-Target-URI: ' || coalesce(url, '')
    || E'\r\nContent-Length: ' || strlen(coalesce(html, '')) || E'\r\n\r\n' || coalesce(html, '') || E'\r\n\r\n' AS rec FROM pages)
SELECT page_id, file, slot, CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       strlen(rec) AS length, sha256(rec) AS sha256,
       CASE mark WHEN 'ff' THEN 'missing' WHEN '00' THEN 'changed' ELSE 'ok' END AS status FROM r""",
        "op11_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i))),
  r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r WHERE length(run) >= 5 GROUP BY ALL),
  x AS (SELECT run, c, hex(id || ':' || run) AS x FROM l),
  b AS (SELECT run, c, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b FROM x),
  h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda s, o: xor(s >> 8, tab[(xor(s, o) & 255) + 1])), 4294967295) AS h FROM b, tab),
  d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
  v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
  k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
  p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
    UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON v.word = k.k
    UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON v.word = k.k),
  q AS (SELECT word, n, near, near_n, count(*) OVER w AS n_near, row_number() OVER (w ORDER BY near_n DESC, near) AS at FROM p WINDOW w AS (PARTITION BY word)),
  f AS MATERIALIZED (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND q.at = 1),
  c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.root WHERE g.form IS NULL""",
        "op13_conversation_trie": r"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i))),
  t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
  i AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
  c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda j: ord(substr(s, j, 1)))), lambda a, o: xor(a >> 8, tab[(xor(a, o) & 255) + 1])), 4294967295) % 9 AS h FROM i, tab),
  b AS (SELECT c.conv_id, k, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h UNION ALL SELECT c.conv_id, k, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
  p AS (SELECT conv_id, row_number() OVER w AS d, strlen(x) AS b, string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER w AS p FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
  a AS MATERIALIZED (SELECT conv_id, 0 AS d, 0 AS b, '' AS p FROM c UNION ALL FROM p),
  e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM a),
  n AS MATERIALIZED (SELECT p, d, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS h FROM e GROUP BY p, d),
  k AS (SELECT up AS p, d - 1 AS d, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY ALL),
  f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
  s AS (SELECT DISTINCT x.p, x.d, y.p AS q, y.d AS e FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.d <= y.d),
  g AS (SELECT s.p, s.d, count(*) FILTER (f.kids = 0) AS n_leaves, CAST(sum((f.n - 1) * f.b) AS BIGINT) AS saved FROM s JOIN f ON f.p = s.q AND f.d = s.e GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, g.n_leaves, g.saved AS saved_tokens, f.h AS ends_sha256
FROM f JOIN g ON g.p = f.p AND g.d = f.d LEFT JOIN n u ON u.p = f.up AND u.d = f.d - 1""",
    }
