"""The queries opN_* over whole tables, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import cws, jaccard, language, lattice, media, mixing, packing, pii, quality, sharding, spelling, trie, warc
from marketlens.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.with_images(read(spark, sf_dir, "documents"))
    return media.image_figures(images).withColumnRenamed("key", "doc_id").withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"), pii.session_key(spark))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_packing, op3_media_columns, op4_language_id, op5_mixing, op6_sharding, op7_pii, op8_warc, op9_lattice_lm, op10_jaccard_join, op11_conversation_trie, op12_spelling_variants, op13_fingerprints)
}

_OP5 = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS k,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, k) FROM l WHERE level <= cap / w) * w) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT source, h, sum(size) AS tokens FROM d GROUP BY source, h),
r AS (SELECT source, h, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
x AS (SELECT r.source, max(CASE WHEN upto <= left_ THEN h
                               WHEN upto - tokens <= left_ AND upto - left_ < left_ - (upto - tokens) THEN h END) AS mark
      FROM r JOIN (SELECT source, target - epochs * source_size AS left_ FROM b) c ON r.source IS NOT DISTINCT FROM c.source
      GROUP BY r.source)
SELECT d.doc_id, d.source, d.size, b.source_size, b.target,
       ((b.epochs + CASE WHEN d.h <= coalesce(x.mark, -1) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS best FROM q GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(q.hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM q JOIN m USING (hex)
"""

_OP10 = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
c AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id
"""



def _crc32(octets: str) -> str:
    """SQL for the checksum of a list of octets, a bit at a time."""
    bits = f"flatten(list_transform({octets}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda s, x: xor(xor(s, x) >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"
_OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32(_DIGITS)} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM s),
p AS (SELECT conv_id, d, words, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM n UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
g AS (SELECT node, d, min(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node, d),
u AS (SELECT g.node, up.node AS above, up.conv_id AS parent FROM g JOIN p ON p.conv_id = g.conv_id AND p.d = g.d - 1 JOIN g up ON up.node = p.node),
k AS (SELECT above AS node, count(*) AS n_children FROM u GROUP BY above),
b AS (SELECT p.node, sum((g.n_convs - 1) * g.words)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves FROM g JOIN p ON p.conv_id = g.conv_id AND p.d <= g.d LEFT JOIN k ON k.node = g.node GROUP BY p.node),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM p) WHERE d = last GROUP BY node)
SELECT g.conv_id, g.d::BIGINT AS depth, u.parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN b USING (node) LEFT JOIN u USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node)
"""

_OCTETS = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, (ord(c) - 64)::BIGINT] END))"
_OP12 = f"""
WITH RECURSIVE r AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_crc32(_OCTETS)} AS h FROM d),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
star AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM i),
less AS (SELECT DISTINCT i.word, i.n, v.word AS other, v.n AS other_n FROM i JOIN v ON v.word = substr(i.word, 1, i - 1) || substr(i.word, i + 1)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM star a JOIN star b ON a.key = b.key AND a.word <> b.word
         UNION ALL SELECT word, n, other, other_n FROM less UNION ALL SELECT other, other_n, word, n FROM less),
best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
f AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE place = 1 AND other_n >= 10 * n),
walk AS (SELECT word, form AS seen, 1 AS steps FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.seen),
root AS (SELECT word, arg_max(seen, steps) AS root FROM walk GROUP BY word)
SELECT v.word, f.form, coalesce(root.root, v.word) AS root, v.n, coalesce(best.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN best ON best.word = v.word AND place = 1 LEFT JOIN f ON f.word = v.word LEFT JOIN root ON root.word = v.word
"""

ORACLES: dict[str, str] = {"op5_mixing": _OP5, "op8_warc": _OP8, "op10_jaccard_join": _OP10, "op11_conversation_trie": _OP11, "op12_spelling_variants": _OP12}
