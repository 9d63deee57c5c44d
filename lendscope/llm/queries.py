"""Registered queries of the training-data operators: thin wrappers that run
an operator with production parameters over its whole table and derive the
digest columns of the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import (
    bpe, exact, fingerprint, html_cut, lines, mixing, phrases, shard, suffix_dedup, superminhash, toxicity, trie, whitening,
)
from lendscope.llm.common import table


#: Target shares of the expected tokens by label domain, and the size of the mixture as a share of the corpus.
DOMAIN_WEIGHTS = {"good": 0.86, "poor": 0.12, "toxic": 0.02}
BUDGET = 0.75


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_domains(docs, table(spark, sf_dir, "labels"), list(DOMAIN_WEIGHTS))
    held = mixing.memberships(docs, model)
    rates = mixing.with_rates(held, mixing.fit_mixture(held, model, DOMAIN_WEIGHTS, BUDGET))
    return rates.select("doc_id", "n_words", *[F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(DOMAIN_WEIGHTS)], "rate", "copies")


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shuffled_shards(table(spark, sf_dir, "documents"), shards=8)


def op3_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_bwt_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), length=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN, ids=False)


def op7_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("id")


def op13_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)


QUERIES = {f.__name__: f for f in (
    op1_soft_mixing, op2_feistel_shards, op3_oph_fingerprints, op4_bwt_suffix_dedup, op5_exact_dedup, op6_byte_bpe,
    op7_min_cut_extraction, op8_line_dedup, op9_superminhash, op10_zstd_toxicity, op11_refined_whitening, op12_prefix_trie,
    op13_phrase_index)}

ORACLE: dict[str, str] = {}

ORACLE["op5_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

ORACLE["op8_line_dedup"] = r"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
     k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
     c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY k.doc_id
"""

ORACLE["op2_feistel_shards"] = f"""
WITH RECURSIVE bit AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS tab FROM bit WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
z AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM d, tab),
p AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {shard.BUCKETS}, doc_id, size, text_crc32) - 1 AS row_number FROM z),
w AS (SELECT row_number AS id, row_number // b AS x, row_number % b AS y, 0 AS step FROM r, p
  UNION ALL
  SELECT id, CASE WHEN step = 8 THEN x ELSE y END,
         CASE WHEN step = 8 THEN y ELSE (x + (((y * 48271 + {list(shard.KEYS)}[step + 1]) % {shard.PRIME}) * ((y * 48271 + {list(shard.KEYS)}[step + 1]) % {shard.PRIME})) % {shard.PRIME}) % (CASE WHEN step % 2 = 0 THEN a ELSE b END) END,
         CASE WHEN step = 8 THEN 0 ELSE step + 1 END
  FROM w, p WHERE step < 8 OR x * b + y >= n)
SELECT r.doc_id, r.size, r.text_crc32, 'rows' AS law, ((x * b + y) % 8)::INT AS shard, (x * b + y) // 8 AS slot, NULL::INT AS grown_shard, row_number
FROM r JOIN w ON w.id = r.row_number, p WHERE step = 8 AND x * b + y < n
"""

ORACLE["op4_bwt_suffix_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 199)) AS i, h FROM t WHERE n >= 200),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM w),
c AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM k JOIN c USING (g)),
j AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 200 AS hi FROM j GROUP BY doc_id, span),
p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prior FROM s),
x AS (SELECT p.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS kept
      FROM p JOIN t USING (doc_id) GROUP BY p.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN x USING (doc_id)
"""

ORACLE["op9_superminhash"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

ORACLE["op12_prefix_trie"] = r"""
WITH RECURSIVE bit AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS tab FROM bit WHERE k = 8),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY i) AS l FROM t GROUP BY conv_id),
z AS (SELECT conv_id, l, conv_id - conv_id % 20 AS base, conv_id::VARCHAR AS s FROM o),
h AS (SELECT conv_id, l, base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 4 AS h FROM z, tab),
c AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, len(l) AS n, md5(l[1:d]::JSON::VARCHAR) AS id, CASE WHEN d > 0 THEN md5(l[1:d - 1]::JSON::VARCHAR) END AS parent,
             CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
      FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM c)),
n AS (SELECT id, any_value(d) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY id),
k AS (SELECT parent AS id, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
a AS (SELECT DISTINCT x.id AS top, y.id AS below FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.d <= y.d),
s AS (SELECT a.top AS id, count(*) FILTER (k.id IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
      FROM a JOIN n ON n.id = a.below LEFT JOIN k ON k.id = a.below GROUP BY a.top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (id) LEFT JOIN k USING (id) LEFT JOIN n q ON q.id = n.parent
"""

ORACLE["op13_phrase_index"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS g FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT len(g) AS n FROM g),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, n WHERE len(w) >= n),
m AS (SELECT x.doc_id, x.i, x.n, g.item_id FROM x JOIN g ON g.g = x.w[x.i:x.i + x.n - 1]),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN i USING (doc_id)
"""
