"""The registered queries of this subpackage and their checking statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lonja.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


OP6 = r"""
WITH it AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, j, j + least(len(w), 10) - 1) AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(k) AS n FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM doc, sizes),
hits AS (SELECT r, p, n, item_id FROM (SELECT r, p, n, list_slice(w, p, p + n - 1) AS k FROM pos) JOIN win USING (k)),
per AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per USING (r) LEFT JOIN ids USING (r)
"""


@query("op6_benchmark_decontamination", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.suffix import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_pii_spans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.semicrf import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query("op8_quality_outliers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.outliers import robust_outliers

    return robust_outliers(table(spark, sf_dir, "documents"))


@query("op5_pu_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.puquality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.trietokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS INT) >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d
"""


@query("op2_warc_boundary_chain", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.minhash import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


OP1 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
one AS (SELECT conv_id, turn, min(text) AS text FROM c GROUP BY ALL),
n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM one),
q AS (SELECT c.conv_id, c.turn, 1 AS level, n.norm FROM c JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn - 1 WHERE norm <> ''
      UNION ALL SELECT c.conv_id, c.turn, 2, n.norm FROM c JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn - 2 WHERE norm <> ''),
said AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS norm
         FROM (SELECT conv_id, turn, unnest(list_append(string_split(text, chr(10)), text)) AS t FROM c)),
near AS (SELECT conv_id, norm, min(turn) AS near FROM said GROUP BY ALL),
first AS (SELECT norm, min(conv_id) AS f_conv, arg_min(near, conv_id) AS f_turn FROM near GROUP BY norm),
l AS (SELECT q.conv_id, q.turn, level, CASE WHEN near < q.turn THEN q.conv_id WHEN f_conv < q.conv_id THEN f_conv END AS o_conv,
             CASE WHEN near < q.turn THEN near WHEN f_conv < q.conv_id THEN f_turn END AS o_turn
      FROM q LEFT JOIN near ON near.conv_id = q.conv_id AND near.norm = q.norm LEFT JOIN first ON first.norm = q.norm),
p AS (SELECT conv_id, turn, count(*) AS n_quotes, count(o_conv) AS n_linked, max(level) AS max_level,
             max((-level, o_conv, o_turn)) FILTER (o_conv IS NOT NULL) AS r FROM l GROUP BY ALL),
m AS (SELECT c.*, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0) AS max_level, r[2] AS parent_conv, r[3] AS parent_turn
      FROM c LEFT JOIN p USING (conv_id, turn)),
t AS (SELECT conv_id, turn, conv_id AS thread_conv, turn AS thread_turn, 0 AS depth FROM m WHERE parent_conv IS NULL
      UNION ALL SELECT m.conv_id, m.turn, thread_conv, thread_turn, depth + 1 FROM m JOIN t ON m.parent_conv = t.conv_id AND m.parent_turn = t.turn)
SELECT m.conv_id, m.turn, role, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, CAST(max_level AS BIGINT) AS max_level,
       parent_conv, parent_turn, thread_conv, thread_turn, CAST(depth AS BIGINT) AS depth,
       length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS own_chars, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS own_sha256
FROM m JOIN t USING (conv_id, turn)
"""


@query("op1_quote_links", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lonja.llm.quotes import as_mail, link_quotes

    found = link_quotes(as_mail(table(spark, sf_dir, "conversations")))
    return found.select(*[c for c in found.columns if c != "own"], F.length("own").cast("long").alias("own_chars"), F.sha2("own", 256).alias("own_sha256"))


OP11 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY k) AS keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query("op11_exact_dedup", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.exactdedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP13 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, {'r': role, 't': text} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
b AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, flatten(list_transform(list_transform(range(1, strlen(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1))),
             lambda a: [CAST(a AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS bits FROM c),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295, bits), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM b),
s AS (SELECT h.conv_id, 0 AS own, pos, x FROM h JOIN o ON o.conv_id = h.base AND pos <= h UNION ALL SELECT h.conv_id, 1, pos, x FROM h JOIN o ON o.conv_id = h.conv_id AND pos > h),
p AS (SELECT h.conv_id, coalesce(list(x ORDER BY own, pos) FILTER (x IS NOT NULL), []) AS path FROM h LEFT JOIN s ON s.conv_id = h.conv_id GROUP BY h.conv_id),
m AS (SELECT conv_id, d, list_slice(path, 1, d) AS pre, len(path) = d AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(pre[d].t) END AS own FROM m GROUP BY d, pre),
k AS (SELECT d - 1 AS d, list_slice(pre, 1, d - 1) AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, pre)),
t AS (SELECT a AS d, list_slice(pre, 1, a) AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN t USING (d, pre) LEFT JOIN n up ON up.d = f.d - 1 AND up.pre = list_slice(f.pre, 1, f.d - 1)
"""


@query("op13_conversation_trie", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.convtrie import placed, prefix_trie, with_shared_heads

    return prefix_trie(*with_shared_heads(*placed(table(spark, sf_dir, "conversations"))))


OP12 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, br) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.br ORDER BY s.score DESC, s.vec_id, s.br) AS rank, s.vec_id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.llm.covertree import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
