"""Registered queries opN_<name> of the training-data operators and their DuckDB twins.

Each query applies its operator to the whole table named in its docstring and
derives the digest columns from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.llm.common import LOWER, UPPER, WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values of the URL query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark: 13-word windows, 5 % rule."""
    from wattlane.llm.decontaminate import find_contamination
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE["op1_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)"""


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents into 16 shards; grown_shard with 17."""
    from wattlane.llm.sharding import shard_rows
    return shard_rows(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _jump_sql(shards: int) -> str:
    return f"""(SELECT doc_id, max(b) AS shard FROM (
        WITH RECURSIVE j(doc_id, k, b, nxt) AS (
            SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT),
                   CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
            UNION ALL
            SELECT doc_id, k2, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE)) AS BIGINT)
            FROM (SELECT doc_id, nxt, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE nxt < {shards}))
        SELECT doc_id, b FROM j) GROUP BY doc_id)"""


ORACLE["op2_sharding"] = f"""
WITH RECURSIVE tab AS (
    SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
doc AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM doc, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(s.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot,
       CAST(g.shard AS INTEGER) AS grown_shard
FROM crc JOIN {_jump_sql(16)} s USING (doc_id) JOIN {_jump_sql(17)} g USING (doc_id)"""


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages against the four fixed rules; a page without a rule is allowed."""
    from wattlane.llm.url_filter import filter_urls
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


ORACLE["op4_url_filter"] = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1"""


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without later occurrences of repeated three-line windows."""
    from wattlane.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text")


ORACLE["op6_line_dedup"] = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS lno FROM documents),
l AS (SELECT doc_id, lno, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY lno) AS n
      FROM raw WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT a.doc_id, a.n AS pos, a.line || chr(10) || b.line || chr(10) || c.line AS h
      FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.n = a.n + 1 JOIN l c ON c.doc_id = a.doc_id AND c.n = a.n + 2),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM w WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS n
         FROM f WHERE doc_id <> fd OR pos <> fp),
agg AS (SELECT r.doc_id, count(l.n) AS n_lines, count(g.n) AS n_removed,
               coalesce(string_agg(r.line, chr(10) ORDER BY r.lno) FILTER (WHERE g.n IS NULL), '') AS txt
        FROM raw r LEFT JOIN l ON l.doc_id = r.doc_id AND l.lno = r.lno LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(txt, '') END AS text
FROM documents d LEFT JOIN agg USING (doc_id)"""


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents counted with word_bpe_49k.json; limit 2048."""
    from wattlane.llm.token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@query("op5_piece_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded with piece_bpe_32k.model."""
    from wattlane.llm.piece_codec import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as token files with word_bpe_49k.json and read back."""
    from wattlane.llm.token_files import read_token_files, write_token_files
    files = write_token_files(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return read_token_files(files).withColumnRenamed("id", "doc_id")


@query("op10_minhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: near-duplicate groups, five-word shingles, similarity 0.8."""
    from wattlane.llm.minhash_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored with a lexicon and weights learned from labels.toxic."""
    from wattlane.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings of equal label linked at cosine 0.98 or more."""
    from wattlane.llm.embedding_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS s
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(e, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id"""


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations rebuilt with shared heads: every node of their prefix trie."""
    from wattlane.llm.prefix_trie import number_turns, prefix_trie, share_heads
    return prefix_trie(*share_heads(*number_turns(table(spark, sf_dir, "conversations"))))


ORACLE["op11_prefix_trie"] = r"""
WITH tab AS (
    SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
          md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295,
          list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
          lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
rb AS (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
       UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (SELECT conv_id, row_number() OVER w AS d, text, string_agg(md5(octet_length(encode(role)) || ':' || role || text), '') OVER w AS k
      FROM rb WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
m AS (SELECT conv_id, 0 AS d, '' AS k, NULL AS up, '' AS text FROM c
      UNION ALL SELECT conv_id, d, k, left(k, CAST(32 * (d - 1) AS INTEGER)), text FROM p),
l AS (SELECT conv_id, max(d) AS n FROM m GROUP BY conv_id),
node AS (SELECT k, max(d) AS depth, max(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                (count(*) - 1) * len(regexp_extract_all(max(text), '[^ 	-
]+')) AS own,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
         FROM m JOIN l USING (conv_id) GROUP BY k),
kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
sub AS (SELECT a.k, sum(b.own) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
        FROM node a JOIN node b ON starts_with(b.k, a.k) LEFT JOIN kids ON kids.up = b.k GROUP BY a.k)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN kids ON kids.up = node.k LEFT JOIN node par ON par.k = node.up"""


@query("op13_warc")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as archives and read back; repeated payloads are revisits."""
    from wattlane.llm.warc import chunk_records, read_archives, write_archives
    files = write_archives(chunk_records(table(spark, sf_dir, "pages")))
    return read_archives(files, with_data=False).where("last").select(
        F.col("id").alias("page_id"), F.col("upto").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE["op13_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(hex || '000', CAST((i * 5) // 4 + 1 AS INTEGER), 3) AS BIGINT) >> (7 - (i * 5) % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
          row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS n,
          max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to FROM b"""


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings on their first 8 principal components, whitened."""
    from wattlane.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
