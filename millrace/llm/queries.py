"""The registered queries of the corpus operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import spread, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lines import line_groups

    return line_groups(table(spark, sf_dir, "documents"), min_chars=1)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.minhash import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")), words=4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import quality_report

    return quality_report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents")), digests=True)


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.media import media_report

    return media_report(spread(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secrets import secret_report

    return secret_report(spread(table(spark, sf_dir, "documents")))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import archive_report

    return archive_report(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_minhash_join": op3_minhash_join,
    "op4_quality": op4_quality,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_media_chunks": op6_media_chunks,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc_index": op8_warc_index,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
}

# Components in SQL: every node with every node that links lead to from it, smaller ones only; the least one counts.
_COMPONENTS = """reach(a, b) AS (
  SELECT id, id FROM node
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """WITH RECURSIVE line AS (
  SELECT doc_id, CAST(n - 1 AS INT) AS line_no, lower(trim(parts[n], ' ')) AS norm
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE length(trim(parts[n], ' ')) >= 1),
own AS (SELECT norm, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM line GROUP BY norm),
node AS (SELECT id FROM own),
gram AS (SELECT DISTINCT id, substr(norm, CAST(i AS INT), 10) AS g FROM (SELECT id, norm, unnest(range(1, greatest(length(norm) - 8, 2))) AS i FROM own)),
size AS (SELECT id, count(*) AS n FROM gram GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
pair AS (SELECT a, b FROM common JOIN size s ON s.id = a JOIN size t ON t.id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
"""
    + _COMPONENTS
    + """, placed AS (SELECT doc_id, line_no, component_id FROM line JOIN own USING (norm) JOIN component USING (id)),
first AS (SELECT component_id, min((doc_id, line_no)) AS f, count(*) AS group_lines FROM placed GROUP BY component_id)
SELECT doc_id, line_no, f[1] AS first_doc_id, f[2] AS first_line_no, group_lines, (doc_id, line_no) = f AS kept FROM placed JOIN first USING (component_id)""",
    "op2_embedding_dedup": """WITH RECURSIVE vec AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
node AS (SELECT vec_id AS id FROM embeddings),
link AS (SELECT x.id AS a, y.id AS b FROM vec x JOIN vec y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
"""
    + _COMPONENTS
    + """SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component""",
    "op3_minhash_join": """WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
node AS (SELECT doc_id AS id FROM word),
gram AS (
  SELECT DISTINCT doc_id AS id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT id, count(*) AS n FROM gram GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
pair AS (SELECT a, b FROM common JOIN size s ON s.id = a JOIN size t ON t.id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
"""
    + _COMPONENTS
    + """SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM component LEFT JOIN size USING (id)""",
    "op8_warc_index": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
