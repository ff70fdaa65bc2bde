"""The registered queries of the operators here, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import chat, decontam, langid, mixing, quality, secrets, simhash, suffix, topk, warc
from quernstone.llm.common import table

#: Shares of all tokens that op7_mixing and the pipeline aim at.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select(*quality.columns(docs))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal("f").alias("fingerprint"), "component_id")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(suffix.deduplicated(table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labelled = mixing.vetted(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, TARGETS, keep=["doc_id"])


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.report(decontam.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("captured", 1_704_067_200 + F.col("page_id"))
    folder = warc.new_folder(spark)
    warc.write_archives(pages, folder)
    history = warc.histories(warc.read_archives(spark, folder))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_suffix": op5_suffix,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_decontam": op8_decontam,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
}

def secrets_sql() -> str:
    """Matches and the pieces between them alternate; a run of fixed least length is written as such."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        if r.group == 0 and r.least > 1:
            pattern = f"{pattern[:-1]}{{{r.least - len(secrets.strings_head(r.pattern))},}}"
        least = r.least if r.group else 0
        parts.append(f"SELECT row, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS j, regexp_split_to_array(t, '{pattern}') AS g, {least} AS least FROM d")
    base = len(secrets.BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT row, k, kind, m[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f) WHERE length(j[i]) >= least),
n AS (SELECT *, kind || ':' || a || ':' || (a + length(hit)) AS said FROM s)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY a, k) FILTER (k < {base}), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN n USING (row) GROUP BY row, doc_id"""


ORACLE_SQL = {
    "op9_secrets": secrets_sql(),
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS hex, max(page_id) OVER (PARTITION BY b) AS last FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS v FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM v""",
    "op1_topk": """
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))) AS v FROM kept GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_chat": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*){chat.ANGLE}', '<\\\1\2', 'g'), '\[(\\*){chat.SQUARE}', '[\\\1\2', 'g') AS esc,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
g AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY n) OR n = 1 AS opens FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN opens THEN length(role) + {len(chat.START + chat.SEP + chat.END)} ELSE {len(chat.TURN)} END) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id""",
}
