"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_leaks
from .html_text import extract_text
from .licences import RULES, SENTENCES, scan_licences
from .mixture import pack_mixture
from .near_duplicates import near_duplicate_classes
from .packing import pack
from .repair import damaged, repaired_conversations
from .resampling import resample
from .secrets import fit_net, scan_secrets
from .sharding import shuffled_shards
from .topk import top_k
from .toxicity import fit_chain, score
from .url_filter import judge_urls

#: The url rules of op10: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of every toxicity category, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's five highest integer inner products among all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences, licences and unmatched sentences of each document that has any."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    joined = {c: F.concat_ws(",", c).alias(c) for c in ("sentence_ids", "licences", "unmatched")}
    return found.select("doc_id", *joined.values(), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best occurrence of each benchmark item in each document that holds it with few edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the class of near-duplicates that it is in."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; one row a piece."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the rules' findings, their digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit_net(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_net")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards by key."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    shards = shuffled_shards(table(spark, sf_dir, "documents"), key="doc_id", size=size)
    text = F.coalesce("row.text", F.lit(""))
    return shards.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by how much their words look like the benchmark's, and every document's score."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=25, min_words=20, seed=7)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows that each hold the sources' shares of all tokens; one row a piece."""
    return pack_mixture(table(spark, sf_dir, "documents"), with_ids=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    given = table(spark, sf_dir, "conversations")
    fixed = repaired_conversations(damaged(given)).withColumnRenamed("conv_id", "id")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(fixed, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_toxicity, op2_topk, op3_licences, op4_decontamination, op5_html_text, op6_near_duplicates, op7_packing, op8_secrets, op9_sharding, op10_url_filter,
        op11_resampling, op12_mixture_packing, op13_conversation_repair,
    )
    return {f.__name__: f for f in registered}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
    rest = "';' || array_to_string(ids, ';') || ';'"
    for licence, run in RULES:
        rest = f"replace(replace(replace({rest}, ';', ';;'), {_quoted(';' + ';;'.join(run) + ';')}, {_quoted(f';={licence};')}), ';;', ';')"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(lower(coalesce(text, '')), '\\n|[.!?:;]+(?:\\s+|$)') AS parts FROM documents),
each AS (SELECT doc_id, r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
ids AS (SELECT doc_id, r, list(id ORDER BY i) AS ids FROM each JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY doc_id, r),
items AS (SELECT doc_id, ids, list_filter(string_split({rest}, ';'), lambda x: x <> '') AS items FROM ids),
found AS (SELECT doc_id, ids, items, list_transform(list_filter(items, lambda x: x[1] = '='), lambda x: x[2:]) AS l FROM items)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licences,
  array_to_string(list_filter(items, lambda x: x[1] <> '='), ',') AS unmatched, len(ids)::BIGINT AS n_sentences
FROM found"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2]))::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
        "op3_licences": _licence_sql(),
        "op10_url_filter": f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT p.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
         FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE k = 1""",
    }
