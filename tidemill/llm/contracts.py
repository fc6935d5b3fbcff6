"""Columns and laws of the operators' queries that SQL can say where it can't say all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.language_id import op10_language_id
from tidemill.llm.mixing import op9_mixing
from tidemill.llm.sharding import op8_sharding
from tidemill.llm.token_counts import op2_token_counts
from tidemill.llm.url_filter import op6_url_filter

QUERIES, SQL = {}, {}


def contract(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return add


#: A table of CRC-32, from its polynomial, and the CRC of a list of bytes.
_CRC = """bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits)"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT)"


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"


@contract("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, t, k, length(parts[k]) + 1 AS n FROM d, unnest(range(1, len(parts) + CASE WHEN len(parts) > 1 AND parts[-1] = '' THEN 0 ELSE 1 END)) r(k)),
b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS start FROM s)
SELECT doc_id, 'text' AS field, (k - 1)::INTEGER AS section, start::BIGINT AS begin, least(start + n, length(t))::BIGINT AS "end" FROM b""")
def contract_token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_counts(spark, sf_dir).select("doc_id", "field", "section", "begin", "end")


@contract(r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(name, start, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, name || start AS rule, verdict FROM p JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN f USING (page_id)""")
def contract_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees' verdicts are left out."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


@contract(f"""WITH {_CRC}, d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, n, list_transform(range(1, length(h), 2), lambda k: (instr('0123456789ABCDEF', h[k]) - 1) * 16 + instr('0123456789ABCDEF', h[k + 1]) - 1) AS bytes FROM d)
SELECT doc_id, (n + 1)::BIGINT AS size, {_crc("bytes")}::BIGINT AS text_crc32, 'bytes' AS law, NULL::INTEGER AS grown_shard FROM b, crc""")
def contract_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sharding(spark, sf_dir).select("doc_id", "size", "text_crc32", "law", "grown_shard")


@contract("SELECT s AS shard, true AS gapless, true AS even, true AS together FROM range(16) t(s)")
def contract_shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each shard go from 0 without gaps; sizes differ by less than the largest group of equal texts; equal texts are together."""
    rows = op8_sharding(spark, sf_dir)
    groups = rows.groupBy("size", "text_crc32").agg(F.sum("size").alias("weight"), F.count_distinct("shard").alias("shards")).agg(F.max("weight").alias("weight"), F.max("shards").alias("most"))
    sums = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("least"), F.max("slot").alias("last"))
    spread = sums.agg((F.max("bytes") - F.min("bytes")).alias("spread"))
    return sums.join(F.broadcast(groups)).join(F.broadcast(spread)).select(
        F.col("shard").cast("long").alias("shard"), ((F.col("least") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), (F.col("spread") <= F.col("weight")).alias("even"), (F.col("most") == 1).alias("together")
    )


@contract(f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS n, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
-- The level at which the sources that are below their cap share what the capped ones leave.
levels AS (SELECT x.source, max((SELECT 1.5 * sum(n) FROM s) - coalesce((SELECT sum(2 * y.n) FROM s y WHERE 2 * y.n / y.w < 2 * x.n / x.w), 0)) / max((SELECT sum(w) FROM s z WHERE 2 * z.n / z.w >= 2 * x.n / x.w)) AS level FROM s x GROUP BY x.source),
best AS (SELECT max(level) AS level FROM levels)
SELECT doc_id, size, n AS source_size, round(least(2 * n, level * w)::DOUBLE, 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, best""")
def contract_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


@contract("SELECT DISTINCT source, true AS near, true AS whole FROM documents")
def contract_mix_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's taken words are off its target by half a document at most; a document is taken 0, 1 or 2 times."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rows = op9_mixing(spark, sf_dir).join(source, "doc_id")
    whole = (F.col("taken") == 0) | (F.col("taken") == F.col("size")) | (F.col("taken") == 2 * F.col("size"))
    sums = rows.groupBy("source").agg(F.abs(F.sum("taken") - F.max("target")).alias("off"), F.max("size").alias("most"), F.bool_and(whole).alias("whole"))
    return sums.select("source", (F.col("off") <= F.col("most") / 2 + 1e-6).alias("near"), "whole")


@contract(f"""WITH {_CRC} SELECT doc_id, {_crc("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k, 1))::BIGINT)")} % 4 = 2 AS held_out,
NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS unknown FROM documents, crc""")
def contract_language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"))
