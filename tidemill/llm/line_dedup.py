"""Lines that many sites share, found by distinct-site spread, go from all texts.

Texts are cut into lines once; hashes of these are written and read by what
follows. Lines with fewer occurrences than the threshold can't have as many
sites. Of the others, sites are counted for each line's hash by HyperLogLog
sketches that merge in the aggregation, so a line in every document costs a
sketch a task. Only lines whose estimate is near the threshold are counted
exactly. All of it is DataFrame functions. What lines are asked for is written
before it is joined: Spark then knows its size, sends it where it is small, and
else may split a join with a very common line. Texts meet their list of shared
lines by a join on the text's hash, which AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.staging import stage

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and how far off an estimate may be, as a share: over 9 standard errors.
LOG_REGISTERS, NEAR = 12, 0.15


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``lines(line, site)``, line being a hash, to the ``line`` of those with ``min_sites`` distinct sites or more."""
    lines = lines.where("site IS NOT NULL")
    often = stage(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"), "often")
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)))
    spread = stage(lines.join(often, "line", "left_semi").groupBy("line").agg(estimate.alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = stage(spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line"), "near")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return stage(spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("line").unionByName(exact.select("line")), "shared")


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, n_lines, n_removed, kept_text.

    Lines are what line feeds part. A line that has a character other than
    ASCII white space and occurs, exactly as it is, in texts of ``min_sites``
    distinct sites or more goes from every text; others stay in order. A null
    site counts for no line, but its texts lose lines too. A null text has no
    lines and stays null; an empty one has one line, which stays. Ids are only
    passed on. Other columns aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    parts = F.split("text", "\n", -1)
    blank = r"^[\x20\x09-\x0D]*$"
    lines = rows.select(_hash(F.col("text")).alias("whole"), "site", F.explode(F.transform(F.filter(parts, lambda x: ~x.rlike(blank)), _hash)).alias("line"))
    lines = stage(lines, "lines")
    shared = lines.select("whole", "line").join(spread_lines(lines.select("line", "site"), min_sites), "line", "left_semi")
    gone = stage(shared.groupBy("whole").agg(F.collect_set("line").alias("gone")), "gone")
    met = rows.withColumn("whole", _hash(F.col("text"))).join(gone, "whole", "left")
    kept = F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.array_contains("gone", _hash(x))))
    sized = met.select(F.col("id").alias(id_col), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), "text", kept.alias("kept"))
    return sized.select(id_col, F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_spread_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
shared AS (SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
every AS (SELECT list(line) AS l FROM shared),
kept AS (SELECT doc_id, string_split(text, chr(10)) AS parts,
         list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(l, x), false)) AS stay FROM documents, every)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(stay), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256
FROM kept
"""
