"""Queries for arguments and side ways of the operators, each with its SQL."""

from __future__ import annotations

import io
import uuid
import wave
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.functions import items, names
from tidemill.operators import appropriate, neighbors, sentiment
from tidemill.operators.dedup import deduplicate
from tidemill.operators.weights import apply_weights
from tidemill.queries import _BALANCE, _CASE, _EMAIL_PHONE, _EVENT_GROUPS, _JUDGED, _SEGMENTS, SQL, _closure, _holes, _judged, _people, query, read
from tidemill.sources import files
from tidemill.staging import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemill/files-{uuid.uuid4().hex}"


# --- de-duplication


@query(f"{_EVENT_GROUPS}, r AS (SELECT *, dense_rank() OVER (ORDER BY head) - 1 AS gid FROM g) SELECT event_id FROM r QUALIFY row_number() OVER (PARTITION BY gid, event_type ORDER BY event_id) = 1")
def dedup_aliases(spark, sf):
    return deduplicate(read(spark, sf, "events"), cols="event_type", by="user_id", mode="w", action="rm", keep="head", order_by="event_id").select("event_id")


_IN_SEGMENTS = "SELECT c_custkey, c_mktsegment || 'e' || email AS key FROM people WHERE email IS NOT NULL UNION ALL SELECT c_custkey, c_mktsegment || 'p' || phone FROM people"


@query(_closure(_IN_SEGMENTS, "SELECT c_custkey, row_number() OVER (PARTITION BY head ORDER BY c_custkey DESC) > 1 AS is_duplicate FROM comp JOIN people USING (c_custkey)"))
def dedup_entity_in_groups(spark, sf):
    return deduplicate(_people(spark, sf), entity_by="email phone", group_by="c_mktsegment", pick="last", action="mark", order_by="c_custkey").select("c_custkey", "is_duplicate")


@query(_closure(_EMAIL_PHONE, "SELECT c_custkey, dense_rank() OVER (ORDER BY head) - 1 AS entity_id FROM comp"))
def dedup_entity_auto(spark, sf):
    return deduplicate(_people(spark, sf), entity_by=True, action="flag", order_by="c_custkey", group_id_column="entity_id").select("c_custkey", "entity_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def dedup_entity_off(spark, sf):
    return deduplicate(read(spark, sf, "documents"), on="source", entity_by=False, order_by="doc_id", keep_order=True).select("doc_id", "source")


@query("SELECT source, 1::BIGINT AS kept, true AS own FROM documents GROUP BY source")
def dedup_random(spark, sf):
    """Of each source one row, which is a row of that source."""
    d = read(spark, sf, "documents")
    kept = deduplicate(d, on="source", pick="rand", random_state=7, order_by="doc_id").select("doc_id", "source")
    return kept.join(d.select("doc_id", F.col("source").alias("known")), "doc_id").groupBy("source").agg(F.count("*").alias("kept"), F.bool_and(F.col("source").eqNullSafe(F.col("known"))).alias("own"))


# --- weights


@query(f"SELECT c_custkey, c_acctbal * ({_CASE}) AS c_acctbal_w FROM customer")
def weights_callables(spark, sf):
    return apply_weights(read(spark, sf, "customer"), {"c_mktsegment": _SEGMENTS}, columns_to_weight=lambda df: ["c_acctbal"], new_column_names=lambda c: f"{c}_w").select("c_custkey", "c_acctbal_w")


@query(f"SELECT c_custkey, c_acctbal * ({_CASE}) AS value FROM customer")
def weights_named(spark, sf):
    return apply_weights(read(spark, sf, "customer"), {"c_mktsegment": _SEGMENTS}, columns_to_weight=["c_acctbal"], new_column_names={"c_acctbal": "value"}).select("c_custkey", "value")


@query(f"WITH {_BALANCE}, f AS (SELECT c_custkey, coalesce(bal, 10) AS bal, coalesce(seg, 'BUILDING') AS seg FROM customer_) SELECT c_custkey, bal * ({_CASE.replace('c_mktsegment', 'seg')}) AS bal_weighted FROM f")
def weights_fill_map(spark, sf):
    return apply_weights(_holes(spark, sf), {"seg": _SEGMENTS}, columns_to_weight="bal", handle_na="fill", fill_values={"bal": 10.0, "seg": "BUILDING"}).select("c_custkey", "bal_weighted")


@query(f"WITH {_BALANCE} SELECT c_custkey, bal * coalesce({_CASE.replace('c_mktsegment', 'seg')}, 1::DOUBLE) AS bal_weighted FROM customer_ WHERE bal IS NOT NULL")
def weights_subset(spark, sf):
    return apply_weights(_holes(spark, sf), {"seg": _SEGMENTS}, columns_to_weight="bal", handle_na="drop", na_subset=["bal"]).select("c_custkey", "bal_weighted")


@query("SELECT 'levels without a weight: ' || string_agg('''' || l || ''' of ''c_mktsegment''', ', ' ORDER BY l) AS problem FROM (SELECT DISTINCT c_mktsegment AS l FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE'))")
def weights_unknown_levels(spark, sf):
    try:
        apply_weights(read(spark, sf, "customer"), {"c_mktsegment": {"BUILDING": 1.0, "FURNITURE": 2.0}}, columns_to_weight="c_acctbal")
        problem = None
    except ValueError as e:
        problem = str(e)
    return spark.createDataFrame([(problem,)], "problem string")


# --- names

_DIGITS = "zero one two three four five six seven eight nine".split()


def _spelled(n: int) -> str:
    return " ".join(_DIGITS[int(c)] for c in str(n))


def _brands(spark, sf, **options) -> DataFrame:
    return names.clean_names_table(read(spark, sf, "part").select("p_brand").distinct(), "p_brand", **options)


_BRANDS = "WITH b AS (SELECT DISTINCT p_brand AS original, regexp_extract(p_brand, '[0-9]+$') AS digits FROM part)"
_SPELL = "trim(" + "".join("replace(" for _ in _DIGITS) + "digits" + "".join(f", '{k}', '{w}_')" for k, w in enumerate(_DIGITS)) + ", '_')"


@query(f"{_BRANDS} SELECT original, 'brand_number_' || digits AS renamed FROM b")
def names_unspelled(spark, sf):
    return _brands(spark, sf, use_make_names=False)


@query(f"{_BRANDS} SELECT original, 'brand_hash_' || digits AS renamed FROM b")
def names_replace(spark, sf):
    return _brands(spark, sf, replace={"#": " hash ", "Brand": "brand"})


@query(f"{_BRANDS} SELECT original, 'brand_x' || digits AS renamed FROM b")
def names_replace_regex(spark, sf):
    return _brands(spark, sf, replace={r"[#]+(\d)": r"_x\1", "^B": "b"}, replace_regex=True, case="l")


@query(f"{_BRANDS} SELECT DISTINCT original, 'brand_number' AS renamed FROM b")
def names_without_numerals(spark, sf):
    return _brands(spark, sf, numerals="rm")


@query(f"{_BRANDS} SELECT original, 'brand_number_' || {_SPELL} AS renamed FROM b")
def names_spelled(spark, sf):
    return _brands(spark, sf, numerals="words", speller=_spelled)


@query(f"{_BRANDS} SELECT original, 'Brand.' || digits || '.' || 'X' AS renamed FROM b")
def names_separators(spark, sf):
    part = read(spark, sf, "part").select("p_brand").distinct()
    return part.select(F.col("p_brand").alias("original"), names.clean_name(F.concat("p_brand", F.lit("::x")), replace={}, sep_in=["#", "::"], case="pc").alias("renamed"))


@query(f"{_BRANDS} SELECT original, 'brandnumber' || digits AS renamed FROM b")
def names_old(spark, sf):
    return _brands(spark, sf, case="old_janitor")


@query("SELECT DISTINCT source AS original, 'alphabhtaps' || coalesce(source, '') AS renamed FROM documents WHERE source IS NOT NULL")
def names_greek(spark, sf):
    d = read(spark, sf, "documents").where("source IS NOT NULL").select("source").distinct()
    return d.select(F.col("source").alias("original"), names.clean_name(F.concat(F.lit("αlphaβήταψ"), "source"), transliterations="greek,ascii").alias("renamed"))


@query("SELECT DISTINCT source AS original, 'é' || lower(source) AS renamed FROM documents WHERE source IS NOT NULL")
def names_untouched(spark, sf):
    d = read(spark, sf, "documents").where("source IS NOT NULL").select("source").distinct()
    return d.select(F.col("source").alias("original"), names.clean_name(F.concat(F.lit("é"), "source"), transliterate=False, use_make_names=False, parsing_option=0, case="lower").alias("renamed"))


@query(r"SELECT ch AS character, count(DISTINCT doc_id)::BIGINT AS rows FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE regexp_matches(ch, '[^\x00-\x7F]') GROUP BY ch")
def names_left_over(spark, sf):
    return names.left_over(read(spark, sf, "documents"), "text")


# --- items


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type)]))) AS item FROM part WHERE p_partkey % 5 != 0)
SELECT item, count(*)::BIGINT AS "rows", (count(*)::DOUBLE / (SELECT count(DISTINCT p_partkey) FROM w))::FLOAT AS freq FROM w GROUP BY item""")
def items_arrays(spark, sf):
    """Items in arrays; rows whose cells are null or have nothing but amounts don't count."""
    part = read(spark, sf, "part")
    some = F.when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("array<string>")).when(F.col("p_partkey") % 5 == 0, F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("2 cups")))
    return items.document_frequency(part.select(F.coalesce(some, F.when(F.col("p_partkey") % 5 != 0, F.array(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(None).cast("string"), "p_type"))).alias("cell")), "cell")


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct([lower(p_type), string_split(p_name, ' ')[1]])) AS item FROM part)
SELECT item, count(*)::BIGINT AS "rows", (count(*)::DOUBLE / (SELECT count(*) FROM part))::FLOAT AS freq FROM w GROUP BY item""")
def items_maps(spark, sf):
    return items.document_frequency(read(spark, sf, "part").select(F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.element_at(F.split("p_name", " "), 1)).alias("cell")), "cell")


@query("SELECT p_partkey, list_distinct(string_split(p_name, ' '))[k] AS item FROM part, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE list_distinct(string_split(p_name, ' '))[k] IS NOT NULL")
def items_split(spark, sf):
    text = F.concat(F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit(" / ")), F.lit("|\n"), F.element_at(F.split("p_name", " "), 1), F.lit(";;"))
    return read(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(items.split_items(text))).alias("item"))


# --- neighbours and decisions

_LOF = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), size AS (SELECT count(*) AS n, least(least(20, greatest(5, count(*) // 20)), count(*) - 1) AS k FROM e),
own AS (SELECT a.vec_id AS q, b.vec_id AS i, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id != b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, {tie}) <= (SELECT k FROM size)),
far AS (SELECT q AS i, max(d) AS far FROM own GROUP BY q),
dense AS (SELECT q, 1 / (avg(greatest(far, d)) + 1e-10) AS density FROM own JOIN far USING (i) GROUP BY q),
trained AS (SELECT own.q, avg(o.density) / any_value(m.density) AS lof FROM own JOIN dense o ON o.q = own.i JOIN dense m ON m.q = own.q GROUP BY own.q),
bound AS (SELECT quantile_cont(lof, 0.95) AS bound FROM trained)"""


@query("WITH " + _LOF.format(tie="b.vec_id") + " SELECT q AS vec_id, round(lof, 6) AS lof, lof > bound AS outlier FROM trained, bound")
def lof_outlier(spark, sf):
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return neighbors.outlier_factors(vectors).select(F.col("query").alias("vec_id"), F.round("lof", 6).alias("lof"), "outlier")


_SPELT = "translate({}::VARCHAR, '0123456789', 'abcdefghij')"
_TURNED = "list_transform(embedding, lambda x, i: CASE WHEN (i - 1) * 8 < len(embedding) * (vec_id // 50 % 4) THEN -x ELSE x END)"
#: Known items and turned vectors, judged by neighbours, frequencies and outlier factors.
_SIMILAR = f"""WITH {_LOF.format(tie=_SPELT.format("b.vec_id"))},
known AS (SELECT vec_id, 'x' || {_SPELT.format("vec_id")} AS item, (((vec_id % 16) + 1)::DOUBLE / 100)::FLOAT::DOUBLE AS freq, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT 'x' || {_SPELT.format("vec_id")} AS item, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL SELECT 'y' || {_SPELT.format("vec_id")}, ({_TURNED})::DOUBLE[] FROM embeddings WHERE vec_id % 50 = 0),
like_ AS (SELECT a.item AS q, k.vec_id AS i, k.item, k.freq, list_cosine_similarity(a.v, k.v) AS sim FROM asked a, known k),
around AS (SELECT q, i, 1 - sim AS d FROM like_ QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, item) <= (SELECT k FROM size)),
dens AS (SELECT q, 1 / (avg(greatest(far, d)) + 1e-10) AS density FROM around JOIN far USING (i) GROUP BY q),
odd AS (SELECT around.q, avg(o.density) / any_value(m.density) > any_value(bound) AS outlier FROM around JOIN dense o ON o.q = around.i JOIN dens m ON m.q = around.q, bound GROUP BY around.q),
near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, item) AS r FROM like_ WHERE q != item),
listed AS (SELECT q, string_agg(item, ' ' ORDER BY r) AS neighbors FROM near WHERE r <= 5 GROUP BY q),
j AS (SELECT a.item, k.item IS NOT NULL AS exact, coalesce(k.freq, n.freq) AS f, CASE WHEN k.item IS NOT NULL THEN 1.0::DOUBLE ELSE n.sim END AS s, n.item AS best, coalesce(k.item, n.item) AS best_match, outlier, neighbors
      FROM asked a LEFT JOIN known k ON k.item = a.item JOIN near n ON n.q = a.item AND n.r = 1 JOIN odd ON odd.q = a.item JOIN listed ON listed.q = a.item),
c AS (SELECT *, greatest(0, least(1, s)) AS cs, (f >= 0.04::DOUBLE AND (exact OR s >= 0.56::DOUBLE) AND NOT outlier) AS yes FROM j)
SELECT item, CASE WHEN yes THEN 'Appropriate' ELSE 'Inappropriate' END AS decision,
  round((0.8 * cs + 0.2 * least(1, ln(1 + f * 10) / ln(11))) * CASE WHEN f < 0.04::DOUBLE THEN 0.25 + 0.75 * f / 0.04 ELSE 1 END * CASE WHEN outlier THEN 0.7 ELSE 1 END, 6)::DOUBLE AS score,
  CASE WHEN exact AND f < 0.04::DOUBLE THEN 'exact match; too uncommon' WHEN exact AND outlier THEN 'embedding outlier vs reference set (exact match)' WHEN exact THEN 'exact match; passes thresholds'
    WHEN s < 0.56::DOUBLE THEN printf('low similarity to known items (best=%s, sim=%.3f)', best, s) WHEN f < 0.04::DOUBLE THEN printf('too uncommon in dataset (best=%s, freq=%.3f)', best, f)
    WHEN outlier THEN 'embedding outlier vs reference set' ELSE printf('similar to ''%s'' (sim=%.3f, freq=%.3f)', best, s, f) END AS reason,
  best_match, round(s, 6) AS best_similarity, outlier, neighbors FROM c"""


SQL["appropriate_similar"] = _SIMILAR


@query(f"""{_JUDGED}, s AS (SELECT item, freq, CASE WHEN freq IS NULL THEN 0 ELSE 0.8 + 0.2 * least(1, ln(1 + freq * 10) / ln(11)) END * CASE WHEN freq < 0.04::DOUBLE THEN 0.25 + 0.75 * freq / 0.04 ELSE 1 END AS score FROM j)
SELECT item || ': ' || CASE WHEN freq >= 0.04::DOUBLE THEN 'Appropriate' ELSE 'Inappropriate' END || printf(' (score=%.3f) — ', coalesce(score, 0)::DOUBLE)
  || CASE WHEN freq IS NULL THEN 'embedding model unavailable; cannot evaluate non-exact item' WHEN freq < 0.04::DOUBLE THEN 'exact match; too uncommon' ELSE 'exact match; passes thresholds' END AS line FROM s""")
def appropriate_report(spark, sf):
    return appropriate.report(_judged(spark, sf))


@query(f"{_JUDGED} SELECT item, CASE WHEN freq >= 0.04::DOUBLE THEN 'Appropriate' ELSE 'Inappropriate' END AS decision, item IS NOT NULL AS whole FROM j")
def appropriate_lines(spark, sf):
    lines = appropriate.json_lines(_judged(spark, sf))
    return lines.select(F.get_json_object("line", "$.item").alias("item"), F.get_json_object("line", "$.decision").alias("decision"), (F.json_array_length(F.json_object_keys("line").cast("string")).isNull() & (F.size(F.json_object_keys("line")) == 11)).alias("whole"))


@query(f"""{_JUDGED}, s AS (SELECT item, freq, freq >= 0.04::DOUBLE AS fine, length(item)::DOUBLE / 10 AS p, CASE WHEN freq IS NULL THEN 0 ELSE 0.8 + 0.2 * least(1, ln(1 + freq * 10) / ln(11)) END * CASE WHEN freq < 0.04::DOUBLE THEN 0.25 + 0.75 * freq / 0.04 ELSE 1 END AS score FROM j)
SELECT item, CASE WHEN fine AND p >= 0.45::DOUBLE THEN 'Appropriate' ELSE 'Inappropriate' END AS decision, CASE WHEN fine THEN p END AS llm_p, round(CASE WHEN fine AND p < 0.45::DOUBLE THEN least(score, p) ELSE coalesce(score, 0) END::DOUBLE, 6) AS score,
  CASE WHEN fine AND p < 0.45::DOUBLE THEN 'LLM veto: short' END AS veto FROM s""")
def appropriate_veto(spark, sf):
    wary = appropriate.replace(appropriate.PRESETS["normal"], llm_enabled=True, llm_min_p=0.45)
    part = read(spark, sf, "part")
    index = appropriate.build_index(part.select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("p_name")), "p_name")
    words = part.select(F.element_at(F.split("p_name", " "), 1).alias("item")).distinct().unionByName(read(spark, sf, "region").select(F.col("r_name").alias("item")))
    out = appropriate.evaluate(words, index, wary, scorer=lambda item: (len(item) / 10, "short"))
    return out.select("item", "decision", "llm_p", F.round("score", 6).alias("score"), F.when(F.col("reason").startswith("LLM veto"), F.col("reason")).alias("veto"))


@query("SELECT event_id, 'Inappropriate' AS decision, 0::DOUBLE AS score, 'empty/invalid input' AS reason FROM events")
def appropriate_void(spark, sf):
    index = spark.createDataFrame([("salt", 0.5), ("pepper", 0.5)], "item string, freq float")
    asked = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit(" cups"))).alias("item"))
    names_ = asked.select("item").distinct()
    judged = appropriate.evaluate(names_, index, appropriate.PRESETS["strict"]).select(F.col("item").alias("known"), "decision", "score", "reason")
    return asked.join(judged, F.col("item").eqNullSafe(F.col("known"))).select("event_id", "decision", "score", "reason")


@query("""WITH n AS (SELECT count(*) AS n FROM part), p(preset, s, f) AS (VALUES ('strict', 0.62::DOUBLE, 0.08::DOUBLE), ('normal', 0.56::DOUBLE, 0.04::DOUBLE), ('lenient', 0.52::DOUBLE, 0.01::DOUBLE)), floors(floor) AS (VALUES (0.3::DOUBLE), (0.56::DOUBLE), (0.9::DOUBLE))
SELECT preset, floor, round(least(s + 0.05, greatest(s - 0.05, floor)), 6)::DOUBLE AS min_sim, round(least(f + 0.06, greatest(f - 0.02, least(0.1, greatest(0.01, 2 / n::DOUBLE)))), 6)::DOUBLE AS min_freq FROM p, floors, n""")
def appropriate_thresholds(spark, sf):
    used = items.row_counts(read(spark, sf, "part"), "p_name").first()["rows_used"]
    rows = [(name, floor, appropriate.suggest(used, floor, t)) for name, t in appropriate.PRESETS.items() for floor in (0.3, 0.56, 0.9)]
    return spark.createDataFrame([(a, b, round(t.min_sim, 6), round(t.min_freq, 6)) for a, b, t in rows], "preset string, floor double, min_sim double, min_freq double")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1, greatest(0, k / 100)) WHEN 1 THEN least(1, greatest(0, k / 100)) WHEN 2 THEN 0.25 END::DOUBLE AS p,
CASE event_id % 4 WHEN 0 THEN 'fenced' WHEN 1 THEN '' WHEN 2 THEN 'LLM parsing fallback' END AS reason FROM (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events)""")
def llm_replies(spark, sf):
    k = (F.from_json("props", "k double")["k"] / 100).cast("string")
    kinds = [F.concat(F.lit('```json\n{"p": '), k, F.lit(', "reason": " fenced "}\n```')), F.concat(F.lit('{"p": '), k, F.lit("}")), F.lit("probability 0.25, not 25"), F.lit("no idea")]
    reply = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", appropriate.parse_replies(reply).alias("said")).select("event_id", "said.p", "said.reason")


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part)
SELECT item, (count(*)::DOUBLE / (SELECT count(*) FROM part))::FLOAT AS freq, 25::INTEGER AS n_neighbors FROM w GROUP BY item""")
def index_round_trip(spark, sf):
    path = _folder(spark)
    appropriate.save_index(appropriate.build_index(read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("p_name")), "p_name"), path)
    index, k = appropriate.load_index(spark, path)
    return index.withColumn("n_neighbors", F.lit(k).cast("int"))


@query("SELECT 'fewer than two unique items' AS few, 'not an index: 25 items, 25 different, 5 with a wrong item or frequency, 10 neighbours' AS wrong, 'not an index: lengths from 1 to 2' AS uneven WHERE (SELECT count(*) FROM nation) = 25")
def index_problems(spark, sf):
    nation = read(spark, sf, "nation")

    def problem(call, *args) -> str | None:
        try:
            call(*args)
        except ValueError as e:
            return str(e)

    frame = nation.select(F.lower("n_name").alias("item"), F.when(F.col("n_regionkey") == 0, 2.0).otherwise(0.5).alias("freq"))
    uneven = frame.withColumn("freq", F.lit(0.5)).withColumn("embedding", F.when(F.col("item").endswith("1"), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    rows = [(problem(appropriate.build_index, nation.where("n_nationkey = 0"), "n_name"), problem(appropriate.check_index, frame, 10), problem(appropriate.check_index, uneven, 10))]
    return spark.createDataFrame(rows, "few string, wrong string, uneven string")


# --- sentiment

_MOODS = {"the": "happy", "of": "Sad,", "de": "furious!", "la": "calm"}
_MOOD_WORDS = "WITH w AS (SELECT conv_id * 1000 + turn AS text_index, unnest(string_split_regex(text, '\\s+')) AS word FROM conversations), m AS (SELECT text_index, CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MOODS.items()) + " ELSE word END AS word FROM w WHERE word != '')"


@query(f"{_MOOD_WORDS} SELECT text_index, word, CASE word WHEN 'happy' THEN 'joy' WHEN 'Sad,' THEN 'sadness' WHEN 'furious!' THEN 'anger' WHEN 'calm' THEN 'peace' END AS emotion FROM m")
def sentiment_emotions(spark, sf):
    words = F.transform(F.split("text", r"\s+"), lambda w: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _MOODS.items() for x in kv)), w), w))
    talks = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(words, "\n").alias("text"))
    return sentiment.detect(talks, ["text"], id_col="id").select("text_index", "word", "emotion")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS text_index, 'role' AS source_column, role AS text FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 'text', text FROM conversations),
w AS (SELECT text_index, source_column, (length(text) % 7)::DOUBLE / 7 AS overall_sentiment, unnest(string_split_regex(text, '\\s+')) AS word FROM t)
SELECT text_index, source_column, round(overall_sentiment, 6) AS overall_sentiment, count(*)::BIGINT AS words FROM w WHERE word != '' GROUP BY ALL""")
def sentiment_texts(spark, sf):
    talks = read(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    out = sentiment.detect(talks, ["role", "text"], text_model=lambda c: (F.length(c) % 7).cast("double") / 7, id_col="id")
    return out.groupBy("text_index", "source_column", F.round("overall_sentiment", 6).alias("overall_sentiment")).agg(F.count("*").alias("words"))


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS n, unnest(string_split_regex(role || ' x', '\\s+')) AS word FROM conversations)
SELECT (n // 32) * 32 AS text_index, count(*)::BIGINT AS words FROM w WHERE word != '' GROUP BY 1""")
def sentiment_batches(spark, sf):
    talks = read(spark, sf, "conversations").select(F.concat("role", F.lit(" x")).alias("text"))
    return sentiment.detect(talks, ["text"], batch=32).groupBy("text_index").agg(F.count("*").alias("words"))


@query(f"{_MOOD_WORDS} SELECT text_index, word, (length(word) % 3 - 1)::DOUBLE AS sentiment_score, CASE length(word) % 3 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS sentiment_category FROM m WHERE word IN ('happy', 'calm')")
def sentiment_model(spark, sf):
    words = F.filter(F.transform(F.split("text", r"\s+"), lambda w: F.try_element_at(F.create_map(*(F.lit(x) for kv in _MOODS.items() for x in kv)), w)), lambda w: w.isin("happy", "calm"))
    talks = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(words, " ").alias("text"))
    return sentiment.detect(talks, ["text"], word_model=lambda c: (F.length(c) % 3 - 1).cast("double"), id_col="id").select("text_index", "word", "sentiment_score", "sentiment_category")


@query("SELECT text_index, word, sentiment_score FROM (SELECT 0::BIGINT AS text_index, '' AS word, 0::DOUBLE AS sentiment_score) WHERE false")
def sentiment_empty(spark, sf):
    talks = read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.when(F.col("turn") % 2 == 0, F.lit(" \n")).alias("text"))
    return sentiment.detect(talks, ["text"], id_col="id").select("text_index", "word", "sentiment_score")


# --- files


def _clock(seconds: str) -> str:
    return f"lpad((({seconds}) // 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad((({seconds}) % 60)::BIGINT::VARCHAR, 2, '0')"


@query(f"SELECT n_nationkey::BIGINT AS n_nationkey, {_clock('(n_nationkey + 1) * 7')} AS duration FROM nation")
def wave_durations(spark, sf):
    """Bytes of WAV files, and their lengths."""

    def sounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for k in rows["n_nationkey"]:
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(1), w.setframerate(10), w.writeframes(b"\0" * (70 * (int(k) + 1)))
                made.append(held.getvalue())
            yield rows.assign(content=made)

    made = read(spark, sf, "nation").select("n_nationkey").mapInPandas(sounds, "n_nationkey long, content binary")
    return made.select("n_nationkey", files.clock(files.wave_seconds(F.col("content"))).alias("duration"))


@query("SELECT n_regionkey::INTEGER AS n_regionkey, 'tables' AS Level_1, 'folder' AS Level_1_type, 'n_regionkey=' || n_regionkey AS Level_2, '.json' AS Level_3_type, '' AS Duration FROM (SELECT DISTINCT n_regionkey FROM nation)")
def listing_levels(spark, sf):
    """Files in folders, as a table as wide as the deepest path."""
    path = f"{_folder(spark)}/tables"
    read(spark, sf, "nation").repartition(1).write.partitionBy("n_regionkey").json(path)
    wide = files.widen(files.media_table(spark, path))
    files.save_csv(wide, f"{path}-listing")
    wide = cli.read_csv(spark, f"{path}-listing")
    return wide.select(F.regexp_extract("Level_2", r"\d+", 0).cast("int").alias("n_regionkey"), "Level_1", "Level_1_type", "Level_2", "Level_3_type", F.coalesce("Duration", F.lit("")).alias("Duration"))


def _paths(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, [".zip", ".rar", "_BACKUP.zip", ".MP3", ".tar.gz", ""])), (key % 6 + 1).cast("int"))
    head = F.when(key % 7 == 0, "Temp").otherwise("a")
    return read(spark, sf, "part").select("p_partkey", F.concat(F.lit("/lib/"), F.when(key % 5 == 0, "Old Things").otherwise("new"), F.lit("/"), head, key.cast("string"), kind).alias("path"))


_PATHS = """p AS (SELECT p_partkey, '/lib/' || CASE WHEN p_partkey % 5 = 0 THEN 'Old Things' ELSE 'new' END AS folder, CASE WHEN p_partkey % 7 = 0 THEN 'Temp' ELSE 'a' END || p_partkey AS stem,
  (['.zip', '.rar', '_BACKUP.zip', '.MP3', '.tar.gz', ''])[p_partkey % 6 + 1] AS kind FROM part)"""


@query(f"WITH {_PATHS} SELECT p_partkey, p_partkey % 6 IN (0, 1) AND p_partkey % 7 != 0 AND p_partkey % 5 != 0 AND p_partkey NOT IN (6, 7) AS wanted, p_partkey % 6 = 3 AS media FROM p")
def archive_rules(spark, sf):
    """Archives by suffix, without names that are excluded, temporary ones, backups and folders."""
    path = F.col("path")
    return _paths(spark, sf).select("p_partkey", files.wanted_archive(path, ["a6.zip", "a7.rar"], ["old things"]).alias("wanted"), files.media(path).alias("media"))


@query(f"""WITH {_PATHS}, n AS (SELECT *, stem || kind AS name, CASE WHEN kind IN ('', '.tar.gz') THEN stem || replace(kind, '.gz', '') ELSE stem || replace(kind, '.' || split_part(kind, '.', -1), '') END AS base, CASE kind WHEN '' THEN '' ELSE '.' || split_part(kind, '.', -1) END AS tail FROM p)
SELECT p_partkey, folder || '/' || base || '/' || CASE WHEN p_partkey % 4 = 0 THEN base || CASE WHEN p_partkey % 8 = 0 THEN '_2' ELSE '_1' END || tail ELSE name END AS destination FROM n""")
def move_plan(spark, sf):
    """Some destinations are there, some with _1 too."""
    wanted = files.plan_moves(_paths(spark, sf)).join(_paths(spark, sf), "path")
    numbered = F.regexp_replace("destination", r"(\.[^./]+)?$", "_1$1")
    numbered = F.when(F.col("destination").rlike(r"\.[^./]+$"), F.regexp_replace("destination", r"(\.[^./]+)$", "_1$1")).otherwise(F.concat("destination", F.lit("_1")))
    there = wanted.where("p_partkey % 4 = 0").select(F.col("destination").alias("path")).unionByName(wanted.where("p_partkey % 8 = 0").select(numbered.alias("path")))
    return files.plan_moves(_paths(spark, sf), there).join(_paths(spark, sf), "path").select("p_partkey", "destination")


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()


@query("""SELECT 'r' || n_regionkey || '.zip' AS archive, n_name || '.txt' AS entry, length(n_name)::BIGINT AS length, 'ok' AS status FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey || '.zip', 'in.zip', NULL, 'ok' FROM nation
UNION ALL SELECT DISTINCT 'in.zip', 'deep' || n_regionkey || '.txt', 4, 'ok' FROM nation UNION ALL SELECT 'bad.zip', NULL, NULL, 'quarantine' """)
def archive_listing(spark, sf):
    """Archives in archives, and one that can't be read."""
    path = _folder(spark)
    for r, rows in pd.DataFrame([tuple(r) for r in read(spark, sf, "nation").select("n_regionkey", "n_name").collect()], columns=["r", "n"]).groupby("r"):
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr(f"deep{r}.txt", "deep")
        with zipfile.ZipFile(outer, "w") as z:
            for n in rows["n"]:
                z.writestr(f"{n}.txt", n)
            z.writestr("in.zip", inner.getvalue())
        _write(spark, f"{path}/r{r}.zip", outer.getvalue())
    for name in ("bad.zip", "temp.zip", "x_backup.zip"):
        _write(spark, f"{path}/{name}", b"no archive")
    found = files.archive_entries(spark, path)
    last: Column = F.element_at(F.split("archive", "[/!]"), -1)
    return found.select(last.alias("archive"), "entry", F.when(~F.coalesce(F.col("entry").endswith(".zip"), F.lit(False)), F.col("length")).alias("length"), F.element_at(F.split("status", ":"), 1).alias("status"))


@query("SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region")
def csv_source(spark, sf):
    path = _folder(spark)
    read(spark, sf, "region").write.option("header", True).csv(path)
    return cli.read_csv(spark, path)


@query("SELECT item, count(*)::BIGINT AS recipes FROM (SELECT unnest(['spaghetti', 'garlic', 'tomato sauce', 'basil', 'olive oil', 'parmesan', 'penne', 'garlic', 'tomato', 'onion', 'basil', 'olive oil', 'feta cheese', 'fettuccine', 'cream', 'garlic', 'parmesan', 'black pepper', 'parsley', 'linguine', 'garlic', 'shrimp', 'lemon', 'butter', 'parsley', 'rigatoni', 'sausage', 'tomato sauce', 'onion', 'bell pepper', 'parmesan']) AS item) GROUP BY item")
def sample_items(spark, sf):
    return appropriate.sample(spark, "items").select(F.explode(items.split_items(F.col("items"))).alias("item")).groupBy("item").agg(F.count("*").alias("recipes"))


@query("SELECT * FROM (VALUES (0, 'first'), (1, 'a'), (2, 'b'), (3, 'last')) t(place, item)")
def shell_items(spark, sf):
    args = cli.parser().parse_args(["first", "last", "--context", "soup", "-i", "a; b"])
    return spark.createDataFrame(list(enumerate(cli.wanted(spark, args)[1])), "place int, item string")
