"""A query for each operator over the test tables, and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import items, names
from tidemill.operators import appropriate, neighbors, sentiment
from tidemill.operators.dedup import deduplicate
from tidemill.operators.weights import apply_weights
from tidemill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- de-duplication


def _first(table: str, keys: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


@query(_first("documents", "text", "doc_id"))
def dedup_exact_first(spark, sf):
    return deduplicate(read(spark, sf, "documents"), on="text", order_by="doc_id")


@query(_first("documents", "lang, source", "doc_id DESC"))
def dedup_exact_last(spark, sf):
    return deduplicate(read(spark, sf, "documents"), on="lang source", pick="last", order_by="doc_id")


@query(_first("events", "user_id, event_type", "event_id", "event_id, user_id, event_type"))
def dedup_exclude_spec(spark, sf):
    return deduplicate(read(spark, sf, "events"), on="-event_id ts value props", order_by="event_id").select("event_id", "user_id", "event_type")


@query(_first("orders", "o_custkey", "o_totalprice DESC, o_orderkey"))
def dedup_max_by(spark, sf):
    return deduplicate(read(spark, sf, "orders"), on="o_custkey", pick="max:o_totalprice", order_by="o_orderkey")


@query(_first("part", "p_brand", "p_retailprice, p_partkey"))
def dedup_min_by(spark, sf):
    return deduplicate(read(spark, sf, "part"), on="p_brand", pick="min:p_retailprice", order_by="p_partkey")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_flag(spark, sf):
    return deduplicate(read(spark, sf, "documents"), on="text", action="flag", order_by="doc_id").select("doc_id", "is_duplicate")


_EVENT_GROUPS = "WITH g AS (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS head FROM events)"


@query(f"{_EVENT_GROUPS} SELECT event_id, user_id, dense_rank() OVER (ORDER BY head) - 1 AS gid FROM g WHERE event_id = head")
def dedup_group_collapse(spark, sf):
    return deduplicate(read(spark, sf, "events"), group_by="user_id", order_by="event_id", group_id_column="gid").select("event_id", "user_id", "gid")


@query(f"{_EVENT_GROUPS}, r AS (SELECT *, dense_rank() OVER (ORDER BY head) - 1 AS gid FROM g) SELECT event_id, gid FROM r QUALIFY row_number() OVER (PARTITION BY gid, event_type ORDER BY event_id) = 1")
def dedup_group_within(spark, sf):
    return deduplicate(read(spark, sf, "events"), on="event_type", group_by="user_id", mode="within", order_by="event_id", group_id_column="gid").select("event_id", "gid")


def _people(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    key = F.col("c_custkey")
    email = F.when(key % 5 != 0, F.concat(F.lit("e"), F.floor(key / 2).cast("string")))
    return c.select("c_custkey", "c_mktsegment", "c_acctbal", email.alias("email"), F.concat(F.lit("p"), (key % 900).cast("string")).alias("phone"), F.concat(F.lit("e"), (key % 700).cast("string")).alias("other"))


_PEOPLE = """people AS (SELECT c_custkey, c_mktsegment, c_acctbal, CASE WHEN c_custkey % 5 != 0 THEN 'e' || (c_custkey // 2) END AS email,
  'p' || (c_custkey % 900) AS phone, 'e' || (c_custkey % 700) AS other FROM customer)"""


def _closure(tokens: str, final: str) -> str:
    return f"""WITH RECURSIVE {_PEOPLE}, token AS ({tokens}),
edge AS (SELECT DISTINCT c_custkey AS a, min(c_custkey) OVER (PARTITION BY key) AS b FROM token),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT c_custkey AS a, c_custkey AS b FROM people UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS c_custkey, min(b) AS head FROM reach GROUP BY a)
{final}"""


_EMAIL_PHONE = "SELECT c_custkey, 'e' || email AS key FROM people WHERE email IS NOT NULL UNION ALL SELECT c_custkey, 'p' || phone FROM people"
_IDS = "SELECT c_custkey, dense_rank() OVER (ORDER BY head) - 1 AS entity_id, row_number() OVER (PARTITION BY head ORDER BY c_acctbal DESC, c_custkey) > 1 AS is_duplicate FROM comp JOIN people USING (c_custkey)"


@query(_closure(_EMAIL_PHONE, _IDS))
def dedup_entity_any(spark, sf):
    out = deduplicate(_people(spark, sf), on="any email phone", pick="max:c_acctbal", action="flag", order_by="c_custkey", group_id_column="entity_id")
    return out.select("c_custkey", "entity_id", "is_duplicate")


@query(
    _closure(
        "SELECT c_custkey, c_mktsegment || 'e' || email AS key FROM people WHERE email IS NOT NULL UNION ALL SELECT c_custkey, c_mktsegment || 'p' || phone FROM people",
        "SELECT c_custkey, dense_rank() OVER (ORDER BY bhead, head) - 1 AS entity_id FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS bhead FROM comp JOIN people USING (c_custkey))",
    )
)
def dedup_entity_blocked(spark, sf):
    out = deduplicate(_people(spark, sf), entity_by="email phone", block_by="c_mktsegment", action="flag", order_by="c_custkey", group_id_column="entity_id")
    return out.select("c_custkey", "entity_id")


@query(_closure("SELECT c_custkey, 'a' || email AS key FROM people WHERE email IS NOT NULL UNION ALL SELECT c_custkey, 'b' || other FROM people", "SELECT c_custkey, dense_rank() OVER (ORDER BY head) - 1 AS entity_id FROM comp"))
def dedup_entity_per_column(spark, sf):
    out = deduplicate(_people(spark, sf), entity_by="email other", entity_scope="per_column", action="flag", order_by="c_custkey", group_id_column="entity_id")
    return out.select("c_custkey", "entity_id")


@query(_closure("SELECT c_custkey, email AS key FROM people WHERE email IS NOT NULL UNION ALL SELECT c_custkey, phone FROM people", "SELECT c_custkey, dense_rank() OVER (ORDER BY head) - 1 AS entity_id FROM comp"))
def dedup_entity_split(spark, sf):
    people = _people(spark, sf).select("c_custkey", F.concat_ws("; ", "email", "phone").alias("contact"))
    return deduplicate(people, entity_by="contact", action="flag", order_by="c_custkey", group_id_column="entity_id").select("c_custkey", "entity_id")


_RATED = "rated AS (SELECT doc_id, quality, CASE WHEN quality IS NOT NULL AND doc_id % 3 = 0 THEN NULL ELSE length(text) END AS v FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_RATED} SELECT doc_id, quality FROM rated WHERE quality IS NOT NULL OR v IS NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY v DESC NULLS LAST, doc_id) = 1")
def dedup_null_key_max(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    d = d.select("doc_id", "quality", F.when(~(F.col("quality").isNotNull() & (F.col("doc_id") % 3 == 0)), F.length("text")).alias("v"))
    return deduplicate(d, on="quality", pick="max:v", order_by="doc_id").select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2")
def dedup_custom(spark, sf):
    return deduplicate(read(spark, sf, "documents").select("doc_id", "source"), on="source", pick=lambda g: g.sort_values("doc_id").head(2))


@query("SELECT count(*)::BIGINT AS original, count(DISTINCT text)::BIGINT AS kept, (count(*) - count(DISTINCT text))::BIGINT AS removed FROM documents")
def dedup_stats(spark, sf):
    _, s = deduplicate(read(spark, sf, "documents"), on="text", order_by="doc_id", return_stats=True)
    return spark.createDataFrame([(s["original_count"], s["kept_count"], s["removed_count"])], "original long, kept long, removed long")


# --- weights

_SEGMENTS = {"AUTOMOBILE": 0.8, "BUILDING": 1.2, "FURNITURE": 1.5, "HOUSEHOLD": 0.75, "MACHINERY": 1.0}
_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _SEGMENTS.items()) + " END"
_BALANCE = "customer_ AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 11 != 0 THEN c_mktsegment END AS seg FROM customer)"


def _holes(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"))


@query(f"WITH {_BALANCE} SELECT c_custkey, bal * ({_CASE}) AS bal_weighted FROM customer_ WHERE bal IS NOT NULL AND seg IS NOT NULL")
def weights_drop(spark, sf):
    return apply_weights(_holes(spark, sf), {"seg": _SEGMENTS}, columns_to_weight="bal", handle_na="drop").select("c_custkey", "bal_weighted")


@query(f"WITH {_BALANCE} SELECT c_custkey, bal * coalesce({_CASE.replace('c_mktsegment', 'seg')}, 1::DOUBLE) AS bal_weighted FROM customer_")
def weights_ignore(spark, sf):
    return apply_weights(_holes(spark, sf), {"seg": _SEGMENTS}, columns_to_weight="bal").select("c_custkey", "bal_weighted")


@query(f"""WITH {_BALANCE}, m AS (SELECT avg(bal) AS a FROM customer_), t AS (SELECT seg FROM customer_ WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1),
f AS (SELECT c_custkey, coalesce(bal, (SELECT a FROM m)) AS bal, coalesce(seg, (SELECT seg FROM t)) AS seg FROM customer_)
SELECT c_custkey, round(bal * ({_CASE.replace("c_mktsegment", "seg")}), 4) AS bal_weighted FROM f""")
def weights_fill(spark, sf):
    out = apply_weights(_holes(spark, sf), {"seg": _SEGMENTS}, columns_to_weight="bal", handle_na="fill")
    return out.select("c_custkey", F.round("bal_weighted", 4).alias("bal_weighted"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END"


@query(f"SELECT o_orderkey, {_STATUS} AS w, o_totalprice * ({_STATUS}) AS price FROM orders")
def weights_default_level(spark, sf):
    out = apply_weights(read(spark, sf, "orders"), {"o_orderstatus": {"F": 0.5}}, columns_to_weight="o_totalprice", new_column_names=["price"], default_weight=2.0, require_all_levels=False, total_weight_col="w")
    return out.select("o_orderkey", "w", "price")


@query(f"SELECT c_custkey, {_CASE} AS c_mktsegment_weight, c_acctbal * ({_CASE}) AS c_acctbal_weighted FROM customer")
def weights_verbose(spark, sf):
    out = apply_weights(read(spark, sf, "customer"), {"c_mktsegment": _SEGMENTS}, columns_to_weight="c_acctbal", verbose=True, verbose_mode="per_variable")
    return out.select("c_custkey", "c_mktsegment_weight", "c_acctbal_weighted")


# --- names

_WORDS = "lower(regexp_replace(regexp_replace(trim(p_name), '\\s+', '_', 'g'), '__+', '_', 'g'))"


def _names(case: str):
    def run(spark, sf):
        return names.clean_names_table(read(spark, sf, "part").select(F.upper("p_name").alias("p_name")).distinct(), "p_name", case=case)

    return run


for _case, _sql in {"upper": "upper(u)", "lower": "lower(u)", "kebab": "replace(lower(u), '_', '-')", "space": "replace(lower(u), '_', ' ')", "sentence": "upper(left(u, 1)) || lower(substr(u, 2))", "snake": "lower(u)"}.items():
    QUERIES[f"names_{_case}"] = _names(_case)
    SQL[f"names_{_case}"] = f"WITH n AS (SELECT DISTINCT upper(p_name) AS original, regexp_replace(trim(upper(p_name)), '\\s+', '_', 'g') AS u FROM part) SELECT original, {_sql} AS renamed FROM n"
for _case in ("camel", "pascal", "title"):
    QUERIES[f"names_{_case}"] = _names(_case)
SQL["names_title"] = """WITH n AS (SELECT DISTINCT upper(p_name) AS original FROM part)
SELECT original, list_aggregate(list_transform(string_split(original, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), 'string_agg', '_') AS renamed FROM n"""
SQL["names_pascal"] = SQL["names_title"].replace("'_')", "'')")
SQL["names_camel"] = f"SELECT original, lower(left(renamed, 1)) || substr(renamed, 2) AS renamed FROM ({SQL['names_pascal']})"


@query("SELECT DISTINCT source AS original, source || '.' || source || '_2.' || source || '_3' AS renamed FROM documents")
def names_dupes(spark, sf):
    d = read(spark, sf, "documents").select("source").distinct()
    return d.select(F.col("source").alias("original"), names.clean_name(F.concat_ws(".", "source", "source", "source")).alias("renamed"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents")
def names_ascii(spark, sf):
    return read(spark, sf, "documents").select("doc_id", names.transliterated(F.col("text"), ["latin", "ascii"]).alias("folded"))


# --- items


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part)
SELECT item, count(*)::BIGINT AS "rows", (count(*)::DOUBLE / (SELECT count(*) FROM part))::FLOAT AS freq FROM w GROUP BY item""")
def items_split_freq(spark, sf):
    return items.document_frequency(read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("p_name")), "p_name")


@query("SELECT p_partkey, lower(p_name) AS item FROM part")
def items_normalize(spark, sf):
    amount = F.element_at(F.array(*map(F.lit, ["1/2 cup ", "2-3 tbsp ", "½", "1 1/2 oz. "])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", items.normalize_item(F.concat(amount, "p_name")).alias("item"))


@query("SELECT count(*)::BIGINT AS rows_total, count(*)::BIGINT AS rows_used, (SELECT count(DISTINCT lower(p_brand)) FROM part)::BIGINT AS unique_items FROM part")
def items_counts(spark, sf):
    return items.row_counts(read(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("x")).alias("p_brand")), "p_brand")


# --- neighbours and decisions


def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "embedding")


_LIKE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT a.vec_id AS query, b.vec_id AS item, round({_LIKE}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_LIKE} DESC, b.vec_id)::INTEGER AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""")
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    return neighbors.nearest(v, v.where("item % 50 = 0").withColumnRenamed("item", "query"), 5).select("query", "item", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH n AS (SELECT max({_LIKE}) AS sim FROM embeddings a, embeddings b WHERE a.vec_id != b.vec_id GROUP BY a.vec_id) SELECT round(least(0.75, greatest(0.45, quantile_cont(sim, 0.05))), 6) AS floor FROM n")
def nn_p05(spark, sf):
    return spark.createDataFrame([(round(neighbors.similarity_floor(_vectors(spark, sf)), 6),)], "floor double")


def _judged(spark, sf) -> DataFrame:
    part = read(spark, sf, "part")
    index = appropriate.build_index(part.select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("p_name")), "p_name")
    words = part.select(F.element_at(F.split("p_name", " "), 1).alias("item")).distinct().unionByName(read(spark, sf, "region").select(F.col("r_name").alias("item")))
    return appropriate.evaluate(words, index, appropriate.PRESETS["normal"])


_JUDGED = """WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part),
f AS (SELECT item AS known, (count(*)::DOUBLE / (SELECT count(*) FROM part))::FLOAT::DOUBLE AS freq FROM w GROUP BY item),
q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS item FROM part UNION ALL SELECT r_name FROM region),
j AS (SELECT q.item, freq FROM q LEFT JOIN f ON lower(q.item) = f.known)"""


@query(f"{_JUDGED} SELECT item, CASE WHEN freq >= 0.04::DOUBLE THEN 'Appropriate' ELSE 'Inappropriate' END AS decision FROM j")
def appropriate_decide(spark, sf):
    return _judged(spark, sf).select("item", "decision")


@query(f"""{_JUDGED} SELECT item, round(CASE WHEN freq IS NULL THEN 0 ELSE (0.8 + 0.2 * least(1, ln(1 + freq * 10) / ln(11))) * CASE WHEN freq < 0.04::DOUBLE THEN 0.25 + 0.75 * freq / 0.04 ELSE 1 END END::DOUBLE, 6) AS score FROM j""")
def appropriate_score(spark, sf):
    return _judged(spark, sf).select("item", F.round("score", 6).alias("score"))


@query()
def appropriate_similar(spark, sf):
    """Known items, and others whose vectors are more or less like theirs, by neighbours, frequencies and outlier factors."""
    name = F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij")
    vectors = read(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    index = vectors.select(F.concat(F.lit("x"), name).alias("item"), ((F.col("vec_id") % 16 + 1) / 100).cast("float").alias("freq"), "embedding")
    some = vectors.where("vec_id % 50 = 0")
    turned = F.transform("embedding", lambda x, i: F.when(i * 8 < F.size("embedding") * (F.col("vec_id") / 50 % 4), -x).otherwise(x))
    asked = some.select(F.concat(F.lit("x"), name).alias("item"), "embedding").unionByName(some.select(F.concat(F.lit("y"), name).alias("item"), turned.alias("embedding")))
    odd = neighbors.outlier_factors(index, asked.withColumnRenamed("item", "query"))
    found = appropriate.evaluate(asked, index, appropriate.PRESETS["normal"], explain=True, outliers=odd)
    return found.select("item", "decision", F.round("score", 6).alias("score"), "reason", "best_match", F.round("best_similarity", 6).alias("best_similarity"), "outlier", F.array_join("neighbors.item", " ").alias("neighbors"))


@query("SELECT event_id, least(1, greatest(0, (json_extract(props, '$.k')::DOUBLE) / 100)) AS p FROM events")
def llm_json_parse(spark, sf):
    said = F.from_json("props", "k double")["k"] / 100
    reply = F.concat(F.lit('so: {"p": '), said.cast("string"), F.lit(', "reason": "{x}"} ok'))
    return read(spark, sf, "events").select("event_id", appropriate.parse_replies(reply)["p"].alias("p"))


# --- sentiment

_LEXICON = [("the", 1.0), ("of", -1.0), ("and", 0.25), ("in", 0.75)]
_WORD_ROWS = f"""WITH l(word, score) AS (VALUES {", ".join(f"('{w}', {s}::DOUBLE)" for w, s in _LEXICON)}),
w AS (SELECT conv_id * 1000 + turn AS text_index, unnest(string_split_regex(text, '\\s+')) AS word FROM conversations),
c AS (SELECT text_index, word, lower(trim(word, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) AS clean FROM w WHERE word != ''),
s AS (SELECT text_index, c.word, coalesce(score, 0::DOUBLE) AS sentiment_score FROM c LEFT JOIN l ON l.word = c.clean),
k AS (SELECT *, CASE WHEN sentiment_score <= -0.5 THEN 'Negative' WHEN sentiment_score <= 0.5 THEN 'Neutral' ELSE 'Positive' END AS sentiment_category FROM s)"""


def _words(spark, sf) -> DataFrame:
    talks = read(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return sentiment.detect(talks, ["text"], spark.createDataFrame(_LEXICON, "word string, score double"), id_col="id")


@query(f"{_WORD_ROWS} SELECT text_index, word, sentiment_score, sentiment_category FROM k")
def sentiment_words(spark, sf):
    return _words(spark, sf).select("text_index", "word", "sentiment_score", "sentiment_category")


@query(f"{_WORD_ROWS} SELECT sentiment_category AS value, count(*)::DOUBLE / (SELECT count(*) FROM k) AS share FROM k GROUP BY 1")
def sentiment_distribution(spark, sf):
    return sentiment.distribution(_words(spark, sf), "sentiment_category", sentiment.CATEGORIES)


@query(f"{_WORD_ROWS} SELECT text_index, word, sentiment_score FROM k ORDER BY sentiment_score DESC, text_index, word LIMIT 5")
def sentiment_topk(spark, sf):
    return sentiment.extremes(_words(spark, sf), "sentiment_score", 5, ties=("text_index", "word")).select("text_index", "word", "sentiment_score")


# --- files


@query("""WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, len(parts)::INTEGER AS depth, CASE WHEN regexp_extract(parts[-1], '^.+?(\\.[^.]+)$', 1) = '' THEN 'file' ELSE regexp_extract(parts[-1], '^.+?(\\.[^.]+)$', 1) END AS type FROM p""")
def path_levels(spark, sf):
    parts = files.levels(F.concat(F.lit("web/"), "url"), "web")
    return read(spark, sf, "pages").select("page_id", (F.size(parts) - 1).alias("depth"), F.element_at(parts, -1)["type"].alias("type"))


@query("SELECT '.parquet' AS type, true AS filled")
def media_listing(spark, sf):
    found = files.list_files(spark, sf, recursive=True, glob="*.parquet")
    return found.select(files.suffix(files.name_of(F.col("path"))).alias("type"), "length").groupBy("type").agg(F.bool_and(F.col("length") > 0).alias("filled"))
