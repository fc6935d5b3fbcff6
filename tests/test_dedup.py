import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators.components import connected_components
from tidemill.operators.dedup import deduplicate
from tidemill.plans import specs

PEOPLE = [(0, 100, "a@x.com", "555-1", 10, "v1"), (1, 100, "a@x.com", None, 12, "v2"), (2, 101, "b@x.com", "555-2", 7, "v3"), (3, 102, "c@x.com", "555-3", 20, "v4"), (4, 102, None, "555-3", 19, "v5"), (5, 103, "c@x.com", None, 18, "v6")]
SCHEMA = "ord long, customer_id long, email string, phone string, score long, payload string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def kept(df):
    return sorted(r["ord"] for r in df.collect())


def test_fixture_cases(people):
    best = {"pick": "max:score", "order_by": "ord"}
    assert kept(deduplicate(people, order_by="ord")) == [0, 1, 2, 3, 4, 5]
    assert kept(deduplicate(people, on="email phone", order_by="ord")) == [0, 1, 2, 3, 4, 5]
    c, stats = deduplicate(people, on="any email phone", group_id_column="entity_id", return_stats=True, **best)
    assert {(r["ord"], r["entity_id"]) for r in c.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {k: stats[k] for k in ("original_count", "kept_count", "removed_count", "flagged_count", "grouping", "mode", "on_kind")} == {"original_count": 6, "kept_count": 3, "removed_count": 3, "flagged_count": 0, "grouping": "entity_by", "mode": "collapse", "on_kind": "any"}
    assert kept(deduplicate(people, group_by="customer_id", **best)) == [1, 2, 3, 5]
    e = deduplicate(people, group_by="customer_id", entity_by="email phone", group_id_column="g", **best)
    assert {(r["ord"], r["g"]) for r in e.collect()} == {(1, 0), (2, 1), (3, 2), (5, 3)}
    f = deduplicate(people, on="any email phone", action="flag", group_id_column="entity_id", **best)
    assert f.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "is_duplicate", "entity_id"]
    assert [(r["is_duplicate"], r["entity_id"]) for r in f.orderBy("ord").collect()] == [(True, 0), (False, 0), (False, 1), (False, 2), (True, 2), (True, 2)]
    assert specs.identity_columns(people.schema) == ["customer_id", "email", "phone"]
    assert kept(deduplicate(people, entity_by="auto", **best)) == [1, 2, 3]


def test_null_keys(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, None, 2.0), (2, "a", 3.0), (3, None, None)], "ord long, k string, v double")
    assert kept(deduplicate(df, on="k", pick="max:v", order_by="ord")) == [2, 3]
    assert kept(deduplicate(df, on="k", pick="max:v", order_by="ord", null_keys="group")) == [1, 2]
    assert kept(deduplicate(df, on="k", order_by="ord")) == [0, 1]
    assert kept(deduplicate(df, on="k", pick="last", order_by="ord")) == [2, 3]
    assert kept(deduplicate(df, on="k", pick=lambda g, key: g.tail(1))) == [2]


def test_callables_get_groups_in_order(spark):
    df = spark.range(400).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("k"), (-F.col("id")).alias("back"))
    shuffled = df.repartition(16)
    assert kept(deduplicate(shuffled, on="k", pick=lambda g: g.tail(1), order_by="ord")) == [397, 398, 399]
    assert kept(deduplicate(shuffled, on="k", pick=lambda g: g.tail(1), order_by="back")) == [0, 1, 2]
    assert kept(deduplicate(df, on="k", pick=lambda g, key: g.head(2))) == [0, 1, 2, 3, 4, 5]


def test_extremes_ignore_nan_and_ties_go_first(spark):
    df = spark.createDataFrame([(0, "a", float("nan")), (1, "a", 3.0), (2, "a", 3.0), (3, "b", None), (4, "b", None)], "ord long, k string, v double")
    assert kept(deduplicate(df, on="k", pick="max:v", order_by="ord")) == [1, 3]
    assert kept(deduplicate(df, on="k", pick="min:v", order_by="ord")) == [1, 3]


def test_identifiers(spark):
    df = spark.createDataFrame([(0, "a@x.com; b@x.com", 1, 2.5, ["x"]), (1, "b@x.com", 7, 1.0, ["y", None]), (2, "  ", 8, 9.0, ["z", "x"]), (3, None, 10, None, None)], "ord long, email string, i long, d double, tags array<string>")
    group = lambda **k: [r["g"] for r in deduplicate(df, action="flag", order_by="ord", group_id_column="g", **k).orderBy("ord").collect()]
    assert group(entity_by="email") == [0, 0, 1, 2]
    assert group(entity_by="email", split_entity_values=False) == [0, 1, 2, 3]
    assert group(entity_by="i d") == [0, 0, 1, 2]
    assert group(entity_by="i d", entity_scope="per_column") == [0, 1, 2, 3]
    assert group(entity_by="tags") == [0, 1, 0, 2]


def test_specs():
    cols = ["A", "B", "C"]
    assert all(specs.resolve(s, cols, "x") == ["A", "B"] for s in ("A,B", "A|B", "A B", ["A", "B"]))
    assert specs.resolve("-A", cols, "x", exclude=True) == specs.resolve("!A", cols, "x", exclude=True) == ["B", "C"]
    assert specs.resolve("*", cols, "x") == specs.resolve("", cols, "x") == cols and specs.resolve(None, cols, "x") is None
    with pytest.raises(ValueError):
        specs.resolve("D", cols, "x")
    with pytest.raises(ValueError):
        specs.parse_key([], cols)
    assert specs.parse_pick("keep_last", cols).kind == "last" and specs.parse_pick("MAX: B", cols).column == "B"


def test_aliases(people):
    assert kept(deduplicate(people, subset="customer_id", keep="last", order_by="ord")) == [1, 2, 4, 5]
    for wrong in ({"subset": "email", "on": "email"}, {"nonsense": 1}):
        with pytest.raises(TypeError):
            deduplicate(people, **wrong)
    with pytest.raises(ValueError):
        deduplicate(people, action="maybe")


def test_random_is_stable_and_one_a_key(people):
    one = deduplicate(people, on="customer_id", pick="random", random_state=3)
    assert one.count() == 4 and kept(one) == kept(deduplicate(people, on="customer_id", pick="random", random_state=3))


def components(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {(x, top(x)) for a, b in pairs for x in (a, b) if any(p != q and x in (p, q) for p, q in pairs)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_components_are_those_of_union_find(spark, pairs):
    found = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == components(pairs)


def test_long_chain(spark):
    chain = list(range(300))
    random.Random(2).shuffle(chain)
    found = connected_components(spark.createDataFrame(list(zip(chain, chain[1:])), "src long, dst long"))
    assert found.count() == 300 and found.select("component").distinct().collect()[0][0] == 0


def test_partitions_do_not_matter(people):
    runs = [deduplicate(people.repartition(n), on="any email phone", pick="max:score", order_by="ord", group_id_column="g").select("ord", "g").orderBy("ord").collect() for n in (1, 2, 8)]
    assert runs[0] == runs[1] == runs[2]


def test_native_plan(people):
    plan = deduplicate(people, on="email", order_by="ord")._jdf.queryExecution().toString()
    assert "Python" not in plan and "WindowGroupLimit" in deduplicate(people, on="email", order_by="ord").where(F.lit(True))._jdf.queryExecution().executedPlan().toString()


def test_rows_in_the_order_they_came_in(spark):
    df = spark.createDataFrame([(k * 7 % 20, k % 6) for k in range(20)], "a long, b long").coalesce(1)
    assert [r["a"] for r in deduplicate(df, on="b", keep_order=True).collect()] == [0, 7, 14, 1, 8, 15]
    assert [r["a"] for r in deduplicate(df, on="b", action="flag", pick="max:a", keep_order=True).collect()] == [r["a"] for r in df.collect()]
