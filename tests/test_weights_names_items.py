import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemill.functions import items, names
from tidemill.operators.weights import apply_weights

# The survey, its weights and what comes of them.
ROWS = [(0, None, 25, "male", "high school"), (1, 60000.0, 30, "female", "bachelor"), (2, 75000.0, 35, "male", None), (3, 80000.0, 40, "female", "bachelor"), (4, 90000.0, 45, "male", "phd"), (5, 100000.0, 50, "female", "master")]
WEIGHTS = {"gender": {"male": 0.8, "female": 1.2}, "education": {"high school": 1.5, "bachelor": 1.0, "master": 0.8, "phd": 0.7}}


@pytest.fixture(scope="module")
def survey(spark):
    return spark.createDataFrame(ROWS, "ord long, income double, age long, gender string, education string")


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("drop", {1: (72000, 36), 3: (96000, 48), 4: (50400, 25.2), 5: (96000, 48)}),
        ("fill", {0: (97200, 30), 1: (72000, 36), 2: (60000, 28), 3: (96000, 48), 4: (50400, 25.2), 5: (96000, 48)}),
        ("ignore", {0: (None, 30), 1: (72000, 36), 2: (60000, 28), 3: (96000, 48), 4: (50400, 25.2), 5: (96000, 48)}),
    ],
)
def test_weights(survey, how, want):
    got = {r["ord"]: (r["income_weighted"], r["age_weighted"]) for r in apply_weights(survey, WEIGHTS, columns_to_weight=["income", "age"], handle_na=how).collect()}
    assert got.keys() == want.keys()
    assert all(g is w is None or g == pytest.approx(w) for k in want for g, w in zip(got[k], want[k], strict=True))


def test_weight_columns(survey):
    out = apply_weights(survey, WEIGHTS, columns_to_weight=["income", "age"], verbose=True)
    assert out.columns[5:] == ["income_gender_weight", "income_education_weight", "income_weighted", "age_gender_weight", "age_education_weight", "age_weighted"]
    out = apply_weights(survey, WEIGHTS, columns_to_weight="income", verbose=True, verbose_mode="per_variable", total_weight_col="weight_total")
    assert out.columns[5:] == ["weight_total", "gender_weight", "education_weight", "income_weighted"]


def test_weight_errors(survey):
    for error, change in [
        (ValueError, {"weights": {"gender": {"male": 1}}}), (TypeError, {"weights": {"gender": {"male": "x", "female": 1}}}), (TypeError, {"columns_to_weight": "gender"}),
        (ValueError, {"new_column_names": ["a", "b"]}), (ValueError, {"handle_na": "x"}), (ValueError, {"weights": {"nope": {}}}),
    ]:
        arguments = {"weights": WEIGHTS, "columns_to_weight": "income"} | change
        with pytest.raises(error):
            apply_weights(survey, arguments.pop("weights"), **arguments)


GOLDEN = [
    ("This is a Test", {}, "this_is_a_test"), ("This is a Test", {"case": "camel"}, "thisIsATest"), ("This is a Test", {"case": "pascal"}, "ThisIsATest"), ("This is a Test", {"case": "kebab"}, "this-is-a-test"),
    ("This is a Test", {"case": "space"}, "this is a test"), ("this is a test", {"case": "title"}, "This_Is_A_Test"), ("this is a test", {"case": "upper"}, "THIS_IS_A_TEST"), ("This IS a TEST", {"case": "lower"}, "this_is_a_test"),
    ("this is a test", {"case": "sentence"}, "This_is_a_test"), ("100% of #1", {}, "100_percent_of_number_1"), ("100% of #1", {"replace": {"%": "percent", "#": "number"}}, "100percent_of_number1"),
    ("Chapter 10", {"numerals": "asis"}, "chapter_10"), ("Chapter 10", {"numerals": "remove"}, "chapter"), ("test.test.test", {"allow_dupes": False}, "test.test_2.test_3"), ("A.B.% #", {"case": "old_janitor"}, "a_b_percent_number"),
    ("καλημέρα", {"transliterations": "Greek"}, "kalhmera"), ("This is a Test", {"case": "snake_case"}, "this_is_a_test"), ("Chapter 10", {"numerals": "keep"}, "chapter_10"), ("test..test", {"sep_in": "."}, "test.test_2"),
    ("a/b.c", {"sep_in": ["/", "."], "sep_out": "."}, "a.b.c"), ("a::b::c", {"sep_in": ["::"], "sep_out": "."}, "a.b.c"), ("a/b/c", {"sep_in": "/", "sep_out": "__"}, "a__b__c"),
    ("καλημέρα", {"transliterations": "Greek", "ascii": False, "transliterate": True}, "kalhmera"), ("abc123def", {"replace": {r"\d+": "_NUM_"}, "replace_regex": True}, "abc_num_def"), ("naïve café", {}, "naive_cafe"),
    ("123x", {}, "123x"), ("Chapter 10", {"numerals": "spell", "speller": lambda n: {10: "ten"}[n]}, "chapter_ten"), ("123", {"speller": lambda n: "one two"}, "one_two"), ("abc1def", {"case": "pascal"}, "Abc1Def"),
]


def test_names(spark):
    for value, options, want in GOLDEN:
        assert names.clean_names(value, **options) == want, (value, want)
    once = names.clean_names("x.x.x")
    assert names.clean_names("x.x.x") == once
    with pytest.raises(ValueError):
        names.clean_names(["a", "b"])
    with pytest.raises(ModuleNotFoundError):
        names.clean_names("Chapter 10", numerals="spell")
    with pytest.raises(ModuleNotFoundError):
        names.clean_names("123")
    with pytest.raises(ValueError):
        names.clean_names("a", case="odd")


def test_name_tables(spark):
    df = spark.createDataFrame([(None,), ("123x",), ("naïve café",)], "v string")
    assert {tuple(r) for r in names.clean_names_table(df, "v").collect()} == {("", ""), ("123x", "123x"), ("naïve café", "naive_cafe")}
    assert names.clean_names_table(df, "v", skip_none=True).count() == 2
    assert names.rename_columns(spark.range(1).toDF("My Col")).columns == ["my_col"]


def test_ascii_of_whole_texts(spark, tmp_path):
    from tidemill.queries import QUERIES

    texts = [(1, "plain first, then été\nand ñandú"), (2, "Łódź straße ﬁn ½ 数据 e\u0301"), (3, "a" * 30 + "é"), (4, None), (5, ""), (6, "12 — 数据"), (7, "x " * 5000 + "Ünï")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: t if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for i, t in texts}
    assert want[1] == "plain first, then ete\nand nandu" and want[2] == "odz strae fin 12  e"
    assert {r["doc_id"]: r["folded"] for r in QUERIES["names_ascii"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("1/2 cup olive oil", "olive oil"), ("1 1/2 tsp salt", "salt"), ("2-3 cloves garlic", "garlic"), ("1to2 eggs", "eggs"), ("½cup sugar", "sugar"), ("sun-dried_tomato", "sun dried tomato"),
        ("7 up", "7 up"), ("1000 island", "island"), ("2% milk", "2 milk"), ("12oz beef", "12oz beef"), ("2 cups", ""), ("cups", ""), ("42", ""), (None, ""),
    ],
)
def test_normalize(spark, value, want):
    assert spark.range(1).select(items.normalize_item(F.lit(value).cast("string"))).first()[0] == want


def test_items(spark):
    from tidemill.operators.appropriate import sample

    split = lambda t: spark.range(1).select(items.split_items(F.lit(t))).first()[0]
    assert split("tofu; rice|beans, salt / pepper") == ["tofu", "rice", "beans", "salt", "pepper"] and split("1/2 cup") == ["1/2 cup"]
    freq = {r["item"]: round(r["freq"], 6) for r in items.document_frequency(sample(spark, "x"), "x").collect()}
    assert len(freq) == 21 and freq["garlic"] == 0.8 and freq["parmesan"] == 0.6 and freq["penne"] == 0.2
    cells = spark.createDataFrame([(["A", "b, c", None],), (None,)], "x array<string>")
    assert [r[0] for r in cells.select(items.items_of(cells, "x")).collect()] == [["a", "b", "c"], []]
    assert tuple(items.row_counts(cells, "x").first()) == (2, 1, 3)


def test_ascii_without_python(spark, caplog):
    import unicodedata

    texts = ["plain", "Ångström ﬁne ½ … ﬀ", "字 ß Ω ℃ 𝔸 ㎏", "", None, "é" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", names.transliterated(F.col("t"), ["latin", "ascii"]).alias("x"))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert all(r["x"] == (r["t"] and unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode()) for r in out.collect())
    assert {r["character"]: r["rows"] for r in names.left_over(df, "t").collect()}["é"] == 1
    assert names.clean_names("µ", transliterate=False, replace={}) == "" and "micro sign" in caplog.text
    assert names.clean_names("aß", transliterate=False) == "aß" and "neither" in caplog.text


def test_levels_and_modes_of_wide_columns(spark):
    from tidemill.operators.weights import apply_weights, fill_nulls

    df = spark.createDataFrame([("a", 1.0, None), ("b", None, "x"), (None, 3.0, "y"), ("b", 2.0, "y")], "s string, v double, t string")
    assert sorted(map(str, fill_nulls(df, df.columns).collect())) == sorted(map(str, spark.createDataFrame([("a", 1.0, "y"), ("b", 2.0, "x"), ("b", 3.0, "y"), ("b", 2.0, "y")], "s string, v double, t string").collect()))
    with pytest.raises(ValueError, match="'b' of 's'"):
        apply_weights(df, {"s": {"a": 2.0}}, columns_to_weight="v")
