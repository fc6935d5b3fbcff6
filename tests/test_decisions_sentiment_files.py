import io
import math
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import appropriate as ap
from tidemill.operators import neighbors as nb
from tidemill.operators import sentiment as se
from tidemill.sources import files


@pytest.fixture(scope="module")
def index(spark):
    rows = [("salt", 0.5, [1.0, 0.0]), ("pepper", 0.5, [0.9, 0.1]), ("rare", 0.01, [0.0, 1.0]), ("edge", 1 / 25, [-1.0, 0.0]), ("zero", 0.5, [0.0, 0.0])]
    return spark.createDataFrame(rows, "item string, freq float, embedding array<float>")


def test_nearest(index):
    q = index.select(F.col("item").alias("query"), "embedding")
    got = {(r["query"], r["rank"]): (r["item"], r["sim"]) for r in nb.nearest(index, q, 2, other=True).collect()}
    assert got[("salt", 1)][0] == "pepper" and got[("salt", 1)][1] == pytest.approx(0.9 / math.hypot(0.9, 0.1)) and got[("zero", 1)] == ("edge", 0.0)
    assert nb.nearest(index, q.where("false"), 2).collect() == []
    assert nb.similarity_floor(index) == 0.56 and nb.outlier_factors(index) is None


def test_outliers(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal([5, 5, 5], 0.3)]) for i in range(60)] + [(99, [-5.0, 5.0, -5.0])]
    df = spark.createDataFrame(rows, "item long, embedding array<double>")
    worst = nb.outlier_factors(df).orderBy(F.desc("lof")).first()
    assert worst["query"] == 99 and worst["outlier"]
    asked = spark.createDataFrame([(1, [5.0, 5.0, 5.0]), (2, [-5.0, -5.0, 5.0])], "query long, embedding array<double>")
    assert {r["query"]: r["outlier"] for r in nb.outlier_factors(df, asked).collect()} == {1: False, 2: True}


def test_decisions(spark, index):
    asked = spark.createDataFrame([("Salt", [1.0, 0.0]), ("sea salt", [0.95, 0.05]), ("rare", [0.0, 1.0]), ("odd", [0.0, -1.0]), ("edge", [-1.0, 0.0]), ("2 cups", [1.0, 0.0]), (None, None)], "item string, embedding array<float>")
    got = {r["item"]: r for r in ap.evaluate(asked, index, ap.PRESETS["normal"], explain=True).collect()}
    assert got["Salt"]["decision"] == ap.YES and got["Salt"]["score"] == pytest.approx(0.8 + 0.2 * math.log1p(5) / math.log1p(10)) and got["Salt"]["neighbors"][0]["item"] == "pepper"
    assert got["sea salt"]["decision"] == ap.YES and got["sea salt"]["reason"].startswith("similar to")
    assert got["rare"]["reason"] == "exact match; too uncommon" and got["odd"]["reason"].startswith("low similarity")
    assert got["edge"]["decision"] == ap.NO, "float 0.04 is below double 0.04"
    assert got["2 cups"]["reason"] == got[None]["reason"] == "empty/invalid input"
    blind = ap.evaluate(asked.drop("embedding"), index, ap.PRESETS["normal"])
    assert {r["item"]: r["reason"] for r in blind.collect()}["odd"].startswith("embedding model unavailable")
    wary = ap.Thresholds(0.56, 0.04, False, True, 0.35)
    vetoed = {r["item"]: r for r in ap.evaluate(asked, index, wary, scorer=lambda x: (0.1, "no") if x == "Salt" else None).collect()}
    assert vetoed["Salt"]["decision"] == ap.NO and vetoed["Salt"]["score"] == 0.1 and vetoed["Salt"]["reason"] == "LLM veto: no" and vetoed["sea salt"]["decision"] == ap.YES
    assert ap.report(blind).count() == ap.json_lines(blind).count() == 7
    assert ap.suggest(5, 0.9, ap.PRESETS["normal"]) == ap.Thresholds(0.6100000000000001, 0.1, False, False, 0.35)


def test_decisions_by_neighbours(spark, tmp_path):
    """The registered query against numpy: exact items and others, too uncommon, too unlike, outliers, and what passes."""
    from tidemill.queries import QUERIES

    r = np.random.default_rng(3)
    table = {i: r.normal(1.0, 0.4, 16).astype(np.float32) for i in range(800)}
    for i in (100, 250, 300, 350):
        table[i] = r.normal(0.0, 1.0, 16).astype(np.float32)
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table.items()], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    unit = lambda v: v.astype(float) / np.linalg.norm(v.astype(float))
    items = sorted((f"x{name(i)}", i) for i in table)
    names, matrix, freq = [x for x, _ in items], np.stack([unit(table[i]) for _, i in items]), [float(np.float32((i % 16 + 1) / 100)) for _, i in items]
    k = 20
    away = 1 - matrix @ matrix.T
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(away, near, 1)[:, -1]
    density = 1 / (np.maximum(far[near], np.take_along_axis(away, near, 1)).mean(axis=1) + 1e-10)
    bound = np.percentile(density[near].mean(axis=1) / density, 95)
    got, reasons = {x["item"]: x for x in QUERIES["appropriate_similar"](spark, str(tmp_path)).collect()}, set()
    assert len(got) == 2 * 16
    for i in range(0, 800, 50):
        for known in (True, False):
            v = table[i].copy()
            v[: 0 if known else 2 * (i // 50 % 4)] *= -1
            like = matrix @ unit(v)
            order = np.argsort(-like, kind="stable")
            own = 1 / (np.maximum(far[order[:k]], 1 - like[order[:k]]).mean() + 1e-10)
            odd = bool(density[order[:k]].mean() / own > bound)
            item = ("x" if known else "y") + name(i)
            around = [j for j in order if names[j] != item]
            at = names.index(item) if known else order[0]
            sim, f = 1.0 if known else float(like[at]), freq[at]
            score = (0.8 * max(0.0, min(1.0, sim)) + 0.2 * min(1, math.log1p(10 * f) / math.log1p(10))) * (0.25 + 0.75 * f / 0.04 if f < 0.04 else 1) * (0.7 if odd else 1)
            x = got[item]
            assert (x["best_match"], x["outlier"], x["neighbors"].split()) == (names[at], odd, [names[j] for j in around[:5]]), item
            assert x["score"] == pytest.approx(score, abs=2e-6) and x["best_similarity"] == pytest.approx(sim, abs=2e-6)
            assert x["decision"] == (ap.YES if f >= 0.04 and (known or sim >= 0.56) and not odd else ap.NO)
            reasons.add(x["reason"].split("(")[0].split("'")[0].strip())
    assert {"exact match; too uncommon", "exact match; passes thresholds", "embedding outlier vs reference set", "low similarity to known items", "similar to", "too uncommon in dataset"} <= reasons


def test_replies():
    assert ap.parse_reply('{"p": 0.3, "reason": "x"}') == (0.3, "x") and ap.parse_reply('```json\n{"p": 0.3, "reason": "a } b"}\n```') == (0.3, "a } b")
    assert ap.parse_reply('{"p": 7}') == (1.0, "") and ap.parse_reply("probability 0.25") == (0.25, "LLM parsing fallback") and ap.parse_reply("no number") is None


def test_saved_index(spark, index, tmp_path):
    ap.save_index(index, str(tmp_path))
    back, k = ap.load_index(spark, str(tmp_path))
    assert k == 25 and sorted(back.collect()) == sorted(index.collect())
    for bad in (index.union(index), index.withColumn("freq", F.lit(2.0)), index.where("false")):
        with pytest.raises(ValueError):
            ap.check_index(bad, 25)


def test_sentiment(spark):
    df = spark.createDataFrame([("I am not unhappy about this amazing event.", "She is hardly ever sad."), ("This is a very bad situation.", "It's rarely that simple."), (None, "")], "a string, b string")
    lexicon = spark.createDataFrame([("bad", -1.0), ("amazing", 0.9)], "word string, score double")
    out = se.detect(df.coalesce(1), ["a", "b"], lexicon, text_model=lambda c: F.lit(0.25), batch=32)
    got = out.collect()
    assert len(got) == 23 and {r["word"]: r["emotion"] for r in got if r["emotion"]} == {"amazing": "surprise", "sad.": "sadness"}
    assert {r["text_index"] for r in got} == {0} and {r["sentiment_category"] for r in got if r["word"] in ("bad", "amazing")} == {"Negative", "Positive"}
    cut = spark.createDataFrame([(float("-inf"),), (-0.5,), (-0.49,), (0.5,), (0.51,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in cut.select(se.category(F.col("s"))).collect()] == [None, "Negative", "Neutral", "Neutral", "Positive", None, None]
    assert {r["value"]: round(r["share"], 3) for r in se.distribution(out, "sentiment_category", se.CATEGORIES).collect()} == {"Negative": 0.043, "Neutral": 0.913, "Positive": 0.043}
    assert se.extremes(out, "sentiment_score", 1, largest=False).first()["word"] == "bad"
    with pytest.raises(ValueError):
        se.detect(df, ["c"])


def test_listing(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "f.txt").write_text("x")
    (root / "noext").write_text("x")
    with wave.open(str(root / "s.WAV"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(10), w.writeframes(b"\0" * 615)
    table = files.media_table(spark, str(root))
    chains = {tuple(x["name"] for x in r["levels"]): (r["levels"][-1]["type"], r["duration"]) for r in table.collect()}
    assert chains == {("root", "a", "b", "f.txt"): (".txt", ""), ("root", "noext"): ("file", ""), ("root", "s.WAV"): (".WAV", "01:01")}
    assert ("root", "root", "a", "f.txt") in {tuple(x["name"] for x in r["levels"]) for r in files.media_table(spark, str(root), compat=True).collect()}
    wide = files.widen(table)
    assert wide.columns[0] == "Level_1" and wide.columns[-3:] == ["Level_4", "Level_4_type", "Duration"]
    files.save_csv(wide, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    times = spark.createDataFrame([(0.0,), (59.9,), (60.0,), (3661.0,)], "s double").select(files.clock(F.col("s"))).collect()
    assert [r[0] for r in times] == ["00:00", "00:59", "01:00", "61:01"]


def test_moves(spark):
    df = spark.createDataFrame([("/x/a.txt",), ("/x/.bashrc",), ("/x/noext",)], "path string")
    assert {tuple(r) for r in files.plan_moves(df).collect()} == {("/x/a.txt", "/x/a/a.txt"), ("/x/.bashrc", "/x/.bashrc/.bashrc"), ("/x/noext", "/x/noext/noext")}
    taken = spark.createDataFrame([("/x/a/a.txt",)], "path string")
    assert ("/x/a.txt", "/x/a/a_1.txt") in {tuple(r) for r in files.plan_moves(df, taken).collect()}
    full = spark.createDataFrame([("/x/a/a.txt",), ("/x/a/a_1.txt",), ("/x/a/a_3.txt",), ("/x/a/a_02.txt",)], "path string")
    twice = spark.createDataFrame([("/x/a.txt",), ("/x/a.txt",), ("/x/a.txt",)], "path string")
    assert sorted(r["destination"] for r in files.plan_moves(twice, full).collect()) == ["/x/a/a_2.txt", "/x/a/a_4.txt", "/x/a/a_5.txt"]
    assert {o for *_, o in files.apply_moves(files.plan_moves(df))} == {"planned"}


def test_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("top.txt", "top")
    for name, data in {"a.zip": outer.getvalue(), "temp1.zip": b"", "X_BACKUP.zip": b"", "bad.zip": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = files.archive_entries(spark, str(tmp_path)).collect()
    assert {r["entry"] for r in got if r["status"] == "ok"} == {"inner.zip", "top.txt", "deep.txt"}
    assert [r["archive"].rsplit("/", 1)[1] for r in got if r["status"] != "ok"] == ["bad.zip"]


def test_extraction(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("n/inner.zip", inner.getvalue())
    (tmp_path / "in" / "bad.zip").write_text("no")
    (tmp_path / "in" / "temp.zip").write_text("no")
    (tmp_path / "in" / "empty" / "er").mkdir(parents=True)
    told = lambda **k: {(r["archive"].rsplit("/", 1)[1], r["status"].split(":")[0], r["entries"], r["attempts"]) for r in files.extract_archives(spark, str(tmp_path / "in"), **k).collect()}
    assert told() == {("a.zip", "planned", 1, 1), ("bad.zip", "quarantine", 0, 3)} and not (tmp_path / "in" / "n").exists()
    assert told(dry_run=False, delete=True) == {("a.zip", "extracted", 1, 1), ("bad.zip", "quarantine", 0, 3), ("inner.zip", "extracted", 1, 1)}
    assert sorted(str(p.relative_to(tmp_path / "in")) for p in (tmp_path / "in").rglob("*") if p.is_file()) == ["failed_archives/bad.zip", "n/deep.txt", "temp.zip"]
    assert not (tmp_path / "in" / "empty").exists()


def test_judge_and_embedder(spark, index, tmp_path):
    judge = ap.Judge("pasta", lambda prompt: '{"p": 0.2, "reason": "no"}' if "Context:\npasta" in prompt else "")
    assert judge("salt") == (0.2, "no")
    broken = ap.Judge("pasta", lambda prompt: 1 / 0)
    assert broken("salt") is None and "division" in broken.disabled_reason
    broken.ask = lambda prompt: "0.9"
    assert broken("salt") is None
    asked = spark.createDataFrame([("sea salt",)], "item string")
    out = ap.evaluate(asked, index, ap.PRESETS["normal"], embedder=lambda texts: [[0.95, 0.05] for _ in texts]).first()
    assert out["decision"] == ap.YES and out["best_match"] == "salt"
    for bad in (F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(float("nan"))), F.lit(None).cast("array<float>")):
        wrong = index.withColumn("embedding", F.when(F.col("item") == "salt", bad.cast("array<float>")).otherwise(F.col("embedding")))
        with pytest.raises(ValueError):
            ap.check_index(wrong, 25)
        path = str(tmp_path / f"{hash(str(bad))}")
        index.write.parquet(f"{path}/old")
        wrong.write.parquet(f"{path}/items")
        spark.createDataFrame([(3, 25)], "version int, n_neighbors int").write.json(f"{path}/meta")
        assert "embedding" not in ap.load_index(spark, path)[0].columns
        assert ap.load_index(spark, path, lambda texts: [[1.0, 2.0]] * len(texts))[0].select("embedding").first()[0] == [1.0, 2.0]


def test_neighbours_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(f"i{k}", [float(x) for x in r.normal(size=4)]) for k in range(90)] + [("none", None), ("i7 copy", None)]
    rows[-1] = ("i7 copy", rows[7][1])
    df = spark.createDataFrame(rows, "item string, embedding array<double>")
    q = df.withColumnRenamed("item", "query")
    want = [tuple(x) for x in nb.nearest(df, q, 3, other=True).orderBy("query", "rank").select("query", "item", F.round("sim", 9), "rank").collect()]
    monkeypatch.setattr(nb, "BLOCK", 16)
    got = [tuple(x) for x in nb.nearest(df, q, 3, other=True).orderBy("query", "rank").select("query", "item", F.round("sim", 9), "rank").collect()]
    assert len(want) == 91 * 3 and got == want


def test_batches_of_texts(spark):
    df = spark.range(100).repartition(4).select(F.concat(F.lit("w"), F.col("id")).alias("t"))
    out = se.detect(df, ["t"], batch=32).groupBy("text_index").count().collect()
    assert {r["text_index"]: r["count"] for r in out} == {0: 32, 32: 32, 64: 32, 96: 4}


def test_archives_too_deep(spark, tmp_path):
    data = b"deep"
    for name in ("deep.txt", "c.zip", "b.zip", "a.zip"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(name, data)
        data = held.getvalue()
    (tmp_path / "top.zip").write_bytes(data)
    levels = lambda n: [(r["archive"].rsplit("/", 1)[1], r["entry"], r["status"].split(":")[0]) for r in files.archive_entries(spark, str(tmp_path), n).collect()]
    assert levels(2) == [("top.zip", "a.zip", "ok"), ("top.zip!a.zip", "b.zip", "ok"), ("top.zip!a.zip!b.zip", None, "quarantine")]
    assert levels(4)[-1] == ("top.zip!a.zip!b.zip!c.zip", "deep.txt", "ok") and len(levels(4)) == 4


def test_project_root(tmp_path):
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert str(files.ProjectPath("data", "x.csv", start=str(tmp_path / "a" / "b"))) == str(tmp_path / "data" / "x.csv")


def test_streams(spark, tmp_path):
    from tidemill.streaming.dedup import first_within, windowed_counts

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "k long, t string").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k long, t string").json(str(tmp_path / "in")).withColumn("t", F.to_timestamp("t"))
    for name, df in {"firsts": first_within(stream(), ["k"], "t", "1 hour"), "counts": windowed_counts(stream(), "t", "1 minute", "0 seconds")}.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
    assert [r["n"] for r in spark.table("counts").collect()] == [2]
