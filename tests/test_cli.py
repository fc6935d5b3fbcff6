import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

from tidemill import cli, logs

ROOT = Path(__file__).resolve().parents[1]


def test_lines(spark, tmp_path, capsys):
    (tmp_path / "r.csv").write_text('ingredients\n"salt, pepper"\n"salt; sugar"\n')
    assert cli.main(["pasta", "Salt", "--data", str(tmp_path / "r.csv"), "-c", "ingredients", "--json", "--save-index", str(tmp_path / "i")]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(x["item"], x["decision"]) for x in out] == [("Salt", "Appropriate")]
    assert cli.main(["", "pepper", "--load-index", str(tmp_path / "i")], ask=lambda _: "soup") == 0
    assert "pepper: Appropriate (score=" in capsys.readouterr().out
    assert cli.main(["x", "salt", "--data", str(tmp_path / "none.csv")]) == 1
    assert cli.main([], ask=lambda _: "") == 1
    assert cli.main(["x", "salt", "--load-index", str(tmp_path / "none")]) == 2


def test_items(spark, caplog):
    args = cli.parser().parse_args(["first", "last", "--context", "soup", "--items-text", "a, b"])
    assert cli.wanted(spark, args) == ("soup", ["first", "a", "b", "last"])
    answers = iter(["soup", "a; b"])
    assert cli.wanted(spark, cli.parser().parse_args([]), lambda _: next(answers)) == ("soup", ["a", "b"])
    cli.wanted(spark, cli.parser().parse_args(["pasta", "tofu"]))
    assert "single word" in caplog.text


def test_neighbours_outliers_and_veto(spark, tmp_path, capsys):
    known = {"salt": [1.0, 0.0], "pepper": [0.9, 0.1], "sugar": [0.0, 1.0]}
    (tmp_path / "r.csv").write_text('items\n"salt, pepper"\n"salt; sugar; pepper"\n')
    rows = [*known.items(), ("sea salt", [0.95, 0.05])]
    spark.createDataFrame(rows, "item string, embedding array<float>").write.parquet(str(tmp_path / "e"))
    args = ["pasta dishes", "-i", "", "--context", "pasta dishes", "-d", str(tmp_path / "r.csv"), "--embeddings", str(tmp_path / "e"), "--explain", "-k", "2"]
    assert cli.main([*args[3:], "sea salt"]) == 0
    out = capsys.readouterr().out
    assert "sea salt: Appropriate" in out and "  Neighbors:\n    - salt" in out and out.count("    - ") == 2
    assert cli.main([*args[3:], "salt", "--llm"], scorer=lambda context: lambda item: (0.0, f"{item} in {context}")) == 0
    assert "LLM veto: salt in pasta dishes" in capsys.readouterr().out


def test_folders(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("new")
    (tmp_path / "a").mkdir()
    for name in ("a.txt", "a_1.txt"):
        (tmp_path / "a" / name).write_text("old")
    assert cli.main(["organize", str(tmp_path)]) == 0 and (tmp_path / "a.txt").exists()
    assert cli.main(["organize", str(tmp_path), "--apply"]) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "a").iterdir()} == {"a.txt": "old", "a_1.txt": "old", "a_2.txt": "new"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.txt", "x")
    (tmp_path / "bad.zip").write_text("no")
    assert cli.main(["extract", str(tmp_path)]) == 1 and (tmp_path / "z.zip").exists()
    assert cli.main(["extract", str(tmp_path), "--apply", "--auto-delete"]) == 1
    assert (tmp_path / "d" / "x.txt").read_text() == "x" and not (tmp_path / "z.zip").exists() and (tmp_path / "failed_archives" / "bad.zip").exists()


def test_log_file(tmp_path):
    logs.configure(path=str(tmp_path / "log")).info("hello")
    assert "INFO - hello" in (tmp_path / "log").read_text()
    logs.configure()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_workers_elsewhere_can_import(tmp_path):
    """A driver that starts in another folder, with the repository on its own path only."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()
parts = {str(tmp_path)!r}
spark.createDataFrame([(50, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>").write.parquet(parts + "/embeddings.parquet")
assert __spark_entry__.queries()["knn_topk"](spark, parts).count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=300).returncode == 0
