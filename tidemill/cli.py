"""Work from a shell.

Decisions about items: ``python -m tidemill.cli --context CONTEXT ITEM... -d recipes.csv -c ingredients``.
Files into folders of their own: ``python -m tidemill.cli organize FOLDER [--apply]``.
Archives, opened beside themselves: ``python -m tidemill.cli extract FOLDER [--apply] [--auto-delete]``.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import logs
from tidemill.functions.items import row_counts, split_items
from tidemill.operators import appropriate as ap
from tidemill.operators import neighbors as nb
from tidemill.sources import files

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    p.add_argument("context", nargs="?", default="", help="what the items are for; items, if --context says it too")
    p.add_argument("items", nargs="*")
    p.add_argument("--context", dest="named_context")
    p.add_argument("-i", "--items-text", default="", help="more items, parted like those of the data")
    p.add_argument("-d", "--dataset", "--data", dest="data", help="CSV file with a header")
    p.add_argument("-c", "--column", default="items")
    p.add_argument("-m", "--model", "--load-index", dest="load_index")
    p.add_argument("--save", "--save-index", dest="save_index")
    p.add_argument("--embeddings", help="Parquet table (item, embedding) of known and asked items")
    p.add_argument("-k", "--k", type=int, default=5)
    p.add_argument("--preset", choices=sorted(ap.PRESETS), default="normal")
    p.add_argument("--min-sim", type=float)
    p.add_argument("--min-freq", type=float)
    p.add_argument("--allow-outlier", action="store_true")
    p.add_argument("--no-lof", action="store_true")
    p.add_argument("--llm", action="store_true", help="ask the scorer that main() is given")
    p.add_argument("--llm-min-p", type=float)
    p.add_argument("--explain", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def items_in(spark: SparkSession, texts: list[str]) -> list[str]:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.posexplode(split_items(F.col("t")))).orderBy("k", "pos")
    return [r["col"] for r in rows.collect()]


def wanted(spark: SparkSession, args: argparse.Namespace, ask=input) -> tuple[str, list[str]]:
    """Context and items; what the arguments lack is asked for."""
    named = args.named_context is not None
    context = (args.named_context if named else args.context).strip()
    items = items_in(spark, [*([args.context] if named and args.context else []), args.items_text, *args.items])
    if not named and context and " " not in context and items:
        log.warning("the context is the single word %r; if it has more words, use --context", context)
    if not context:
        context = ask("Context: ").strip()
    return context, items or items_in(spark, [ask("Items: ").strip()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV source with a header and inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def thresholds_of(args: argparse.Namespace, rows_used: int | None, floor: float) -> ap.Thresholds:
    """The preset's; near them what the data suggest, unless an index was loaded; what is given wins."""
    unit = lambda x: min(1.0, max(0.0, x))
    base = ap.PRESETS[args.preset]
    t = ap.suggest(rows_used, floor, base, args.min_sim, args.min_freq) if rows_used is not None else ap.replace(base, min_sim=base.min_sim if args.min_sim is None else unit(args.min_sim), min_freq=base.min_freq if args.min_freq is None else unit(args.min_freq))
    return ap.replace(t, allow_outlier=args.allow_outlier or base.allow_outlier, llm_enabled=args.llm, llm_min_p=base.llm_min_p if args.llm_min_p is None else unit(args.llm_min_p))


def decide(argv: list[str], scorer=None, ask=input) -> int:
    args = parser().parse_args(argv)
    logs.configure(logging.WARNING if args.quiet else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    context, items = wanted(spark, args, ask)
    if not items:
        log.error("no items")
        return 1
    if args.llm and scorer is None:
        log.warning("there is no scorer, so nothing is vetoed")
    try:
        vectors = spark.read.parquet(args.embeddings).select("item", "embedding") if args.embeddings else None
        rows_used, floor = None, 0.56
        if args.load_index:
            index, _ = ap.load_index(spark, args.load_index)
        else:
            try:
                data = read_csv(spark, os.path.expanduser(args.data)) if args.data else ap.sample(spark, args.column)
            except AnalysisException as e:
                log.error("no dataset: %s", e)
                return 1
            index = ap.build_index(data, args.column)
            rows_used = row_counts(data, args.column).first()["rows_used"]
            if vectors is not None:
                index = index.join(vectors, "item")
                floor = nb.similarity_floor(index)
        if args.save_index:
            ap.save_index(index, args.save_index, max(args.k, 10))
        asked = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "place int, item string")
        odd = None
        if vectors is not None and "embedding" in index.columns:
            asked = asked.join(vectors, "item", "left")
            if not args.no_lof:
                odd = nb.outlier_factors(index, asked.select(ap.normalize_item(F.col("item")).alias("query"), "embedding").where("embedding IS NOT NULL").dropDuplicates(["query"]), 0.08)
        decided = ap.evaluate(asked.drop("place"), index, thresholds_of(args, rows_used, floor), args.k, args.explain, odd, scorer(context) if scorer else None)
        said = dict(tuple(r) for r in decided.select("item", ap.json_line(decided) if args.json else ap.report_line()).collect())
        for item in items:
            print(said[item])
    except Exception as e:
        log.error("failed: %s", e)
        return 2
    return 0


def organize(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tidemill organize")
    p.add_argument("folder")
    p.add_argument("--apply", action="store_true", help="move; else only say what would be")
    p.add_argument("--recursive", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    bare = lambda df: df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    here = bare(files.list_files(spark, args.folder, args.recursive))
    for row in files.apply_moves(files.plan_moves(here, bare(files.list_files(spark, args.folder))), dry_run=not args.apply):
        print("\t".join(row))
    return 0


def extract(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tidemill extract")
    p.add_argument("folder")
    p.add_argument("--apply", action="store_true", help="extract; else only say what would be")
    p.add_argument("--auto-delete", action="store_true")
    p.add_argument("--attempts", type=int, default=3)
    args = p.parse_args(argv)
    out = files.extract_archives(SparkSession.builder.getOrCreate(), os.path.abspath(args.folder), not args.apply, args.auto_delete, args.attempts).collect()
    for r in out:
        print(f"{r['status']}\t{r['archive']}\t{r['entries']}")
    return int(any(r["status"].startswith(("quarantine", "failed")) for r in out))


def main(argv: list[str] | None = None, scorer=None, ask=input) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] in ("organize", "extract"):
        return (organize if argv[0] == "organize" else extract)(argv[1:])
    return decide(argv, scorer, ask)


if __name__ == "__main__":
    sys.exit(main())
