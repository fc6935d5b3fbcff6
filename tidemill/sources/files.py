"""Files as tables: listings, level chains, move plans, archives. Only ``apply_moves`` changes anything."""

from __future__ import annotations

import io
import itertools
import os
import shutil
import wave
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.staging import parallelism, stage

# Suffixes that have a duration, and what an archive's name excludes.
MEDIA = (".mp3", ".wav", ".flac", ".ogg", ".m4a", ".mp4", ".aac", ".aiff", ".opus")
TEMPORARY, BACKUP = "temp", "_backup.zip"


def list_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length)`` of regular files; contents aren't read."""
    return _binary(spark, path, recursive, glob).drop("content")


def _binary(spark: SparkSession, path: str, recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix, in its own case; ``file`` without one."""
    found = F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)
    return F.when(found == "", "file").otherwise(found)


def levels(path: Column, root: str, compat: bool = False) -> Column:
    """The chain of (name, type) from the root folder to the file.

    ``compat`` gives the chain of a scanner that repeats the root and leaves
    out the file's own folder.
    """
    root = root.rstrip("/")
    top = root.rsplit("/", 1)[-1]
    rest = F.split(F.replace(path, F.lit(root + "/"), F.lit("")), "/")
    folders = F.slice(rest, 1, F.size(rest) - 1)
    folders = F.when(F.size(folders) > 0, F.concat(F.array(F.lit(top)), F.array(F.lit(top)), F.slice(folders, 1, F.size(folders) - 1))).otherwise(F.array(F.lit(top))) if compat else F.concat(F.array(F.lit(top)), folders)
    pair = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    last = F.element_at(rest, -1)
    return F.concat(F.transform(folders, lambda x: pair(x, F.lit("folder"))), F.array(pair(last, suffix(last))))


def media(path: Column) -> Column:
    """Whether the suffix, in any case, is of a kind of file that has a duration."""
    return F.lower(suffix(name_of(path))).isin(list(MEDIA))


def clock(seconds: Column) -> Column:
    """MM:SS; minutes may exceed 59; empty for null."""
    whole = F.floor(seconds)
    return F.when(seconds.isNull(), "").otherwise(F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60))


def _seconds(data: bytes | None) -> float | None:
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, TypeError, ZeroDivisionError):
        return None


def wave_seconds(content: Column) -> Column:
    """Length of WAV bytes; null for anything else."""

    @F.pandas_udf("double")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(_seconds).astype(float)

    return run(content)


def media_table(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """``(levels, duration)`` of each file under ``path``; durations of WAV files, empty for others."""
    root = path if "://" in path or path.startswith("file:") else f"file:{os.path.abspath(path)}"
    # Contents are read of WAV files only; those of other media would need a decoder.
    heard = _binary(spark, path, True, "*.[wW][aA][vV]").select("path", wave_seconds(F.col("content")).alias("seconds"))
    files = list_files(spark, path).join(heard, "path", "left")
    seconds = F.when(media(F.col("path")), F.col("seconds"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "file:/")
    return files.select(levels(bare(F.col("path")), "file:/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root, compat).alias("levels"), clock(seconds).alias("duration"))


def widen(table: DataFrame) -> DataFrame:
    """``Level_i, Level_i_type`` as deep as the deepest chain, then ``Duration``; missing levels are empty."""
    depth = table.agg(F.max(F.size("levels"))).first()[0] or 0
    cells = []
    for i in range(1, depth + 1):
        level = F.try_element_at("levels", F.lit(i))
        cells += [F.coalesce(level["name"], F.lit("")).alias(f"Level_{i}"), F.coalesce(level["type"], F.lit("")).alias(f"Level_{i}_type")]
    return table.select(*cells, F.col("duration").alias("Duration"))


def save_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def stamped(folder: str, now: datetime | None = None) -> str:
    """Name of a table of a folder: its own name and the time."""
    return f"{os.path.basename(folder.rstrip('/'))}_{(now or datetime.now()):%Y%m%d_%H%M%S}.csv"


def plan_moves(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(path, destination)``: each file into a folder named like it without its suffix.

    Where ``existing(path)`` has the destination, the file gets the first of _1,
    _2, ... before the suffix that is free; of files that would meet, the later
    the next free one.
    """
    name = name_of(F.col("path"))
    folder = F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)))")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    tail = F.expr("substring(name, length(stem) + 1)")
    plan = files.select("path", folder.alias("folder"), name.alias("name"), stem.alias("stem")).withColumn("tail", tail).withColumn("wanted", F.concat("folder", "stem", F.lit("/"), "name"))
    if existing is None:
        existing = files.sparkSession.createDataFrame([], "path string")
    # A file that is there takes its own name, and, if a number ends its stem, that number of the name without it.
    numbered = r"^(.*)_([1-9][0-9]{0,8})((?:\.[^./]+)?)$"
    own = F.struct(F.col("path").alias("wanted"), F.lit(0).cast("long").alias("n"))
    other = F.struct(F.concat(F.regexp_extract("path", numbered, 1), F.regexp_extract("path", numbered, 3)).alias("wanted"), F.try_to_number(F.nullif(F.regexp_extract("path", numbered, 2), F.lit("")), F.lit("999999999")).cast("long").alias("n"))
    taken = existing.select(F.explode(F.array(own, other)).alias("t")).select("t.*").where("n IS NOT NULL").groupBy("wanted").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    turn = F.row_number().over(Window.partitionBy("wanted").orderBy("path")).cast("long") - 1
    plan = plan.withColumn("turn", turn).join(taken, "wanted", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    n = F.aggregate("taken", F.col("turn"), lambda free, x: F.when(x <= free, free + 1).otherwise(free))
    return plan.withColumn("n", n).select("path", F.when(F.col("n") == 0, F.col("wanted")).otherwise(F.concat("folder", "stem", F.lit("/"), "stem", F.lit("_"), F.col("n").cast("string"), "tail")).alias("destination"))


def _free(path: str) -> str:
    stem, tail = os.path.splitext(path)
    return next(p for p in itertools.chain([path], (f"{stem}_{n}{tail}" for n in itertools.count(1))) if not os.path.lexists(p))


def apply_moves(plan: DataFrame, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """Move local files one after the other; ``(path, destination, outcome)``.

    A file is never replaced: if the destination has been taken since the plan,
    the next free number is.
    """
    done = []
    for path, destination in ((r[0].removeprefix("file:"), r[1].removeprefix("file:")) for r in plan.toLocalIterator()):
        outcome = "planned"
        if not dry_run:
            try:
                os.makedirs(os.path.dirname(destination), exist_ok=True)
                destination = _free(destination)
                shutil.move(path, destination)
                outcome = "moved"
            except OSError as e:
                outcome = f"failed: {e}"
        done.append((path, destination, outcome))
    return done


def remove_empty_folders(path: str) -> list[str]:
    """Folders under a local path without anything in them go, from below; their paths."""
    gone = []
    for folder, _, _ in os.walk(path, topdown=False):
        if folder != path and not os.listdir(folder):
            os.rmdir(folder)
            gone.append(folder)
    return gone


def wanted_archive(path: Column, excluded_names: Iterable[str] = (), excluded_folders: Iterable[str] = (), suffixes: Iterable[str] = (".zip", ".rar")) -> Column:
    """Archives by suffix, in its own case, that no rule excludes: names, temp*, *_backup.zip, parts of folders."""
    name, folder = name_of(path), F.lower(F.regexp_replace(path, "/[^/]*$", ""))
    known = F.lit(False)
    for s in suffixes:
        known = known | name.endswith(s)
    out = name.isin(list(excluded_names)) | F.lower(name).startswith(TEMPORARY) | F.lower(name).endswith(BACKUP)
    for f in excluded_folders:
        out = out | folder.contains(f.lower())
    return known & ~out


_ENTRY = "archive string, entry string, length long, status string, content binary"


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of ZIP bytes; nested archives with their content. One that can't be read gives a row that says so."""
    for rows in batches:
        for path, data in zip(rows["path"], rows["content"], strict=True):
            out = []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    if bad := z.testzip():
                        raise zipfile.BadZipFile(f"bad entry {bad}")
                    for info in z.infolist():
                        if not info.is_dir():
                            out.append((path, info.filename, info.file_size, "ok", z.read(info) if info.filename.endswith(".zip") else None))
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
                out = [(path, None, None, f"quarantine: {e}", None)]
            yield pd.DataFrame(out, columns=["archive", "entry", "length", "status", "content"])


def archive_entries(spark: SparkSession, path: str, most_levels: int = 32, **exclusions) -> DataFrame:
    """``(archive, entry, length, status)`` of ZIP archives under ``path`` and, level by level, of archives in them.

    A nested archive's path is ``outer.zip!inner.zip``; a path is opened once.
    An archive may hold itself, so archives nested deeper than ``most_levels``
    stay closed, each with a quarantine row of its own. Nothing is written beside the archives.
    """
    found = None
    now = _binary(spark, path, True, "*.zip").where(wanted_archive(F.col("path"), **exclusions)).select("path", "content")
    for _ in range(most_levels):
        level = stage(now.mapInPandas(_opened, _ENTRY), "entries")
        found = level.drop("content") if found is None else found.unionByName(level.drop("content"))
        now = level.where("content IS NOT NULL").select(F.concat("archive", F.lit("!"), "entry").alias("path"), "content")
        if now.isEmpty():
            return found
    closed = F.lit(f"quarantine: deeper than {most_levels} levels").alias("status")
    return found.unionByName(now.select(F.col("path").alias("archive"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("long").alias("length"), closed))


def _extracted(path: str, failed: str, attempts: int, delete: bool, dry_run: bool) -> tuple[str, int, int]:
    """Status, entries and attempts of a local archive that is opened beside itself."""
    for attempt in range(1, attempts + 1):
        try:
            with zipfile.ZipFile(path) as z:
                if bad := z.testzip():
                    raise zipfile.BadZipFile(f"bad entry {bad}")
                names = [x for x in z.infolist() if not x.is_dir()]
                if dry_run:
                    return "planned", len(names), attempt
                z.extractall(os.path.dirname(path))
            if delete and names:
                os.remove(path)
            return "extracted", len(names), attempt
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
            problem = f"quarantine: {e}"
        except OSError as e:
            problem = f"failed: {e}"
    if not dry_run and problem.startswith("quarantine"):
        os.makedirs(failed, exist_ok=True)
        shutil.move(path, _free(os.path.join(failed, os.path.basename(path))))
    return problem, 0, attempts


def extract_archives(spark: SparkSession, path: str, dry_run: bool = True, delete: bool = False, attempts: int = 3, most_levels: int = 32, **exclusions) -> DataFrame:
    """``(archive, status, entries, attempts)`` of ZIP archives under a folder that all machines share, each opened beside itself.

    What comes out is looked through for archives again, until there are none
    or, as an archive may hold itself, ``most_levels`` are done; the rest then
    has status ``closed``. An archive that can't be read after ``attempts`` goes
    to the folder ``failed_archives``. ``delete`` removes opened ones, and then
    folders left empty. A dry run opens nothing and so sees the first level.
    """
    root = path.removeprefix("file:")
    failed = os.path.join(root, "failed_archives")
    seen, out, schema = set(), [], "archive string, status string, entries long, attempts long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = [_extracted(p, failed, attempts, delete, dry_run) for p in rows["path"]]
            yield pd.DataFrame([(p, *t) for p, t in zip(rows["path"], told, strict=True)], columns=["archive", "status", "entries", "attempts"])

    def waiting() -> list[str]:
        # Listing files is the driver's work; a list of paths is what comes of it.
        names = [os.path.join(d, f) for d, _, names in os.walk(root) if not d.startswith(failed) for f in sorted(names) if f.endswith(".zip")]
        held = spark.createDataFrame([(p,) for p in names if p not in seen], "path string")
        return [r["path"] for r in held.where(wanted_archive(F.col("path"), **exclusions)).collect()]

    for _ in range(most_levels):
        now = waiting()
        if not now:
            break
        seen.update(now)
        tasks = spark.createDataFrame([(p,) for p in now], "path string").repartition(min(len(now), parallelism(spark)))
        out += [tuple(r) for r in tasks.mapInPandas(run, schema).collect()]
        if dry_run:
            break
    else:
        out += [(p, "closed", 0, 0) for p in waiting()]
    if delete and not dry_run:
        remove_empty_folders(root)
    return spark.createDataFrame(out, schema)


class ProjectPath:
    """Paths under the nearest folder above that has one of some markers."""

    markers = (".git", "pyproject.toml", "setup.py", "requirements.txt")
    _roots: dict[tuple[str, tuple[str, ...]], Path] = {}

    def __init__(self, *parts: str, start: str | None = None):
        self.start, self.parts = Path(start or os.getcwd()).resolve(), parts

    @classmethod
    def add_marker(cls, marker: str) -> None:
        cls.markers = (*cls.markers, marker)
        cls._roots.clear()

    @property
    def root(self) -> Path:
        key = (str(self.start), self.markers)
        if key not in self._roots:
            found = next((p for p in (self.start, *self.start.parents) if any((p / m).exists() for m in self.markers)), None)
            if found is None:
                raise FileNotFoundError(f"no {self.markers} above {self.start}")
            self._roots[key] = found
        return self._roots[key]

    def path(self) -> Path:
        return self.root.joinpath(*self.parts)

    def __fspath__(self) -> str:
        return str(self.path())

    __str__ = __fspath__
