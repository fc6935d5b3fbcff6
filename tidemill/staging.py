"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests, a laptop)
    a temporary folder of this machine is taken and set for the rest of the
    session; on a cluster that is an error, as executors wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where staged tables are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for a while."""
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that
    read the table. The shuffle files of what was written go at once; the table
    goes when it is released, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _folder(spark, path, lambda files, folder: files.deleteOnExit(folder))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _folder(spark: SparkSession, path: str, action: Callable) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    action(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            _folder(table.sparkSession, path, lambda files, folder: files.delete(folder, True))


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Applications whose workers have this package.
_SENT: set[str] = set()


def portable(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, which first sends this package to Python workers, once for an application.

    Workers import what is sent to them by name. They start in folders of their
    own, so what the driver has on its path is not on theirs.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        context, home = spark.sparkContext, Path(__file__).resolve().parent
        if context.applicationId not in _SENT and home.is_dir():
            packed = Path(tempfile.mkdtemp(prefix=f"{home.name}-")) / f"{home.name}.zip"
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
                for source in sorted(home.rglob("*.py")):
                    out.write(source, source.relative_to(home.parent))
            context.addPyFile(str(packed))
            _SENT.add(context.applicationId)
        return query(spark, *args)

    return run
