"""Session helpers: where intermediate tables go, how the package reaches the workers, how scans are dealt out."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an action removes its shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors for intermediate tables.

    ``spark.checkpoint.dir`` decides. A folder of our own is made only where the setting is unset and Spark runs
    inside a single machine (``local[...]``, as in tests); on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(context, "_helixmill_root", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="helixmill-")
        context._helixmill_root = own
        atexit.register(_remove_local, own)
    return f"file://{own}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once, so that they find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_helixmill_shipped", False):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="helixmill-")
    atexit.register(_remove_local, folder)
    packed = f"{folder}/helixmill-{uuid.uuid4().hex[:12]}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(packed)
    context._helixmill_shipped = True


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{checkpoint_root(spark)}/helixmill/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files as they end; else these stay until the driver's garbage is collected."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts its lineage.

    A lost executor then costs no recomputation of what came before, and the shuffle files behind the table go at once.
    The table is removed by ``discard``, or when the driver's Python ends, since results that are still lazy may read it
    until then.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` gave and that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table._helixmill_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder then stays for its owner to clear
        pass


#: Session setting: number of tasks that scans are dealt out to before Python works on them.
TASKS = "spark.helixmill.scanTasks"


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to as many tasks as ``spark.helixmill.scanTasks`` says; where it is unset, scans stay as they are.

    For tables in fewer files than the session has cores (as in a benchmark on one machine). Rows lose their order.
    """
    tasks = df.sparkSession.conf.get(TASKS, None)
    return df if tasks is None or df.isStreaming else df.repartition(int(tasks))
