"""Session helpers: configuration for local runs, and where lineage is cut."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomtext", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    n = cpus or min(8, os.cpu_count() or 1)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package, and the modules beside it, to the executors of a session that can't import them yet."""
    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "loomtext.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in [*(root / "loomtext").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
                out.write(file, file.relative_to(root))
        spark.sparkContext.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names in ``spark.checkpoint.dir``.

    Only where that is unset and the session is local, as in tests, a temporary folder of this machine is used; on a
    cluster without the setting this raises an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from reliable storage (``shared_folder``), so that later stages don't recompute them."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def executed(df: DataFrame) -> DataFrame:
    """The same rows for several jobs, which share the shuffle files of one execution; within one job Spark does so by itself. Without Spark's internal method: ``df``."""
    session = getattr(df.sparkSession, "_jsparkSession", None)
    if not hasattr(session, "internalCreateDataFrame"):
        return df
    return DataFrame(session.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), df.sparkSession)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomtext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of what is no longer needed once rows are stored: Spark frees shuffle files when the driver has collected what refers to them.

    A shuffle before another one is freed a round later.
    """
    for _ in range(6):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of what is executed as soon as that has ended, without waiting for the driver's collector.

    For frames that are made and cut within, once; a Spark before 4.1 doesn't know the setting and frees them later.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    """Without a session any more there is nobody to ask; the files stay for whoever cleans the folder."""
    if spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sized(df: DataFrame, rows: int, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows, with what a hash relation adds to each, take ``most`` bytes; else a join with it shuffles."""
    return F.broadcast(df) if rows * (row_bytes + 64) <= most else df
