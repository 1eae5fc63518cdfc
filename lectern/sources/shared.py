"""The folder that driver and executors share, and tables that are kept there for one session."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker: several of these are held at once, on both sides.
BATCH = "8m"
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and take batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it.  A folder of this machine serves only where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="lectern-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Spark removes the files once nothing refers to them, where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in whatever store it lies."""
    place, store = _place(spark, path)
    store.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a file or folder a name that nothing has yet."""
    place, store = _place(spark, path)
    target, _ = _place(spark, to)
    if store.exists(target) or not store.rename(place, target):
        raise FileExistsError(to)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The paths in a folder, in order."""
    place, store = _place(spark, folder)
    return sorted(str(f.getPath().toString()) for f in store.listStatus(place))


def replace(spark: SparkSession, path: str, to: str) -> None:
    """Give a file a name, whatever has it; the step is atomic where the store's renaming is."""
    sc = spark.sparkContext
    jvm = sc._jvm.org.apache.hadoop.fs
    place, store = _place(spark, path)
    target, _ = _place(spark, to)
    how = sc._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    how[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(store.getUri(), sc._jsc.hadoopConfiguration()).rename(place, target, how)
