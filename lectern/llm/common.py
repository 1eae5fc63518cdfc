"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder

__all__ = ["added_up", "cut", "pick", "read", "remove", "shared_folder", "ship", "small", "stretches", "turn"]
ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of a batch that goes to a Python worker: several of these are held at once, on both sides.
BATCH = "8m"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and take batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


#: What operators keep in a Python worker between tasks, by their names, and how they let it go; and whose turn it is.
_KEPT: dict[str, Callable[[], None]] = {}
_TURN = [""]


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Say that ``owner`` keeps something between the tasks of a worker, and how to let it go."""
    _KEPT[owner] = forget


def turn(owner: str) -> None:
    """Begin a task of ``owner`` in a Python worker.

    Workers serve many operators one after the other.  When the turn changes,
    what the others keep is let go, and the memory goes back to the system.
    """
    if _TURN[0] == owner:
        return
    _TURN[0] = owner
    for name, forget in _KEPT.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not that C library


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name before any other spelling.

    Columns are taken by position, so further columns cannot clash with them.
    """
    places = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        close = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or close):
            raise ValueError(f"no column {name!r} among {df.columns}")
        places.append((exact or close)[0])
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def small(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; looks at no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


#: Numbers in one row of a vector that tasks add up.
STRETCH = 4_096


def stretches(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A vector as columns (at, counts) of rows of STRETCH numbers."""
    cuts = np.minimum(np.arange(0, len(total) + STRETCH, STRETCH), len(total))
    rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(total, pa.int64()))
    return pa.array(range(len(rows)), pa.int32()), rows


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` numbers whose ``stretches`` (at, counts) the rows are.

    A task gives each stretch once, so nothing is left to add before they are dealt: a second Python worker beside each
    task's own would only take memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("added_up")
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = row.values.to_numpy(zero_copy_only=False)
                sums[at] = sums[at] + own if at in sums else own.copy()
        for at, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own], pa.list_(pa.int64()))], ["at", "counts"])

    schema = "at int, counts array<long>"
    found = parts.select("at", "counts").repartition("at").mapInArrow(run, schema)
    out = np.zeros(size, np.int64)
    for r in found.collect():  # ``size`` numbers
        out[r.at * STRETCH : r.at * STRETCH + len(r.counts)] = r.counts
    return out
