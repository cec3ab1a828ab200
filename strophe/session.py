"""Session helpers: shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's ``spark.checkpoint.dir`` decides. Where it is unset a session on one machine (tests, a laptop) gets a temporary
    folder; on a cluster a folder of one machine would be lost with it, so this is an error.
    """
    sc = spark.sparkContext
    set_by_session = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not set_by_session:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        set_by_session = tempfile.mkdtemp(prefix="strophe-ckpt-")
        atexit.register(shutil.rmtree, set_by_session, True)
    sc.setCheckpointDir(set_by_session)
    return set_by_session


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Removes what ``cut`` wrote of a table that nothing needs any more, so that rounds do not fill the shared folder. Only for tables
    that never left the function that cut them. A table that was not cut, and a folder that cannot be removed, are left as they are."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    at = plan.rdd().getCheckpointFile()
    if at.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which operators size their own splits."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small table over the cores before a Python stage.

    A scan packs small files into few tasks; a CPU-bound kernel behind it would then use few cores.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parallelism(df.sparkSession)))


def even(df: DataFrame) -> DataFrame:
    """Rows before a CPU-bound kernel over texts: as they come where the scan has cut them finely, else dealt out evenly.

    A scan packs rows into few tasks of unequal work. Only where it has fewer than two tasks a core, so that cores would idle, do the
    texts move at all; a table larger than that needs no help.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)


def once(key: Hashable, make: Callable):
    """What ``make`` gives, made once in this process. Functions travel to workers by value and bring their own globals along, so the
    results are held by a module of their own; the last few keys are kept."""
    held = sys.modules.setdefault("_strophe_held", types.ModuleType("_strophe_held")).__dict__.setdefault("made", {})
    if key not in held:
        while len(held) > 8:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are written to be read again."""
    return f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}/{name}"
