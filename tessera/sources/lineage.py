"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only in local mode, where that may be unset, a temporary folder is taken. The shuffle files of the lineage that was
    cut off are removed at once; `df` itself must not be run again, frames made from it may.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    out = df.checkpoint(eager=True)
    cleaner = context._jsc.sc().cleaner()
    if cleaner.isDefined():
        for shuffle in _shuffles(df._jdf.queryExecution().toRdd()):
            cleaner.get().doCleanupShuffle(shuffle, False)
    return out


def release(context: SparkContext, *frames: DataFrame) -> None:
    """Delete the checkpoint files of frames that `cut` returned and that nothing will read again."""
    for frame in frames:
        file = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.sc().hadoopConfiguration()).delete(path, True)


def _shuffles(rdd: JavaObject) -> set[int]:
    """Shuffles that an RDD depends on and that it shares with no stored one."""
    found, seen, todo = set(), set(), [rdd]
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen or rdd.getStorageLevel().isValid():
            continue
        seen.add(rdd.id())
        dependencies = rdd.dependencies()
        for at in range(dependencies.size()):
            dependency = dependencies.apply(at)
            if dependency.getClass().getSimpleName() == "ShuffleDependency":
                found.add(dependency.shuffleId())
            todo.append(dependency.rdd())
    return found
