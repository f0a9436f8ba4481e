"""Session factory and the two session-level helpers that every operator shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def make_session(master: str = "local[*]", app: str = "tesserae", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable folder of the session, set if it isn't yet (see ``cut_lineage``)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there.

    The folder is the one named by ``spark.checkpoint.dir``. Only where that is unset and executors share this machine (local tests)
    a temporary folder is used; on a cluster it is an error. Checkpoints that nothing refers to any more are removed if the session
    was made with ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``make_session`` does.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by_key(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``cut_lineage`` of ``df`` in ``parts`` parts by the hash of ``key``, sorted by it: a join on ``key`` then moves and sorts the other side only.

    Adaptive execution hides how its result is partitioned, so it is off for this one write.
    """
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        return cut_lineage(df.repartition(parts, key).sortWithinPartitions(key))
    finally:
        conf.set(adaptive, before)


def release(spark: SparkSession) -> None:
    """Gives up shuffle files and checkpoints that nothing refers to any more: Spark removes them when the driver collects its garbage, which may be too late for the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
