"""Session defaults shared by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("mnemo")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors must share.

    Where it is unset, a session of one process (local[...]) has a folder of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        at = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at.rstrip("/")
