"""Places that all executors share, and tables in them that cut lineage."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from mnemo.session import shared_dir


BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
COLLECT_SECONDS = 5.0
_collected = 0.0


def small_batches(spark: SparkSession) -> None:
    """Bound what the JVM and a Python worker hold of a stream of Arrow batches, in bytes and rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written rows (cuts lineage)."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and let Spark drop the shuffles behind them."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            df._written_to = None
    global _collected
    if tables and time.monotonic() - _collected > COLLECT_SECONDS:
        tables[0].sparkSession._jvm.System.gc()  # Spark deletes shuffle files once the driver has dropped their plans
        _collected = time.monotonic()
