"""The access log as a stream: windowed counts with late data, per-memory state, and pruning by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_accesses(spark, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream of (id, ts, kind)."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "event_id")


def counts(accesses: DataFrame, window: str = "1 day", slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """(id, start, n) per window; state is dropped once the watermark has passed it.

    ``late`` None keeps the watermark that the stream already has (after ``once``, say).
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    marked = accesses if late is None else accesses.withWatermark("ts", late)
    return marked.groupBy(w.alias("w"), "id").agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), "n")


def sessions(accesses: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(id, start, end, n): runs of accesses with no gap longer than ``gap``."""
    w = F.session_window("ts", gap)
    return accesses.withWatermark("ts", late).groupBy(w.alias("w"), "id").agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(accesses: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return accesses.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def activation_state(accesses: DataFrame, late: str = "1 day") -> DataFrame:
    """(id, n, days, last): running totals of each memory, held as state by the engine."""
    import pandas as pd

    def run(key, batches, state):
        n, days, last = state.get if state.exists else (0, 0, 0)
        for rows in batches:
            rows = rows.sort_values("ts")
            for ts in rows["ts"]:
                day = int(ts.timestamp() // 86400)
                days += day != last
                last = max(day, last)
                n += 1
        state.update((n, days, last))
        yield pd.DataFrame({"id": [key[0]], "n": [n], "days": [days], "last": [last]})

    return accesses.withWatermark("ts", late).groupBy("id").applyInPandasWithState(run, "id bigint, n bigint, days bigint, last bigint", "n bigint, days bigint, last bigint", "update", "NoTimeout")


def append_to(accesses: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to the log, exactly once per batch id; returns the started query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return accesses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
