"""Adapters from the driver's tables to the engine's records, and the same as DuckDB text.

``mem``: documents as memories whose metadata follow from the id by arithmetic. ``ver``: events as a
version log. ``acc``: events as an access log. ``edge``: typed weighted edges between similar vectors.
``dlg``: conversations as transcripts. ``sess``: events of a user and day as step sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"

#: Columns of ``mem`` in SQL that both engines read alike; ages are whole hours before NOW.
MEM = {
    "id": "doc_id",
    "ns": "'src:' || source",
    "key": "'k' || cast(doc_id // 2 AS VARCHAR)",
    "content": "coalesce(text, '')",
    "kind": "CASE doc_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' ELSE 'procedural' END",
    "tier": "CASE doc_id % 5 WHEN 0 THEN 'sensory' WHEN 3 THEN 'ltm' WHEN 4 THEN 'dormant' ELSE 'stm' END",
    "priority": "CASE doc_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'normal' END",
    "importance": "(doc_id * 37 % 100) / CAST(100 AS DOUBLE)",
    "access_count": "doc_id * 13 % 120",
    "utility_count": "doc_id * 7 % 40",
    "pinned": "doc_id % 50 = 0",
    "locked": "doc_id % 40 = 0",
    "age_hours": "(doc_id * 17) % 2003",
    "idle_hours": "(doc_id * 17) % 2003 * (doc_id % 4) // 4",
    "expires_in_hours": "CASE WHEN doc_id % 9 = 0 THEN doc_id % 21 - 10 END",
    "deleted_hours": "CASE WHEN doc_id % 23 = 0 THEN doc_id % 1500 END",
    "valid_from_hours": "CASE WHEN doc_id % 8 = 0 THEN (doc_id * 17) % 2003 + 24 END",
    "valid_to_hours": "CASE WHEN doc_id % 16 = 0 THEN doc_id % 700 END",
    "lang": "lang",
    "source": "source",
    "source_user": "'user' || cast(doc_id % 5 AS VARCHAR)",
    "source_kind": "CASE doc_id % 4 WHEN 0 THEN 'stated' WHEN 1 THEN 'observed' WHEN 2 THEN 'self' ELSE 'peer' END",
}


def _spark(expression: str) -> str:
    return expression.replace("//", "DIV").replace("VARCHAR", "STRING")


class Tables:
    """The driver's tables and their adapters, read lazily from one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def mem(self, *columns: str) -> DataFrame:
        """Memories; only the named columns are read."""
        return self.documents.selectExpr(*[f"{_spark(MEM[c])} AS {c}" for c in columns or MEM])

    def live(self, *columns: str) -> DataFrame:
        """Memories that are neither deleted nor expired."""
        need = list(dict.fromkeys([*columns, "deleted_hours", "expires_in_hours"])) if columns else list(MEM)
        rows = self.mem(*need).filter("deleted_hours IS NULL AND (expires_in_hours IS NULL OR expires_in_hours > 0)")
        return rows.select(*columns) if columns else rows

    def ver(self) -> DataFrame:
        """(id, ns, key, version, ts, value, deleted)."""
        order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("ns"),
            F.col("event_type").alias("key"),
            F.row_number().over(order).alias("version"),
            "ts",
            "value",
            (F.col("event_id") % 11 == 0).alias("deleted"),
        )

    def vectors(self) -> DataFrame:
        """(id, label, v): vectors of unit length in doubles."""
        v = F.transform("embedding", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return self.embeddings.select(F.col("vec_id").alias("id"), "label", F.transform(v, lambda x: x / norm).alias("v"))

    def dlg(self) -> DataFrame:
        """(id, content): 'role: text' lines of a conversation in turn order."""
        line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
        return self.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l")).select("id", F.expr("array_join(transform(l, x -> x.line), '\n')").alias("content"))

    def sess(self) -> DataFrame:
        """(sid, steps): event types of a user and day in order."""
        day = F.date_format("ts", "yyyy-MM-dd")
        sid = F.concat_ws("/", F.col("user_id").cast("string"), day)
        return self.events.groupBy(sid.alias("sid")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e")).select("sid", F.expr("transform(e, x -> x.event_type)").alias("steps"))


def mem_sql(*columns: str) -> str:
    return "SELECT " + ", ".join(f"{MEM[c]} AS {c}" for c in columns or MEM) + " FROM documents"


def live_sql(*columns: str) -> str:
    return mem_sql(*columns) + " WHERE NOT (doc_id % 23 = 0) AND (doc_id % 9 <> 0 OR doc_id % 21 - 10 > 0)"


VER_SQL = """SELECT event_id AS id, 'user:' || user_id AS ns, event_type AS key,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, ts, value, event_id % 11 = 0 AS deleted FROM events"""
VEC_SQL = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"
DLG_SQL = "SELECT conv_id AS id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1"
SESS_SQL = "SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS sid, list(event_type ORDER BY ts, event_id) AS steps FROM events GROUP BY 1"
