"""Readers and writers: memories as JSON lines, markdown folders, dialogue benchmarks, embedding caches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = (
    "id string, ns string, key string, content string, kind string, tags array<string>, version int, supersedes string, created_at timestamp, "
    "deleted_at timestamp, priority string, access_count int, last_accessed_at timestamp, meta string, expires_at timestamp, importance double, "
    "utility_count int, tier string, est_tokens int, pinned boolean, ease double, valid_from timestamp, valid_to timestamp, source_user string, "
    "source_kind string, source_scope string, files array<struct<path:string,rel:string>>"
)
TURNS = "array<struct<role:string,content:string,has_answer:boolean>>"
LONG_DIALOGUES = f"question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<{TURNS}>, answer_session_ids array<string>"
FACT_TRACKS = "id string, context string, questions array<string>, answers array<array<string>>"


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; missing fields are null."""
    return spark.read.schema(MEMORY).json(path)


def write_memories(rows: DataFrame, path: str) -> None:
    """Live rows as JSON lines in order of ns, key, version."""
    rows.filter("deleted_at IS NULL").repartitionByRange("ns", "key", "version").sortWithinPartitions("ns", "key", "version").write.json(path)


def import_memories(news: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (ns, key, content) is not there yet, as they are."""
    have = existing.select("ns", "key", F.sha2("content", 256).alias("__h")).distinct()
    return news.withColumn("__h", F.sha2("content", 256)).join(have, ["ns", "key", "__h"], "left_anti").drop("__h")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, date, pos, heading, key, body) of the sections of every file."""
    from mnemo.operators.mining import sections

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("text"))
    day = F.regexp_extract("id", r"(\d{4}-\d{2}-\d{2})", 1)
    return sections(files).select(F.col("id").alias("file"), F.when(day != "", day).alias("date"), "pos", "heading", "key", "body")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(sid, steps): one session per line, steps parted by white space."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("sid"), F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)).alias("steps"))


def read_candidates(rows: DataFrame, column: str = "value") -> DataFrame:
    """Captured candidates from JSON arrays of {content, kind, importance, cues}."""
    kind = "array<struct<content:string,kind:string,importance:double,cues:array<string>>>"
    return rows.select(F.explode(F.from_json(column, kind)).alias("c")).select("c.*")


def read_long_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, questions): (qid, sid, date, content) and (qid, kind, question, answer, relevant); '_abs' questions left out."""
    rows = spark.read.schema(LONG_DIALOGUES).option("multiLine", True).json(path).filter(~F.col("question_id").endswith("_abs"))
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    s = rows.select(F.col("question_id").alias("qid"), F.explode(zipped).alias("s"))
    text = F.array_join(F.transform(F.col("s.haystack_sessions"), lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    sessions = s.select("qid", F.col("s.haystack_session_ids").alias("sid"), F.col("s.haystack_dates").alias("date"), text.alias("content"))
    return sessions, rows.select(F.col("question_id").alias("qid"), F.col("question_type").alias("kind"), "question", "answer", F.col("answer_session_ids").alias("relevant"))


def read_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of two-person dialogues: (sample, session, dia_id, speaker, text) and (sample, question, answer, evidence, category)."""
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    rows = spark.read.schema("sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,adversarial_answer:string,evidence:array<string>,category:int>>").option("multiLine", True).json(path)
    flat = rows.select(F.col("sample_id").alias("sample"), F.explode("conversation").alias("session", "json")).filter(F.col("session").rlike(r"^session_\d+$"))
    turns = flat.select("sample", "session", F.explode(F.from_json("json", turn)).alias("t")).select("sample", "session", "t.dia_id", "t.speaker", "t.text")
    return turns, rows.select(F.col("sample_id").alias("sample"), F.explode("qa").alias("q")).select("sample", "q.*")


def read_fact_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, questions): numbered lines in order, (id, pos, fact) and (id, n, question, answers)."""
    rows = spark.read.schema(FACT_TRACKS).json(path)
    facts = rows.select("id", F.posexplode(F.regexp_extract_all("context", F.lit(r"(?m)^\s*\d+\.\s*(.+)$"), F.lit(1))).alias("pos", "fact"))
    asked = rows.select("id", F.posexplode(F.arrays_zip("questions", "answers")).alias("n", "x")).select("id", "n", F.col("x.questions").alias("question"), F.col("x.answers").alias("answers"))
    return facts, asked


def read_cue_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(relation_type, cue_dialogue, trigger_query, time_gap)."""
    return spark.read.schema("relation_type string, cue_dialogue string, trigger_query string, time_gap string").option("multiLine", True).json(path)


def read_persona_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, session, points, questions) of JSON lines of users with sessions of memory points."""
    point = "struct<index:int,memory_content:string,memory_type:string,is_update:string,original_memories:array<string>,timestamp:string,importance:double>"
    ask = "struct<question:string,answer:string,evidence:array<struct<memory_content:string,memory_type:string>>,difficulty:string,question_type:string>"
    rows = spark.read.schema(f"uuid string, persona_info string, sessions array<struct<start_time:string,end_time:string,memory_points:array<{point}>,questions:array<{ask}>>>").json(path)
    return rows.select("uuid", F.posexplode("sessions").alias("session", "s")).select("uuid", "session", F.col("s.memory_points").alias("points"), F.col("s.questions").alias("questions"))


def with_cached_vectors(rows: DataFrame, cache: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(known, missing): rows with a vector from cache (hash, v), and the distinct texts without one."""
    keyed = rows.withColumn("hash", F.left(F.sha2(text, 256), F.lit(32)))
    return keyed.join(cache, "hash"), keyed.join(cache, "hash", "left_anti").select("hash", text).dropDuplicates(["hash"])


def embed(rows: DataFrame, embedder, dims: int, text: str = "content") -> DataFrame:
    """Append v (array<float>) from a function of lists of texts; called once per Arrow batch."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embedder(texts.fillna("").tolist())])

    return rows.withColumn("v", run(text)).filter(F.size("v") == dims)


def decode_vectors(rows: DataFrame, blob: str) -> DataFrame:
    """Append v from blobs of 0x01 and little-endian 32-bit floats, or JSON text; null if neither."""
    import json

    import numpy as np

    def one(b: bytes | None) -> list[float] | None:
        if not b:
            return None
        if b[0] == 1 and len(b) % 4 == 1:
            return np.frombuffer(b[1:], "<f4").tolist()
        try:
            return [float(x) for x in json.loads(b)]
        except ValueError:
            return None

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return rows.withColumn("v", run(blob))
