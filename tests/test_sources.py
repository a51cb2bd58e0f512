"""Readers and streams."""

import json

from mnemo.sources import readers as R
from mnemo.streaming import access as A


def test_json_round_trip(spark, tmp_path):
    rows = [{"id": "1", "ns": "a", "key": "k", "content": "x", "version": 1, "tags": ["t"], "importance": 0.25, "created_at": "2024-01-01T00:00:00.000Z"}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    df = R.read_memories(spark, f"file://{tmp_path}/in.json")
    R.write_memories(df, f"file://{tmp_path}/out")
    back = R.read_memories(spark, f"file://{tmp_path}/out")
    assert back.first()["importance"] == 0.25 and back.first()["tags"] == ["t"]
    assert R.import_memories(back, df).count() == 0


def test_markdown_sessions_and_candidates(spark, tmp_path):
    (tmp_path / "2024-01-05.md").write_text("intro\n## Plan A\nbody\n")
    (tmp_path / "s.txt").write_text("git commit push\n\nls\n")
    got = R.read_markdown(spark, f"file://{tmp_path}").orderBy("pos").collect()
    assert [(r["date"], r["key"], r["body"]) for r in got] == [("2024-01-05", "preamble", "intro"), ("2024-01-05", "plan-a", "body")]
    assert sorted(len(r["steps"]) for r in R.read_sessions(spark, f"file://{tmp_path}/s.txt").collect()) == [1, 3]
    df = spark.createDataFrame([('[{"content": "c", "kind": "semantic", "importance": 0.5, "cues": ["fact"]}]',)], "value string")
    assert R.read_candidates(df).first()["cues"] == ["fact"]


def test_benchmark_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"question_id": "q1", "question": "?", "haystack_session_ids": ["s"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "hi"}]], "answer_session_ids": ["s"]}, {"question_id": "q2_abs"}]))
    sessions, asked = R.read_long_dialogues(spark, f"file://{tmp_path}/l.json")
    assert sessions.first()["content"] == "user: hi" and asked.count() == 1
    (tmp_path / "c.json").write_text(json.dumps([{"sample_id": "a", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hey"}], "session_1_date_time": "x"}, "qa": [{"question": "q", "evidence": ["D1:1"], "category": 2}]}]))
    turns, qa = R.read_conversations(spark, f"file://{tmp_path}/c.json")
    assert turns.first()["text"] == "hey" and qa.first()["category"] == 2
    (tmp_path / "f.json").write_text(json.dumps({"id": "f", "context": "1. one fact\n2. two facts", "questions": ["q"], "answers": [["a"]]}))
    facts, asked = R.read_fact_tracks(spark, f"file://{tmp_path}/f.json")
    assert [r["fact"] for r in facts.orderBy("pos").collect()] == ["one fact", "two facts"] and asked.count() == 1


def test_vectors(spark):
    import struct

    blob = b"\x01" + struct.pack("<2f", 1.0, 2.0)
    df = spark.createDataFrame([(blob,), (b"[3, 4]",), (None,)], "b binary")
    assert [r["v"] for r in R.decode_vectors(df, "b").collect()] == [[1.0, 2.0], [3.0, 4.0], None]
    texts = spark.createDataFrame([("aa",), ("aa",), ("b",)], "content string")
    known, missing = R.with_cached_vectors(texts, spark.createDataFrame([], "hash string, v array<float>"))
    assert known.count() == 0 and missing.count() == 2
    assert R.embed(missing, lambda xs: [[len(x), 1.0] for x in xs], 2).count() == 2


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "a.parquet")
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "b.parquet")
    source = f"file://{tmp_path}/in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    drain(A.counts(A.once(A.read_accesses(spark, source), late="40 days"), late=None).writeStream.outputMode("append").format("memory").queryName("daily").start())
    drain(A.activation_state(A.read_accesses(spark, source)).writeStream.outputMode("update").format("memory").queryName("state").start())
    top = {r["id"]: r["n"] for r in spark.sql("SELECT id, max(n) AS n FROM state GROUP BY id").collect()}
    want = {r["user_id"]: r["n"] for r in events.groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    assert top.keys() == want.keys() and all(want[k] <= v <= 2 * want[k] for k, v in top.items())
    drain(A.append_to(A.read_accesses(spark, source), f"file://{tmp_path}/log", f"file://{tmp_path}/cp"))
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2 * events.count()
