"""The snapshot store, patches, and operators with sequential parts."""

import pytest
from pyspark.sql import functions as F

from mnemo.operators import context as C
from mnemo.operators import graph as G
from mnemo.operators import lifecycle as L
from mnemo.operators import mining as M
from mnemo.operators.store import Conflict, Store, make_patch, patch


def rows(spark, *items):
    return spark.createDataFrame(items, "ns string, key string, content string")


def test_versions_and_conflicts(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.live().count() == 0
    v1 = s.put(rows(spark, ("a", "x", "one"), ("a", "y", "two")))
    v2 = s.put(rows(spark, ("a", "x", "three"), ("a", "y", "two")), base=v1)
    live = {r["key"]: r for r in s.live().collect()}
    assert (live["x"]["version"], live["x"]["content"]) == (2, "three") and live["y"]["version"] == 1
    assert live["x"]["supersedes"] == s.versions(v1).filter("key = 'x'").first()["id"]
    with pytest.raises(Conflict):
        s.put(rows(spark, ("a", "z", "late")), base=v1)
    s.remove(rows(spark, ("a", "y", "")).select("ns", "key"))
    assert [r["key"] for r in s.live().collect()] == ["x"]
    assert {r["content"] for r in s.live(v1).collect()} == {"one", "two"}
    before = s.versions().count()
    s.compact()
    assert s.versions().count() == 1 < before and v2 == 2


def test_racing_writers(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/r"), Store(spark, f"file://{tmp_path}/r")
    a.put(rows(spark, ("n", "k", "1")))
    with pytest.raises(Conflict):
        b._commit(b.live(), 0)


def test_patch_round_trip():
    old, new = "a\nb\nc\nd\ne", "a\nB\nc\nd\nE\nf"
    assert patch(old, make_patch(old, new)) == new
    with pytest.raises(ValueError):
        patch("x\ny", make_patch(old, new))
    with pytest.raises(ValueError):
        patch(old, "nothing")


def test_rules_in_order(spark):
    base = dict(id=1, tier="stm", kind="episodic", age_hours=100, idle_hours=0, importance=0.5, access_count=60, utility_count=0, pinned=False, locked=False, priority="normal")
    cases = [
        ({}, "sys-promote-to-ltm"),
        ({"id": 2, "tier": "sensory", "age_hours": 2, "access_count": 2}, "sys-promote-sensory"),
        ({"id": 3, "tier": "sensory", "age_hours": 5}, "sys-decay-sensory"),
        ({"id": 4, "tier": "ltm", "idle_hours": 200}, "sys-demote-stale-ltm"),
        ({"id": 5, "tier": "ltm", "idle_hours": 200, "utility_count": 10}, None),
        ({"id": 6, "access_count": 100, "utility_count": 1}, "sys-prune-low-utility"),
        ({"id": 7, "age_hours": 800, "access_count": 2}, "sys-archive-old-episodic"),
        ({"id": 8, "access_count": 2}, "sys-decay-unaccessed"),
    ]
    df = spark.createDataFrame([base | c for c, _ in cases])
    got = {r["id"]: r["rule"] for r in L.first_match(df).collect()}
    assert [got[i + 1] for i in range(len(cases))] == [r for _, r in cases]
    logged = spark.createDataFrame([(1, 2), (6, 2)], "id bigint, days bigint")
    got = {r["id"]: r["rule"] for r in L.first_match(df, days=logged).collect()}
    assert got[1] is None and got[6] is None or got[6] == "sys-promote-to-ltm"


def test_packing(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 100), (1, 2, 0.8, 900), (1, 3, 0.7, 100), (1, 4, 0.6, 50)], "qid bigint, id bigint, score double, tokens bigint")
    got = [(r["id"], r["tokens"], r["excerpt"], r["used"]) for r in C.pack(df, 600).orderBy("used").collect()]
    assert got == [(1, 100, False, 100), (2, 420, True, 520), (3, 100, True, 620)]
    pins = spark.createDataFrame([(1, 1, 60, 0.9), (1, 2, 70, 0.8), (1, 3, 40, 0.7)], "qid bigint, id bigint, tokens bigint, importance double")
    assert {r["id"] for r in C.pack_pinned(pins, 100).collect()} == {1, 3}


def test_components_and_supersede_order(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (7, 8), (3, 3)], "a bigint, b bigint")
    assert {(r["id"], r["comp"]) for r in G.components(e).collect()} == {(4, 4), (5, 4), (9, 4), (7, 7), (8, 7)}
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "qid bigint, id bigint, rank bigint")
    new = spark.createDataFrame([(30, 10)], "new_id bigint, old_id bigint")
    assert [r["id"] for r in L.supersede_order(ranked, new).orderBy("rank").collect()] == [30, 10, 20]


def test_chunks_and_entities(spark):
    text = "# One\nalpha beta\n\n\n# Two\n" + "word " * 300
    parts = M.split_text(text)
    assert parts[0].startswith("# One") and all(len(p.encode()) <= 600 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    df = spark.createDataFrame([(1, "We met Anna Smith in Paris. Then left. Bob Miller came.\nNothing Here")], "id bigint, content string")
    assert {r["entity"] for r in M.entities(df).collect()} == {"anna smith", "paris", "bob miller", "nothing here"}


def test_plans_have_no_python_or_cross_join(spark, sf):
    from mnemo import plans

    for name in ("latest_live", "reflect_actions", "exact_dups", "edges_topk_policy", "ns_stats", "sequence_mining"):
        text = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    text = plans.QUERIES["ns_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in text.split("ReadSchema")[1]


def test_repoint_and_upsert(spark):
    e = spark.createDataFrame([(1, 2, "relates_to", 0.5, 0)], "a bigint, b bigint, rel string, weight double, at int")
    moved = G.repoint(e, spark.createDataFrame([(2, 3)], "old bigint, new bigint")).first()
    assert (moved["a"], moved["b"]) == (1, 3)
    news = spark.createDataFrame([(1, 2, "relates_to", 0.9, 1)], e.schema)
    assert G.upsert(e, news).select(F.max("weight")).first()[0] == 0.9


def test_versions_go_on_after_compaction(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/again")
    note = lambda c: spark.createDataFrame([("n", "k", c)], "ns string, key string, content string")
    s.put(note("one"))
    first = s.live().first()["id"]
    s.remove(note("one"))
    s.compact()
    assert s.live().count() == 0
    s.put(note("two"))
    row = s.live().first()
    assert (row["version"], row["content"]) == (3, "two") and row["id"] != first
    with pytest.raises(Conflict):
        s._commit(s.live(), s.head() - 1)
    assert not [x for x in (tmp_path / "again" / "manifests").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")]
