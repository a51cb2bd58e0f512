"""Operators around a ranking, against plain Python on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import context as C
from mnemo.operators import lifecycle as L
from mnemo.operators import mining as M
from mnemo.operators import search as R


def test_short_terms_of_other_scripts_are_found(spark):
    docs = spark.createDataFrame([(1, "a trip to 東京都 now", 5), (2, "京 alone", 4), (3, "plain words", 3), (4, None, 2), (5, "東京", 1)], "id bigint, content string, age_hours bigint")
    asked = spark.createDataFrame([(1, "東京"), (2, "京"), (3, "words"), (4, None)], "qid bigint, query string")
    got = {(r["qid"], r["id"]) for r in R.substring_search(docs, asked, 10).collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 2), (2, 5), (3, 3)}


def test_vector_queries_that_share_an_id_lose_nobody(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    asked = [(100, v[i].tolist()) for i in range(40)] + [(200 + i, v[i].tolist()) for i in range(8)] * 2
    schema = "id bigint, v array<double>"
    got = R.vector_search(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), 3, block=4).collect()
    assert {r["qid"] for r in got} == {100, *range(200, 208)}
    for i in range(8):
        near = v @ v[i]
        want = sorted((-round(float(c), 6), j) for j, c in enumerate(near) if c >= 0.2)[:3]
        assert sorted((r["rank"], r["id"]) for r in got if r["qid"] == 200 + i) == [(k + 1, j) for k, (_, j) in enumerate(want)]


def test_mmr_on_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.sort(rng.random(20))[::-1]
    ranked = spark.createDataFrame([(7, i, i + 1, float(s)) for i, s in enumerate(score)], "qid bigint, id bigint, rank bigint, score double")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v) if i != 3], "id bigint, v array<double>")
    m = v.copy()
    m[3] = 0  # has no vector
    left, taken = list(range(20)), []
    while len(taken) < 6:
        best = max(left, key=lambda i: (0.7 * score[i] / score[0] - 0.3 * max([float(m[i] @ m[j]) for j in taken], default=0.0), -i))
        taken.append(best)
        left.remove(best)
    got = R.mmr_vectors(ranked, vectors, 6).orderBy("rank").collect()
    assert [r["id"] for r in got] == taken


def test_bridges_lead_to_further_results(spark):
    docs = spark.createDataFrame([(1, "The team plays the sport of baseball. Other things."), (2, "They met near Boris Becker in town! Then home"), (3, "baseball fields need grass"), (4, "boris becker won"), (5, None)], "id bigint, content string")
    asked = spark.createDataFrame([(1, "team sport")], "qid bigint, query string")
    ranked = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 1.0)], "qid bigint, id bigint, rank bigint, score double")
    led = {r["bridge"]: r["weight"] for r in R.bridges(ranked, docs, asked).collect()}
    assert led == {"baseball": 1, "boris becker": 2, "becker": 1, "town": 1}
    got = R.hop2(ranked, docs, asked).orderBy("rank").collect()
    assert [(r["id"], r["bridge"]) for r in got] == [(4, "boris becker"), (3, "baseball")]
    assert R.hop2(ranked.limit(0), docs, asked).count() == 0


def plain_excerpt(content, terms, most):
    if len(content) <= most:
        return content
    parts, now = [], []

    def flush():
        p = "\n".join(now).strip(" \n\t\r")
        if len(p) > 20:
            parts.append(p)
        now.clear()

    for line in (x.strip(" ") for x in content.split("\n")):
        if line == "" or 1 <= line.find(": ") <= 24:
            flush()
        now.append(line)
    flush()
    if not parts:
        return content[:most]
    hits = [sum(t in p.lower() for t in terms) for p in parts]
    lo = hi = hits.index(max(hits))
    n = len(parts[lo])
    while n < most:
        if hi + 1 < len(parts) and n + len(parts[hi + 1]) <= most:
            hi += 1
            n += len(parts[hi])
        elif lo > 0 and n + len(parts[lo - 1]) <= most:
            lo -= 1
            n += len(parts[lo])
        else:
            break
    return "\n".join(parts[lo : hi + 1])


def test_excerpts(spark):
    rng = random.Random(6)
    words = "rain river stone cloud forest meadow harbour lantern".split()
    rows = [(0, "", "rain"), (1, "short", "rain"), (2, "x\n" * 200, "rain")]
    for i in range(3, 40):
        lines = [rng.choice(["", "user: ", "  ", ""]) + " ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(rng.randint(5, 25))]
        rows.append((i, "\n".join(lines), " ".join(rng.sample(words, 3))))
    got = spark.createDataFrame(rows, "id bigint, content string, q string").select("id", X.excerpt(F.col("content"), X.content_terms(F.col("q")), 200).alias("e")).collect()
    assert {r["id"]: r["e"] for r in got} == {i: plain_excerpt(c, q.split(), 200) for i, c, q in rows}


def test_reserve_hoist_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, t, r) for i, (t, r) in enumerate([(50, False), (80, True), (300, True), (40, True), (10, False)])], "qid bigint, id bigint, score double, tokens bigint, reserved boolean")
    got = C.reserve_hoist(rows, 390).orderBy("position").collect()
    assert [(r["id"], r["held"]) for r in got] == [(1, True), (3, True), (0, False), (2, False), (4, False)]


def test_keys_stay_unique_up_to_the_27th(spark):
    rows = spark.createDataFrame([(i, "n", "note") for i in range(30)] + [(99, "m", "note")], "id bigint, ns string, key string")
    got = {r["id"]: r["key"] for r in M.numbered_keys(rows).collect()}
    assert got[0] == got[99] == "note" and got[1] == "note-a" and got[26] == "note-z" and {got[i] for i in (27, 28, 29)} == {"note-x"}


def test_locked_tag_stays():
    with pytest.raises(ValueError):
        L.remove_tag(None, "locked")


def test_names_in_questions(spark):
    row = spark.createDataFrame([("What did Caroline's sister Anna tell Bob's A team? USA", "anna and Anna-Lena of the USA; Carolines")], "q string, c string")
    got = row.select(X.proper_nouns(F.col("q")).alias("n")).first()["n"]
    assert got == ["Caroline", "Anna", "Bob", "USA"]
    assert row.select(X.name_matches(F.col("c"), X.proper_nouns(F.col("q"))).alias("k")).first()["k"] == 2
