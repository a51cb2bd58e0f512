import numpy as np

from mnemo.operators import lifecycle as L
from mnemo.operators import mining as M
from mnemo.operators import pairs as P


def brute(sets):
    return {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) >= 5 and 10 * len(x & y) >= 7 * max(len(x), len(y))}


def some_sets(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "stuvwxyz"]
    out = {}
    for i in range(n):
        base = [words[(i % 12 * 7 + k * k) % 64] for k in range(4 + i % 12 * 3)]
        out[i] = frozenset(base) ^ frozenset(rng.choice(words, i // 12 % 4))
    return out | {n: frozenset(words)}


def test_paraphrase_pairs_are_not_shuffled(spark):
    sets = some_sets(3)
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in sets.items()] + [(999, None)], "id bigint, content string")
    got = L.paraphrases(rows, rows.filter("id % 3 = 0"))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["qid"], r["id"]): r["shared"] for r in got.collect()} == {p: n for p, n in brute(sets).items() if p[0] % 3 == 0}


def test_paraphrase_classes_link_blocks(spark):
    sets = some_sets(4)
    got = L.paraphrase_classes(spark.createDataFrame([(i, " ".join(x)) for i, x in sets.items()], "id bigint, content string")).collect()
    links, root = brute(sets), {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[b] = min(root[a], root[b])
    assert {r["id"]: (r["class"], r["links"]) for r in got} == {i: (root[i], sum(a == i for a, _ in links)) for i in sets}


def test_matches_in_small_steps(monkeypatch):
    level = np.full(1 << P.BITS, 8, np.uint8)
    pack = P._set_blocks(level)

    def block(name, ids, sets):
        rows = [np.array(sorted(hash(w) * 0x9E3779B97F4A7C15 % (1 << 62) for w in sets[i]), np.int64) for i in ids]
        sizes = np.array([len(r) for r in rows], np.int64)
        items, extra = pack(sizes, np.concatenate(rows))
        return P._Sets({"block": name, "ids": np.array(ids).tobytes(), "copies": np.ones(len(ids), np.int64).tobytes(), "sizes": sizes.tobytes(), "items": items.tobytes(), "extra": extra.tobytes()}, 5, 0.7, level)

    sets = {i: x for i, x in some_sets(5).items() if len(x) >= 5}
    a, b = block(1, list(sets)[::2], sets), block(2, list(sets)[1::2], sets)
    want = brute(sets)
    for chunk, seen in ((1 << 16, 1 << 25), (7, 100)):
        monkeypatch.setattr(P, "CHUNK", chunk)
        monkeypatch.setattr(P, "SEEN", seen)
        got = {}
        for x, y in ((a, a), (a, b), (b, b)):
            i, j, n = P._matches(x, y)
            got |= {tuple(sorted((p, q))): c for p, q, c in zip(x.ids[i].tolist(), y.ids[j].tolist(), n.tolist(), strict=True)}
        assert got == {p: c for p, c in want.items() if p[0] < p[1]} and len(got) > 50


def test_topic_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(6)
    lists = {i: {f"t{w}": float(rng.integers(1, 9)) / 8 for w in rng.choice(40, 1 + i % 10, replace=False)} for i in range(90)}
    lists |= {i + 90: lists[i] for i in range(5)}
    dot = lambda x, y: sum(w * y.get(t, 0.0) for t, w in x.items())
    want = {(a, b): (len(x.keys() & y.keys()), round(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, 6)) for a, x in lists.items() for b, y in lists.items() if a != b}
    want = {p: v for p, v in want.items() if v[1] >= 0.3}
    listed = spark.createDataFrame([(i, t, w) for i, x in lists.items() for t, w in x.items()], "id bigint, term string, score double")
    ids = spark.createDataFrame([(i,) for i in [*lists, 777]], "id bigint")
    got = M.topic_overlap(listed, ids.filter("id % 4 = 0"))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["qid"], r["id"]): (r["shared"], r["cosine"]) for r in got.collect()} == {p: v for p, v in want.items() if p[0] % 4 == 0}


def test_topic_classes_link_blocks(spark):
    rng = np.random.default_rng(7)
    lists = {i: {f"t{w}": float(rng.integers(1, 9)) / 8 for w in rng.choice(150, 1 + i % 6, replace=False)} for i in range(90)}
    lists |= {i + 90: lists[i] for i in range(5)}
    listed = spark.createDataFrame([(i, t, w) for i, x in lists.items() for t, w in x.items()], "id bigint, term string, score double")
    ids = spark.createDataFrame([(i,) for i in [*lists, 777]], "id bigint")
    links = [(r["qid"], r["id"]) for r in M.topic_overlap(listed, ids).collect()]
    root = {i: i for i in [*lists, 777]}
    for _ in lists:
        for a, b in links:
            root[b] = min(root[a], root[b])
    got = {r["id"]: (r["class"], r["links"]) for r in M.topic_classes(ids, listed).collect()}
    assert got == {i: (k, sum(a == i for a, _ in links)) for i, k in root.items()} and len(set(root.values())) > 5


def test_topics_of_a_document_in_several_rows(spark):
    rows = [(1, "apple apple pear"), (1, "apple plum"), (2, "pear"), (3, None), (None, "plum")]
    got = {(r["id"], r["term"]): r["rank"] for r in M.topics(spark.createDataFrame(rows, "id bigint, content string"), 2).collect()}
    assert got == {(1, "apple"): 1, (1, "plum"): 2, (2, "pear"): 1}
