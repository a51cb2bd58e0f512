"""Queries without DuckDB text over whole tables, against brute force."""

import collections

import numpy as np

from mnemo import plans
from mnemo.operators import lifecycle as L
from mnemo.operators import mining as M
from mnemo.plans.graph import edges
from mnemo.sources.tables import Tables


def component_of(pairs):
    """The least id reachable from each end."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_of_every_relates_to_edge(spark, sf):
    rows = edges(Tables(spark, sf)).select("a", "b", "rel").collect()
    comp = component_of([(r["a"], r["b"]) for r in rows if r["rel"] == "relates_to" and r["a"] != r["b"]])
    size = collections.Counter(comp.values())
    got = {(r["id"], r["comp"], r["size"]) for r in plans.QUERIES["components"](spark, sf).collect()}
    assert got == {(i, c, size[c]) for i, c in comp.items()}
    child = {r["b"] for r in rows if r["rel"] == "contains"}
    orphans = collections.Counter(c for i, c in comp.items() if i not in child)
    got = {(r["comp"], r["n"], r["orphans"]) for r in plans.QUERIES["consolidation_candidates"](spark, sf).collect()}
    assert got == {(c, n, orphans[c]) for c, n in size.items() if n >= 3 and orphans[c] * 2 > n}


def test_pagerank_of_every_node_with_mass(spark, sf):
    t = Tables(spark, sf)
    walk = collections.defaultdict(list)
    for r in edges(t).filter("rel <> 'merged_into' AND weight > 0").collect():
        walk[r["a"]].append((r["b"], r["weight"]))
        walk[r["b"]].append((r["a"], r["weight"]))
    seeds = {r["doc_id"]: r["doc_id"] % 3 + 1.0 for r in t.documents.filter("doc_id % 100 = 7").collect()}
    start = {i: m / sum(seeds.values()) for i, m in seeds.items()}
    rank = start
    for _ in range(20):
        after = collections.defaultdict(float, {i: m * 0.5 for i, m in start.items()})
        for i, m in rank.items():
            out = sum(w for _, w in walk[i])
            for far, w in walk[i]:
                after[far] += m * 0.5 * w / out
        rank = after
    got = {r["id"]: r["mass"] for r in plans.QUERIES["pagerank_personalized"](spark, sf).collect()}
    assert set(got) == set(rank) and min(got.values()) < 0.0001
    assert all(abs(got[i] - m) < 1e-6 for i, m in rank.items())  # the query rounds to six places


def test_every_vector_gets_its_leader(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i * 7 % 1500, None if i % 5 == 4 else int(i % 5 > 2), x.tolist()) for i, x in enumerate(v)]
    want, leaders = {}, collections.defaultdict(list)
    for i, g, x in sorted(rows, key=lambda r: r[0]):
        first = next((j for j, y in leaders[g] if np.dot(x, y) >= 0.8), None)
        if first is None:
            leaders[g].append((i, x))
        want[i] = (g, i if first is None else first)
    got = L.leader_clusters(spark.createDataFrame(rows, "id bigint, g bigint, v array<double>"), "g", 0.8, chunk=32).collect()
    assert len(got) == 1500 and {r["id"]: (r["g"], r["leader"]) for r in got} == want
    assert max(map(len, leaders.values())) > 64


def test_paraphrases_of_every_document(spark):
    rng = np.random.default_rng(2)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "stuvwxyz"]
    rows = [(1000, None), (1001, "too few words here"), (1002, "")]
    for i in range(120):
        base = [words[(i % 30 * 7 + k * k) % 64] for k in range(6 + i % 9)]
        rows.append((i, " ".join(base if i % 3 else [*base[:-1], str(rng.choice(words))])))
    sets = {i: frozenset(w for w in (c or "").split() if len(w) >= 4) for i, c in rows}
    near = lambda x, y: len(x & y) >= 5 and 10 * len(x & y) >= 7 * max(len(x), len(y))
    links = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    comp, n = component_of(links), collections.Counter(x for pair in links for x in pair)
    got = {r["id"]: (r["class"], r["links"]) for r in L.paraphrase_classes(spark.createDataFrame(rows, "id bigint, content string")).collect()}
    assert got == {i: (comp.get(i, i), n[i]) for i in sets}
    assert len(links) > 50 and any(sets[a] != sets[b] for a, b in links) and any(a % 50 and b % 50 for a, b in links)


def test_overlaps_of_every_document(spark, sf):
    m = Tables(spark, sf).mem("id", "content")
    for name, listed, overlap in (("topic_overlap_classes", M.topics(m, 10), M.topic_overlap), ("entity_overlap_classes", M.entities(m), M.entity_overlap)):
        links = [(r["qid"], r["id"]) for r in overlap(listed, m).filter("qid < id").collect()]
        comp, n = component_of(links), collections.Counter(x for pair in links for x in pair)
        got = {r["id"]: (r["class"], r["links"]) for r in plans.QUERIES[name](spark, sf).collect()}
        assert got == {r["id"]: (comp.get(r["id"], r["id"]), n[r["id"]]) for r in m.select("id").collect()}
        assert name != "topic_overlap_classes" or any(a % 50 and b % 50 for a, b in links)
