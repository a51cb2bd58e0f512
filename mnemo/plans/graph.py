"""Graph queries over edges that follow from document ids by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.operators import graph as G
from mnemo.operators import search as R
from mnemo.sources.tables import VEC_SQL, live_sql, mem_sql

from .registry import query
from .retrieval import BM25, VECTOR, asked

RELS = [r[0] for r in G.POLICY]
REL_SQL = "[" + ", ".join(f"'{r}'" for r in RELS) + "]"
EDGE_SQL = f"""e AS (SELECT doc_id AS a, doc_id // 2 AS b, {REL_SQL}[(doc_id * 31) % 9 + 1] AS rel, round((doc_id * 53 % 97) / 97.0::DOUBLE, 6) AS weight,
 doc_id * 11 % 1500 AS idle_hours, doc_id % 7 AS access_count FROM documents WHERE doc_id > 0
UNION ALL SELECT doc_id, doc_id // 3, {REL_SQL}[(doc_id * 17 + 4) % 9 + 1], round((doc_id * 29 % 89) / 89.0::DOUBLE, 6), doc_id * 13 % 1500, doc_id % 5 FROM documents WHERE doc_id > 3 AND doc_id % 4 = 1)"""
POLICY_SQL = "p(rel, dw, along, against, priority, handling, hops) AS (VALUES " + ", ".join(f"('{r}', {w}, {o}, {i}, {p}, '{h}', {n})" for r, w, o, i, p, h, n in G.POLICY) + ")"
STEP_SQL = f"""{EDGE_SQL}, {POLICY_SQL},
stp AS (SELECT a AS seed, b AS far, rel, weight, priority, handling, hops FROM e JOIN p USING (rel) WHERE along UNION ALL SELECT b, a, rel, weight, priority, handling, hops FROM e JOIN p USING (rel) WHERE against),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY priority DESC, weight DESC, far, rel) AS r FROM stp WHERE weight >= 0.1) WHERE r <= 5)"""


def edges(t) -> DataFrame:
    rels = F.array(*map(F.lit, RELS))
    i = F.col("doc_id")

    def part(div: int, m: int, s: int, wm: int, wd: int, idle: int, acc: int) -> DataFrame:
        return t.documents.select(i.alias("a"), F.expr(f"doc_id DIV {div}").alias("b"), F.element_at(rels, ((i * m + s) % 9 + 1).cast("int")).alias("rel"), F.round((i * wm % wd) / F.lit(float(wd)), 6).alias("weight"), (i * idle % 1500).alias("idle_hours"), (i % acc).alias("access_count"))

    return part(2, 31, 0, 53, 97, 11, 7).filter("a > 0").union(part(3, 17, 4, 29, 89, 13, 5).filter("a > 3 AND a % 4 = 1"))


@query(f"WITH {STEP_SQL} SELECT seed, far, rel, weight, handling, r FROM be")
def edges_topk_policy(t):
    return G.best_edges(G.directed(edges(t))).select("seed", "far", "rel", "weight", "handling", "r")


SEEDS = "sd AS (SELECT qid, id, score FROM bmr WHERE rank <= 5)"
HOP1 = """x1 AS (SELECT qid, far AS id, max({'score': least(score * weight * 0.3, 0.3), 'l': hops, 'hop': 1, 'rel': rel}) AS x FROM sd JOIN be ON be.seed = sd.id GROUP BY 1, 2),
h1 AS (SELECT qid, id, x.score AS score, x.l AS l, x.hop AS hop, x.rel AS via FROM x1 WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.qid = x1.qid AND sd.id = x1.id))"""
HOP2 = """x2 AS (SELECT qid, far AS id, max({'score': least(score * weight * 0.3, 0.3), 'l': hops, 'hop': 2, 'rel': rel}) AS x FROM h1 JOIN be ON be.seed = h1.id WHERE l >= 2 GROUP BY 1, 2),
h2 AS (SELECT qid, id, x.score AS score, x.l AS l, x.hop AS hop, x.rel AS via FROM x2 WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.qid = x2.qid AND sd.id = x2.id) AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.qid = x2.qid AND h1.id = x2.id)),
hh AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""
TAIL = "SELECT qid, id, round(score, 6) AS score, hop, via FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM {}) WHERE r <= 50"


def seeds(t) -> DataFrame:
    return R.bm25_search(t.live("id", "content"), asked(t), 5).select("qid", "id", "score")


@query(f"WITH {BM25}, {STEP_SQL}, {SEEDS}, {HOP1} " + TAIL.format("h1"))
def expand_1hop(t):
    return G.spread(seeds(t), edges(t), hops=1).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25}, {STEP_SQL}, {SEEDS}, {HOP1}, {HOP2} " + TAIL.format("hh"))
def expand_2hop(t):
    return G.spread(seeds(t), edges(t), hops=2).withColumn("score", F.round("score", 6))


def _ppr_sql(rounds: int) -> str:
    parts = [
        f"WITH {EDGE_SQL}",
        "pr AS (SELECT a, b, weight FROM e WHERE rel <> 'merged_into' AND weight > 0)",
        "bo AS (SELECT * FROM pr UNION ALL SELECT b, a, weight FROM pr)",
        "ot AS (SELECT a, sum(weight) AS o FROM bo GROUP BY 1)",
        "wk AS MATERIALIZED (SELECT a, b, weight / o AS p FROM bo JOIN ot USING (a))",
        "s0 AS (SELECT doc_id AS id, (doc_id % 3 + 1)::DOUBLE AS mass FROM documents WHERE doc_id % 100 = 7)",
        "r0 AS MATERIALIZED (SELECT id, mass / (SELECT sum(mass) FROM s0) AS mass FROM s0)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT id, sum(mass) AS mass FROM (SELECT b AS id, mass * p * 0.5 AS mass FROM r{i - 1} JOIN wk ON wk.a = r{i - 1}.id UNION ALL SELECT id, mass * 0.5 FROM r0) GROUP BY 1)")
    return ",\n".join(parts) + f" SELECT id, round(mass, 6) AS mass FROM r{rounds}"


@query(_ppr_sql(20))
def pagerank_personalized(t):
    start = t.documents.filter("doc_id % 100 = 7").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).cast("double").alias("mass"))
    return G.pagerank(start, edges(t)).select("id", F.round("mass", 6).alias("mass"))


COMPONENT_SQL = f"""{EDGE_SQL}, u AS (SELECT a, b FROM e WHERE rel = 'relates_to' AND a <> b UNION SELECT b, a FROM e WHERE rel = 'relates_to' AND a <> b),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), c AS (SELECT a AS id, least(a, min(b)) AS comp FROM r GROUP BY a)"""


@query(f"WITH RECURSIVE {COMPONENT_SQL} SELECT id, comp, count(*) OVER (PARTITION BY comp) AS size FROM c")
def components(t):
    found = G.components(edges(t).filter("rel = 'relates_to'"))
    sizes = found.groupBy("comp").agg(F.count("*").alias("size"))
    return found.join(sizes, "comp").select("id", "comp", "size")


@query(f"""WITH {EDGE_SQL}, m AS ({live_sql('id')}), w AS (SELECT a, b, rel, CASE WHEN idle_hours > 720 AND access_count < 3 THEN weight * 0.9 ELSE weight END AS weight FROM e)
SELECT a, b, rel, round(weight, 6) AS weight FROM w SEMI JOIN m ON m.id = w.a WHERE weight >= 0.05 AND EXISTS (SELECT 1 FROM m WHERE m.id = w.b)""")
def edge_decay_prune(t):
    return G.decay_and_prune(edges(t), t.live("id")).select("a", "b", "rel", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGE_SQL} SELECT a, b, weight FROM e WHERE rel = 'relates_to' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.a = e.a AND x.b = e.b AND x.rel IN ('caused_by', 'prevents', 'implies')) ORDER BY weight DESC, a, b LIMIT 50")
def reasoning_candidates(t):
    return G.reasoning_candidates(edges(t)).select("a", "b", "weight")


@query(f"""WITH {EDGE_SQL}, l AS (SELECT doc_id AS id, doc_id // 16 AS qid FROM documents UNION ALL SELECT doc_id // 2, doc_id // 16 FROM documents WHERE doc_id % 3 = 0),
h AS (SELECT a, b, rel, count(*) AS times FROM e JOIN (SELECT DISTINCT * FROM l) x ON x.id = e.a JOIN (SELECT DISTINCT * FROM l) y ON y.id = e.b AND y.qid = x.qid GROUP BY 1, 2, 3)
SELECT e.a, e.b, e.rel, coalesce(times, 0) AS times, round(1.0 - (1.0 - weight) * pow(0.95, coalesce(times, 0)), 6) AS weight FROM e LEFT JOIN h ON h.a = e.a AND h.b = e.b AND h.rel = e.rel""")
def hebbian_update(t):
    d = t.documents
    lists = d.select(F.expr("doc_id DIV 16").alias("qid"), F.col("doc_id").alias("id")).union(d.filter("doc_id % 3 = 0").select(F.expr("doc_id DIV 16"), F.expr("doc_id DIV 2"))).distinct()
    return G.hebbian(edges(t), lists).select("a", "b", "rel", "times", F.round("weight", 6).alias("weight"))


@query(f"""WITH {EDGE_SQL}, c AS (SELECT DISTINCT a AS id, b AS child FROM e WHERE rel = 'contains'), n AS (SELECT id, count(*) AS children FROM c GROUP BY 1),
g AS (SELECT c.id, sum(n.children) AS g FROM c JOIN n ON n.id = c.child GROUP BY 1) SELECT n.id, children, coalesce(g, 0)::BIGINT AS grandchildren FROM n LEFT JOIN g USING (id)""")
def contains_tree(t):
    return G.contains_tree(edges(t))


@query(f"""WITH {EDGE_SQL}, m AS ({mem_sql('id', 'deleted_hours', 'expires_in_hours')}),
c AS (SELECT e.b AS id, count(*) AS children, avg((deleted_hours IS NULL AND (expires_in_hours IS NULL OR expires_in_hours > 0))::INT) AS s FROM e JOIN m ON m.id = e.a WHERE rel = 'contains' GROUP BY 1)
SELECT id, children, round(s, 6) AS alive_share, round(greatest(0.05, 1 - s), 6) AS summary_weight FROM c""")
def summary_liveness(t):
    rows = t.mem("id", "deleted_hours", "expires_in_hours").withColumn("alive", F.expr("deleted_hours IS NULL AND (expires_in_hours IS NULL OR expires_in_hours > 0)"))
    flipped = edges(t).select(F.col("b").alias("a"), F.col("a").alias("b"), "rel")
    return G.liveness(flipped, rows).select("id", "children", F.round("alive_share", 6).alias("alive_share"), F.round("summary_weight", 6).alias("summary_weight"))


@query(f"""WITH {VECTOR}, x AS (SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(score) AS weight FROM vr WHERE score >= 0.3 GROUP BY 1, 2),
y AS (SELECT a AS n, a, b, weight FROM x UNION ALL SELECT b, a, b, weight FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY weight DESC, a, b) AS r FROM y) SELECT DISTINCT a, b, weight FROM z WHERE r <= 8""")
def knn_graph(t):
    v = t.vectors()
    near = R.vector_search(v, v.filter("id % 50 = 0"), 10).filter("score >= 0.3")
    pairs = near.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.max("score").alias("weight"))
    return G.capped(pairs, "weight", 8).select("a", "b", "weight")


@query(f"""WITH {VECTOR} SELECT qid AS a, id AS b, greatest(0.5, score) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vr WHERE score >= 0.25) WHERE r <= 5""")
def auto_link(t):
    v = t.vectors()
    near = R.top(R.vector_search(v, v.filter("id % 50 = 0"), 10, floor=0.2).filter("score >= 0.25").drop("rank"), 5)
    return near.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.greatest(F.lit(0.5), "score").alias("weight"))


@query(f"""WITH {EDGE_SQL}, mv AS (SELECT doc_id AS old, doc_id + 1 AS new FROM documents WHERE doc_id % 10 = 3),
x AS (SELECT coalesce(p.new, a) AS a, coalesce(q.new, b) AS b, rel, weight FROM e LEFT JOIN mv p ON p.old = e.a LEFT JOIN mv q ON q.old = e.b) SELECT a, b, rel, weight FROM x WHERE a <> b""")
def edge_repoint(t):
    moves = t.documents.filter("doc_id % 10 = 3").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 1).alias("new"))
    return G.repoint(edges(t), moves).select("a", "b", "rel", "weight")


@query(f"""WITH {EDGE_SQL}, n AS (SELECT a, b, rel, 0.99 AS weight, 1 AS pos FROM e WHERE a % 6 = 0), u AS (SELECT a, b, rel, weight, 0 AS pos FROM e UNION ALL SELECT * FROM n)
SELECT a, b, rel, arg_max(weight, pos)::DOUBLE AS weight FROM u GROUP BY 1, 2, 3""")
def edge_upsert(t):
    old = edges(t).select("a", "b", "rel", "weight", F.lit(0).alias("at"))
    news = old.filter("a % 6 = 0").withColumn("weight", F.lit(0.99)).withColumn("at", F.lit(1))
    return G.upsert(old, news).select("a", "b", "rel", "weight")


@query(f"WITH {EDGE_SQL} SELECT rel, count(*) AS n, round(avg(weight), 6) AS weight, count(DISTINCT a) AS sources FROM e GROUP BY 1")
def edge_stats(t):
    return edges(t).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"), F.countDistinct("a").alias("sources"))


@query(f"""WITH v AS ({VEC_SQL}) SELECT a.id AS id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1""")
def neighbour_cosine(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("embedding").alias("w"))
    return v.join(other, "id").select("id", "other", F.round(S.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))
