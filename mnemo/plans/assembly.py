"""What search and context assembly add around a ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import context as C
from mnemo.operators import graph as G
from mnemo.operators import search as R
from mnemo.sources.tables import live_sql

from .context import SCORES, scored
from .graph import SEEDS, STEP_SQL, edges, seeds
from .registry import ORACLES, query
from .retrieval import BM25, FUSED, LIKE, asked, fused

LEVEL = "CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END"


@query(f"""WITH {BM25}, s AS (SELECT qid, id, round({LEVEL} * 0.1::DOUBLE + (1.0::DOUBLE / (1.0::DOUBLE + age_hours / 24.0::DOUBLE / 7.0::DOUBLE)) * CASE WHEN qid % 3 = 0 THEN 0.7 ELSE 0.3 END::DOUBLE
 + score * CASE WHEN qid % 3 = 0 THEN 0.2 ELSE 0.5 END::DOUBLE + 1e-9::DOUBLE, 6) AS score FROM bmr JOIN m USING (id))
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def fts_order(t):
    """Every third question counts as one about time, so that both weightings are reached."""
    docs = t.live("id", "content", "age_hours", "priority")
    found = R.bm25_search(docs, asked(t), 1 << 30)
    return R.fts_order(found, docs, asked(t), 10, temporal=F.col("qid") % 3 == 0)


TEMPORAL = ", ".join(f"'{w}'" for w in X.TEMPORAL_WORDS)


@query(f"""WITH {BM25}, {LIKE}, {FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM f),
l AS (SELECT qid, max(score) FILTER (WHERE r = 1) / max(score) FILTER (WHERE r = 2) AS lead FROM r WHERE r <= 2 GROUP BY 1),
a AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN query || ' recently' ELSE query END AS query FROM q)
SELECT qid, round(lead, 6) AS lead, len(list_filter(regexp_extract_all(lower(query), '\\S+'), lambda w: w IN ({TEMPORAL}))) > 0 AS temporal,
 len(list_filter(regexp_extract_all(lower(query), '\\S+'), lambda w: w IN ({TEMPORAL}))) > 0 OR coalesce(round(lead, 6) >= 1.04, FALSE) AS skip FROM l JOIN a USING (qid)""")
def rerank_skips(t):
    """Every fourth question is put as one about time; the lead asked for is small, so that it decides some."""
    told = asked(t).withColumn("query", F.when(F.col("qid") % 4 == 0, F.concat("query", F.lit(" recently"))).otherwise(F.col("query")))
    found = R.rerank_skips(fused(t), told, 1.04)
    return found.select("qid", F.round("lead", 6).alias("lead"), "temporal", (F.col("temporal") | F.coalesce(F.round("lead", 6) >= 1.04, F.lit(False))).alias("skip"))


NAMES = "list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(query, '[A-Za-z0-9'']+'), lambda w: regexp_matches(w, '^[A-Z].') AND w NOT IN ({})), lambda w: regexp_replace(w, '''[sS]$', '')), lambda w: length(w) > 1))".format(", ".join(f"'{w}'" for w in X.NO_NAMES))


@query(f"""WITH {BM25}, x AS (SELECT qid, id, {NAMES} AS names, content FROM bmr JOIN q USING (qid) JOIN m USING (id) WHERE rank <= 10)
SELECT qid, id, len(names) AS names, len(list_filter(names, lambda n: regexp_matches(content, '(^|[^A-Za-z])' || n || '($|[^A-Za-z])'))) AS found FROM x""")
def name_boost(t):
    docs = t.live("id", "content")
    rows = R.dealt(R.bm25_search(docs, asked(t), 10), "qid", "id").join(asked(t), "qid").join(docs, "id").withColumn("n", X.proper_nouns(F.col("query")))
    return rows.select("qid", "id", F.size("n").cast("bigint").alias("names"), X.name_matches(F.col("content"), F.col("n")).cast("bigint").alias("found"))


@query(f"""WITH {SCORES}, r AS (SELECT qid, id, score, tokens, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM cs),
l AS (SELECT qid, list({{'c': tokens::BIGINT, 'h': [r]}} ORDER BY r) AS l FROM r WHERE id % 3 = 0 GROUP BY 1),
h AS (SELECT qid, list_reduce(l, lambda a, x: CASE WHEN a.c + x.c <= 1000 THEN {{'c': a.c + x.c, 'h': list_concat(a.h, x.h)}} ELSE a END, {{'c': 0::BIGINT, 'h': []::BIGINT[]}}).h AS h FROM l),
p AS (SELECT r.qid, id, r, coalesce(list_contains(h, r), FALSE) AS held FROM r LEFT JOIN h USING (qid))
SELECT qid, id, held, row_number() OVER (PARTITION BY qid ORDER BY held DESC, r) AS position FROM p""")
def reserve_hoist(t):
    return C.reserve_hoist(scored(t).withColumn("reserved", F.col("id") % 3 == 0), 3000).select("qid", "id", "held", "position")


@query(f"""WITH {SCORES}, pk AS (SELECT qid, count(*) AS n FROM ({ORACLES['context_pack']}) GROUP BY 1), ac AS (SELECT ns, count(*) AS n FROM m GROUP BY 1), c AS (SELECT qid, count(*) AS n FROM cs GROUP BY 1)
SELECT c.qid, c.n - coalesce(pk.n, 0) AS skipped, c.n - coalesce(pk.n, 0) > 12 OR coalesce(ac.n, 0) > 100 AS suggested FROM c LEFT JOIN pk USING (qid) LEFT JOIN ac ON ac.ns = 'src:src' || (c.qid % 9)""")
def compaction_hint(t):
    rows = scored(t)
    spaces = asked(t).select("qid", F.concat(F.lit("src:src"), (F.col("qid") % 9).cast("string")).alias("ns"))
    return C.compaction_hint(rows, C.pack(rows, 1500), spaces, t.live("ns"), most=12, crowded=100)


@query(f"""WITH {BM25}, {LIKE}, {FUSED}, s AS (SELECT qid, 'fts' AS s, count(*) AS n FROM bmr WHERE rank <= 50 GROUP BY 1 UNION ALL SELECT qid, 'like', count(*) FROM lkr WHERE rank <= 50 GROUP BY 1 UNION ALL SELECT qid, 'fused', count(*) FROM f GROUP BY 1)
SELECT qid, string_agg(s || '=' || n, ' ' ORDER BY s) AS stages FROM s GROUP BY 1""")
def stage_counts(t):
    docs = t.live("id", "content", "age_hours")
    fts, like = R.bm25_search(docs, asked(t), 50), R.substring_search(docs, asked(t), 50)
    return C.stage_counts(fts=fts, like=like, fused=R.fuse([fts, like]))


AWAKE = f"aw AS (SELECT id FROM ({live_sql('id', 'tier')}) WHERE tier <> 'dormant')"


@query(f"""WITH {BM25}, {STEP_SQL}, {SEEDS}, {AWAKE}, k AS (SELECT DISTINCT a AS parent, b AS id FROM e WHERE rel = 'contains'), o AS (SELECT parent FROM k GROUP BY 1 HAVING count(*) <= 12)
SELECT qid, parent AS id, round(greatest(0.3::DOUBLE, max(score)), 6) AS score FROM sd JOIN k USING (id) SEMI JOIN o USING (parent) SEMI JOIN aw ON aw.id = k.parent
WHERE NOT EXISTS (SELECT 1 FROM sd s WHERE s.qid = sd.qid AND s.id = k.parent) GROUP BY 1, 2""")
def parent_boost(t):
    return G.parent_boost(seeds(t), edges(t), t.live("id", "tier")).select("qid", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, {STEP_SQL}, {SEEDS}, {AWAKE} SELECT qid, far AS id, round(max(score) * 0.8::DOUBLE, 6) AS score FROM sd JOIN be ON be.seed = sd.id SEMI JOIN aw ON aw.id = be.far
WHERE be.rel = 'contradicts' AND be.seed <> be.far AND NOT EXISTS (SELECT 1 FROM sd s WHERE s.qid = sd.qid AND s.id = be.far) GROUP BY 1, 2""")
def forced_contradictions(t):
    return G.force_contradictions(seeds(t), edges(t), t.live("id", "tier")).select("qid", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {STEP_SQL}, m AS ({live_sql('id', 'tier', 'age_hours')}), x AS (SELECT a, b, rel, p.tier AS ta, q.tier AS tb, p.age_hours AS aa, q.age_hours AS ba FROM e JOIN m p ON p.id = e.a JOIN m q ON q.id = e.b)
SELECT b AS seed, a AS id, rel FROM x WHERE rel = 'contradicts' AND ta = 'dormant' AND tb <> 'dormant' AND aa < ba UNION ALL SELECT a, b, rel FROM x WHERE rel IN ('depends_on', 'prevents') AND tb = 'dormant' AND ta <> 'dormant'""")
def dormant_resurrection(t):
    return G.resurrections(edges(t), t.live("id", "tier", "age_hours"))


@query(None)
def mmr_vectors(t):
    v = t.vectors()
    return R.mmr_vectors(R.vector_search(v, v.filter("id % 50 = 0"), 20), v, 5)


@query(None)
def bridge_terms(t):
    docs = t.live("id", "content")
    return R.bridges(R.bm25_search(docs, asked(t), 10), docs, asked(t))


@query(None)
def entity_bridge_hop2(t):
    docs = t.live("id", "content")
    return R.hop2(R.bm25_search(docs, asked(t), 10), docs, asked(t))
