"""Context assembly queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.operators import context as C
from mnemo.operators import search as R
from mnemo.operators import views as V
from mnemo.sources.tables import live_sql

from .graph import EDGE_SQL, edges
from .registry import query
from .retrieval import BM25, STOP, asked

CASES = lambda i: f"CASE kind WHEN 'episodic' THEN {S.KIND_WEIGHTS['episodic'][i]} WHEN 'procedural' THEN {S.KIND_WEIGHTS['procedural'][i]} ELSE {S.KIND_WEIGHTS['semantic'][i]} END::DOUBLE"
TIER = "CASE tier WHEN 'ltm' THEN 1.0 WHEN 'stm' THEN 0.8 WHEN 'dormant' THEN 0.15 WHEN 'sensory' THEN 0.1 ELSE 0.8 END::DOUBLE"
ACCESS = "CASE WHEN access_count > 0 THEN least(ln(access_count + 1.0) / ln(100.0), 1) ELSE 0 END"
SCORES = f"""{BM25}, cr AS (SELECT qid, m.*, list_filter(list_transform(regexp_extract_all(query, '\\S+'), lambda w: trim(lower(w), '?.,!"''()[]{{}}:;，。？！')), lambda w: w <> '' AND w NOT IN ({STOP})) AS terms,
 regexp_extract_all(lower(content), '[a-z0-9]{{2,}}') AS own FROM bmr JOIN m USING (id) JOIN q USING (qid) WHERE rank <= 20),
cg AS (SELECT *, 0.15::DOUBLE + 0.55::DOUBLE * CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: list_contains(own, t) OR (strlen(t) >= 4 AND len(list_filter(own, lambda w: starts_with(w, left(t, 4)))) > 0))) / len(terms) ELSE 0.5 END AS rel FROM cr),
cs AS (SELECT qid, id, round(rel, 6) AS relevance, source_user, source_kind, strlen(content) // 4 + 20 AS tokens,
 round((rel * {CASES(0)} + exp(-0.1::DOUBLE * (age_hours / 24.0::DOUBLE)) * {CASES(1)} + importance * {CASES(2)} + {ACCESS} * {CASES(3)})
  * CASE WHEN rel < 0.45 THEN greatest((rel - 0.15::DOUBLE) / 0.30::DOUBLE, 0.05::DOUBLE) ELSE 1.0::DOUBLE END * {TIER}, 6) AS score FROM cg)"""


def scored(t) -> DataFrame:
    docs = t.live("id", "content", "kind", "tier", "age_hours", "importance", "access_count")
    ranked = R.bm25_search(docs, asked(t), 20).select("qid", "id", F.lit(0.0).alias("similarity"))
    return C.scores(ranked, asked(t), docs)


@query(f"WITH {SCORES} SELECT qid, id, relevance, score, tokens FROM cs")
def context_scores(t):
    return scored(t)


@query(f"WITH {SCORES}, b AS (SELECT *, max(relevance) OVER (PARTITION BY qid) AS best FROM cs) SELECT qid, id, relevance, score FROM b WHERE score >= 0.35 OR (relevance >= 0.35 AND relevance >= 0.8 * best)")
def min_score_rescue(t):
    return C.above_floor(scored(t), 0.35).select("qid", "id", "relevance", "score")


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM cs),
x AS (SELECT qid, max(score) AS f, min(score) FILTER (WHERE r <= 5) AS l, count(*) AS n FROM r GROUP BY 1) SELECT qid, id, score FROM r JOIN x USING (qid) WHERE NOT (n >= 2 AND f - l < 0.1) OR r = 1""")
def min_spread(t):
    return C.min_spread(scored(t), 0.1).select("qid", "id", "score")


@query(f"""WITH {SCORES}, o AS (SELECT DISTINCT qid, source_user FROM cs WHERE source_kind = 'observed'), s AS (SELECT qid, source_user, id, score, row_number() OVER (PARTITION BY qid, source_user ORDER BY score DESC, id) AS r FROM cs SEMI JOIN o USING (qid, source_user) WHERE source_kind = 'stated')
SELECT qid, source_user, id, score FROM s WHERE r = 1""")
def statement_reserve(t):
    rows = scored(t).join(t.live("id", "source_user", "source_kind"), "id")
    return C.reserve_statements(rows).select("qid", "source_user", "id", "score")


@query(f"""WITH {SCORES}, n AS (SELECT qid, id, score, tokens, CASE WHEN tokens > 400 THEN least(tokens, 420) ELSE tokens END AS need FROM cs),
s AS (SELECT *, sum(need) OVER w AS tot FROM n WINDOW w AS (PARTITION BY qid ORDER BY score DESC, id)),
o AS (SELECT *, sum((tot > 1500)::INT) OVER (PARTITION BY qid ORDER BY score DESC, id) AS misses, 1500 - (tot - need) AS rest FROM s),
k AS (SELECT qid, id, score, CASE WHEN misses = 0 THEN need ELSE least(need, rest + 20) END AS tokens, misses = 1 OR tokens > 400 AS excerpt FROM o WHERE misses = 0 OR (misses = 1 AND tot > 1500 AND rest >= 25))
SELECT qid, id, tokens::BIGINT AS tokens, excerpt, (sum(tokens) OVER (PARTITION BY qid ORDER BY score DESC, id))::BIGINT AS used FROM k""")
def context_pack(t):
    return C.pack(scored(t), 1500)


@query(None)
def pinned_pack(t):
    from mnemo.functions import text as X

    rows = t.live("id", "importance", "content", "pinned").filter("pinned").select((F.col("id") % 3).alias("qid"), "id", X.est_tokens(F.col("content")).cast("bigint").alias("tokens"), "importance")
    return C.pack_pinned(rows, 2000)


@query(f"""WITH m AS ({live_sql()}), s AS (SELECT id // 64 AS qid, id, round(importance, 6) AS score FROM m), {EDGE_SQL},
c0 AS (SELECT DISTINCT b AS parent, a AS id FROM e WHERE rel = 'contains'), c AS (SELECT c0.* FROM c0 JOIN (SELECT parent FROM c0 GROUP BY 1 HAVING count(*) <= 12) USING (parent) SEMI JOIN m ON m.id = c0.parent),
f AS (SELECT s.qid, parent, count(*) AS n, max(score) AS score FROM s JOIN c USING (id) GROUP BY 1, 2 HAVING count(*) >= 1), g AS (SELECT DISTINCT f.qid, c.id FROM f JOIN c USING (parent))
SELECT qid, id, score, 0::BIGINT AS replaces FROM s ANTI JOIN g USING (qid, id) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = s.qid AND f.parent = s.id) UNION ALL SELECT qid, parent, score, n FROM f""")
def packing_substitution(t):
    m = t.live("id", "importance")
    rows = m.select(F.expr("id DIV 64").alias("qid"), "id", F.round("importance", 6).alias("score"))
    flipped = edges(t).select(F.col("b").alias("a"), F.col("a").alias("b"), "rel")
    return C.substitute_parents(rows, flipped, m, least=1)


@query(f"WITH m AS ({live_sql()}) SELECT id, CASE WHEN lang = 'de' OR source = 'src3' OR age_hours <= 72 THEN 2.5 ELSE 1.0 END::DOUBLE AS boost FROM m")
def session_scope_boost(t):
    return t.live("id", "lang", "source", "age_hours").select("id", C.session_boost(F.array("lang", "source"), F.col("age_hours"), ["de", "src3"], 72).alias("boost"))


@query(f"""WITH m AS ({live_sql()}), a(alias, canonical) AS (VALUES ('USER1', 'alice'), ('user2', 'bob'), ('User3', 'alice'))
SELECT id, CASE WHEN coalesce(a.canonical, source_user) = 'alice' THEN 1.8 ELSE 1.0 END::DOUBLE AS boost FROM m LEFT JOIN a ON lower(a.alias) = lower(source_user)""")
def source_boost(t):
    from .views import ALIASES

    aliases = t.spark.createDataFrame(ALIASES, "alias string, canonical string")
    return V.resolve_alias(t.live("id", "source_user"), aliases, "source_user").select("id", C.source_boost(F.col("canonical"), "alice").alias("boost"))


@query(f"""WITH m AS ({live_sql()}) SELECT id, round(exp(-0.1::DOUBLE * (age_hours / 24.0::DOUBLE)), 6) AS recency, round({ACCESS}, 6) AS access, {TIER} AS tier_factor,
round(CASE WHEN access_count > 0 THEN least(utility_count / access_count, 1) ELSE 0 END, 6) AS utility FROM m""")
def score_parts(t):
    rows = t.live("id", "age_hours", "access_count", "utility_count", "tier")
    return rows.select("id", F.round(S.recency(F.col("age_hours") / 24.0), 6).alias("recency"), F.round(S.access_frequency(F.col("access_count")), 6).alias("access"), S.tier_multiplier(F.col("tier")).alias("tier_factor"), F.round(S.utility_ratio(F.col("utility_count"), F.col("access_count")), 6).alias("utility"))


@query(f"""WITH m AS ({live_sql()}), x AS (SELECT id, greatest(age_hours, 1.0/60) AS l0, idle_hours, access_count AS n FROM m),
y AS (SELECT id, l0 AS life, CASE WHEN n < 1 THEN l0 ELSE least(greatest(idle_hours, 1.0/60), l0) END::DOUBLE AS last, greatest(n, 1) - 1 AS n FROM x),
z AS (SELECT id, ln(pow(last, -0.5) + CASE WHEN life > last THEN n * (pow(life, 0.5) - pow(last, 0.5)) / (0.5 * (life - last)) ELSE n * pow(last, -0.5) END) AS a FROM y) SELECT id, round(1 / (1 + exp(-a)), 6) AS activation FROM z""")
def actr_approx(t):
    rows = t.live("id", "age_hours", "idle_hours", "access_count")
    return rows.select("id", F.round(S.activation_approximate(F.col("age_hours"), F.col("idle_hours"), F.col("access_count")), 6).alias("activation"))


@query("""WITH a AS (SELECT user_id AS id, epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 3600.0 AS h FROM events), s AS (SELECT id, max(h) AS created, sum(pow(greatest(h, 1.0/60), -0.5)) AS s FROM a GROUP BY 1)
SELECT id, round(1 / (1 + exp(-ln(pow(greatest(created, 1.0/60), -0.5) + s))), 6) AS activation FROM s""")
def actr_exact(t):
    from mnemo.sources.tables import NOW

    hours = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3.6e9)
    rows = t.events.select(F.col("user_id").alias("id"), hours.alias("h")).groupBy("id").agg(F.max("h").alias("created"), F.collect_list("h").alias("hs"))
    return rows.select("id", F.round(S.activation_exact(F.col("created"), F.col("hs")), 6).alias("activation"))
