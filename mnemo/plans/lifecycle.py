"""Lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X
from mnemo.operators import graph as G
from mnemo.operators import lifecycle as L
from mnemo.operators import search as R
from mnemo.sources.tables import NOW, VEC_SQL, live_sql, mem_sql

from .graph import COMPONENT_SQL, EDGE_SQL, edges
from .registry import query
from .retrieval import asked

RATIO = "CASE WHEN access_count > 0 THEN least(utility_count / access_count, 1) ELSE 0 END"
EASE = "least(1.0 + 0.2 * utility_count, 4.0)"


def _rules_sql(logged: bool) -> str:
    when = {
        "sys-decay-sensory": "tier = 'sensory' AND age_hours > 4",
        "sys-promote-sensory": "tier = 'sensory' AND age_hours > 1 AND access_count > 1",
        "sys-prune-low-utility": f"access_count > 20 AND utility_count > 0 AND {RATIO} < 0.05" + (" AND (days IS NULL OR (days < 2 AND age_hours >= 72))" if logged else ""),
        "sys-demote-stale-ltm": f"tier = 'ltm' AND idle_hours > 168 AND NOT ({EASE} > 1 AND idle_hours < 168 * {EASE})",
        "sys-promote-to-ltm": "tier = 'stm' AND access_count > 50 AND age_hours > 72" + (" AND (days IS NULL OR days >= 3)" if logged else ""),
        "sys-archive-old-episodic": "tier = 'stm' AND kind = 'episodic' AND age_hours > 720 AND access_count < 5",
        "sys-decay-unaccessed": "tier = 'stm' AND age_hours > 48 AND access_count < 10",
    }
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in when.items()) + " END"


DAYS = "d AS (SELECT user_id AS id, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1)"
MATCH = f"{DAYS}, m AS ({live_sql()}), x AS (SELECT m.*, d.days FROM m LEFT JOIN d USING (id)), h AS (SELECT *, {_rules_sql(True)} AS rule FROM x)"


def days(t):
    return L.access_days(t.events.select(F.col("user_id").alias("id"), "ts"))


@query(f"WITH {MATCH} SELECT id, rule FROM h WHERE rule IS NOT NULL")
def reflect_first_match(t):
    return L.first_match(t.live(), days=days(t)).filter("rule IS NOT NULL").select("id", "rule")


@query(f"""WITH {MATCH}, f AS (SELECT *, rule IS NOT NULL AND NOT (pinned OR locked) AS free FROM h)
SELECT id, round(CASE WHEN free AND rule = 'sys-decay-unaccessed' THEN greatest(0.1, importance * 0.95) ELSE importance END, 6) AS importance,
CASE WHEN free AND rule = 'sys-promote-sensory' THEN 'stm' WHEN free AND rule = 'sys-promote-to-ltm' THEN 'ltm' WHEN free AND rule IN ('sys-prune-low-utility', 'sys-demote-stale-ltm', 'sys-archive-old-episodic') THEN 'dormant' ELSE tier END AS tier,
coalesce(free AND rule = 'sys-decay-sensory', FALSE) AS deleted FROM f""")
def reflect_actions(t):
    return L.apply_actions(L.first_match(t.live(), days=days(t))).select("id", F.round("importance", 6).alias("importance"), "tier", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query(f"WITH {DAYS} SELECT id, days FROM d")
def spaced_access_days(t):
    return days(t)


@query(f"WITH m AS ({live_sql()}) SELECT id, round({EASE}, 6)::DOUBLE AS ease FROM m")
def ease_update(t):
    return t.live("id", "utility_count").select("id", F.round(S.ease(F.col("utility_count")), 6).alias("ease"))


@query(f"WITH m AS ({mem_sql()}) SELECT id, ns FROM m WHERE deleted_hours IS NULL AND expires_in_hours <= 0")
def gc_expired(t):
    return t.mem("id", "ns", "deleted_hours", "expires_in_hours").filter(L.expired()).select("id", "ns")


@query(f"WITH m AS ({mem_sql()}) SELECT id, priority FROM m WHERE deleted_hours IS NULL AND NOT (pinned OR locked) AND priority IN ('low', 'normal') AND (idle_hours > 500 OR (access_count >= 5 AND {RATIO} < 0.2))")
def gc_stale(t):
    return t.mem().filter(L.stale(500)).select("id", "priority")


@query(f"WITH m AS ({mem_sql()}) SELECT id, deleted_hours FROM m WHERE deleted_hours > 720 AND NOT (pinned OR locked)")
def purge_candidates(t):
    return t.mem("id", "deleted_hours", "pinned", "locked").filter(L.purgeable(720)).select("id", "deleted_hours")


@query(f"WITH {EDGE_SQL}, m AS ({mem_sql()}), s AS (SELECT id FROM m WHERE NOT coalesce(deleted_hours > 720 AND NOT (pinned OR locked), FALSE)) SELECT a, b, rel FROM e WHERE a IN (SELECT id FROM s) AND b IN (SELECT id FROM s)")
def purge_cascade(t):
    stay = t.mem("id", "deleted_hours", "pinned", "locked").filter(~F.coalesce(L.purgeable(720), F.lit(False)))
    return L.cascade(L.cascade(edges(t), stay, "a"), stay, "b").select("a", "b", "rel")


@query("""SELECT event_id, id FROM (SELECT event_id, user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events
WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY AND user_id % 7 <> 0) WHERE r <= 30""")
def access_log_prune(t):
    log = t.events.select("event_id", F.col("user_id").alias("id"), "ts")
    alive = t.events.select(F.col("user_id").alias("id")).filter("id % 7 <> 0").distinct()
    return L.prune_log(log, NOW, 20, 30, alive).select("event_id", "id")


@query(f"""WITH m AS ({live_sql()}) SELECT id, CASE WHEN id % 4 = 0 THEN CASE tier WHEN 'sensory' THEN 'stm' WHEN 'stm' THEN 'ltm' ELSE tier END WHEN id % 4 = 1 THEN CASE tier WHEN 'ltm' THEN 'stm' WHEN 'stm' THEN 'dormant' ELSE tier END ELSE tier END AS tier,
round(CASE WHEN id % 4 = 2 THEN least(1, importance + 0.1) WHEN id % 4 = 3 THEN greatest(0, importance - 0.1) ELSE importance END, 6) AS importance FROM m""")
def curate_project(t):
    part = F.col("id") % 4
    tier = F.when(part == 0, L.curate("promote")["tier"]).when(part == 1, L.curate("demote")["tier"]).otherwise(F.col("tier"))
    weight = F.when(part == 2, L.curate("boost")["importance"]).when(part == 3, L.curate("diminish")["importance"]).otherwise(F.col("importance"))
    return t.live("id", "tier", "importance").select("id", tier.alias("tier"), F.round(weight, 6).alias("importance"))


@query(f"WITH m AS ({mem_sql()}), c AS (SELECT sha256(content) AS hash, min(id) AS least, count(*) AS n FROM m GROUP BY 1) SELECT m.id, least, n FROM m JOIN c ON c.hash = sha256(m.content)")
def exact_dups(t):
    m = t.mem("id", "content")
    return m.withColumn("hash", F.sha2("content", 256)).join(L.exact_classes(m, []), "hash").select("id", "least", "n")


DISTINCTIVE = "list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}]+'), lambda w: length(w) >= 4))"


@query(f"""WITH m AS ({mem_sql('id', 'content')}), k AS (SELECT id, {DISTINCTIVE} AS tokens FROM m), s AS (SELECT * FROM k WHERE len(tokens) >= 5), p AS (SELECT id, unnest(tokens) AS token FROM s),
c AS (SELECT q.id AS qid, p.id, count(*) AS shared FROM p q JOIN p ON p.token = q.token AND p.id <> q.id WHERE q.id % 50 = 0 GROUP BY 1, 2)
SELECT qid, c.id, shared FROM c JOIN s a ON a.id = qid JOIN s b ON b.id = c.id WHERE shared >= 5 AND shared >= 0.7 * len(a.tokens) AND shared >= 0.7 * len(b.tokens)""")
def paraphrase_pairs(t):
    m = t.mem("id", "content")
    return L.paraphrases(m, m.filter("id % 50 = 0"))


@query(None)
def paraphrase_classes(t):
    """Every document; ``paraphrase_pairs`` asks for those that its SQL names."""
    return L.paraphrase_classes(t.mem("id", "content"))


@query(f"""WITH m AS ({mem_sql()}), c AS (SELECT sha256(content) AS hash, min(id) AS least FROM m GROUP BY 1), d AS (SELECT least AS id, max(importance) AS i, count(*) AS n FROM m JOIN c ON c.hash = sha256(m.content) WHERE m.id <> least GROUP BY 1)
SELECT m.id, round(greatest(importance, coalesce(i, importance)), 6) AS importance, (access_count + coalesce(n, 0))::BIGINT AS access_count FROM m LEFT JOIN d USING (id) WHERE m.id IN (SELECT least FROM c)""")
def dedup_canonical(t):
    m = t.mem("id", "content", "importance", "access_count")
    marked = m.withColumn("hash", F.sha2("content", 256)).join(L.exact_classes(m, []).select("hash", "least"), "hash")
    news = marked.filter("id <> least").select(F.col("least").alias("id"), "importance")
    return L.reinforce(marked.filter("id = least").select("id", "importance", "access_count"), news).select("id", F.round("importance", 6).alias("importance"), F.col("access_count").cast("bigint").alias("access_count"))


@query(f"""WITH m AS ({live_sql()}), g AS (SELECT *, id // 4 AS g FROM m)
SELECT g, count(*) AS n, arg_max(id, (importance, -id)) AS survivor, round(max(importance), 6) AS importance, max(access_count) AS access_count, max(utility_count) AS utility_count,
arg_max(tier, CASE tier WHEN 'ltm' THEN 3 WHEN 'stm' THEN 2 WHEN 'sensory' THEN 1 ELSE 0 END) AS tier, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM unnest(list_concat(list(lang), list(source))) u(x)) AS tags FROM g GROUP BY 1""")
def merge_group_max(t):
    m = t.live("id", "importance", "access_count", "utility_count", "tier", "lang", "source").withColumn("g", F.expr("id DIV 4")).withColumn("tags", F.array("lang", "source"))
    return L.merge_groups(m, "g").select("g", "n", "survivor", F.round("importance", 6).alias("importance"), "access_count", "utility_count", "tier", F.array_join("tags", ",").alias("tags"))


@query(f"WITH m AS ({live_sql()}), x AS (SELECT id // 3 AS g, id, lang AS tag FROM m UNION SELECT id // 3, id, source FROM m), s AS (SELECT id // 3 AS g, count(*) AS n FROM m GROUP BY 1) SELECT g, tag FROM x JOIN s USING (g) GROUP BY g, tag, n HAVING count(*) = n")
def cluster_tags(t):
    m = t.live("id", "lang", "source").select(F.expr("id DIV 3").alias("g"), "id", F.array("lang", "source").alias("tags"))
    return L.shared_tags(m, "g")


@query(None)
def leader_clusters(t):
    return L.leader_clusters(t.vectors().withColumn("g", (F.col("label") % 4).cast("bigint")), "g", 0.38)


@query(f"""WITH RECURSIVE {COMPONENT_SQL}, k AS (SELECT DISTINCT b AS id FROM e WHERE rel = 'contains')
SELECT comp, count(*) AS n, count(*) FILTER (WHERE k.id IS NULL) AS orphans FROM c LEFT JOIN k USING (id) GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE k.id IS NULL) * 2 > count(*)""")
def consolidation_candidates(t):
    e = edges(t)
    return L.consolidations(G.components(e.filter("rel = 'relates_to'")), e.filter("rel = 'contains'"))


@query(f"WITH m AS ({live_sql()}) SELECT id, array_to_string(list_distinct([CASE WHEN lang = 'de' THEN 'german' ELSE lang END, source]), ',') AS tags FROM m".replace("list_distinct([", "([").replace("source]),", "source]),"))
def tag_rename(t):
    return t.live("id", "lang", "source").select("id", F.array_join(L.rename_tag(F.array("lang", "source"), "de", "german"), ",").alias("tags"))


FACTS = [
    (1, "home", "garden", "planted seven yellow roses beside the kitchen window", 90),
    (2, "home", "berries", "strawberry plants grow behind the garage every summer", 80),
    (3, "home", "garden2", "moved the yellow roses from kitchen window to the garage", 10),
    (4, "work", "editor", "everyone uses the heavy editor with vertical tabs", 70),
    (5, "work", "editor2", "team switched to another editor without vertical tabs", 5),
    (6, "work", "note", "no longer anything shared here", 4),
]
FACT_SQL = ", ".join("({}, '{}', '{}', '{}', {})".format(*f) for f in FACTS)


@query("SELECT new_id::BIGINT AS new_id, old_id::BIGINT AS old_id, overlap::BIGINT AS overlap FROM (VALUES (3, 1, 4), (5, 4, 3)) v(new_id, old_id, overlap)")
def supersede_pairs(t):
    return L.superseded(t.spark.createDataFrame(FACTS, "id bigint, ns string, key string, content string, age_hours bigint"))


@query(None)
def supersede_order(t):
    ranked = R.bm25_search(t.live("id", "content"), asked(t), 20)
    replaces = t.documents.filter("doc_id > 1").select(F.col("doc_id").alias("new_id"), F.expr("doc_id DIV 2").alias("old_id"))
    return L.supersede_order(ranked, replaces)


@query("SELECT ttl, seconds::BIGINT AS seconds FROM (VALUES ('7d', 604800), ('12h', 43200), ('30m', 1800), ('5s', 5), ('x', NULL), ('3w', NULL)) v(ttl, seconds)")
def ttl_seconds(t):
    return t.spark.createDataFrame([("7d",), ("12h",), ("30m",), ("5s",), ("x",), ("3w",)], "ttl string").select("ttl", L.ttl_seconds(F.col("ttl")).alias("seconds"))


@query(f"""WITH v AS ({VEC_SQL}), p AS (SELECT a.id AS qid, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM v a JOIN v b ON b.id < a.id AND b.id >= a.id - 50 WHERE a.id % 50 = 0)
SELECT qid, id, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS r FROM p WHERE c > 0.1) WHERE r = 1""")
def semantic_dedup_window(t):
    from pyspark.sql import Window

    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    news = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("w"))
    spread = news.select("qid", "w", F.explode(F.sequence(F.greatest(F.col("qid") - 50, F.lit(0)), F.greatest(F.col("qid") - 1, F.lit(0)))).alias("id")).filter("id < qid")
    near = spread.join(v, "id").select("qid", "id", F.round(S.cosine(F.col("w"), F.col("v")), 6).alias("cosine")).filter("cosine > 0.1")
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return near.withColumn("r", F.row_number().over(w)).filter("r = 1").select("qid", "id", "cosine")


@query(f"WITH m AS ({live_sql('id', 'content')}) SELECT id, len({DISTINCTIVE}) AS n FROM m")
def distinctive_token_counts(t):
    return t.live("id", "content").select("id", F.size(X.distinctive_tokens(F.col("content"))).cast("bigint").alias("n"))
