"""Queries over version chains, filters and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import views as V
from mnemo.sources.tables import VER_SQL, live_sql, mem_sql

from .registry import query

VALUES_NS = [("agent:main",), ("agent:main:notes",), ("bad ns",), ("_x:y",), ("a",), ("a::b",), ("x-1:y_2",)]
ALIASES = [("USER1", "alice"), ("user2", "bob"), ("User3", "alice")]


@query(f"WITH v AS ({VER_SQL}) SELECT ns, key, max(version) AS version, arg_max(id, version) AS id, round(arg_max(value, version), 6) AS value FROM v WHERE NOT deleted GROUP BY 1, 2")
def latest_live(t):
    return V.latest_live(t.ver()).select("ns", "key", F.col("version").cast("bigint").alias("version"), "id", F.round("value", 6).alias("value"))


@query(f"""WITH v AS ({VER_SQL}), l AS (SELECT DISTINCT ns, key FROM v WHERE NOT deleted)
SELECT id, ns, key, version, lag(id) OVER (PARTITION BY ns, key ORDER BY version) AS supersedes, deleted FROM v SEMI JOIN l USING (ns, key)""")
def history_chain(t):
    return V.history(t.ver()).select("id", "ns", "key", F.col("version").cast("bigint").alias("version"), "supersedes", "deleted")


@query(f"""WITH v AS ({VER_SQL}), h AS (SELECT ns, key, max(version) AS head FROM v GROUP BY 1, 2),
w AS (SELECT id, ns, key, version AS base_version FROM v WHERE id % 3 = 0)
SELECT id, ns, key, base_version, head FROM w JOIN h USING (ns, key) WHERE head <> base_version""")
def version_cas_conflicts(t):
    v = t.ver()
    writes = v.filter("id % 3 = 0").select("id", "ns", "key", F.col("version").cast("bigint").alias("base_version"))
    return V.cas_conflicts(v, writes).select("id", "ns", "key", "base_version", F.col("head").cast("bigint").alias("head"))


@query(f"""WITH m AS ({live_sql()}) SELECT id, ns, kind FROM m
WHERE coalesce(valid_from_hours, age_hours) >= 240 AND (valid_to_hours IS NULL OR valid_to_hours < 240)""")
def as_of_recall(t):
    return t.live("id", "ns", "kind", "age_hours", "valid_from_hours", "valid_to_hours").filter(V.valid_at(240)).select("id", "ns", "kind")


@query(f"WITH m AS ({live_sql()}) SELECT id, key, tier FROM m WHERE tier NOT IN ('dormant', 'sensory', 'archived') AND age_hours BETWEEN 48 AND 720 AND kind = 'semantic' AND starts_with(ns, 'src:src1')")
def filtered_list(t):
    rows = t.live("id", "key", "tier", "age_hours", "kind", "ns")
    return rows.filter(V.tier_allowed("tier") & F.col("age_hours").between(48, 720) & (F.col("kind") == "semantic") & V.in_namespace("ns", "src:src1*")).select("id", "key", "tier")


@query(f"WITH m AS ({live_sql()}) SELECT ns, count(*) AS n, count(DISTINCT key) AS keys, CAST(sum(strlen(content) // 4 + 20) AS BIGINT) AS tokens FROM m GROUP BY 1")
def ns_stats(t):
    return t.live("ns", "key", "content").groupBy("ns").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum(X.est_tokens(F.col("content"))).alias("tokens"))


@query(f"WITH m AS ({live_sql()}) SELECT tier, count(*) AS n, CAST(sum(strlen(content) // 4 + 20) AS BIGINT) AS tokens, count(*) FILTER (WHERE pinned) AS pinned FROM m GROUP BY 1")
def tier_summary(t):
    return t.live("tier", "content", "pinned").groupBy("tier").agg(F.count("*").alias("n"), F.sum(X.est_tokens(F.col("content"))).alias("tokens"), F.count_if("pinned").alias("pinned"))


@query(f"WITH m AS ({live_sql('id', 'lang', 'source')}), x AS (SELECT lang AS tag FROM m UNION ALL SELECT source FROM m) SELECT tag, count(*) AS n FROM x WHERE tag IS NOT NULL GROUP BY 1")
def tag_counts(t):
    return t.live("id", "lang", "source").select(F.explode(F.array("lang", "source")).alias("tag")).filter("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""WITH m AS ({live_sql()}), r AS (SELECT lang, source, row_number() OVER (ORDER BY age_hours, id) AS r FROM m ORDER BY r LIMIT 20),
x AS (SELECT lang AS tag, r * 2 AS r FROM r UNION ALL SELECT source, r * 2 + 1 FROM r)
SELECT tag, min(r) AS first_seen FROM x WHERE tag IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 5""")
def recent_topics(t):
    top = t.live("id", "age_hours", "lang", "source").orderBy("age_hours", "id").limit(20)
    ranked = top.select(F.posexplode(F.array(F.struct("lang", "source"))), "age_hours", "id").selectExpr("col.lang AS lang", "col.source AS source", "age_hours", "id")
    from pyspark.sql import Window

    r = F.row_number().over(Window.orderBy("age_hours", "id")).cast("bigint")  # twenty rows
    both = ranked.withColumn("r", r).select(F.posexplode(F.array("lang", "source")).alias("p", "tag"), "r").filter("tag IS NOT NULL")
    return both.groupBy("tag").agg(F.min(F.col("r") * 2 + F.col("p")).alias("first_seen")).orderBy("first_seen").limit(5)


@query(f"WITH m AS ({live_sql()}) SELECT id, key, round(importance, 6) AS importance, left(content, 80) AS summary FROM m ORDER BY m.importance DESC, id LIMIT 5")
def top_importance(t):
    return t.live("id", "key", "importance", "content").orderBy(F.desc("importance"), "id").limit(5).select("id", "key", F.round("importance", 6).alias("importance"), F.left("content", F.lit(80)).alias("summary"))


@query(f"WITH m AS ({live_sql()}) SELECT id, round(importance, 6) AS importance, strlen(content) // 4 + 20 AS est_tokens FROM m WHERE pinned")
def pinned_scan(t):
    return V.pinned_scan(t.live("id", "importance", "content", "pinned", "age_hours")).select("id", F.round("importance", 6).alias("importance"), X.est_tokens(F.col("content")).cast("bigint").alias("est_tokens"))


@query(f"""WITH v AS ({VER_SQL}), x AS (SELECT 1 AS level, 'user' AS node FROM v UNION ALL SELECT 2, ns FROM v) SELECT level, node, count(*) AS n FROM x GROUP BY 1, 2""")
def ns_tree(t):
    return V.namespace_levels(t.ver())


@query("""SELECT ns, ns IN ('agent:main', 'agent:main:notes', 'a', 'x-1:y_2') AS ok, len(string_split(ns, ':'))::INT AS depth
FROM (VALUES ('agent:main'), ('agent:main:notes'), ('bad ns'), ('_x:y'), ('a'), ('a::b'), ('x-1:y_2')) v(ns)""")
def namespace_check(t):
    rows = t.spark.createDataFrame(VALUES_NS, "ns string")
    return rows.select("ns", V.namespace_ok("ns").alias("ok"), F.size(F.split("ns", ":")).alias("depth"))


@query(f"""WITH m AS ({live_sql()}), a(alias, canonical) AS (VALUES ('USER1', 'alice'), ('user2', 'bob'), ('User3', 'alice'))
SELECT coalesce(a.canonical, source_user) AS canonical, count(*) AS n, round(avg(importance), 6) AS importance FROM m LEFT JOIN a ON lower(a.alias) = lower(m.source_user) GROUP BY 1""")
def source_aliases(t):
    aliases = t.spark.createDataFrame(ALIASES, "alias string, canonical string")
    return V.resolve_alias(t.live("source_user", "importance"), aliases, "source_user").groupBy("canonical").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


@query(f"""WITH m AS ({live_sql()}), f AS (SELECT id, 'src/f' || id % 17 || '.go' AS path, CASE id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'modified' WHEN 2 THEN 'read' ELSE 'deleted' END AS rel FROM m
UNION ALL SELECT id, 'doc/g' || id % 5 || '.md', 'read' FROM m WHERE id % 2 = 0)
SELECT m.id, count(f.path) AS n_files, string_agg(DISTINCT f.path || '=' || f.rel, ',' ORDER BY f.path || '=' || f.rel) AS files FROM m LEFT JOIN f USING (id) GROUP BY 1""")
def attached_files(t):
    m = t.live("id")
    rel = F.element_at(F.array(*map(F.lit, ("created", "modified", "read", "deleted"))), (F.col("id") % 4 + 1).cast("int"))
    files = m.select("id", F.concat(F.lit("src/f"), F.col("id") % 17, F.lit(".go")).alias("path"), rel.alias("rel"))
    files = files.union(m.filter("id % 2 = 0").select("id", F.concat(F.lit("doc/g"), F.col("id") % 5, F.lit(".md")), F.lit("read")))
    named = V.with_files(m, files)
    return named.select("id", F.size("files").cast("bigint").alias("n_files"), F.expr("array_join(array_sort(transform(files, f -> f.path || '=' || f.rel)), ',')").alias("files"))


@query(f"WITH m AS ({mem_sql()}) SELECT count(*) AS total, count(*) FILTER (WHERE deleted_hours IS NULL) AS active, count(*) FILTER (WHERE deleted_hours IS NULL AND expires_in_hours <= 0) AS expired, count(*) FILTER (WHERE pinned OR locked) AS protected FROM m")
def store_totals(t):
    return t.mem("deleted_hours", "expires_in_hours", "pinned", "locked").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("deleted_hours").isNull()).alias("active"),
        F.count_if(F.expr("deleted_hours IS NULL AND expires_in_hours <= 0")).alias("expired"),
        F.count_if(V.protected()).alias("protected"),
    )


@query(f"""WITH m AS ({live_sql()}) SELECT id, key, kind, tier, CASE WHEN length(content) > 80 THEN left(content, 80) || '...' ELSE content END AS summary FROM m WHERE source_kind = 'stated'""")
def peek_stubs(t):
    return V.stubs(t.live("id", "key", "kind", "tier", "importance", "content", "source_kind").filter("source_kind = 'stated'")).select("id", "key", "kind", "tier", "summary")


@query(f"WITH m AS ({live_sql()}) SELECT kind, tier, count(*) AS n, round(avg(importance), 6) AS importance FROM m GROUP BY GROUPING SETS ((kind, tier), (kind), ())")
def kind_tier_rollup(t):
    return t.live("kind", "tier", "importance").rollup("kind", "tier").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
