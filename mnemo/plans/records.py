"""Keys, dates, versions, rules, namespaces and the views a dashboard reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import evaluation as E
from mnemo.operators import graph as G
from mnemo.operators import lifecycle as L
from mnemo.operators import mining as M
from mnemo.operators import views as V
from mnemo.sources.tables import DLG_SQL, VER_SQL, live_sql, mem_sql

from .graph import EDGE_SQL, edges
from .lifecycle import DISTINCTIVE
from .registry import ORACLES, query
from .retrieval import STOP, _any, terms


@query("""WITH x AS (SELECT event_id, event_id % 6 AS f, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS c, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE f WHEN 0 THEN d || 'T' || c || 'Z' WHEN 1 THEN d || 'T' || c WHEN 2 THEN d || ' ' || c WHEN 3 THEN d WHEN 4 THEN 'about ' || d ELSE d || 'T' || c || '.25+02:00' END AS text,
 CASE f WHEN 3 THEN epoch(date_trunc('day', s)) WHEN 4 THEN NULL WHEN 5 THEN epoch(s) - 7200 ELSE epoch(s) END::BIGINT AS seconds FROM x""")
def flexible_dates(t):
    d, c, f = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.col("event_id") % 6
    text = F.when(f == 0, F.concat(d, F.lit("T"), c, F.lit("Z"))).when(f == 1, F.concat(d, F.lit("T"), c)).when(f == 2, F.concat(d, F.lit(" "), c)).when(f == 3, d)
    text = text.when(f == 4, F.concat(F.lit("about "), d)).otherwise(F.concat(d, F.lit("T"), c, F.lit(".25+02:00")))
    return t.events.select("event_id", text.alias("text")).withColumn("seconds", X.flexible_epoch(F.col("text")))


DIGITS, CJK = "0123456789", "零一二三四五六七八九"


@query(f"""WITH x AS (SELECT doc_id AS id, translate(doc_id::VARCHAR, '{DIGITS}', '{CJK}') AS z FROM documents),
y AS (SELECT *, CASE WHEN length(z) < 3 THEN z ELSE array_to_string(list_transform(range(1, length(z)), lambda i: substr(z, i::INT, 2)), ' ') END AS p FROM x)
SELECT id, CASE id % 3 WHEN 0 THEN z WHEN 1 THEN 'k' || z ELSE 'word' || id END AS term,
 CASE id % 3 WHEN 0 THEN CASE WHEN length(z) < 3 THEN z ELSE '"' || p || '"' END WHEN 1 THEN '"k ' || p || '"' ELSE 'word' || id END AS phrase FROM y""")
def cjk_phrases(t):
    z = F.translate(F.col("doc_id").cast("string"), DIGITS, CJK)
    term = F.when(F.col("doc_id") % 3 == 0, z).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("k"), z)).otherwise(F.concat(F.lit("word"), F.col("doc_id").cast("string")))
    return t.documents.select(F.col("doc_id").alias("id"), term.alias("term")).withColumn("phrase", X.cjk_query_term(F.col("term")))


FILLERS = ", ".join(f"'{w}'" for w in X.KEY_FILLERS)
KEY_SQL = f"""w AS (SELECT id, ns, list_filter(list_transform(regexp_extract_all(lower(content), '\\S+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+$', '', 'g')), lambda x: strlen(x) >= 4 AND x NOT IN ({FILLERS})) AS ws FROM m),
d AS (SELECT id, ns, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:3] AS ws FROM w),
k AS (SELECT id, ns, coalesce(nullif(trim(substr(trim(regexp_replace(lower(array_to_string(ws, ' ')), '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'note') AS key FROM d),
n AS (SELECT id, ns, key, row_number() OVER (PARTITION BY ns, key ORDER BY id) - 1 AS n FROM k)"""


@query(f"WITH m AS ({live_sql('id', 'ns', 'content')}), {KEY_SQL} SELECT id, ns, CASE WHEN n < 1 THEN key WHEN n > 26 THEN key || '-x' ELSE key || '-' || chr((96 + n)::INT) END AS key FROM n")
def capture_keys(t):
    return M.numbered_keys(t.live("id", "ns", "content").select("id", "ns", X.make_key(F.col("content")).alias("key")))


@query(f"""SELECT coalesce(nullif(trim(substr(trim(regexp_replace(lower(pattern), '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'steps') AS key, 'procedural' AS kind,
 replace(pattern, '>', ' -> ') AS content, importance, support FROM ({ORACLES['sequence_maximal']})""")
def mine_commit(t):
    from .mining import sequence_maximal

    return M.mined_memories(sequence_maximal(t))


@query(f"WITH x AS ({DLG_SQL}) SELECT id, array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda l: starts_with(l, 'user: ')), lambda l: substr(l, 7)), chr(10)) AS said FROM x")
def user_turns(t):
    return t.dlg().select("id", X.user_turns(F.col("content")).alias("said"))


HIGHLIT = f"""h AS (SELECT id, string_split(content, chr(10)) AS ls, {terms("string_split(content, chr(10))[1]")} AS ts FROM x)"""


@query(f"""WITH x AS ({DLG_SQL}), {HIGHLIT}
SELECT id, array_to_string(list_transform(ls, lambda l: CASE WHEN length(trim(l, ' ')) > 10 AND len(list_filter(ts, lambda w: contains(lower(l), w))) > 0 THEN '>>> ' || l ELSE l END), chr(10)) AS marked FROM h""")
def highlight_lines(t):
    first = F.split("content", "\n")[0]
    return t.dlg().select("id", X.bind(X.content_terms(first), lambda ts: X.highlight(F.col("content"), ts)).alias("marked"))


@query(f"""WITH x AS ({DLG_SQL}), l AS (SELECT id, list_transform(string_split(content, chr(10)), lambda y: trim(y, ' ')) AS ls FROM x),
c AS (SELECT id, string_split(array_to_string(list_transform(ls, lambda y: CASE WHEN y = '' OR instr(y, ': ') BETWEEN 2 AND 25 THEN chr(1) || y ELSE y END), chr(10)), chr(1)) AS ps FROM l),
p AS (SELECT id, list_filter(list_transform(ps, lambda y: trim(y, ' ' || chr(10) || chr(9) || chr(13))), lambda y: length(y) > 20) AS ps FROM c)
SELECT id, len(ps) AS n, array_to_string(ps, chr(10) || chr(10)) AS text FROM p""")
def paragraph_split(t):
    return t.dlg().select("id", X.paragraphs(F.col("content")).alias("p")).select("id", F.size("p").cast("bigint").alias("n"), F.array_join("p", "\n\n").alias("text"))


@query(None)
def best_excerpt(t):
    """The most telling part of each conversation, asked by the words of its last line."""
    last = F.element_at(F.split("content", "\n"), -1)
    return t.dlg().select("id", X.bind(X.content_terms(last), lambda ts: X.excerpt(F.col("content"), ts, 300)).alias("excerpt"))


@query(f"""WITH v AS ({VER_SQL}), l AS (SELECT ns, key, arg_max(id, version) AS id FROM v WHERE NOT deleted GROUP BY 1, 2),
a AS (SELECT DISTINCT ns, key || CASE WHEN id % 150 = 0 THEN '?' ELSE '' END AS key FROM v WHERE id % 50 = 0) SELECT ns, key, id FROM a LEFT JOIN l USING (ns, key)""")
def resolve_keys(t):
    v = t.ver()
    asked = v.filter("id % 50 = 0").select("ns", F.concat("key", F.when(F.col("id") % 150 == 0, "?").otherwise("")).alias("key"))
    return V.resolve(v, asked)


@query(f"""WITH v AS (SELECT *, id % 17 AS access_count FROM ({VER_SQL})), n AS (SELECT ns, key, max(version) AS top, arg_max(id, version) AS id, arg_max(access_count, version) AS own, count(*) FILTER (WHERE id % 3 > 0) AS accesses FROM v GROUP BY 1, 2),
o AS (SELECT ns, key, max(access_count) AS c FROM v JOIN n USING (ns, key) WHERE version < top GROUP BY 1, 2) SELECT id, accesses, coalesce(c, own) AS access_count FROM n LEFT JOIN o USING (ns, key)""".replace("SELECT ns, key, max(access_count) AS c FROM v", "SELECT v.ns, v.key, max(access_count) AS c FROM v"))
def rehearsal_carry_over(t):
    v = t.ver().withColumn("access_count", F.col("id") % 17)
    return L.carry_over(v, t.events.filter("event_id % 3 > 0").select(F.col("event_id").alias("id")))


@query(f"""WITH m AS ({mem_sql('id', 'utility_count', 'deleted_hours')}), c AS (SELECT doc_id // 3 AS id, count(*) AS n FROM documents WHERE doc_id % 4 > 0 GROUP BY 1)
SELECT id, utility_count + coalesce(n, 0) AS utility_count FROM m LEFT JOIN c USING (id) WHERE deleted_hours IS NULL""")
def utility_credit(t):
    rows = t.mem("id", "utility_count", "deleted_hours").filter("deleted_hours IS NULL").select("id", "utility_count")
    return L.credit(rows, t.documents.filter("doc_id % 4 > 0").select(F.expr("doc_id DIV 3").alias("id")))


@query(f"""WITH v AS (SELECT *, CASE WHEN id % 13 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS valid_to FROM ({VER_SQL})), k AS (SELECT ns, key, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS stamp FROM v WHERE id % 40 = 0 GROUP BY 1, 2),
l AS (SELECT ns, key, max(version) AS version FROM v WHERE NOT deleted GROUP BY 1, 2) SELECT v.id, coalesce(valid_to, CASE WHEN l.version IS NOT NULL THEN stamp END) AS valid_to FROM v LEFT JOIN l ON l.ns = v.ns AND l.key = v.key AND l.version = v.version LEFT JOIN k ON k.ns = v.ns AND k.key = v.key""")
def validity_stamps(t):
    v = t.ver().withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    marks = v.filter("id % 40 = 0").select("ns", "key", "at")
    return L.invalidate(v.withColumn("valid_to", F.when(F.col("id") % 13 == 0, F.col("at"))).drop("at"), marks).select("id", "valid_to")


RULE_SQL = ", ".join(f"('{r.id}', {r.priority})" for r in L.RULES)


@query(f"""WITH r(rule, priority) AS (VALUES {RULE_SQL}), s AS (SELECT DISTINCT ns FROM ({mem_sql('ns')})), b AS (SELECT ns, rule, priority FROM s, r),
x AS (SELECT ns, rule, 77 AS priority FROM b WHERE (strlen(ns) + strlen(rule)) % 3 = 0) SELECT * FROM x UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.ns = b.ns AND x.rule = b.rule)""")
def rule_seeding(t):
    spaces = t.mem("ns").distinct()
    none = t.spark.createDataFrame([], "ns string, rule string, priority int")
    old = L.seed_rules(spaces, none).filter((F.octet_length("ns") + F.octet_length("rule")) % 3 == 0).withColumn("priority", F.lit(77))
    return L.seed_rules(spaces, old)


@query(f"WITH m AS ({live_sql('id', 'lang', 'source')}) SELECT id, array_to_string(list_filter([lang, source], lambda x: x <> 'de'), ',') AS tags FROM m")
def tag_remove(t):
    return t.live("id", "lang", "source").select("id", F.array_join(L.remove_tag(F.array("lang", "source"), "de"), ",").alias("tags"))


@query(f"WITH m AS ({mem_sql('id', 'ns')}) SELECT id, ns, coalesce(ns = 'src:src1' OR starts_with(ns, 'src:src1:'), FALSE) AS deleted FROM m")
def namespace_soft_removal(t):
    return L.remove_namespace(t.mem("id", "ns"), "src:src1")


@query(f"WITH m AS ({mem_sql('id', 'ns')}) SELECT ns, count(*) AS n FROM m WHERE NOT coalesce(ns = 'src:src2' OR starts_with(ns, 'src:src2:'), FALSE) GROUP BY 1")
def namespace_hard_removal(t):
    return L.remove_namespace(t.mem("id", "ns"), "src:src2", hard=True).groupBy("ns").agg(F.count("*").alias("n"))


@query(f"WITH {EDGE_SQL} SELECT a, b, rel, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.a = e.a AND x.b = e.b AND x.rel = e.rel AND x.a % 5 = 2)")
def edge_delete(t):
    e = edges(t).select("a", "b", "rel", "weight")
    return G.delete_edges(e, e.filter("a % 5 = 2")).select("a", "b", "rel", "weight")


@query(f"""WITH {EDGE_SQL}, m AS ({live_sql('id', 'ns', 'key', 'kind', 'tier', 'importance')}), o AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT b AS id, count(*) AS n FROM e GROUP BY 1)
SELECT m.*, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM m LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def dashboard_memories(t):
    return V.edge_counts(t.live("id", "ns", "key", "kind", "tier", "importance"), edges(t))


@query(f"""WITH {EDGE_SQL}, m AS (SELECT id, key FROM ({live_sql('id', 'ns', 'key')}) WHERE starts_with(ns, 'src:src1'))
SELECT x.key AS from_key, y.key AS to_key, rel, weight FROM (SELECT DISTINCT a, b, rel, weight FROM e) e JOIN m x ON x.id = e.a JOIN m y ON y.id = e.b""")
def dashboard_graph(t):
    return V.namespace_graph(t.live("id", "ns", "key"), edges(t), "src:src1*")


@query(f"""WITH {EDGE_SQL}, x AS (SELECT doc_id % 5 AS qid, doc_id AS id FROM documents WHERE doc_id % 3 = 1), g AS (SELECT doc_id % 5 AS qid, doc_id AS id FROM documents WHERE doc_id % 4 < 2),
k AS (SELECT DISTINCT a, b FROM e WHERE rel = 'contains'), d AS (SELECT * FROM g SEMI JOIN x USING (qid, id)),
c AS (SELECT g.qid, g.id, x.id AS child FROM g ANTI JOIN x USING (qid, id) JOIN k ON k.a = g.id JOIN x ON x.qid = g.qid AND x.id = k.b),
r AS (SELECT qid, count(*) AS n FROM (SELECT qid, id FROM d UNION SELECT qid, id FROM c) GROUP BY 1), h AS (SELECT qid, count(*) AS n FROM (SELECT qid, id FROM d UNION SELECT qid, child FROM c) GROUP BY 1)
SELECT qid, round(coalesce(r.n, 0) / (SELECT count(*) FROM g WHERE g.qid = q.qid), 6) AS precision, round(coalesce(h.n, 0) / (SELECT count(*) FROM x WHERE x.qid = q.qid), 6) AS recall
FROM (SELECT DISTINCT qid FROM x) q LEFT JOIN r USING (qid) LEFT JOIN h USING (qid)""")
def eval_parent_cover(t):
    d = t.documents.select((F.col("doc_id") % 5).alias("qid"), F.col("doc_id").alias("id"))
    found = E.covered_metrics(d.filter("id % 3 = 1"), d.filter("id % 4 < 2"), edges(t).filter("rel = 'contains'"))
    return found.select("qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT lang, '| ' || lang || ' | ' || count(*) || ' | ' || floor(avg((doc_id * 37 % 100) / 100.0::DOUBLE) * 100 + 0.5)::BIGINT || '% | ' || floor(avg((doc_id * 7 % 40) / 40.0::DOUBLE) * 100 + 0.5)::BIGINT || '% |' AS line
FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def report_table(t):
    rows = t.documents.filter("lang IS NOT NULL").select("lang", (F.col("doc_id") * 37 % 100 / 100.0).alias("recall"), (F.col("doc_id") * 7 % 40 / 40.0).alias("mrr"))
    return E.report_lines(rows, "lang", ["recall", "mrr"])


ASKING = ["", "today ", "What is the current plan: ", "any tips? ", "last week ", "a month ago ", "this week "]
ASKING_SQL = "(SELECT conv_id, turn, [" + ", ".join(f"'{x}'" for x in ASKING) + "][((conv_id + turn) % 7 + 1)::INT] || text AS query FROM conversations)"


def said(t, cues):
    """Turns of all conversations, each opened by one of the cues."""
    cue = F.element_at(F.array(*map(F.lit, cues)), ((F.col("conv_id") + F.col("turn")) % len(cues) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat(cue, "text").alias("query"))


@query(f"""SELECT conv_id, turn, {_any(X.TEMPORAL_WORDS)} AS temporal, {_any(X.UPDATE_WORDS)} AS update, {_any(X.PREFERENCE_WORDS, "?.,!\"''")} AS wants,
CASE WHEN regexp_matches(query, '(?i)\\byesterday\\b') THEN 48 WHEN regexp_matches(query, '(?i)\\blast week\\b|\\ba week ago\\b|\\bpast week\\b') THEN 288
 WHEN regexp_matches(query, '(?i)\\blast month\\b|\\ba month ago\\b|\\bpast month\\b') THEN 1080 WHEN regexp_matches(query, '(?i)\\btoday\\b|\\bthis morning\\b|\\btonight\\b') THEN 24
 WHEN regexp_matches(query, '(?i)\\bthis week\\b') THEN 168 END AS from_hours FROM {ASKING_SQL} q""")
def turn_intents(t):
    q = F.col("query")
    return said(t, ASKING).select("conv_id", "turn", X.is_temporal(q).alias("temporal"), X.is_update(q).alias("update"), X.wants_preference(q).alias("wants"), X.temporal_window(q)["from_hours"].alias("from_hours"))


WIDTH_SQL = "['', 'How many ', 'List '][((conv_id + turn) % 3 + 1)::INT] || text"
WIDE = "(?i)\\b(how many|list|all|every|compare|summar\\w+|overall|in total|both)\\b"


@query(f"WITH x AS (SELECT conv_id, turn, regexp_matches({WIDTH_SQL}, '{WIDE}') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN w THEN 'wide' ELSE 'narrow' END AS intent, CASE WHEN w THEN 15 ELSE 5 END AS k FROM x")
def turn_width(t):
    return said(t, ["", "How many ", "List "]).select("conv_id", "turn", E.wide_intent(F.col("query")).alias("intent"), E.top_k_for(F.col("query")).alias("k"))


@query(f"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations),
y AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(ws[2:], lambda w: trim(w, '{X.TRIM_SET.replace("'", "''")}')), lambda w: strlen(w) >= 3 AND regexp_matches(w, '^[A-Z]')), lambda w: lower(w)), lambda w: w NOT IN ({STOP})) AS ns FROM x)
SELECT conv_id, turn, array_to_string(list_filter(ns, lambda w, i: list_position(ns, w) = i), '|') AS names FROM y""")
def turn_names(t):
    return t.conversations.select("conv_id", "turn", F.array_join(X.query_names(F.col("text")), "|").alias("names"))


SECTIONED = "'intro' || chr(10) || '## ' || replace(coalesce(text, ''), '. ', '.' || chr(10) || '## ')"


@query(f"""WITH x AS (SELECT doc_id AS id, string_split({SECTIONED}, chr(10) || '## ') AS ps FROM documents), y AS (SELECT id, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM x),
z AS (SELECT id, pos, trim(CASE WHEN pos > 0 THEN '## ' || p ELSE p END, ' ' || chr(10) || chr(9) || chr(13)) AS part FROM y), h AS (SELECT *, regexp_extract(part, '^## (.*)', 1) AS heading FROM z WHERE part <> '')
SELECT id, pos, heading, CASE WHEN heading <> '' THEN trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'preamble' END AS key,
 trim(regexp_replace(part, '^## .*\\n?', ''), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM h""")
def document_sections(t):
    marked = F.concat(F.lit("intro\n## "), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n## ")))
    return M.sections(t.documents.select(F.col("doc_id").alias("id"), marked.alias("text")))


NOTE_SQL = "SELECT conv_id * 1000 + turn AS id, 'c' || conv_id % 10 AS ns, 'k' || turn AS key, CASE WHEN turn % 3 = 0 THEN 'switched to another ' ELSE '' END || text AS content, 100000000 - (conv_id * 1000 + turn) AS age_hours FROM conversations"


@query(f"""WITH m AS (SELECT *, regexp_matches(content, '{X.CHANGE_CUES.replace("'", "''")}') AS new, {DISTINCTIVE} AS ts FROM ({NOTE_SQL})), n AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY age_hours DESC, id) AS pos FROM m),
p AS (SELECT x.id AS new_id, y.id AS old_id, y.pos AS pos, len(list_intersect(x.ts, y.ts)) AS overlap FROM n x JOIN n y ON x.ns = y.ns AND y.pos < x.pos AND y.pos >= x.pos - 100 AND x.key <> y.key WHERE x.new)
SELECT new_id, old_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY overlap DESC, pos DESC) AS r FROM p WHERE overlap >= 2) WHERE r = 1""")
def turn_supersedes(t):
    i = F.col("conv_id") * 1000 + F.col("turn")
    content = F.concat(F.when(F.col("turn") % 3 == 0, "switched to another ").otherwise(""), "text")
    return L.superseded(t.conversations.select(i.alias("id"), F.concat(F.lit("c"), (F.col("conv_id") % 10).cast("string")).alias("ns"), F.concat(F.lit("k"), F.col("turn").cast("string")).alias("key"), content.alias("content"), (F.lit(100000000) - i).alias("age_hours")))


@query("""SELECT doc_id AS id, (doc_id % 50) || ['d', 'h', 'm', 's', 'w', ''][(doc_id % 6 + 1)::INT] AS ttl, CASE doc_id % 6 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 WHEN 3 THEN 1 END * (doc_id % 50) AS seconds FROM documents""")
def document_ttl(t):
    unit = F.element_at(F.array(*map(F.lit, ["d", "h", "m", "s", "w", ""])), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select(F.col("doc_id").alias("id"), F.concat((F.col("doc_id") % 50).cast("string"), unit).alias("ttl")).withColumn("seconds", L.ttl_seconds(F.col("ttl")))
