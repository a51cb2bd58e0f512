"""Mining and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import text as X
from mnemo.operators import evaluation as E
from mnemo.operators import mining as M
from mnemo.operators import search as R
from mnemo.sources.tables import SESS_SQL, VEC_SQL, live_sql, mem_sql

from .registry import query
from .retrieval import BM25, STOP, VECTOR, asked

TOPICS = f"""m AS ({mem_sql('id', 'content')}), tk AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({STOP}))) AS term FROM m),
tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2), ln AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
ts AS (SELECT id, term, round(tf / len * ln(1 + (SELECT count(*) FROM m) / (1.0::DOUBLE + df)), 6) AS score FROM tf JOIN df USING (term) JOIN ln USING (id)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM ts) WHERE rank <= 10)"""


@query(f"WITH {TOPICS} SELECT id, term, score, rank FROM tp")
def tfidf_topics(t):
    return M.topics(t.mem("id", "content"), 10)


@query(f"""WITH {TOPICS}, n AS (SELECT id, sqrt(sum(score * score)) AS norm FROM tp GROUP BY 1),
p AS (SELECT q.id AS qid, d.id, count(*) AS shared, sum(q.score * d.score) AS dot FROM tp q JOIN tp d ON d.term = q.term AND d.id <> q.id WHERE q.id % 50 = 0 GROUP BY 1, 2)
SELECT qid, id, shared, cosine FROM (SELECT p.qid, p.id, shared, round(dot / (n.norm * z.norm), 6) AS cosine FROM p JOIN n ON n.id = p.id JOIN n z ON z.id = p.qid) WHERE cosine >= 0.3""")
def topic_overlap_pairs(t):
    m = t.mem("id", "content")
    return M.topic_overlap(M.topics(m, 10), m.filter("id % 50 = 0"))


@query(None)
def topic_overlap_classes(t):
    """Every document; ``topic_overlap_pairs`` asks for those that its SQL names."""
    m = t.mem("id", "content")
    return M.topic_classes(m, M.topics(m, 10))


ENTITIES = f"""m AS ({mem_sql('id', 'content')}), li AS (SELECT id, unnest(string_split(content, chr(10))) AS t FROM m),
se AS (SELECT id, unnest(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM li),
ru AS (SELECT id, s, regexp_extract(s, '^[^\\p{{L}}\\p{{N}}_]*(\\p{{Lu}}[\\p{{L}}\\p{{N}}''_-]+(?: \\p{{Lu}}[\\p{{L}}\\p{{N}}''_-]+)*)', 1) AS first FROM se)"""


@query(None)
def entities(t):
    return M.entities(t.mem("id", "content"))


@query(None)
def entity_cooccurrence(t):
    m = t.mem("id", "content")
    return M.entity_overlap(M.entities(m), m.filter("id % 50 = 0"))


@query(None)
def entity_overlap_classes(t):
    """Every document; ``entity_cooccurrence`` asks for those that its SQL names."""
    m = t.mem("id", "content")
    return M.overlap_classes(m, M.entities(m), ["entity"], M.entity_overlap)


SEQ = f"""s AS ({SESS_SQL}), g AS (SELECT DISTINCT sid, array_to_string(steps[i:i+n-1], '>') AS pattern, n AS length FROM s, range(2, 6) r(n), unnest(range(1, len(steps) + 1)) u(i) WHERE i + n - 1 <= len(steps)),
p AS (SELECT pattern, any_value(length)::INT AS length, count(DISTINCT sid) AS support FROM g GROUP BY 1 HAVING count(DISTINCT sid) >= 2)"""


@query(f"WITH {SEQ} SELECT pattern, length, support FROM p")
def sequence_mining(t):
    return M.sequences(t.sess())


@query(f"""WITH {SEQ} SELECT pattern, length, support, round(least(0.85, 0.4 + 0.05 * support), 6)::DOUBLE AS importance FROM p
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.length > p.length AND q.support = p.support AND contains('>' || q.pattern || '>', '>' || p.pattern || '>'))""")
def sequence_maximal(t):
    return M.maximal(M.sequences(t.sess())).select("pattern", "length", "support", F.round(M.workflow_importance(F.col("support")), 6).alias("importance"))


SAID = [
    (1, "user: I prefer dark roast coffee in the morning.\nuser: What time is it?"),
    (2, "Actually, stop using tabs. Never share my address with anyone!"),
    (3, "We decided to keep the old server. The weather was fine."),
    (4, "I'm allergic to peanuts. Visit https://example.com/a now please."),
    (5, "nothing to see in this line"),
    (6, "My car is a red wagon.\nMy car is a red wagon."),
]


@query("""SELECT id::BIGINT AS id, segment, cues, importance::DOUBLE AS importance, kind, priority, rank::BIGINT AS rank FROM (VALUES
(1, 'I prefer dark roast coffee in the morning.', 'preference', 0.64, 'semantic', 'normal', 1),
(2, 'Never share my address with anyone!', 'boundary', 0.74, 'semantic', 'normal', 1),
(2, 'Actually, stop using tabs.', 'correction', 0.68, 'episodic', 'normal', 2),
(3, 'We decided to keep the old server.', 'decision', 0.62, 'semantic', 'normal', 1),
(4, 'I''m allergic to peanuts.', 'health', 0.66, 'episodic', 'normal', 1),
(6, 'My car is a red wagon.', 'fact', 0.52, 'semantic', 'low', 1)) v(id, segment, cues, importance, kind, priority, rank)""")
def capture_candidates(t):
    return M.capture(t.spark.createDataFrame(SAID, "id bigint, text string"))


@query("""SELECT id::BIGINT AS id, pos::BIGINT AS pos, heading, key, body FROM (VALUES (1, 0, '', 'preamble', 'intro line'), (1, 1, 'First Part!', 'first-part', 'alpha' || chr(10) || 'beta'), (1, 2, 'Second', 'second', ''),
(2, 0, '', 'preamble', 'no headings here'), (3, 1, 'Only', 'only', 'x')) v(id, pos, heading, key, body)""")
def markdown_sections(t):
    rows = [(1, "intro line\n## First Part!\nalpha\nbeta\n## Second"), (2, "no headings here"), (3, "## Only\nx")]
    return M.sections(t.spark.createDataFrame(rows, "id bigint, text string"))


@query(None)
def text_chunks(t):
    return M.chunks(t.mem("id", "content"))


@query("""WITH s AS (SELECT conv_id AS id, turn, role, text, strlen(text) AS n FROM conversations WHERE lower(role) NOT IN ('assistant', 'ai', 'bot', 'model', 'system', 'narrator')),
p AS (SELECT *, floor((sum(n) OVER w - n) / 500)::BIGINT AS win FROM s WINDOW w AS (PARTITION BY id, role ORDER BY turn)),
b AS (SELECT id, role, turn, text, win, lead(win) OVER (PARTITION BY id, role ORDER BY turn) AS nxt FROM p),
u AS (SELECT id, role, turn, text, win FROM b UNION ALL SELECT id, role, turn, text, nxt FROM b WHERE nxt > win),
o AS (SELECT id, role AS speaker, win AS "window", string_agg(text, chr(10) ORDER BY turn) AS text FROM u GROUP BY 1, 2, 3)
SELECT id, speaker, "window", text FROM o WHERE strlen(text) >= 50""")
def speaker_windows(t):
    turns = t.conversations.select(F.col("conv_id").alias("id"), "turn", "role", "text")
    return M.speaker_turns(turns)


RELEVANT = """rel AS (SELECT item_id AS qid, doc_id AS id FROM benchmark, documents WHERE contains(documents.text, substr(benchmark.text, 1, 60)))"""


@query(f"""WITH {VECTOR}, lab AS (SELECT vec_id AS id, label FROM embeddings), j AS (SELECT a.id AS qid, b.id FROM lab a JOIN lab b ON b.label = a.label AND b.id <> a.id WHERE a.id % 50 = 0), n AS (SELECT qid, count(*) AS n FROM j GROUP BY 1),
h AS (SELECT vr.qid, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM vr SEMI JOIN j USING (qid, id) WHERE rank <= 10 GROUP BY 1)
SELECT n.qid, round(coalesce(hits / 10, 0), 6) AS "precision", round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg,
round(coalesce(1 / first, 0), 6) AS mrr, coalesce(hits, 0) > 0 AS hit FROM n LEFT JOIN h USING (qid)""")
def eval_recall_ndcg_mrr(t):
    v = t.vectors()
    ranked = R.vector_search(v, v.filter("id % 50 = 0"), 10)
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    asked_labels = labels.filter("id % 50 = 0").select(F.col("id").alias("qid"), "label")
    judged = labels.join(asked_labels, "label").filter("id <> qid").select("qid", "id")
    return E.ranking_metrics(ranked, judged, 10)


@query(f"""WITH {BM25}, a AS (SELECT item_id AS qid, substr(text, 1, 30) AS answer FROM benchmark) SELECT qid, min(rank) AS first FROM bmr JOIN m USING (id) JOIN a USING (qid) WHERE rank <= 10 AND contains(lower(content), lower(answer)) GROUP BY 1""")
def eval_hit_at_k(t):
    docs = t.live("id", "content")
    answers = t.benchmark.select(F.col("item_id").alias("qid"), F.substring("text", F.lit(1), F.lit(30)).alias("answer"))
    return E.hit_by_substring(R.bm25_search(docs, asked(t), 10), docs, answers, 10)


@query("""WITH c AS (SELECT a.conv_id AS id, a.turn, a.text AS answer, b.text AS expected FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
w AS (SELECT *, regexp_extract_all(lower(answer), '[a-z0-9]{1,}') AS a, regexp_extract_all(lower(expected), '[a-z0-9]{1,}') AS e, lower(trim(expected)) AS low FROM c),
k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(e, lambda x: x = w))))), 0) AS common,
 CASE WHEN len(e) > 0 THEN len(list_intersect(a, e)) / len(list_distinct(e)) ELSE 0 END AS recall, low <> '' AND contains(lower(answer), low) AS holds FROM w),
f AS (SELECT *, CASE WHEN common > 0 THEN 2.0::DOUBLE * common / (len(a) + len(e)) ELSE 0 END AS f1 FROM k)
SELECT id, turn, holds AS contains, round(recall, 6) AS recall, round(f1, 6) AS f1, round(greatest(holds::INT::DOUBLE, recall, f1), 6) AS score FROM f""")
def answer_scores(t):
    c = t.conversations
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    rows = c.join(later, ["conv_id", "turn"])
    return rows.select(F.col("conv_id").alias("id"), "turn", E.answer_scores(F.col("text"), F.col("expected")).alias("x")).select("id", "turn", "x.*")


@query("""SELECT qid::BIGINT AS qid, intent, k FROM (VALUES (1, 'narrow', 5), (2, 'wide', 15), (3, 'wide', 15), (4, 'narrow', 5)) v(qid, intent, k)""")
def query_width(t):
    rows = [(1, "Where is the key?"), (2, "How many trips did we take?"), (3, "Compare both plans"), (4, "name of the river")]
    return t.spark.createDataFrame(rows, "qid bigint, query string").select("qid", E.wide_intent(F.col("query")).alias("intent"), E.top_k_for(F.col("query")).alias("k"))


@query(f"""WITH {VECTOR}, lab AS (SELECT vec_id AS id, label FROM embeddings), x AS (SELECT q.label, (d.label = q.label)::INT AS ok FROM vr JOIN lab q ON q.id = vr.qid JOIN lab d ON d.id = vr.id)
SELECT label, count(*) AS n, round(avg(ok), 6) AS "precision" FROM x GROUP BY GROUPING SETS ((label), ())""")
def eval_by_label(t):
    v = t.vectors()
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    ranked = R.vector_search(v, v.filter("id % 50 = 0"), 10)
    rows = ranked.join(labels.select(F.col("id").alias("qid"), "label"), "qid").join(labels.select("id", F.col("label").alias("found")), "id")
    return rows.rollup("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("found")).cast("int")), 6).alias("precision"))


@query(f"WITH m AS ({live_sql('id', 'content')}) SELECT id, strlen(content) // 4 + 20 AS est_tokens, trim(regexp_replace(lower(left(content, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM m")
def slugs(t):
    return t.live("id", "content").select("id", X.est_tokens(F.col("content")).cast("bigint").alias("est_tokens"), X.slug(F.left("content", F.lit(40))).alias("slug"))


@query(f"WITH v AS ({VEC_SQL}) SELECT label, count(*) AS n, round(avg(list_sum(list_transform(v, lambda x: x * x))), 6) AS energy FROM v GROUP BY 1")
def vector_stats(t):
    from mnemo.functions import score as S

    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(S.dot(F.col("embedding"), F.col("embedding"))), 6).alias("energy"))
