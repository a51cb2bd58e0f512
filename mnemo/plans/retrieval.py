"""Search queries: every benchmark item (or every fiftieth vector) asks all live memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X
from mnemo.operators import search as R
from mnemo.sources.tables import DLG_SQL, VEC_SQL, live_sql

from .registry import query

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
BM25 = f"""m AS ({live_sql()}),
tok AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM m),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT id, sum(tf) AS len FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q) WHERE term NOT IN ({STOP})),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
 FROM post JOIN df USING (term) JOIN qt USING (term) JOIN len USING (id), st GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm)"""
TERMS = f"list_filter(list_transform(regexp_extract_all({{0}}, '\\S+'), lambda w: trim(lower(w), '?.,!\"''()[]{{{{}}}}:;')), lambda w: strlen(w) > 2 AND w NOT IN ({STOP}))"


def terms(column: str) -> str:
    return TERMS.format(column)


VECTOR = f"""v AS ({VEC_SQL}),
vr AS (SELECT * FROM (SELECT q.id AS qid, d.id, round(list_cosine_similarity(q.v, d.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, d.v), 6) DESC, d.id) AS rank
 FROM v q JOIN v d ON q.id <> d.id AND q.id % 50 = 0 WHERE list_cosine_similarity(q.v, d.v) >= 0.2) WHERE rank <= 10)"""
LIKE = f"""lt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({terms('query')}) AS term FROM q)),
lk AS (SELECT qid, m.id, m.age_hours, count(*) AS hits FROM lt, m WHERE contains(lower(m.content), term) GROUP BY 1, 2, 3),
lkr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY age_hours, id) AS rank FROM lk)"""
FUSED = """f AS (SELECT qid, id, sum(1.0::DOUBLE / (20 + rank)) AS score FROM (SELECT qid, id, rank FROM bmr WHERE rank <= 50 UNION ALL SELECT qid, id, rank FROM lkr WHERE rank <= 50) GROUP BY 1, 2)"""


def asked(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {BM25} SELECT qid, id, score, rank FROM bmr WHERE rank <= 10")
def bm25_search(t):
    return R.bm25_search(t.live("id", "content"), asked(t), 10).select("qid", "id", "score", "rank")


@query(f"WITH {BM25}, {LIKE} SELECT qid, id, hits, rank FROM lkr WHERE rank <= 10")
def like_search(t):
    return R.substring_search(t.live("id", "content", "age_hours"), asked(t), 10)


@query(f"WITH {VECTOR} SELECT qid, id, score, rank FROM vr")
def vector_topk(t):
    v = t.vectors()
    return R.vector_search(v, v.filter("id % 50 = 0"), 10).select("qid", "id", "score", "rank")


def fused(t):
    docs = t.live("id", "content", "age_hours")
    return R.fuse([R.bm25_search(docs, asked(t), 50), R.substring_search(docs, asked(t), 50)])


@query(f"WITH {BM25}, {LIKE}, {FUSED} SELECT * FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM f) WHERE rank <= 10")
def hybrid_rrf(t):
    return R.top(fused(t).withColumn("score", F.round("score", 6)), 10).select("qid", "id", "score", "rank")


@query(f"""WITH {BM25}, {LIKE}, {FUSED},
b AS (SELECT f.qid, f.id, f.score, m.age_hours, m.priority, {terms('q.query')} AS terms, lower(m.content) AS low FROM f JOIN m USING (id) JOIN q USING (qid)),
o AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(low, t))) / len(terms) ELSE 0 END AS overlap FROM b),
s AS (SELECT *, round(score * 0.7 + overlap * 0.3 * score, 6) AS final FROM o)
SELECT * FROM (SELECT qid, id, final, row_number() OVER (PARTITION BY qid ORDER BY final DESC, age_hours,
 CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 0.75 WHEN 'normal' THEN 0.5 ELSE 0.25 END DESC, id) AS rank FROM s) WHERE rank <= 10""")
def hybrid_rerank(t):
    docs = t.live("id", "content", "kind", "age_hours", "priority")
    plain = asked(t)
    rows = R.blend(fused(t), plain, docs)
    rows = rows.withColumn("final", F.round("final", 6))
    return R.final_order(rows, 10).select("qid", "id", "final", "rank")


HALVES = "list_transform([1, 2], lambda s: CASE s WHEN 1 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END)"


@query(f"""WITH {BM25.replace("q AS (SELECT item_id AS qid, text AS query FROM benchmark)", f"q AS (SELECT item_id * 2 + s - 1 AS qid, ({HALVES})[s] AS query FROM benchmark, (VALUES (1), (2)) x(s))")},
r AS (SELECT qid // 2 AS item, qid % 2 AS sub, id, rank FROM bmr WHERE rank <= 20),
n AS (SELECT item, count(DISTINCT sub) AS subs FROM r GROUP BY 1),
z AS (SELECT item AS qid, id, round(sum(1.0::DOUBLE / (20 + rank)) + (any_value(subs) - count(*)) / 120.0::DOUBLE, 6) AS score FROM r JOIN n USING (item) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 10""")
def multi_query(t):
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    subs = t.benchmark.select("item_id", F.posexplode(F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))).alias("sub", "query"))
    found = R.bm25_search(t.live("id", "content"), subs.select((F.col("item_id") * 2 + F.col("sub")).alias("qid"), "query"), 20)
    merged = R.merge_subqueries(found.select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).alias("sub"), "id", "rank"))
    return R.top(merged.withColumn("score", F.round("score", 6)), 10).select("qid", "id", "score", "rank")


@query(f"""WITH {BM25}, w AS (SELECT DISTINCT qid, id, unnest(regexp_extract_all(lower(content), '[a-z0-9]{{4,}}')) AS term FROM bmr JOIN m USING (id) WHERE rank <= 3),
c AS (SELECT qid, term, count(*) AS docs FROM w WHERE term NOT IN ({STOP}) AND (qid, term) NOT IN (SELECT (qid, term) FROM qt) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT qid, term, docs FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY docs DESC, term) AS r FROM c) WHERE r <= 5""".replace("AND (qid, term) NOT IN (SELECT (qid, term) FROM qt)", "AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.qid = w.qid AND qt.term = w.term)"))
def feedback_terms(t):
    docs = t.live("id", "content")
    return R.feedback_terms(R.bm25_search(docs, asked(t), 3), docs, asked(t))


@query(None)
def mmr_rerank(t):
    docs = t.live("id", "content")
    return R.mmr(R.bm25_search(docs, asked(t), 20), docs, 10)


@query(f"""WITH {BM25}, r AS (SELECT qid, id, rank FROM bmr WHERE rank <= 20),
p AS (SELECT r.qid, r.id, r.rank, {terms('q.query')} AS terms, unnest(list_filter([substr(m.content, 1, 1024), substr(m.content, 1025, 1024)], lambda c: c <> '')) AS chunk FROM r JOIN m USING (id) JOIN q USING (qid)),
b AS (SELECT qid, id, rank, round(max(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(chunk), t))) / len(terms) ELSE 0 END), 6) AS score FROM p GROUP BY 1, 2, 3)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM b""")
def chunk_rerank(t):
    docs = t.live("id", "content")
    return R.rerank(R.bm25_search(docs, asked(t), 20), docs, asked(t))


QUESTIONS = [
    (1, "What did we decide yesterday about the roses?"),
    (2, "where do I live now and what is my current address"),
    (3, "Can you recommend a good book, please?"),
    (4, "Who is Alice, and where does Bob Miller live these days"),
    (5, "last week Caroline talked about the river trip"),
    (6, "both the northern harbour office and the southern storage"),
    (7, "plain words only"),
    (8, "tips for this week?"),
    (9, "a month ago they changed the plan; what was it before"),
]
QUESTION_SQL = ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in QUESTIONS)


def questions(t):
    return t.spark.createDataFrame(QUESTIONS, "qid bigint, query string")


def _any(values: list[str], trim: str = "") -> str:
    word = f"trim(lower(w), '{trim}')" if trim else "lower(w)"
    return f"len(list_filter(regexp_extract_all(query, '\\S+'), lambda w: {word} IN ({', '.join(repr(v) for v in values)}))) > 0"


@query(f"""SELECT qid::BIGINT AS qid, {_any(X.TEMPORAL_WORDS)} AS temporal, {_any(X.UPDATE_WORDS)} AS update, {_any(X.PREFERENCE_WORDS, "?.,!\"''")} AS wants,
CASE WHEN regexp_matches(query, '(?i)\\byesterday\\b') THEN 48 WHEN regexp_matches(query, '(?i)\\blast week\\b|\\ba week ago\\b|\\bpast week\\b') THEN 288
 WHEN regexp_matches(query, '(?i)\\blast month\\b|\\ba month ago\\b|\\bpast month\\b') THEN 1080 WHEN regexp_matches(query, '(?i)\\btoday\\b|\\bthis morning\\b|\\btonight\\b') THEN 24
 WHEN regexp_matches(query, '(?i)\\bthis week\\b') THEN 168 END AS from_hours FROM (VALUES {QUESTION_SQL}) q(qid, query)""")
def query_intents(t):
    q = F.col("query")
    return questions(t).select("qid", X.is_temporal(q).alias("temporal"), X.is_update(q).alias("update"), X.wants_preference(q).alias("wants"), X.temporal_window(q)["from_hours"].alias("from_hours"))


@query(f"""WITH m AS ({live_sql()}), q AS (SELECT * FROM (VALUES {QUESTION_SQL}) q(qid, query) WHERE qid IN (1, 5, 8, 9)), w AS (SELECT qid, CASE qid WHEN 1 THEN 48 WHEN 5 THEN 288 WHEN 8 THEN 168 ELSE 1080 END AS f, CASE qid WHEN 1 THEN 12 WHEN 5 THEN 96 WHEN 8 THEN 0 ELSE 432 END AS t FROM q),
p AS (SELECT qid, id, round(pow(2.0, -greatest(age_hours - f, t - age_hours, 0) / ((f - t) / 2.0)), 6) AS proximity, age_hours FROM m, w)
SELECT qid::BIGINT AS qid, id, proximity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY proximity DESC, age_hours, id) AS rank FROM p) WHERE rank <= 20""")
def temporal_window_rank(t):
    from pyspark.sql import Window

    q = questions(t).withColumn("w", X.temporal_window(F.col("query"))).filter("w IS NOT NULL").select("qid", "w.*")
    rows = t.live("id", "age_hours").crossJoin(F.broadcast(q))  # four windows
    rows = rows.withColumn("proximity", F.round(S.window_proximity(F.col("age_hours"), F.col("from_hours"), F.col("to_hours")), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("proximity"), "age_hours", "id")
    return rows.select("qid", "id", "proximity", F.row_number().over(order).cast("bigint").alias("rank")).filter("rank <= 20")


@query(f"""WITH {BM25}, r AS (SELECT qid, id, age_hours FROM bmr JOIN m USING (id) WHERE rank <= 10)
SELECT qid, id, round(1.0 - (age_hours - min(age_hours) OVER w) / greatest(max(age_hours) OVER w - min(age_hours) OVER w, 1)::DOUBLE, 6) AS recency FROM r WINDOW w AS (PARTITION BY qid)""")
def relative_recency_rank(t):
    from pyspark.sql import Window

    docs = t.live("id", "content", "age_hours")
    w = Window.partitionBy("qid")
    rows = R.bm25_search(docs, asked(t), 10).join(docs.select("id", "age_hours"), "id")
    newest, oldest = F.min("age_hours").over(w), F.max("age_hours").over(w)
    return rows.select("qid", "id", F.round(1.0 - (F.col("age_hours") - newest) / F.greatest(oldest - newest, F.lit(1)), 6).alias("recency"))


@query(f"""WITH {BM25}, r AS (SELECT qid, id, {terms('query')} AS terms, lower(content) AS low FROM bmr JOIN m USING (id) JOIN q USING (qid) WHERE rank <= 10)
SELECT qid, id, round(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(low, t))) / len(terms) ELSE 0 END, 6) AS overlap FROM r""")
def term_overlap(t):
    docs = t.live("id", "content")
    rows = R.dealt(R.bm25_search(docs, asked(t), 10), "qid", "id").join(docs, "id").join(asked(t), "qid")
    return rows.select("qid", "id", F.round(X.term_overlap(X.content_terms(F.col("query")), F.col("content")), 6).alias("overlap"))


@query(f"""WITH {BM25}, r AS (SELECT qid, id, list_filter(list_transform(regexp_extract_all(query, '\\S+'), lambda w: trim(lower(w), '?.,!"''()[]{{}}:;，。？！')), lambda w: w <> '' AND w NOT IN ({STOP})) AS terms,
 regexp_extract_all(lower(content), '[a-z0-9]{{2,}}') AS own FROM bmr JOIN m USING (id) JOIN q USING (qid) WHERE rank <= 10)
SELECT qid, id, round(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: list_contains(own, t) OR (strlen(t) >= 4 AND len(list_filter(own, lambda w: starts_with(w, left(t, 4)))) > 0))) / len(terms) ELSE 0.5 END, 6) AS relevance FROM r""")
def graded_relevance(t):
    docs = t.live("id", "content")
    rows = R.dealt(R.bm25_search(docs, asked(t), 10), "qid", "id").join(docs, "id").join(asked(t), "qid")
    return rows.select("qid", "id", F.round(X.graded_relevance(F.col("query"), F.col("content")), 6).alias("relevance"))


@query(f"""WITH d AS ({DLG_SQL}), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM d),
s AS (SELECT id, regexp_extract(trim(line), '^([A-Za-z0-9_ ]{{1,24}}?): ', 1) AS speaker FROM l WHERE regexp_matches(trim(line), '^[A-Za-z0-9_ ]{{1,24}}: '))
SELECT id, speaker, count(*) AS lines FROM s GROUP BY 1, 2""")
def speaker_lines(t):
    return t.dlg().select("id", F.explode(X.speaker_lines(F.col("content"))).alias("x")).groupBy("id", "x.speaker").agg(F.count("*").alias("lines"))


@query(f"""WITH d AS ({DLG_SQL}), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM d),
s AS (SELECT id, regexp_extract(trim(line), '^[A-Za-z0-9_ ]{{1,24}}?: ', 0) AS p, trim(line) AS line FROM l),
n AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE contains(lower(p), 'user')) AS u FROM s WHERE p <> '' GROUP BY 1)
SELECT d.id, coalesce(round(u / n::DOUBLE, 6), 0) AS mention FROM d LEFT JOIN n USING (id)""")
def person_mention(t):
    return t.dlg().select("id", F.round(X.person_mention(F.array(F.lit("user")), F.col("content")), 6).alias("mention"))


@query(f"""WITH d AS ({DLG_SQL}) SELECT id, round(least((""" + " + ".join(f"contains(lower(content), '{m.replace(chr(39), chr(39) * 2)}')::INT" for m in X.PREFERENCE_MARKERS) + ") / 5.0::DOUBLE, 1), 6) AS preference FROM d")
def preference_markers(t):
    return t.dlg().select("id", F.round(X.preference_score(F.col("content")), 6).alias("preference"))


@query("SELECT qid::BIGINT AS qid, names FROM (VALUES (1, ''), (2, ''), (3, ''), (4, 'alice|bob|miller'), (5, 'caroline'), (6, ''), (7, ''), (8, ''), (9, '')) v(qid, names)")
def query_names(t):
    return questions(t).select("qid", F.array_join(X.query_names(F.col("query")), "|").alias("names"))


@query("""SELECT qid::BIGINT AS qid, parts FROM (VALUES (1, NULL), (2, 'where do I live now|what is my current address'), (3, NULL), (4, 'Who is Alice, and|where does Bob Miller live these days'), (5, NULL),
(6, 'both the northern harbour office|the southern storage'), (7, NULL), (8, NULL), (9, NULL)) v(qid, parts)""")
def sub_questions(t):
    return questions(t).select("qid", F.array_join(X.decompose(F.col("query")), "|").alias("parts"))


@query("""SELECT id::BIGINT AS id, grams, share FROM (VALUES (1, '我喜|喜歡|歡吃|吃蘋|蘋果', 1.0), (2, '東京', 0.222222), (3, '', 0.0), (4, '水', 0.5), (5, '', 0.0)) v(id, grams, share)""".replace("1.0), (2", "1.0::DOUBLE), (2"))
def cjk_bigrams(t):
    rows = t.spark.createDataFrame([(1, "我喜歡吃蘋果"), (2, "visit 東京 ok"), (3, "plain text"), (4, "水 x"), (5, "12 34")], "id bigint, text string")
    return rows.select("id", F.array_join(X.cjk_bigrams(F.col("text")), "|").alias("grams"), F.round(X.cjk_share(F.col("text")), 6).alias("share"))


@query(f"""WITH {BM25}, e AS (SELECT doc_id AS a, doc_id // 2 AS b, round((doc_id * 53 % 97) / 97.0::DOUBLE, 6) AS weight FROM documents WHERE doc_id > 0),
u AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e), r AS (SELECT qid, id, rank FROM bmr WHERE rank <= 10),
x AS (SELECT qid, u.b AS id, max(weight) AS weight FROM r JOIN u ON u.a = r.id WHERE rank <= 5 GROUP BY 1, 2),
y AS (SELECT x.*, {terms('q.query')} AS terms, lower(m.content) AS low FROM x JOIN m USING (id) JOIN q USING (qid) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.qid = x.qid AND r.id = x.id)),
z AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(low, t))) / len(terms) ELSE 0 END AS o FROM y)
SELECT qid, id, round(weight * o, 6) AS score FROM z WHERE o >= 0.1""")
def edge_expanded_search(t):
    docs = t.live("id", "content")
    edges = t.documents.filter("doc_id > 0").select(F.col("doc_id").alias("a"), F.expr("doc_id DIV 2").alias("b"), F.round((F.col("doc_id") * 53 % 97) / 97.0, 6).alias("weight"))
    return R.expand_over_edges(R.bm25_search(docs, asked(t), 10), edges, asked(t), docs)
