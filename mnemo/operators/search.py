"""Retrieval for a table of queries at once: channels, fusion, re-ranking, expansion.

Rankings stay slim (query, document, score); texts are joined to the few ranked rows. Postings meet
query terms in an equi-join on the term and are summed per (query, document) with map-side partial sums,
so a very common term only adds rows, never a group that one task must hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X

from .graph import written


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Slim rows dealt out evenly before costly expressions (adaptive execution would merge them by their few bytes)."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, id, tf) of all words."""
    return docs.select(F.col(key).alias("id"), F.explode(X.words(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def terms_of(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, term): distinct words of each query that are no stop words."""
    return queries.select(F.col(key).alias("qid"), F.explode(F.array_distinct(F.filter(X.words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(X.STOP_WORDS)))).alias("term"))


def top(scored: DataFrame, k: int, by: str = "score", group: str = "qid", tie: str = "id") -> DataFrame:
    """The k best rows of each group, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", text: str = "content", qkey: str = "qid", qtext: str = "query") -> DataFrame:
    """(qid, id, score, rank): the k best documents of each query."""
    wanted = terms_of(queries, qkey, qtext)
    words = X.words(F.coalesce(text, F.lit("")))
    lengths = docs.select(F.size(words).cast("bigint").alias("len")).filter("len > 0")
    stats = lengths.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("mean"))).scalar()
    # Words that some query asks for are counted, with the length beside them, and written once: three steps read them.
    tokens = docs.select(F.col(key).alias("id"), words.alias("words")).select("id", F.size("words").cast("bigint").alias("len"), F.explode("words").alias("term"))
    hits = written(tokens.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf")))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(wanted, "term")
    part = S.bm25(F.col("tf"), F.col("df"), stats["n"], F.col("len"), stats["mean"])
    return top(rows.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score")), k)


def substring_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", text: str = "content", age: str = "age_hours") -> DataFrame:
    """(qid, id, hits, rank): documents that hold a query term as a substring, newest first.

    A term of at least three characters is found through its words' trigrams: a document is a candidate
    for a term if it has all trigrams of the term; the substring test follows on candidates only. Shorter
    terms (of three bytes or more, so none of ASCII letters) meet the short grams of the other words.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    terms = queries.select("qid", F.explode(F.array_distinct(X.content_terms(F.col("query")))).alias("term"))
    pairs = terms.filter(F.length("term") >= 3).select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram"))
    need = pairs.groupBy("term").agg(F.count("*").alias("need"))
    low = docs.select(key, age, F.lower(text).alias("low"))
    # Fields keep punctuation, as terms do inside; a term never holds white space.
    vocabulary = written(low.select(F.explode(X.fields(F.col("low"))).alias("word")).distinct())
    found = vocabulary.filter(F.length("word") >= 3).select("word", F.explode(grams(F.col("word"))).alias("gram")).join(pairs, "gram").groupBy("word", "term").agg(F.count("*").alias("n"))
    matched = found.join(need, "term").filter("n = need").filter(F.contains("word", "term")).select("word", "term")
    few = F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1, F.lit(1)), lambda i: F.substring("word", i, n))))
    wide = vocabulary.filter((F.octet_length("word") > F.length("word")) & (F.length("word") > 1)).select("word", F.explode(F.array_distinct(few)).alias("term"))
    wide = wide.union(vocabulary.filter(F.length("word") == 1).select("word", "word"))
    matched = matched.union(wide.join(terms.filter(F.length("term") < 3).select("term").distinct(), "term").select("word", "term"))
    hits = low.select(F.col(key).alias("id"), age, F.explode(F.array_distinct(X.fields(F.col("low")))).alias("word")).join(matched, "word").select("id", age, "term").distinct()
    per = hits.join(terms, "term").groupBy("qid", "id", age).agg(F.countDistinct("term").alias("hits"))
    w = Window.partitionBy("qid").orderBy(age, "id")
    return per.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("qid", "id", "hits", "rank")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.2, block: int = 2048) -> DataFrame:
    """(qid, id, score, rank): the k nearest unit vectors of each query vector by cosine, exact.

    Queries go in blocks of about ``block`` rows, each a broadcast that tasks multiply with slices of
    their own rows; a task keeps k rows per query before anything is shuffled. Equal query rows count once;
    rows that share an id but not the vector are dealt to blocks apart, and their answers are ranked together.
    """
    asked = queries.select(F.col("id").alias("qid"), "v").distinct()
    blocks = max(1, -(-asked.count() // block))
    placed = asked.withColumn("b", F.pmod(F.xxhash64("qid", "v"), F.lit(blocks)))
    out: DataFrame | None = None
    for b in range(blocks):
        got = placed.filter(F.col("b") == b).orderBy("qid").collect()  # distinct and hash-dealt: about ``block`` rows
        if not got:
            continue
        ids = np.array([r["qid"] for r in got], np.int64)
        matrix = np.array([r["v"] for r in got], np.float64).T
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            parts = (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024))
            for part in parts:
                own = part.column("id").to_numpy(zero_copy_only=False)
                rows = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                cosine = rows @ matrix
                at, q = np.nonzero(cosine >= floor)
                q_all = np.concatenate((best[0], q))
                i_all = np.concatenate((best[1], own[at]))
                s_all = np.concatenate((best[2], cosine[at, q]))
                order = np.lexsort((i_all, -np.round(s_all, 6), q_all))
                first = np.searchsorted(q_all[order], q_all[order])
                keep = order[np.arange(len(order)) - first < k + 1]  # one more: the query itself may be among them
                best = (q_all[keep], i_all[keep], s_all[keep])
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]] if len(ids) else best[0]), pa.array(best[1]), pa.array(best[2])], names=["qid", "id", "score"])

        part = vectors.select("id", "v").mapInArrow(run, "qid bigint, id bigint, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "qid bigint, id bigint, score double, rank bigint")
    return top(out.filter("qid <> id").withColumn("score", F.round("score", 6)), k)


def fuse(channels: list[DataFrame], k: int = 20) -> DataFrame:
    """(qid, id, score): reciprocal ranks of all channels (qid, id, rank) summed."""
    rows = channels[0].select("qid", "id", "rank")
    for c in channels[1:]:
        rows = rows.union(c.select("qid", "id", "rank"))
    return rows.groupBy("qid", "id").agg(F.sum(S.rrf(F.col("rank"), k)).alias("score"))


def blend(fused: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Append ``final``: the fused score re-weighted by overlaps, preferences, persons, recency and kind.

    ``queries`` has (qid, query); ``docs`` (id, content, kind, age_hours, priority).
    """
    asked = queries.select("qid", "query", X.content_terms(F.col("query")).alias("terms"), X.query_names(F.col("query")).alias("names"), X.is_temporal(F.col("query")).alias("temporal"), X.is_update(F.col("query")).alias("update"), X.wants_preference(F.col("query")).alias("wants"), X.temporal_window(F.col("query")).alias("window"))
    rows = dealt(fused, "qid", "id").join(asked, "qid").join(docs, "id")
    content = F.col("content")
    factor = 0.7 + X.term_overlap(F.col("terms"), content) * 0.3 + X.user_overlap(F.col("terms"), content) * 0.1
    liked = F.when(F.col("wants"), 1 + X.preference_score(content) * 0.2).otherwise(1.0)
    named = F.when(F.size("names") > 0, 1 + X.person_mention(F.col("names"), content) * 0.3).otherwise(1.0)
    rows = rows.withColumn("s", F.col("score") * factor * liked * named)
    w = Window.partitionBy("qid")
    newest, oldest = F.min("age_hours").over(w), F.max("age_hours").over(w)
    relative = 1.0 - (F.col("age_hours") - newest) / F.greatest(oldest - newest, F.lit(1))
    recent = F.when(F.col("window").isNotNull(), S.window_proximity(F.col("age_hours"), F.col("window.from_hours"), F.col("window.to_hours"))).otherwise(relative)
    kind = F.when(F.col("kind") == "episodic", 0.3).otherwise(0.0)
    final = F.when(F.col("temporal"), F.col("s") * 0.4 + recent * 0.3 + kind).when(F.col("update"), F.col("s") * 0.5 + recent * 0.4 + kind * 0.1).otherwise(F.col("s"))
    return rows.withColumn("final", final)


def final_order(rows: DataFrame, k: int) -> DataFrame:
    """(…, rank): by blended score, then newest, priority, id."""
    w = Window.partitionBy("qid").orderBy(F.desc("final"), "age_hours", F.desc(S.priority_score(F.col("priority"))), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def merge_subqueries(ranked: DataFrame, missing: int = 100, k: int = 20) -> DataFrame:
    """(qid, id, score) from (qid, sub, id, rank): a document missing from one of the sub-queries counts as rank ``missing``."""
    subs = ranked.groupBy("qid").agg(F.countDistinct("sub").alias("subs"))
    per = ranked.groupBy("qid", "id").agg(F.sum(S.rrf(F.col("rank"), k)).alias("s"), F.count("*").alias("c"))
    return per.join(subs, "qid").select("qid", "id", (F.col("s") + (F.col("subs") - F.col("c")) * F.lit(1.0 / (k + missing))).alias("score"))


def feedback_terms(ranked: DataFrame, docs: DataFrame, queries: DataFrame, first: int = 3, shared_by: int = 2, n: int = 5) -> DataFrame:
    """(qid, term, docs): words of at least four bytes in ``shared_by`` of the first results that the query lacks."""
    best = ranked.filter(F.col("rank") <= first).join(docs.select("id", "content"), "id")
    words = best.select("qid", "id", F.explode(F.array_distinct(X.words(F.col("content"), 4))).alias("term")).filter(~F.col("term").isin(X.STOP_WORDS))
    words = words.join(terms_of(queries, "qid", "query"), ["qid", "term"], "left_anti")
    often = words.groupBy("qid", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= shared_by)
    w = Window.partitionBy("qid").orderBy(F.desc("docs"), "term")
    return often.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def _mmr(scores: np.ndarray, similar: np.ndarray, k: int, weight: float) -> list[int]:
    left, taken = list(range(len(scores))), []
    while left and len(taken) < k:
        value = [weight * scores[i] - (1 - weight) * max((similar[i][j] for j in taken), default=0.0) for i in left]
        taken.append(left.pop(int(np.argmax(value))))
    return taken


def mmr(ranked: DataFrame, docs: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(qid, id, rank): greedy choice by score less similarity of word sets to what was chosen.

    Works on the ranked rows of one query at a time, whose number the ranking bounds.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank"]).reset_index(drop=True)
        sets = [set(x) for x in rows["words"]]
        similar = np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in sets] for a in sets])
        top_score = rows["score"].max() or 1.0
        order = _mmr((rows["score"] / top_score).to_numpy(), similar, k, weight)
        return pd.DataFrame({"qid": rows["qid"].iloc[order].to_numpy(), "id": rows["id"].iloc[order].to_numpy(), "rank": np.arange(1, len(order) + 1)})

    rows = ranked.join(docs.select("id", F.array_distinct(X.words(F.col("content"), 3)).alias("words")), "id").select("qid", "id", "rank", "score", "words")
    return rows.groupBy("qid").applyInPandas(run, "qid bigint, id bigint, rank bigint")


def expand_over_edges(ranked: DataFrame, edges: DataFrame, queries: DataFrame, docs: DataFrame, seeds: int = 5, least: float = 0.1) -> DataFrame:
    """(qid, id, score): neighbours of the first results, weight times overlap with the query, not yet ranked."""
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))
    near = ranked.filter(F.col("rank") <= seeds).join(both, F.col("id") == F.col("a")).groupBy("qid", F.col("b").alias("id")).agg(F.max("weight").alias("weight"))
    near = near.join(ranked.select("qid", "id"), ["qid", "id"], "left_anti").join(docs.select("id", "content"), "id").join(queries.select("qid", X.content_terms(F.col("query")).alias("terms")), "qid")
    overlap = X.term_overlap(F.col("terms"), F.col("content"))
    return near.withColumn("o", overlap).filter(F.col("o") >= least).select("qid", "id", F.round(F.col("weight") * F.col("o"), 6).alias("score"))


def rerank(ranked: DataFrame, docs: DataFrame, queries: DataFrame, scorer: Column | None = None, chunk: int = 1024, chunks: int = 2, pool: int = 20) -> DataFrame:
    """(qid, id, score, rank): the pool ordered by the best chunk; ``scorer`` is any expression of (query, chunk).

    Cut points are characters; summaries and model scorers plug in as a column (a pandas UDF, say).
    """
    scorer = X.term_overlap(X.content_terms(F.col("query")), F.col("chunk")) if scorer is None else scorer
    rows = dealt(ranked.filter(F.col("rank") <= pool), "qid", "id").join(docs.select("id", "content"), "id").join(queries.select("qid", "query"), "qid")
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.substring("content", i * chunk + 1, F.lit(chunk)))
    rows = rows.select("qid", "id", "query", F.col("rank").alias("before"), F.explode(F.filter(parts, lambda c: c != "")).alias("chunk"))
    best = rows.groupBy("qid", "id", "before").agg(F.round(F.max(scorer), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "before")
    return best.select("qid", "id", "score", F.row_number().over(w).cast("bigint").alias("rank"))


def fts_order(matched: DataFrame, docs: DataFrame, queries: DataFrame, k: int, temporal: Column | None = None) -> DataFrame:
    """(qid, id, score, rank) of BM25 rows (qid, id, score) by priority, age and text rank together.

    A question about time weighs age (0.7) over text (0.2), others text (0.5) over age (0.3).
    ``temporal``: what tells such questions, by default their words; all matches are scored.
    """
    asked = queries.select("qid", (X.is_temporal(F.col("query")) if temporal is None else temporal).alias("t"))
    rows = matched.select("qid", "id", F.col("score").alias("text")).join(docs.select("id", "age_hours", "priority"), "id").join(asked, "qid")
    level = F.when(F.col("priority") == "critical", 4).when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).otherwise(1)
    age = 1.0 / (1.0 + F.col("age_hours") / 24.0 / 7.0)
    score = level * 0.1 + age * F.when(F.col("t"), 0.7).otherwise(0.3) + F.col("text") * F.when(F.col("t"), 0.2).otherwise(0.5)
    return top(rows.select("qid", "id", F.round(score + 1e-9, 6).alias("score")), k)  # halves of the sixth place go up


def rerank_skips(ranked: DataFrame, queries: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(qid, lead, temporal, skip): questions whose re-ranking is not worth it.

    These ask about time, or the fused score of their first row is at least ``ratio`` times that of the second.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    two = ranked.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    lead = two.groupBy("qid").agg((F.max(F.when(F.col("r") == 1, F.col("score"))) / F.max(F.when(F.col("r") == 2, F.col("score")))).alias("lead"))
    rows = lead.join(queries.select("qid", X.is_temporal(F.col("query")).alias("temporal")), "qid")
    return rows.withColumn("skip", F.col("temporal") | F.coalesce(F.col("lead") >= ratio, F.lit(False)))


def mmr_vectors(ranked: DataFrame, vectors: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(qid, id, rank): greedy choice by score less the cosine with what was chosen (unit vectors; none counts as 0).

    Works on the ranked rows of one query at a time, whose number the ranking bounds.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank"]).reset_index(drop=True)
        width = max((len(v) for v in rows["v"] if v is not None), default=1)
        m = np.array([v if v is not None else np.zeros(width) for v in rows["v"]])
        top_score = rows["score"].max() or 1.0
        order = _mmr((rows["score"] / top_score).to_numpy(), m @ m.T, k, weight)
        return pd.DataFrame({"qid": rows["qid"].iloc[order].to_numpy(), "id": rows["id"].iloc[order].to_numpy(), "rank": np.arange(1, len(order) + 1)})

    rows = ranked.join(vectors.select("id", "v"), "id", "left").select("qid", "id", "rank", "score", "v")
    return rows.groupBy("qid").applyInPandas(run, "qid bigint, id bigint, rank bigint")


def bridges(ranked: DataFrame, docs: DataFrame, queries: DataFrame, seeds: int = 5, n: int = 5) -> DataFrame:
    """(qid, bridge, weight): what leads on from the first results and the question does not name.

    Entities of a result weigh 2 a mention, each of the last three words of its first sentence 1; the n
    greatest sums of a question stay (ties by text).
    """
    from mnemo.operators.mining import entities

    first = ranked.filter(F.col("rank") <= seeds).select("qid", "id").join(queries.select("qid", F.lower("query").alias("asked")), "qid")
    texts = docs.select("id", "content").join(first.select("id").distinct(), "id", "left_semi")
    named = entities(texts).select("id", F.col("entity").alias("bridge"), (F.col("n") * 2).alias("w"))
    said = F.slice(F.reverse(X.fields(F.substring_index(F.translate("content", "!?\n", "..."), ".", 1))), 1, 3)
    tail = texts.select("id", F.explode(F.transform(said, lambda x: F.lower(F.btrim(x, F.lit(".,!?;:\"'"))))).alias("bridge"), F.lit(1).cast("bigint").alias("w"))
    both = first.join(named.unionByName(tail), "id").filter((F.octet_length("bridge") >= 3) & ~F.contains("asked", "bridge") & ~F.col("bridge").isin(X.STOP_WORDS))
    total = both.groupBy("qid", "bridge").agg(F.sum("w").alias("weight"))
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "bridge")
    return total.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("qid", "bridge", "weight", F.col("r").cast("bigint").alias("r"))


def hop2(ranked: DataFrame, docs: DataFrame, queries: DataFrame, seeds: int = 5, n: int = 5, added: int = 10) -> DataFrame:
    """(qid, id, bridge, rank): up to ``added`` further results, from one search for each bridge of a question."""
    led = bridges(ranked, docs, queries, seeds, n).withColumn("q", F.concat_ws(":", F.col("qid").cast("string"), F.col("r").cast("string")))
    found = bm25_search(docs, led.select(F.col("q").alias("qid"), F.col("bridge").alias("query")), added // 2 + 1).select(F.col("qid").alias("q"), "id", F.col("rank").alias("own"))
    rows = found.join(led.select("q", "qid", "bridge", "r"), "q").join(ranked.select("qid", "id"), ["qid", "id"], "left_anti")
    best = rows.groupBy("qid", "id").agg(F.min(F.struct("r", "own", "bridge")).alias("x")).select("qid", "id", "x.*")
    w = Window.partitionBy("qid").orderBy("r", "own", "id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= added).select("qid", "id", "bridge", "rank")
