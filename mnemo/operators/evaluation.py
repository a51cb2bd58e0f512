"""Retrieval metrics and answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as X


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, precision, recall, ndcg, mrr, hit) at k of ranked (qid, id, rank) against binary judgements (qid, id)."""
    judged = relevant.select("qid", "id").distinct()
    sizes = judged.groupBy("qid").agg(F.count("*").alias("n"))
    hits = ranked.filter(F.col("rank") <= k).join(judged, ["qid", "id"], "left_semi")
    per = hits.groupBy("qid").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    rows = sizes.join(per, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "qid",
        F.round(zero(F.col("hits") / k), 6).alias("precision"),
        F.round(zero(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
        (F.coalesce("hits", F.lit(0)) > 0).alias("hit"),
    )


def summary(metrics: DataFrame, group: str) -> DataFrame:
    """Means per group and over all (null group)."""
    cols = [F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")]
    return metrics.rollup(group).agg(F.count("*").alias("n"), *cols)


def _tokens(c: Column) -> Column:
    return X.words(c)


def answer_scores(answer: Column, expected: Column) -> Column:
    """struct<contains, recall, f1, score> of an answer: substring, share of expected words, F1 of word counts, and the greatest."""

    def common(a: Column, e: Column) -> Column:
        return F.aggregate(F.array_distinct(e), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(e, lambda x: x == w))))

    def both(x: Column) -> Column:
        a, e = x["a"], x["e"]
        holds = (x["low"] != "") & F.contains(F.lower(answer), x["low"])
        recall = F.when(F.size(e) > 0, F.size(F.array_intersect(a, e)) / F.size(F.array_distinct(e))).otherwise(0.0)
        c = common(a, e)
        f1 = F.when(c > 0, 2.0 * c / (F.size(a) + F.size(e))).otherwise(0.0)
        return F.struct(holds.alias("contains"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.greatest(holds.cast("double"), recall, f1), 6).alias("score"))

    return X.bind(F.struct(_tokens(answer).alias("a"), _tokens(expected).alias("e"), F.lower(F.trim(expected)).alias("low")), both)


def wide_intent(query: Column) -> Column:
    """'wide' for counting, listing and comparing questions, else 'narrow'."""
    return F.when(query.rlike(r"(?i)\b(how many|list|all|every|compare|summar\w+|overall|in total|both)\b"), "wide").otherwise("narrow")


def top_k_for(query: Column) -> Column:
    return F.when(wide_intent(query) == "wide", 15).otherwise(5)


def hit_by_substring(ranked: DataFrame, docs: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """(qid, first): rank of the first of k results whose text holds the expected answer."""
    rows = ranked.filter(F.col("rank") <= k).join(docs.select("id", "content"), "id").join(answers, "qid")
    return rows.filter(F.contains(F.lower("content"), F.lower("answer"))).groupBy("qid").agg(F.min("rank").alias("first"))


def covered_metrics(expected: DataFrame, returned: DataFrame, contains: DataFrame) -> DataFrame:
    """(qid, precision, recall) of (qid, id) rows, where a returned parent counts for the expected children it holds.

    A returned row is relevant if it is expected or else the parent of an expected one; an expected row is
    found if it is returned or a returned row that is not itself expected holds it. ``contains``: (a, b).
    """
    expected, returned = expected.select("qid", "id").distinct(), returned.select("qid", "id").distinct()
    other = returned.join(expected, ["qid", "id"], "left_anti")
    cover = other.join(contains.select(F.col("a").alias("id"), F.col("b").alias("child")).distinct(), "id").join(expected.select("qid", F.col("id").alias("child")), ["qid", "child"], "left_semi")
    direct = returned.join(expected, ["qid", "id"], "left_semi")
    relevant = direct.union(cover.select("qid", "id").distinct()).groupBy("qid").agg(F.count("*").alias("r"))
    hits = direct.union(cover.select("qid", F.col("child").alias("id"))).distinct().groupBy("qid").agg(F.count("*").alias("h"))
    rows = expected.groupBy("qid").agg(F.count("*").alias("e")).join(returned.groupBy("qid").agg(F.count("*").alias("n")), "qid", "full")
    rows = rows.join(relevant, "qid", "left").join(hits, "qid", "left").na.fill(0)
    return rows.select("qid", F.when(F.col("n") > 0, F.col("r") / F.col("n")).otherwise(0.0).alias("precision"), F.when(F.col("e") > 0, F.col("h") / F.col("e")).otherwise(0.0).alias("recall"))


def report_lines(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, line): a table line of each group with its number of rows and the mean of each metric in percent."""
    means = [F.floor(F.avg(m) * 100 + 0.5).cast("bigint").cast("string") for m in metrics]
    cells = [F.col(group).cast("string"), F.col("__n").cast("string"), *(F.concat(F.col(f"__{m}"), F.lit("%")) for m in metrics)]
    found = rows.groupBy(group).agg(F.count("*").alias("__n"), *(x.alias(f"__{m}") for x, m in zip(means, metrics, strict=True)))
    return found.select(group, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
