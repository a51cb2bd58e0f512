"""Assembling a context under a token budget from scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X

from .search import dealt


def relevance(similarity: Column, graded: Column) -> Column:
    """A cosine of 0.3 or more as it is, else 0.15 + 0.55 x graded term relevance."""
    return F.when(similarity >= 0.3, similarity).otherwise(F.lit(0.15) + F.lit(0.55) * graded)


def scores(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, relevance, score, tokens) of ranked rows (qid, id, similarity)."""
    rows = dealt(ranked, "qid", "id").join(queries.select("qid", "query"), "qid").join(docs, "id")
    rel = relevance(F.coalesce(F.col("similarity"), F.lit(0.0)), X.graded_relevance(F.col("query"), F.col("content")))

    def both(r: Column) -> Column:
        """Relevance is bound once here; as a plain column it would be worked out anew in every place that uses it."""
        final = S.composite(r, F.col("age_hours") / 24.0, F.col("importance"), F.col("access_count"), F.col("kind"), F.col("tier"))
        return F.struct(F.round(r, 6).alias("relevance"), F.round(final, 6).alias("score"))

    rows = rows.withColumn("x", F.transform(F.array(rel), both)[0])
    return rows.select("qid", "id", "x.relevance", "x.score", X.est_tokens(F.col("content")).cast("bigint").alias("tokens"))


def above_floor(rows: DataFrame, least: float, exempt: str | None = None, confident: float = 0.35, dominant: float = 0.8) -> DataFrame:
    """Rows with the least score, or confident and near the query's best relevance, or exempt."""
    best = F.max("relevance").over(Window.partitionBy("qid"))
    keep = (F.col("score") >= least) | ((F.col("relevance") >= confident) & (F.col("relevance") >= dominant * F.col("__best")))
    if exempt:
        keep = keep | F.col(exempt)
    return rows.withColumn("__best", best).filter(keep).drop("__best")


def min_spread(rows: DataFrame, delta: float) -> DataFrame:
    """Only the first row of queries whose first and fifth (or last) scores differ by less than ``delta``."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    numbered = rows.withColumn("__r", F.row_number().over(w))
    ends = numbered.groupBy("qid").agg(F.max("score").alias("__first"), F.min(F.when(F.col("__r") <= 5, F.col("score"))).alias("__tail"), F.count("*").alias("__n"))
    numbered = numbered.join(ends, "qid")
    flat = (F.col("__n") >= 2) & (F.col("__first") - F.col("__tail") < delta)
    return numbered.filter(~flat | (F.col("__r") == 1)).drop("__r", "__first", "__tail", "__n")


def reserve_statements(rows: DataFrame) -> DataFrame:
    """The best 'stated' row of each query and person who also has an 'observed' row."""
    people = rows.filter("source_kind = 'observed'").select("qid", "source_user").distinct()
    stated = rows.filter("source_kind = 'stated'").join(people, ["qid", "source_user"], "left_semi")
    w = Window.partitionBy("qid", "source_user").orderBy(F.desc("score"), "id")
    return stated.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def pack(rows: DataFrame, budget: int = 4000, cap: int = 400, least: int = 25) -> DataFrame:
    """(qid, id, tokens, excerpt, used) in order of score until the budget is spent.

    A row larger than ``cap`` tokens is cut to it; the first that no longer fits is cut to what is left if
    that is at least ``least``, and packing ends. Running totals decide, so this is a window, not a loop:
    rows before the first overflow fit by themselves.
    """
    cut = F.when(F.col("tokens") > cap, F.least(F.col("tokens"), F.lit(cap + 20))).otherwise(F.col("tokens"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("need", cut.cast("bigint")).withColumn("sum", F.sum("need").over(w))
    over = rows.withColumn("before", F.col("sum") - F.col("need")).withColumn("misses", F.sum((F.col("sum") > budget).cast("int")).over(w))
    left = budget - F.col("before")
    part = F.least(F.col("need"), left + 20)
    kept = over.filter((F.col("misses") == 0) | ((F.col("misses") == 1) & (F.col("sum") > budget) & (left >= least)))
    size = F.when(F.col("misses") == 0, F.col("need")).otherwise(part)
    kept = kept.withColumn("size", size.cast("bigint"))
    return kept.select("qid", "id", F.col("size").alias("tokens"), ((F.col("misses") == 1) | (F.col("tokens") > cap)).alias("excerpt"), F.sum("size").over(w).alias("used"))


def pack_pinned(rows: DataFrame, budget: int) -> DataFrame:
    """(qid, id, tokens): pinned rows in order while they fit; one that does not fit is passed over.

    A greedy choice with skips depends on all before it; it runs per query on its pinned rows.
    """
    import pandas as pd

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["importance", "id"], ascending=[False, True])
        used, keep = 0, []
        for i, n in zip(x["id"], x["tokens"], strict=True):
            if used + n <= budget:
                used += n
                keep.append(i)
        return x[x["id"].isin(keep)][["qid", "id", "tokens"]]

    return rows.select("qid", "id", "tokens", "importance").groupBy("qid").applyInPandas(run, "qid bigint, id bigint, tokens bigint")


def substitute_parents(rows: DataFrame, edges: DataFrame, parents: DataFrame, least: int = 3, fan_out: int = 12) -> DataFrame:
    """(qid, id, score, replaces): parents that stand for at least ``least`` of a query's rows, and the other rows."""
    child = edges.filter("rel = 'contains'").select(F.col("a").alias("parent"), F.col("b").alias("id")).distinct()
    child = child.join(child.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") <= fan_out), "parent").select("parent", "id")
    child = child.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi")
    full = rows.join(child, "id").groupBy("qid", "parent").agg(F.count("*").alias("c"), F.max("score").alias("score")).filter(F.col("c") >= least)
    gone = full.select("qid", "parent").join(child, "parent").select("qid", "id").distinct()
    stay = rows.select("qid", "id", "score").join(gone, ["qid", "id"], "left_anti").join(full.select("qid", F.col("parent").alias("id")), ["qid", "id"], "left_anti")
    return stay.withColumn("replaces", F.lit(0).cast("bigint")).union(full.select("qid", F.col("parent").alias("id"), "score", F.col("c").alias("replaces")))


def session_boost(tags: Column, age_hours: Column, wanted: list[str], since_hours: int, factor: float = 2.5) -> Column:
    return F.when(F.arrays_overlap(tags, X.strings(wanted)) | (age_hours <= since_hours), F.lit(factor)).otherwise(F.lit(1.0))


def source_boost(canonical: Column, user: str, factor: float = 1.8) -> Column:
    return F.when(F.lower(canonical) == user.lower(), F.lit(factor)).otherwise(F.lit(1.0))


def reserve_hoist(rows: DataFrame, remaining: int) -> DataFrame:
    """Rows (qid, id, score, tokens, reserved) with ``held`` and ``position``: reserved ones that fit a third of the budget go first.

    Reserved rows claim tokens in order of score; one that no longer fits is passed over, smaller ones behind it may fit.
    """
    third = remaining // 3
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    numbered = rows.withColumn("__r", F.row_number().over(w))
    empty = F.struct(F.lit(0).cast("bigint").alias("claimed"), F.array().cast("array<int>").alias("held"))
    claim = F.aggregate("__l", empty, lambda s, x: F.when(s["claimed"] + x["tokens"] <= third, F.struct((s["claimed"] + x["tokens"]).alias("claimed"), F.array_append(s["held"], x["__r"]).alias("held"))).otherwise(s), lambda s: s["held"])
    lists = numbered.filter("reserved").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("__r", "tokens"))).alias("__l")).select("qid", claim.alias("__h"))  # ranked rows only
    out = numbered.join(lists, "qid", "left").withColumn("held", F.coalesce(F.array_contains("__h", F.col("__r")), F.lit(False)))
    order = Window.partitionBy("qid").orderBy(F.desc("held"), "__r")
    return out.withColumn("position", F.row_number().over(order).cast("bigint")).drop("__r", "__h")


def compaction_hint(candidates: DataFrame, packed: DataFrame, spaces: DataFrame, active: DataFrame, most: int = 2, crowded: int = 500) -> DataFrame:
    """(qid, skipped, suggested): more than ``most`` candidates left out, or more than ``crowded`` live rows in the query's namespace.

    ``spaces``: (qid, ns); ``active``: live rows with ns.
    """
    taken = packed.groupBy("qid").agg(F.count("*").alias("__in"))
    counts = active.groupBy("ns").agg(F.count("*").alias("__active"))
    rows = candidates.groupBy("qid").agg(F.count("*").alias("__all")).join(taken, "qid", "left").join(spaces, "qid", "left").join(counts, "ns", "left")
    skipped = F.col("__all") - F.coalesce("__in", F.lit(0))
    return rows.select("qid", skipped.alias("skipped"), ((skipped > most) | (F.coalesce("__active", F.lit(0)) > crowded)).alias("suggested"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(qid, stages): rows of each query after each stage, 'a=3 b=12' in order of the stages' names."""
    rows = None
    for name in sorted(stages):
        part = stages[name].groupBy("qid").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "n"))), lambda x: F.concat(x["stage"], F.lit("="), x["n"].cast("string"))), " ")
    return rows.groupBy("qid").agg(text.alias("stages"))
