"""Rules, decay, garbage collection, deduplication and merging of memories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X
from mnemo.operators import pairs as P


@dataclass(frozen=True)
class Rule:
    """Conditions left None are not set; numbers compare strictly."""

    id: str
    priority: int
    op: str
    tier: str | None = None
    kind: str | None = None
    age_over: int | None = None
    idle_over: int | None = None
    importance_under: float | None = None
    access_under: int | None = None
    access_over: int | None = None
    utility_under: float | None = None
    tag: str | None = None
    similarity_over: float | None = None
    to_tier: str | None = None
    factor: float | None = None
    floor: float | None = None


# The built-in rules.
RULES = [
    Rule("sys-decay-sensory", 95, "DELETE", tier="sensory", age_over=4),
    Rule("sys-promote-sensory", 90, "PROMOTE", tier="sensory", age_over=1, access_over=1, to_tier="stm"),
    Rule("sys-prune-low-utility", 90, "DEMOTE", access_over=20, utility_under=0.05, to_tier="dormant"),
    Rule("sys-promote-to-ltm", 50, "PROMOTE", tier="stm", access_over=50, age_over=72, to_tier="ltm"),
    Rule("sys-demote-stale-ltm", 50, "DEMOTE", tier="ltm", idle_over=168, to_tier="dormant"),
    Rule("sys-archive-old-episodic", 45, "ARCHIVE", tier="stm", kind="episodic", age_over=720, access_under=5, to_tier="dormant"),
    Rule("sys-merge-similar", 40, "MERGE", tier="stm", similarity_over=0.9),
    Rule("sys-dedup-all", 35, "MERGE", similarity_over=0.92),
    Rule("sys-decay-unaccessed", 10, "DECAY", tier="stm", age_over=48, access_under=10, factor=0.95, floor=0.1),
]


def protected(pinned: str = "pinned", locked: str = "locked") -> Column:
    return F.col(pinned) | F.col(locked)


def rule_matches(r: Rule, logged: bool) -> Column:
    """Whether a row meets a rule, with the access-day gates and the ease shield."""
    c = F.col
    tests = [
        None if r.tier is None else c("tier") == r.tier,
        None if r.kind is None else c("kind") == r.kind,
        None if r.age_over is None else c("age_hours") > r.age_over,
        None if r.idle_over is None else c("idle_hours") > r.idle_over,
        None if r.importance_under is None else c("importance") < r.importance_under,
        None if r.access_under is None else c("access_count") < r.access_under,
        None if r.access_over is None else c("access_count") > r.access_over,
        None if r.utility_under is None else (c("access_count") > 0) & (c("utility_count") > 0) & (S.utility_ratio(c("utility_count"), c("access_count")) < r.utility_under),
        None if r.tag is None else F.array_contains("tags", r.tag),
    ]
    if logged and r.id == "sys-promote-to-ltm":
        tests.append(c("days").isNull() | (c("days") >= 3))
    if logged and r.id == "sys-prune-low-utility":
        tests.append(c("days").isNull() | ((c("days") < 2) & (c("age_hours") >= 72)))
    if r.op == "DEMOTE" and r.idle_over is not None:
        ease = S.ease(c("utility_count"))
        tests.append(~((ease > 1) & (c("idle_hours") < r.idle_over * ease)))
    out = F.lit(True)
    for t in tests:
        out = out if t is None else out & t
    return out


def first_match(rows: DataFrame, rules: list[Rule] | None = None, days: DataFrame | None = None) -> DataFrame:
    """Append rule, op, to_tier, factor, floor of the first rule met, by priority then id; null if none.

    Rules are one CASE expression, so rows are neither joined with them nor shuffled. ``days`` (id, days)
    holds distinct access days.
    """
    rows = rows if days is None else rows.join(days, "id", "left")
    chosen = None
    ordered = sorted([r for r in rules or RULES if r.similarity_over is None], key=lambda r: (-r.priority, r.id))
    for r in ordered:
        what = F.struct(F.lit(r.id).alias("rule"), F.lit(r.op).alias("op"), F.lit(r.to_tier).cast("string").alias("to_tier"), F.lit(r.factor).cast("double").alias("factor"), F.lit(r.floor).cast("double").alias("floor"))
        met = rule_matches(r, days is not None)
        chosen = F.when(met, what) if chosen is None else chosen.when(met, what)
    return rows.withColumn("__hit", chosen).select(*rows.columns, "__hit.*")


def apply_actions(matched: DataFrame) -> DataFrame:
    """The rows after their action: importance, tier, deleted; protected rows stay as they are."""
    free = ~protected() & F.col("op").isNotNull()
    return matched.select(
        "id",
        F.when(free & (F.col("op") == "DECAY"), F.greatest(F.col("floor"), F.col("importance") * F.col("factor"))).otherwise(F.col("importance")).alias("importance"),
        F.when(free & F.col("op").isin("PROMOTE", "DEMOTE", "ARCHIVE"), F.col("to_tier")).otherwise(F.col("tier")).alias("tier"),
        (free & (F.col("op") == "DELETE")).alias("deleted"),
    )


def access_days(log: DataFrame) -> DataFrame:
    """(id, days): distinct days with an access."""
    return log.groupBy("id").agg(F.countDistinct(F.to_date("ts")).alias("days"))


def prune_log(log: DataFrame, now: str, days: int = 120, keep: int = 100, alive: DataFrame | None = None) -> DataFrame:
    """The newest ``keep`` accesses of each live memory within ``days``."""
    rows = log.filter(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    rows = rows if alive is None else rows.join(alive.select("id"), "id", "left_semi")
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r")


def expired() -> Column:
    return F.col("deleted_hours").isNull() & F.col("expires_in_hours").isNotNull() & (F.col("expires_in_hours") <= 0)


def stale(idle_over: int, useless_from: int = 5, utility_under: float = 0.2) -> Column:
    """Idle rows below high priority, and rows used often but rarely usefully; protected rows never."""
    idle = (F.col("idle_hours") > idle_over) & F.col("priority").isin("low", "normal")
    useless = (F.col("access_count") >= useless_from) & (S.utility_ratio(F.col("utility_count"), F.col("access_count")) < utility_under) & F.col("priority").isin("low", "normal")
    return F.col("deleted_hours").isNull() & ~protected() & (idle | useless)


def purgeable(older_than: int) -> Column:
    return (F.col("deleted_hours") > older_than) & ~protected()


def cascade(children: DataFrame, survivors: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a dependent table whose memory survives."""
    return children.join(survivors.select(F.col("id").alias(key)), key, "left_semi")


def curate(op: str, amount: float = 0.1) -> dict[str, Column]:
    """Column changes of an editorial operation."""
    changes = {
        "promote": {"tier": F.when(F.col("tier").isin("sensory"), "stm").when(F.col("tier") == "stm", "ltm").otherwise(F.col("tier"))},
        "demote": {"tier": F.when(F.col("tier") == "ltm", "stm").when(F.col("tier") == "stm", "dormant").otherwise(F.col("tier"))},
        "boost": {"importance": F.least(F.lit(1.0), F.col("importance") + amount)},
        "diminish": {"importance": F.greatest(F.lit(0.0), F.col("importance") - amount)},
        "archive": {"tier": F.lit("dormant")},
        "delete": {"deleted_hours": F.lit(0).cast("bigint")},
        "pin": {"pinned": F.lit(True)},
        "unpin": {"pinned": F.lit(False)},
    }
    return changes[op]


def exact_classes(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys..., hash, least, n): classes of equal content; partial minima, so copies never meet in one task."""
    return rows.groupBy(*keys, F.sha2(F.col(content), 256).alias("hash")).agg(F.min("id").alias("least"), F.count("*").alias("n"))


def paraphrases(rows: DataFrame, queries: DataFrame, shared: int = 5, overlap: float = 0.7) -> DataFrame:
    """(qid, id, shared): rows that say what a query row says: at least ``shared`` distinctive tokens in common and ``overlap`` of either's."""
    return P.set_pairs(rows, queries, shared, overlap)


def paraphrase_classes(rows: DataFrame, shared: int = 5, overlap: float = 0.7) -> DataFrame:
    """(id, class, links) of every row: least id of its component of paraphrases, number of its paraphrases."""
    return P.set_classes(rows, shared, overlap)


def reinforce(rows: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows strengthened by incoming duplicates (id, importance): greatest importance, an access for each."""
    news = duplicates.groupBy("id").agg(F.max("importance").alias("__i"), F.count("*").alias("__n"))
    out = rows.join(news, "id", "left")
    return out.withColumn("importance", F.greatest("importance", F.coalesce("__i", "importance"))).withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).drop("__i", "__n")


def merge_groups(rows: DataFrame, group: str) -> DataFrame:
    """One row per group: union of tags, greatest importance, access, utility and tier, survivor of most importance."""
    best = F.max_by(F.struct("id", "tier"), F.struct("importance", -F.col("id")))
    tier = F.max_by("tier", S.tier_rank(F.col("tier")))
    return rows.groupBy(group).agg(best["id"].alias("survivor"), F.count("*").alias("n"), F.max("importance").alias("importance"), F.max("access_count").alias("access_count"), F.max("utility_count").alias("utility_count"), tier.alias("tier"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


def shared_tags(rows: DataFrame, group: str) -> DataFrame:
    """(group, tag): tags that every row of the group has."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    tags = rows.select(group, "id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy(group, "tag").agg(F.count("*").alias("c"))
    return tags.join(sizes, group).filter("c = n").select(group, "tag")


def leader_clusters(vectors: DataFrame, group: str, threshold: float, block: int = 256, chunk: int = 4096) -> DataFrame:
    """(group, id, leader): each row in order of id joins the first leader at the threshold or leads itself.

    The choice depends on all before it, so a group's rows stream through one task in order of id; ``block``
    rows at a time meet the leaders so far, which are all that the task keeps.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        at, ids, full, last = None, [], [], []  # the group; its leaders' ids, matrices of ``chunk`` and the rest
        for batch in batches:
            groups = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and (at is None or at[0] != groups[lo]):
                    at, ids, full, last = (groups[lo],), [], [], []
                for start in range(lo, hi, block):
                    part = batch.slice(start, min(block, hi - start))
                    own, v = part.column(1).to_pylist(), np.array(part.column(2).to_pylist())
                    mine = np.full(len(own), -1)
                    for k, leaders in enumerate([*full, *([np.array(last)] if last else [])]):
                        todo = np.flatnonzero(mine < 0)
                        near = v[todo] @ leaders.T >= threshold
                        mine[todo] = np.where(near.any(axis=1), k * chunk + near.argmax(axis=1), -1)
                    todo = np.flatnonzero(mine < 0)
                    near = v[todo] @ v[todo].T >= threshold
                    new: list[int] = []
                    for i in range(len(todo)):
                        first = next((j for j in new if near[i, j]), i)
                        if first == i:
                            new.append(i)
                            mine[todo[i]] = len(ids)
                            ids.append(own[todo[i]])
                            last.append(v[todo[i]])
                            if len(last) == chunk:
                                full.append(np.array(last))
                                last = []
                        else:
                            mine[todo[i]] = mine[todo[first]]
                    yield pa.RecordBatch.from_arrays([pa.array(groups[start : start + len(own)], pa.int64()), pa.array(own, pa.int64()), pa.array([ids[j] for j in mine], pa.int64())], names=[group, "id", "leader"])

    rows = vectors.select(F.col(group).cast("bigint").alias(group), F.col("id").cast("bigint").alias("id"), "v")
    return rows.repartition(group).sortWithinPartitions(group, "id").mapInArrow(run, f"{group} bigint, id bigint, leader bigint")


def consolidations(components: DataFrame, contains: DataFrame, least: int = 3) -> DataFrame:
    """(comp, n, orphans): components of at least ``least`` rows most of which have no contains-parent."""
    child = contains.select(F.col("b").alias("id")).distinct().withColumn("has", F.lit(1))
    return components.join(child, "id", "left").groupBy("comp").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("orphans")).filter((F.col("n") >= least) & (F.col("orphans") * 2 > F.col("n")))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


def superseded(rows: DataFrame, recent: int = 100, least: int = 2) -> DataFrame:
    """(new_id, old_id, overlap): for rows that announce a change, the row among the ``recent`` before them in the
    namespace that shares most distinctive tokens (ties: the newer).

    The window of recent rows is the operation's meaning; it is a bound per row, not per group.
    """
    w = Window.partitionBy("ns").orderBy(F.desc("age_hours"), "id")
    numbered = rows.withColumn("pos", F.row_number().over(w)).withColumn("tokens", X.distinctive_tokens(F.col("content")))
    news = numbered.filter(F.col("content").rlike(X.CHANGE_CUES)).select("ns", F.col("id").alias("new_id"), F.col("key").alias("new_key"), F.col("pos").alias("new_pos"), F.col("tokens").alias("new_tokens"))
    old = numbered.select("ns", F.col("id").alias("old_id"), "key", "pos", "tokens", "age_hours")
    block = lambda c: F.floor(c / recent)
    spread = news.withColumn("block", F.explode(F.array(block(F.col("new_pos") - recent), block(F.col("new_pos"))))).distinct()
    pairs = spread.join(old.withColumn("block", block(F.col("pos"))), ["ns", "block"]).filter((F.col("pos") < F.col("new_pos")) & (F.col("pos") >= F.col("new_pos") - recent) & (F.col("key") != F.col("new_key")))
    scored = pairs.withColumn("overlap", F.size(F.array_intersect("new_tokens", "tokens")).cast("bigint")).filter(F.col("overlap") >= least)
    best = Window.partitionBy("new_id").orderBy(F.desc("overlap"), F.desc("pos"))
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("new_id", "old_id", "overlap")


def supersede_order(ranked: DataFrame, replaces: DataFrame) -> DataFrame:
    """(qid, id, rank): ranked lists in which a row that replaces another stands before it.

    Moves repeat until none is needed, so each query's ranked rows are handled together.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        order = list(dict.fromkeys(rows["id"].tolist()))
        olds = {(a, b) for a, xs in zip(rows["id"], rows["olds"], strict=True) if xs is not None for b in xs}
        for _ in range(len(order) ** 2):
            at = {x: i for i, x in enumerate(order)}
            bad = next(((a, b) for a, b in sorted(olds) if a in at and b in at and at[b] < at[a]), None)
            if bad is None:
                break
            order.remove(bad[0])
            order.insert(at[bad[1]], bad[0])
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "id": order, "rank": range(1, len(order) + 1)})

    lists = replaces.groupBy(F.col("new_id").alias("id")).agg(F.collect_set("old_id").alias("olds"))
    return ranked.select("qid", "id", "rank").join(lists, "id", "left").groupBy("qid").applyInPandas(run, "qid bigint, id bigint, rank bigint")


def ttl_seconds(ttl: Column) -> Column:
    """Seconds of '<n>d', '<n>h', '<n>m' or '<n>s'; null for anything else."""
    n = F.regexp_extract(ttl, r"^(\d+)[dhms]$", 1)
    unit = F.regexp_extract(ttl, r"^\d+([dhms])$", 1)
    return F.when(n != "", n.cast("bigint") * S.choose(unit, {"d": 86400, "h": 3600, "m": 60}, 1)).otherwise(F.lit(None).cast("bigint"))


def remove_tag(tags: Column, tag: str) -> Column:
    """Tags without one; the read-only bit cannot be removed in bulk."""
    if tag == "locked":
        raise ValueError("'locked' is the read-only bit; unlock rows one by one")
    return F.array_remove(tags, tag)


def remove_namespace(rows: DataFrame, ns: str, hard: bool = False) -> DataFrame:
    """Rows of a namespace and those below it marked as ``deleted``, or with ``hard`` left out."""
    gone = F.coalesce((F.col("ns") == ns) | F.startswith(F.col("ns"), F.lit(f"{ns}:")), F.lit(False))
    if hard:
        return rows.filter(~gone)
    return rows.withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) | gone if "deleted" in rows.columns else gone)


def credit(rows: DataFrame, credits: DataFrame) -> DataFrame:
    """Rows with utility_count raised by the number of their credits (id); those of unknown ids change nothing."""
    n = credits.groupBy("id").agg(F.count("*").alias("__n"))
    return rows.join(n, "id", "left").withColumn("utility_count", F.col("utility_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def carry_over(versions: DataFrame, log: DataFrame) -> DataFrame:
    """(id, accesses, access_count) of the newest version of each slot after it took over its predecessors' log.

    ``versions``: (id, ns, key, version, access_count); ``log``: one row an access (id). Log rows move to
    the newest version; where there are older ones its count becomes the greatest of theirs.
    """
    newest = versions.groupBy("ns", "key").agg(F.max(F.struct("version", "id", "access_count")).alias("x")).select("ns", "key", F.col("x.version").alias("top"), F.col("x.id").alias("new"), F.col("x.access_count").alias("own"))
    moved = log.join(versions.select("id", "ns", "key"), "id").groupBy("ns", "key").agg(F.count("*").alias("accesses"))
    older = versions.join(newest.select("ns", "key", "top"), ["ns", "key"]).filter(F.col("version") < F.col("top")).groupBy("ns", "key").agg(F.max("access_count").alias("before"))
    rows = newest.join(moved, ["ns", "key"], "left").join(older, ["ns", "key"], "left")
    return rows.select(F.col("new").alias("id"), F.coalesce("accesses", F.lit(0)).alias("accesses"), F.coalesce("before", "own").alias("access_count"))


def invalidate(versions: DataFrame, marks: DataFrame) -> DataFrame:
    """Versions with ``valid_to`` stamped on the latest live one of each marked slot (ns, key, at), unless it has one."""
    last = versions.filter("NOT deleted").groupBy("ns", "key").agg(F.max("version").alias("version"))
    hit = marks.groupBy("ns", "key").agg(F.min("at").alias("__at")).join(last, ["ns", "key"])
    return versions.join(hit, ["ns", "key", "version"], "left").withColumn("valid_to", F.coalesce("valid_to", F.when(~F.col("deleted"), F.col("__at")))).drop("__at")


def seed_rules(spaces: DataFrame, existing: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(ns, rule, priority) of every namespace: what exists, and the built-in rules that are missing there."""
    built_in = spaces.select("ns").distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.priority).alias("priority")) for r in rules or RULES]))).select("ns", "x.rule", "x.priority")
    return existing.select("ns", "rule", "priority").union(built_in.join(existing, ["ns", "rule"], "left_anti").select("ns", "rule", "priority"))
