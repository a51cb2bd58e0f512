"""Typed weighted edges: expansion, personalised PageRank, components, linking, upkeep.

Edges are (a, b, rel, weight, ...); labels and ranks move by equi-joins, and iterative results are written
to the shared folder between rounds so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.session import shared_dir

# Relation, weight, along (out), against (in), priority, handling, hops.
POLICY = [
    ("contradicts", 0.9, True, True, 3, "reserve", 1),
    ("depends_on", 0.7, True, False, 2, "reserve", 2),
    ("prevents", 0.7, True, False, 2, "reserve", 2),
    ("refines", 0.8, True, True, 2, "accompany", 1),
    ("caused_by", 0.75, True, False, 2, "accompany", 2),
    ("implies", 0.8, True, False, 2, "accompany", 1),
    ("contains", 0.6, True, False, 2, "substitute", 1),
    ("relates_to", 0.5, True, True, 1, "background", 1),
    ("merged_into", 0.0, False, False, 0, "never", 1),
]
REASONING = ("caused_by", "prevents", "implies")


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write once to the folder that driver and executors share and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    if path := getattr(df, "_written_to", None):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def policy(spark: SparkSession) -> DataFrame:
    """Nine rows."""
    return F.broadcast(spark.createDataFrame(POLICY, "rel string, default_weight double, along boolean, against boolean, priority int, handling string, hops int"))


def directed(edges: DataFrame) -> DataFrame:
    """(seed, far, rel, weight, priority, handling, hops): every step the policy allows."""
    rows = edges.join(policy(edges.sparkSession), "rel", "left")
    rows = rows.select("a", "b", "rel", "weight", F.coalesce("along", F.lit(True)).alias("along"), F.coalesce("against", F.lit(False)).alias("against"), F.coalesce("priority", F.lit(1)).alias("priority"), F.coalesce("handling", F.lit("background")).alias("handling"), F.coalesce("hops", F.lit(1)).alias("hops"))
    keep = ["rel", "weight", "priority", "handling", "hops"]
    out = rows.filter("along").select(F.col("a").alias("seed"), F.col("b").alias("far"), *keep)
    return out.union(rows.filter("against").select(F.col("b").alias("seed"), F.col("a").alias("far"), *keep))


def best_edges(steps: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    """The k edges of each seed by priority, then weight."""
    w = Window.partitionBy("seed").orderBy(F.desc("priority"), F.desc("weight"), "far", "rel")
    return steps.filter(F.col("weight") >= least).withColumn("r", F.row_number().over(w).cast("bigint")).filter(F.col("r") <= k)


def spread(seeds: DataFrame, edges: DataFrame, hops: int = 2, damping: float = 0.3, total: int = 50, per_seed: int = 5, only_edge_cap: float = 0.3) -> DataFrame:
    """(qid, id, score, hop, via): neighbours reached from scored seeds (qid, id, score) in at most ``hops`` steps.

    A step passes score x weight x damping; a node keeps its best arrival, capped; the best ``total`` per
    query remain, best seeds first. A second hop follows only relations whose policy allows it.
    """
    steps = best_edges(directed(edges), per_seed)
    front = seeds.select("qid", "id", "score", F.lit(2).alias("left"))
    found: DataFrame | None = None
    for hop in range(1, hops + 1):
        reach = front.filter(F.col("left") >= hop).join(steps, F.col("id") == F.col("seed"))
        reach = reach.select("qid", F.col("far").alias("id"), F.least(F.col("score") * F.col("weight") * damping, F.lit(only_edge_cap)).alias("score"), F.col("hops").alias("left"), F.lit(hop).alias("hop"), "rel")
        best = reach.groupBy("qid", "id").agg(F.max(F.struct("score", "left", "hop", "rel")).alias("x")).select("qid", "id", "x.*")
        best = best.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
        if found is not None:
            best = best.join(found.select("qid", "id"), ["qid", "id"], "left_anti")
        found = best if found is None else found.union(best)
        front = best.select("qid", "id", "score", "left")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= total).select("qid", "id", "score", "hop", F.col("rel").alias("via"))


def pagerank(seeds: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.5, cut_every: int = 4) -> DataFrame:
    """(id, mass): r = (1 - alpha) s + alpha W'r over the symmetrised graph from seeds (id, mass)."""
    pairs = edges.filter("rel <> 'merged_into' AND weight > 0")
    both = pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight"))
    out = both.groupBy("a").agg(F.sum("weight").alias("out"))
    walk = written(both.join(out, "a").select("a", "b", (F.col("weight") / F.col("out")).alias("p")))
    total = seeds.agg(F.sum("mass")).first()[0]
    start = seeds.select("id", (F.col("mass") / total).alias("mass"))
    home = start.select("id", (F.col("mass") * (1 - alpha)).alias("mass"))
    rank, cut = start, None
    for i in range(rounds):
        moved = rank.join(walk, rank["id"] == walk["a"]).select(F.col("b").alias("id"), (F.col("mass") * F.col("p") * alpha).alias("mass"))
        rank = moved.union(home).groupBy("id").agg(F.sum("mass").alias("mass"))
        if (i + 1) % cut_every == 0 or i + 1 == rounds:
            last, cut = cut, written(rank)
            rank = cut
            if last is not None:
                discard(last)
    discard(walk)
    return rank


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp): least id reachable, by hooking every node to the least label around it and jumping labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = written(both.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")))
    for _ in range(rounds):
        far = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = label.join(far, "id").select("id", F.least("comp", "m").alias("comp"))
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        after = written(step.join(jump, "comp").select("id", F.least("comp", "root").alias("comp")))
        settled = after.join(label.withColumnRenamed("comp", "old"), "id").filter("comp <> old").isEmpty()
        discard(label)
        label = after
        if settled:
            discard(both)
            return label
    raise RuntimeError("components did not settle")


def classes(members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, links) of every member (id, hash or null): least id of its component, number of its links.

    Members of one of the ``sets`` (hash, least, copies) are linked to each other; ``links`` (a, b) join the
    least ids of different sets, each pair once.
    """
    ends = links.union(links.select("b", "a")).join(sets.select(F.col("least").alias("b"), "copies"), "b").groupBy(F.col("a").alias("least")).agg(F.sum("copies").alias("far"))
    found = sets.join(ends, "least", "left").join(components(links).withColumnRenamed("id", "least"), "least", "left")
    found = found.select("hash", F.coalesce("comp", "least").alias("class"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(found, "hash", "left").select("id", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def decay_and_prune(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges idle for 30 days with fewer than 3 uses lose a tenth; those below 0.05 or with a dead end go."""
    idle = (F.col("idle_hours") > 720) & (F.col("access_count") < 3)
    rows = edges.withColumn("weight", F.when(idle, F.col("weight") * 0.9).otherwise(F.col("weight"))).filter("weight >= 0.05")
    ids = alive.select("id")
    return rows.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def upsert(edges: DataFrame, news: DataFrame, order: str = "at") -> DataFrame:
    """The last write of each (a, b, rel) wins."""
    w = Window.partitionBy("a", "b", "rel").orderBy(F.desc(order))
    return edges.unionByName(news, allowMissingColumns=True).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def reasoning_candidates(edges: DataFrame, k: int = 50) -> DataFrame:
    """relates_to pairs that no reasoning edge joins in that direction, by weight."""
    known = edges.filter(F.col("rel").isin(*REASONING)).select("a", "b")
    return edges.filter("rel = 'relates_to'").join(known, ["a", "b"], "left_anti").orderBy(F.desc("weight"), "a", "b").limit(k)


def hebbian(edges: DataFrame, returned: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Edges strengthened by the number of result lists (qid, id) that hold both ends.

    Lists meet edges, not each other, so no pair within a list is ever made.
    """
    hits = edges.select("a", "b", "rel").join(returned.select("qid", F.col("id").alias("a")), "a").join(returned.select("qid", F.col("id").alias("b")), ["qid", "b"])
    times = hits.groupBy("a", "b", "rel").agg(F.count("*").alias("times"))
    return edges.join(times, ["a", "b", "rel"], "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("weight", S.hebbian(F.col("weight"), F.col("times")))


def contains_tree(edges: DataFrame) -> DataFrame:
    """(id, children, grandchildren) of nodes with contains-children."""
    child = edges.filter("rel = 'contains'").select(F.col("a").alias("id"), F.col("b").alias("child")).distinct()
    counts = child.groupBy("id").agg(F.count("*").alias("children"))
    grand = child.join(counts.select(F.col("id").alias("child"), F.col("children").alias("g")), "child").groupBy("id").agg(F.sum("g").alias("grandchildren"))
    return counts.join(grand, "id", "left").withColumn("grandchildren", F.coalesce("grandchildren", F.lit(0)))


def liveness(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, children, alive_share, summary_weight) of contains-parents: max(0.05, 1 - share of live children)."""
    child = edges.filter("rel = 'contains'").join(rows.select(F.col("id").alias("b"), "alive"), "b")
    out = child.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("children"), F.avg(F.col("alive").cast("int")).alias("alive_share"))
    return out.withColumn("summary_weight", F.greatest(F.lit(0.05), 1 - F.col("alive_share")))


def repoint(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with both ends replaced by (old, new) where given."""
    a, b = moves.select(F.col("old").alias("a"), F.col("new").alias("na")), moves.select(F.col("old").alias("b"), F.col("new").alias("nb"))
    rows = edges.join(a, "a", "left").join(b, "b", "left")
    return rows.withColumn("a", F.coalesce("na", "a")).withColumn("b", F.coalesce("nb", "b")).drop("na", "nb").filter("a <> b")


def capped(pairs: DataFrame, weight: str, k: int = 8) -> DataFrame:
    """Pairs (a, b) among the k heaviest of either end."""
    both = pairs.select(F.col("a").alias("x"), "a", "b", weight).union(pairs.select(F.col("b").alias("x"), "a", "b", weight))
    w = Window.partitionBy("x").orderBy(F.desc(weight), "a", "b")
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("a", "b", weight).distinct()


def fan_out_ok(children: Column, most: int = 12) -> Column:
    return children <= most


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those named by (a, b, rel)."""
    return edges.join(gone.select("a", "b", "rel").distinct(), ["a", "b", "rel"], "left_anti")


def parent_boost(seeds: DataFrame, edges: DataFrame, rows: DataFrame, most: int = 12, least: float = 0.3) -> DataFrame:
    """(qid, id, score): contains-parents of seeds (qid, id, score) that are no seeds, at the best child's score.

    Parents of more than ``most`` children and dormant ones stay out; ``rows``: live rows with id and tier.
    """
    child = edges.filter("rel = 'contains'").select(F.col("a").alias("parent"), F.col("b").alias("id")).distinct()
    small = child.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("parent")
    up = seeds.join(child.join(small, "parent"), "id").groupBy("qid", F.col("parent").alias("id")).agg(F.greatest(F.lit(least), F.max("score")).alias("score"))
    awake = rows.filter("tier <> 'dormant'").select("id")
    return up.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti").join(awake, "id", "left_semi").select("qid", "id", "score")


def force_contradictions(seeds: DataFrame, edges: DataFrame, rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(qid, id, score): what contradicts a seed over its best edges, either way, at ``share`` of the seed's score."""
    steps = best_edges(directed(edges)).filter("rel = 'contradicts' AND seed <> far").select(F.col("seed").alias("id"), "far")
    found = seeds.join(steps, "id").groupBy("qid", F.col("far").alias("id")).agg((F.max("score") * share).alias("score"))
    awake = rows.filter("tier <> 'dormant'").select("id")
    return found.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti").join(awake, "id", "left_semi").select("qid", "id", "score")


def resurrections(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(seed, id, rel): dormant neighbours that return with an awake seed.

    A contradicting row is the from side and newer than what it refutes; what a seed depends on or is
    prevented by is the to side. ``rows``: live rows with id, tier and age_hours.
    """
    about = lambda side: rows.select(F.col("id").alias(side), F.col("tier").alias(f"{side}_tier"), F.col("age_hours").alias(f"{side}_age"))
    both = edges.join(about("a"), "a").join(about("b"), "b")
    refuted = both.filter("rel = 'contradicts' AND a_tier = 'dormant' AND b_tier <> 'dormant' AND a_age < b_age").select(F.col("b").alias("seed"), F.col("a").alias("id"), "rel")
    needed = both.filter("rel IN ('depends_on', 'prevents') AND b_tier = 'dormant' AND a_tier <> 'dormant'").select(F.col("a").alias("seed"), F.col("b").alias("id"), "rel")
    return refuted.union(needed)
