"""Version chains, visibility, namespaces and plain statistics over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str = "version") -> DataFrame:
    """The row of the greatest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def latest_live(versions: DataFrame) -> DataFrame:
    """Of each (ns, key) the greatest version that is not deleted."""
    return latest(versions.filter(~F.col("deleted")), ["ns", "key"])


def history(versions: DataFrame) -> DataFrame:
    """All versions, deleted ones too, of keys with a live version, with the version each replaces."""
    live = versions.filter(~F.col("deleted")).select("ns", "key").distinct()
    w = Window.partitionBy("ns", "key").orderBy("version")
    return versions.join(live, ["ns", "key"], "left_semi").withColumn("supersedes", F.lag("id").over(w))


def cas_conflicts(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes (ns, key, base_version, ...) whose base is not the head of their chain."""
    head = versions.groupBy("ns", "key").agg(F.max("version").alias("head"))
    return writes.join(head, ["ns", "key"], "left").filter(F.coalesce("head", F.lit(0)) != F.col("base_version"))


def valid_at(hours: int, created: str = "age_hours", valid_from: str = "valid_from_hours", valid_to: str = "valid_to_hours") -> Column:
    """Whether a fact held ``hours`` before now (all columns: hours before now)."""
    return (F.coalesce(valid_from, created) >= hours) & (F.col(valid_to).isNull() | (F.col(valid_to) < hours))


def in_namespace(column: str, pattern: str) -> Column:
    """'' any, 'x:*' or 'x*' by prefix, else equal."""
    if not pattern:
        return F.lit(True)
    return F.col(column).startswith(pattern[:-1]) if pattern.endswith("*") else F.col(column) == pattern


def namespace_ok(column: str) -> Column:
    """At most 128 bytes of ':'-separated segments of [A-Za-z0-9_-] that don't begin with '_'."""
    return (F.octet_length(column) <= 128) & F.col(column).rlike(r"^[A-Za-z0-9-][A-Za-z0-9_-]*(:[A-Za-z0-9-][A-Za-z0-9_-]*)*$")


def namespace_levels(rows: DataFrame, column: str = "ns") -> DataFrame:
    """(level, node, n): rows below every prefix of the namespace."""
    parts = F.split(column, ":")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), i), ":").alias("node")))).alias("x")
    return rows.select(node).groupBy("x.level", "x.node").agg(F.count("*").alias("n"))


def protected(pinned: str = "pinned", locked: str = "locked") -> Column:
    return F.col(pinned) | F.col(locked)


def has_tags(tags: str, wanted: list[str]) -> Column:
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(tags, t)
    return out


def tier_allowed(tier: str, excluded: tuple[str, ...] = ("dormant", "sensory", "archived")) -> Column:
    return ~F.coalesce(tier, F.lit("stm")).isin(*excluded)


def resolve_alias(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Append ``canonical``: the alias's target (case ignored, one step), or the name itself.

    The alias table is joined by size: Spark broadcasts it only while it is small.
    """
    named = aliases.select(F.lower("alias").alias("__alias"), "canonical")
    return rows.withColumn("__alias", F.lower(column)).join(named, "__alias", "left").drop("__alias").withColumn("canonical", F.coalesce("canonical", column))


def with_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Append the sorted list of (path, rel) of each memory."""
    lists = files.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("path", "rel"))).alias("files"))
    return rows.join(lists, "id", "left")


def find_by_file(rows: DataFrame, files: DataFrame, path: str, rel: str | None = None) -> DataFrame:
    hit = files.filter((F.col("path") == path) & (F.lit(True) if rel is None else F.col("rel") == rel)).select("id").distinct()
    return rows.join(hit, "id", "left_semi")


def stubs(rows: DataFrame, n: int = 80) -> DataFrame:
    """Compact projection: id, key, kind, tier, importance, est_tokens and the first ``n`` characters."""
    from mnemo.functions.text import est_tokens, truncate

    return rows.select("id", "key", "kind", "tier", "importance", est_tokens(F.col("content")).alias("est_tokens"), truncate(F.col("content"), n).alias("summary"))


def pinned_scan(rows: DataFrame) -> DataFrame:
    return rows.filter("pinned").orderBy(F.desc("importance"), "age_hours", "id")


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Live rows of a table of ids."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def resolve(versions: DataFrame, slots: DataFrame) -> DataFrame:
    """(ns, key, id): the latest live version of each asked slot; id is null where there is none."""
    return slots.select("ns", "key").distinct().join(latest_live(versions).select("ns", "key", "id"), ["ns", "key"], "left")


def edge_counts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with how many edges leave and reach them (n_out, n_in)."""
    leave = edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_out"))
    reach = edges.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n_in"))
    out = rows.join(leave, "id", "left").join(reach, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_out", "n_in")})


def namespace_graph(rows: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """(from_key, to_key, rel, weight) of the edges between rows of one namespace."""
    own = rows.filter(in_namespace("ns", pattern)).select("id", "key")
    both = edges.join(own.select(F.col("id").alias("a"), F.col("key").alias("from_key")), "a").join(own.select(F.col("id").alias("b"), F.col("key").alias("to_key")), "b")
    return both.select("a", "b", "from_key", "to_key", "rel", "weight").distinct().select("from_key", "to_key", "rel", "weight")
