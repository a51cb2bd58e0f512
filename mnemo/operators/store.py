"""A snapshot store on Parquet: append-only versions, compare-and-swap on a manifest, latest views.

Every commit writes a new immutable folder of rows and then the next numbered manifest, created only if
it does not exist yet; of two writers with the same base one fails and retries on the new head. Nothing
is updated in place, readers use the last manifest, and compaction rewrites the live rows.
"""

from __future__ import annotations

import difflib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, ns string, key string, version int, content string, kind string, tier string, tags array<string>, importance double, created_at timestamp, deleted boolean, supersedes string"


class Conflict(RuntimeError):
    """Another writer committed first, or the base version is not the head."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def head(self) -> int:
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(m[1]) for s in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)", s.getPath().getName()))), default=0)

    def _folders(self, version: int) -> list[str]:
        if not version:
            return []
        stream = self._fs.open(self._at("manifests", str(version)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def versions(self, at: int | None = None) -> DataFrame:
        """All rows of a snapshot (the head by default)."""
        return self._read([f for f in self._folders(self.head() if at is None else at) if f.startswith("data/")])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def live(self, at: int | None = None) -> DataFrame:
        """The greatest version of each (ns, key), where that is not a deletion."""
        w = Window.partitionBy("ns", "key").orderBy(F.desc("version"))
        return self.versions(at).withColumn("__r", F.row_number().over(w)).filter("__r = 1 AND NOT deleted").drop("__r")

    def _commit(self, rows: DataFrame, base: int, instead: list[str] | None = None) -> int:
        """Add rows to the folders of ``base``, or to those named ``instead``."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        listed = [*(self._folders(base) if instead is None else instead), folder]
        # Written under another name first: whoever sees a manifest sees all of it.
        jvm, made, wanted = self.spark._jvm, self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", str(base + 1))
        stream = self._fs.create(made, False)
        try:
            stream.write(bytearray("\n".join(listed).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(made), self._fs.makeQualified(wanted), never_over)
        except Exception as e:
            self._fs.delete(made, False)
            raise Conflict(f"version {base + 1} was committed meanwhile") from e
        return base + 1

    def put(self, news: DataFrame, base: int | None = None) -> int:
        """Add (ns, key, content, ...) as next versions of their slots; missing columns get defaults.

        ``base``: the snapshot the caller has read; a newer head is a conflict. Several rows for one slot
        become consecutive versions in order of created_at, then content. Equal content is not written again.
        """
        at = self.head()
        if base is not None and base != at:
            raise Conflict(f"head is {at}, not {base}")
        defaults = {"kind": F.lit("semantic"), "tier": F.lit("stm"), "tags": F.array().cast("array<string>"), "importance": F.lit(0.5), "created_at": F.lit("1970-01-01").cast("timestamp"), "deleted": F.lit(False)}
        for c, v in defaults.items():
            news = news.withColumn(c, v if c not in news.columns else F.coalesce(F.col(c), v))
        now = self.live(at).select("ns", "key", F.sha2("content", 256).alias("__h"))
        tops = self._read(self._folders(at)).groupBy("ns", "key").agg(F.max("version").alias("__top"), F.max_by("id", "version").alias("__id"))
        fresh = news.withColumn("__h", F.sha2("content", 256)).join(now, ["ns", "key", "__h"], "left_anti").drop("__h")
        w = Window.partitionBy("ns", "key").orderBy("created_at", "content")
        rows = fresh.join(tops, ["ns", "key"], "left").withColumn("version", F.coalesce("__top", F.lit(0)) + F.row_number().over(w))
        ident = F.left(F.sha2(F.concat_ws("\x01", "ns", "key", F.col("version").cast("string")), 256), F.lit(26))
        rows = rows.withColumn("id", ident).withColumn("supersedes", F.coalesce(F.lag("id").over(w), "__id"))
        return self._commit(rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]), at)

    def remove(self, slots: DataFrame) -> int:
        """Tombstones for (ns, key)."""
        at = self.head()
        gone = self.live(at).join(slots.select("ns", "key").distinct(), ["ns", "key"], "left_semi")
        stones = gone.withColumn("supersedes", F.col("id")).withColumn("version", F.col("version") + 1).withColumn("deleted", F.lit(True))
        return self._commit(stones, at)

    def compact(self) -> int:
        """Rewrite the live rows only; the last tombstones go to a folder that just tells where versions and ids go on."""
        at = self.head()
        w = Window.partitionBy("ns", "key").orderBy(F.desc("version"))
        last = self._read(self._folders(at)).withColumn("__r", F.row_number().over(w)).filter("__r = 1 AND deleted").drop("__r")
        gone = f"gone/{uuid.uuid4().hex}"
        last.write.parquet(f"{self.path}/{gone}")
        return self._commit(self.live(at), at, instead=[gone])


def patch(content: str, diff: str) -> str:
    """Apply a unified diff whose context must match word for word; raises ValueError otherwise."""
    lines = content.split("\n")
    out, at = [], 0
    for head, body in re.findall(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@[^\n]*)\n((?:[ +\-\\][^\n]*\n?|\n)*)", diff):
        start = int(re.match(r"@@ -(\d+)", head)[1])
        old = [x[1:] for x in body.split("\n") if x[:1] in (" ", "-")]
        new = [x[1:] for x in body.split("\n") if x[:1] in (" ", "+")]
        pos = max(start - 1, 0)
        if pos < at or lines[pos : pos + len(old)] != old:
            raise ValueError(f"context does not match at line {start}")
        out += lines[at:pos] + new
        at = pos + len(old)
    if at == 0 and not out:
        raise ValueError("no hunk")
    return "\n".join(out + lines[at:])


def make_patch(old: str, new: str) -> str:
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=1))
