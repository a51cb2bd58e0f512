"""WARC archives written and read back by Spark, on any file system that Spark reaches.

Writing: every row becomes one record; a record ends with CR LF CR LF, which is the line separator of
the text writer, so parts are valid archives. Of rows with equal payloads (of ``min_bytes`` at least)
the one with the least id is a response, the others are revisits that carry the HTTP head only.

Reading: files are cut at the version line wherever it stands, also inside payloads and across splits.
Tasks number the cuts, read what looks like a record head behind each, and emit candidate offsets with
the offset at which a record of that length would end. Starting from offset 0 of each file, pointer
jumping (reach doubles each round) keeps only records that the chain of lengths reaches, so a version
line or a whole record inside a payload is never taken for one. Payloads that hold a version line are
put together again from their cuts.

Null payloads count as empty. Rows with repeated ids each get a record. A null id is written as empty
and read back as null. Line breaks in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import discard, materialize

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: RFC 4648 base 32 digits, and those that conv() writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def digest(payload: Column) -> Column:
    """Bare upper-case base 32 SHA-1 (each 5 bytes give 8 digits)."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, records_per_file: int = 4096) -> None:
    """Write one record per row to files of at most ``records_per_file`` records below ``path``."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.withColumn("d", digest(F.col("p").cast("binary"))).withColumn("n", F.octet_length("p"))
    same = materialize(rows.select("k", "d", "n").filter(F.col("n") >= min_bytes).groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("c")).filter("c > 1").select("d", "first"))
    rows = rows.join(same, "d", "left")
    again = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(again, head).otherwise(F.concat(head, F.col("p")))
    target = F.replace(F.replace(F.coalesce("u", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    fields = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("k"),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("d"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(fields, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    discard(same)


_HEAD = re.compile(rb"((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


def _parse(cut: bytes) -> dict | None:
    """Fields of a record head at the start of ``cut`` (behind the version line), or None."""
    m = _HEAD.match(cut)
    if not m:
        return None
    fields = {a.lower(): b.strip() for a, b in _FIELD.findall(m[1])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15 or b"warc-type" not in fields:
        return None
    return {"fields": fields, "head": m.end(), "length": int(length)}


def _identity(raw: bytes | None) -> str | None:
    return raw.decode("utf-8", "replace").removeprefix("<urn:page:").removesuffix(">") if raw is not None else None


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, cut): text between version lines, numbered by scan order within a split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("cut"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, off, size, ok, next, ...) of every cut; off is the offset of the version line before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, off = None, 0
        names = ["file", "block", "at", "local", "size", "ok", "reach", "head", "id", "kind", "refers", "http", "payload_bytes", "payload_digest"]
        for batch in batches:
            out: list[tuple] = []
            for file, block, at, cut in zip(*(batch.column(i) for i in range(4)), strict=True):
                file, block, at, cut = file.as_py(), block.as_py(), at.as_py(), cut.as_py()
                if (file, block) != where:
                    where, off = (file, block), 0
                found = _parse(cut)
                row: tuple = (file, block, at, off, len(cut), found is not None)
                if found:
                    f, end = found["fields"], found["head"] + found["length"]
                    body = cut[found["head"] : end]
                    split = body.find(b"\r\n\r\n") + 4
                    http = body[: split - 4] if split > 3 else b""
                    declared = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", http, re.M)
                    whole = end <= len(cut)
                    kind = f[b"warc-type"].decode("ascii", "replace")
                    payload = body[split:] if split > 3 else body
                    if kind == "revisit":
                        size, sha = int(declared[1]) if declared else None, f.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
                    elif whole:
                        size, sha = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size, sha = None, None
                    row += (end + len(END), found["head"], _identity(f.get(b"warc-record-id")), kind, _identity(f.get(b"warc-refers-to")), split if split > 3 else 0, size, sha)
                else:
                    row += (None,) * 8
                out.append(row)
                off += len(cut) + len(MAGIC)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    schema = "file string, block bigint, at bigint, local bigint, size bigint, ok boolean, reach bigint, head bigint, id string, kind string, refers string, http bigint, payload_bytes bigint, payload_digest string"
    cuts = materialize(_cuts(spark, path).mapInArrow(run, schema))
    # Splits tile a file: the first cut of a file stands before its first version line.
    total = cuts.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("t"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("file", "block", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("base"))
    placed = cuts.join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("local") - len(MAGIC))
    return placed.withColumn("next", F.col("off") + len(MAGIC) + F.col("reach"))


def reachable(found: DataFrame, rounds: int = 48) -> DataFrame:
    """(file, off) of the records that the chain of lengths from offset 0 reaches."""
    jump = materialize(found.filter("ok").select("file", "off", "next"))
    reached = materialize(jump.filter("off = 0").select("file", "off"))
    n = reached.count()
    for _ in range(rounds):
        step = reached.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        known = jump.select("file", "off")
        old, reached = reached, materialize(reached.union(step.join(known, ["file", "off"], "left_semi")).distinct())
        discard(old)
        grown = reached.count()
        if grown == n:
            break
        n = grown
        after = jump.select("file", F.col("off").alias("next"), F.col("next").alias("then"))
        old, jump = jump, materialize(jump.join(after, ["file", "next"], "left").select("file", "off", F.coalesce("then", "next").alias("next")))
        discard(old)
    discard(jump)
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, id, kind, refers, payload_bytes, payload_digest) of every record of the archives below ``path``."""
    found = materialize(candidates(spark, path))
    records = found.filter("ok").join(reachable(found), ["file", "off"])
    records = materialize(records.select("file", "off", "next", "head", "id", "kind", "refers", "http", "payload_bytes", "payload_digest"))
    columns = ["file", "off", "id", "kind", "refers", "payload_bytes", "payload_digest"]
    torn = records.filter("payload_bytes IS NULL")
    if torn.isEmpty():
        discard(found)
        return records.select(*columns)
    # A version line inside the payload: gather the cuts from the record's start to its end.
    spans = torn.select(F.col("file").alias("f"), F.col("off").alias("lo"), F.col("next").alias("hi"), F.col("head").alias("skip"), F.col("http").alias("more"))
    inside = found.select("file", "at", "off").join(spans, (F.col("file") == F.col("f")) & (F.col("off") >= F.col("lo")) & (F.col("off") < F.col("hi"))).drop("f")
    parts = _cuts(spark, path).select("file", "at", "cut").join(inside, ["file", "at"])
    whole = parts.groupBy("file", "lo", "hi", "skip", "more").agg(F.array_sort(F.collect_list(F.struct("off", "cut"))).alias("cuts"))
    joined = F.expr(f"array_join(transform(cuts, x -> cast(x.cut AS string)), '{MAGIC}')").cast("binary")
    size = F.col("hi") - F.col("lo") - len(MAGIC) - F.col("skip") - len(END) - F.col("more")
    body = whole.select("file", F.col("lo").alias("off"), size.alias("bytes"), F.substring(joined, (F.col("skip") + F.col("more") + 1).cast("int"), size.cast("int")).alias("body"))
    mended = body.select("file", "off", F.col("bytes").alias("pb"), digest(F.col("body")).alias("pd"))
    return records.join(mended, ["file", "off"], "left").select(*columns[:-2], F.coalesce("payload_bytes", "pb").alias("payload_bytes"), F.coalesce("payload_digest", "pd").alias("payload_digest"))
