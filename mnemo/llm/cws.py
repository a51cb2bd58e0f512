"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text is the weighted set of its words (runs of bytes other than ASCII white space; weight: how often
the word stands in it). For each of ``samples`` slots every word gets, from hashes of word and slot
alone, r and c from Gamma(2, 1) and b from U(0, 1); with t = floor(ln(weight) / r + b) its key is
ln c - r (t - b) - r. The slot's sample is the (word, t) with the least key. Two texts agree in a slot
with probability equal to the generalised Jaccard similarity of their weighted sets (sum of minima over
sum of maxima), so the share of equal slots estimates it without bias.

The key (38 bits) and a 24-bit hash of the sample share a long, so a slot is one ``min`` in a generated
hash aggregate. Words are counted by sorting their hashes inside the row; the aggregate's keys contain
the partitioning of the rows, so no word is ever shuffled.

Null texts count as empty. A text without words has the fingerprint ''; two such are alike (1.0), one
such and another text are not (0.0). Repeated rows and ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import materialize

SAMPLE_BITS = 24
_HALF = 4294967296.0


def _unit(x: Column, high: bool) -> Column:
    part = F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(0xFFFFFFFF))
    return (part.cast("double") + 0.5) / _HALF


def slot(word: Column, log_weight: Column, k: int) -> Column:
    """The packed key and sample of one word in slot ``k``."""
    a, b, c = (F.xxhash64(word, F.lit(3 * k + i)) for i in range(3))
    r = -F.ln(_unit(a, True) * _unit(a, False))
    log_c = F.ln(-F.ln(_unit(b, True) * _unit(b, False)))
    beta = _unit(c, True)
    t = F.floor(log_weight / r + beta)
    key = log_c - r * (t - beta) - r
    packed = ((key + 128.0) * float(1 << 30)).cast("long")
    sample = F.xxhash64(word, t, F.lit(k)).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))
    return packed * (1 << SAMPLE_BITS) + sample


def fingerprints(rows: DataFrame, keys: list[str], text: str, samples: int) -> DataFrame:
    """(keys..., fp): array of ``samples`` slots per distinct value of ``keys``; null without words.

    If ``rows`` is partitioned by some of ``keys``, nothing is shuffled.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    rows = rows.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("__h"))
    firsts = F.expr("filter(sequence(0, greatest(size(__h) - 1, 0)), i -> i < size(__h) AND (i = 0 OR get(__h, i) <> get(__h, i - 1)))")
    rows = rows.select(*keys, "__h", firsts.alias("__f"))
    terms = rows.select(*keys, "__h", "__f", F.posexplode_outer("__f").alias("__i", "__s"))
    terms = terms.select(*keys, F.expr("get(__h, __s)").alias("__w"), F.expr("ln(cast(coalesce(get(__f, __i + 1), size(__h)) - __s AS double))").alias("__l"))
    slots = [F.min(slot(F.col("__w"), F.col("__l"), k)).alias(f"__m{k}") for k in range(samples)]
    found = terms.groupBy(*keys).agg(*slots)
    low = [F.col(f"__m{k}").bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)).cast("int") for k in range(samples)]
    return found.select(*keys, F.when(F.col("__m0").isNotNull(), F.array(*low)).alias("fp"))


def spelt(fp: str) -> Column:
    """Six hexadecimal digits per slot."""
    return F.coalesce(F.array_join(F.transform(F.col(fp), lambda x: F.lpad(F.lower(F.hex(x)), SAMPLE_BITS // 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def neighbours(docs: DataFrame, key: str, text: str, rows_per_bucket: int = 1000, max_ranges: int = 10000, max_parts: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, behind): rows has (bucket, pos, k, t, next_text) of every row, behind (bucket, next_bucket).

    The next text is that of the next row in descending order of ``key`` (nulls last, ties by text; the
    first row follows the last). Buckets are ranges of ``key`` of about equal numbers of rows, whose bounds
    (``max_ranges`` at most) come to the driver; with more rows than these hold, each range is cut into up
    to ``max_parts`` parts of equal width. Each bucket gets a copy of the first row of the bucket behind it,
    so a window within buckets finds every neighbour and texts are shuffled once. Rows of one id share a bucket.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    count = docs.count()
    ranges = max(1, min(max_ranges, count // rows_per_bucket))
    parts = max(1, min(max_parts, count // (ranges * rows_per_bucket)))
    bounds: list[float] = []
    if ranges > 1:
        d = F.col(key).cast("double")
        low, high, got = docs.agg(F.min(d), F.max(d), F.percentile_approx(d, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()
        bounds = sorted(set(got or []))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType
    if bounds:
        edges = [low, *bounds, high]
        spans = [(float(i), lo, parts / (hi - lo) if hi > lo else 0.0) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        cuts = F.broadcast(spark.createDataFrame(spans, "__range double, __low double, __scale double"))

    def put(d: DataFrame) -> DataFrame:
        if not bounds:
            return d.withColumn("bucket", F.lit(0))
        cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__d", outputCol="__range")
        d = cut.transform(d.withColumn("__d", F.coalesce(F.col("k").cast("double"), F.lit(-1.7e308)))).join(cuts, "__range")
        part = F.least(F.greatest(F.floor((F.col("__d") - F.col("__low")) * F.col("__scale")), F.lit(0)), F.lit(parts - 1))
        return d.withColumn("bucket", (F.col("__range") * parts + part).cast("int")).drop("__d", "__range", "__low", "__scale")

    placed = put(rows)
    tops = put(rows.select("k")).groupBy("bucket").agg(F.max("k").alias("top"))  # max_ranges * max_parts rows at most
    ring = Window.orderBy(F.desc("bucket"))
    own, after = F.struct("bucket", "top"), F.lead(F.struct("bucket", "top")).over(ring)
    table = tops.select(F.col("bucket").alias("into"), F.coalesce(after, F.first(own).over(ring)).alias("n"))
    table = materialize(table.select(F.col("n.bucket").alias("next_bucket"), F.col("n.top").alias("top"), "into"))
    heads = placed.join(F.broadcast(table), (F.col("bucket") == F.col("next_bucket")) & F.col("k").eqNullSafe(F.col("top")))
    heads = heads.groupBy("into").agg(F.min("t").alias("t")).select(F.lit(None).cast(kind).alias("k"), "t", F.col("into").alias("bucket"), F.lit(1).alias("end"))
    order = Window.partitionBy("bucket").orderBy("end", F.desc_nulls_last("k"), "t")
    every = placed.select("k", "t", "bucket", F.lit(0).alias("end")).unionByName(heads)
    every = every.withColumn("next_text", F.lead("t").over(order)).withColumn("pos", F.row_number().over(order)).filter("end = 0")
    return every.select("bucket", "pos", "k", "t", "next_text"), table.select(F.col("into").alias("bucket"), "next_bucket")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 32) -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, next_fp) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) of the next
    row's first ones.
    """
    rows, behind = neighbours(docs, key, text)
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("bucket", "pos", F.col("k").alias("id"), F.length("t").cast("long").alias("n_chars"), "t", edited.alias("e"))
    fixed = ["bucket", "pos", "id", "n_chars", "edited_sha256"]
    rows = rows.select(*fixed[:-1], F.sha2(F.col("e").cast("binary"), 256).alias(fixed[-1]), "t", "e")
    both = rows.select(*fixed, F.posexplode(F.array("t", "e")).alias("side", "text"))
    # Buckets keep rows and their words in one partition from here on.
    found = fingerprints(both, [*fixed, "side"], "text", samples)
    pair = found.groupBy(*fixed).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    pair = materialize(pair)
    heads = pair.filter("pos = 1").select(F.col("bucket").alias("next_bucket"), F.struct("fp").alias("head")).join(behind, "next_bucket").select("bucket", "head")
    order = Window.partitionBy("bucket").orderBy("pos")
    ahead = pair.withColumn("after", F.lead(F.struct("fp")).over(order)).join(heads, "bucket", "left")
    return ahead.select("id", "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("after", "head")["fp"].alias("next_fp"))
