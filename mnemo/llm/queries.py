"""One thin query for each operator of this package, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    from . import cws

    found = cws.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        cws.spelt("fp").alias("fingerprint"),
        cws.spelt("edited_fp").alias("edited_fingerprint"),
        cws.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        cws.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    from . import minhash

    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op4_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    part = langid.fold("doc_id", 5)
    lists = langid.train(docs.filter(part != 0), "lang", "text", F.xxhash64("doc_id"))
    held = docs.select("doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held_out"))
    return langid.predict(held, lists).select("doc_id", "held_out", "lang_pred", "score")


def op8_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from . import langid, zquality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    part = langid.fold("doc_id", 5)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(part != 0)
    model = zquality.train(docs, labels, "doc_id", "text", "quality")
    held = docs.withColumn("held_out", F.coalesce(part == 0, F.lit(False)))
    return zquality.score(held, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    from . import winnow

    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    from . import html

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    import uuid

    from . import warc
    from ._io import shared_dir

    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        F.expr("try_cast(id AS bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.expr("try_cast(refers AS bigint)").alias("refers_to"),
    )


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from . import rlbwt

    found = rlbwt.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from . import langid, lbl

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    part = langid.fold("doc_id", 10)
    found, vocab = lbl.score(docs, "doc_id", "text", docs.filter(part != 0))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_rank_order_langid": op4_rank_order_langid,
    "op5_site_templates": op5_site_templates,
    "op6_run_length_index": op6_run_length_index,
    "op7_warc_chain": op7_warc_chain,
    "op8_zstd_quality": op8_zstd_quality,
    "op9_winnowing": op9_winnowing,
    "op10_log_bilinear": op10_log_bilinear,
}

#: Words of whole texts, A-Z in lower case.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}')"
_ALNUM = _WORDS.replace("{words}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ORACLES: dict[str, str] = {
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(words="[^ \\t-\\r]+")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_winnowing": f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
iw AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i+9], ' ')) END) AS x FROM iw),
k AS (SELECT DISTINCT least(len(ws), 10) AS k FROM iw WHERE len(ws) > 0),
p AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS pos FROM dw, k WHERE len(ws) >= k),
h AS (SELECT doc_id, k, pos, item_id FROM p JOIN i ON i.x = array_to_string(p.ws[pos:pos+k-1], ' ')),
c AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS w FROM (SELECT DISTINCT doc_id, k, pos FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT dw.doc_id, len(dw.ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_warc_chain": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM p),
b AS (SELECT page_id, n, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(hex, i, 1)) - 1) AS v FROM d),
t AS (SELECT page_id, n, list_concat([0], flatten(list_transform(v, lambda x: [(x // 8) % 2, (x // 4) % 2, (x // 2) % 2, x % 2]))) AS v FROM b),
e AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (16 * v[5*i+2] + 8 * v[5*i+3] + 4 * v[5*i+4] + 2 * v[5*i+5] + v[5*i+6] + 1)::BIGINT, 1)), '') AS digest FROM t),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM e)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
}
