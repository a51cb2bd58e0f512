"""Quality by compression: a text compresses better under the dictionary of the texts it resembles.

Two zstandard dictionaries are built from good and bad labelled texts. The difference of the two
compressed sizes over their sum is calibrated to the probability of a good label by isotonic regression
on further labelled rows that the dictionaries have not seen.

Training collects at most about ``sample`` labelled rows of each label for the dictionaries and as many
again for the calibration, chosen by a hash of the id, with their whole texts; both are parameters. Scoring
reads whole texts. Null and empty texts have difference 0. If a label is missing from training, every text
gets the mean label. Repeated rows are kept, and learned from as often as they stand there; an id with two
labels counts under both. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import materialize


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    at: np.ndarray
    p: np.ndarray


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there is too little to train on."""
    try:
        return zstd.train_dictionary(size, texts, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(texts)[-size:]


def compressors(model: Model, level: int = 3) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    made = []
    for raw in (model.good, model.bad):
        d = zstd.ZstdCompressionDict(raw)
        d.precompute_compress(level=level)
        made.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
    return made[0], made[1]


def difference(raw: bytes, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> float:
    """Over 0 where the good dictionary helps more."""
    if not raw:
        return 0.0
    g, b = len(good.compress(raw)), len(bad.compress(raw))
    return (b - g) / (b + g)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (difference, probability) of the least-squares non-decreasing curve (pool adjacent violators).

    Blocks of less than 20 rows' weight of either kind are tempered by half a row of each label.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, weight of label 1, weighted difference
    for d, t, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w, w * t, w * d])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[0] for b in blocks])
    p = np.array([(b[1] + 0.5) / (b[0] + 1) for b in blocks])
    return at, np.maximum.accumulate(p)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = 2000, dict_bytes: int = 1 << 16) -> Model:
    """Fit on ``docs`` (key, text) that ``labels`` (key, 0/1 label) marks; only sampled labels meet the texts."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), at.alias("at"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {y: min(1.0, 2 * sample / n) for y, n in counts.items()}
    limit = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * float(1 << 20)
    few = materialize(known.filter(F.col("at") < limit))  # about 4 x sample rows
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key")
    texts = texts.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    got = texts.select("text", "label", "key", "at").toPandas().sort_values(["at", "key", "text"])
    if set(got["label"]) != {0, 1}:
        mean = float(got["label"].mean()) if len(got) else 0.5
        return Model(b"", b"", np.zeros(1), np.full(1, mean))
    raw = [t.encode("utf-8", "surrogatepass") for t in got["text"]]
    y = got["label"].to_numpy()
    first = np.arange(len(got)) % 2 == 0
    if min((first & (y == v)).sum() for v in (0, 1)) == 0 or min((~first & (y == v)).sum() for v in (0, 1)) == 0:
        first = np.ones(len(got), bool)
    picked = {v: [r for r, f, z in zip(raw, first, y, strict=True) if f and z == v] for v in (0, 1)}
    model = Model(dictionary(picked[1], dict_bytes), dictionary(picked[0], dict_bytes), np.zeros(1), np.zeros(1))
    good, bad = compressors(model)
    rest = ~first if (~first).any() else first
    x = np.array([difference(r, good, bad) for r, f in zip(raw, rest, strict=True) if f])
    # The labels were sampled apart: weigh each back to its share of all labelled rows.
    drawn = np.bincount(y[rest], minlength=2)
    weight = np.array([counts[v] / drawn[v] for v in (0, 1)])
    weight *= len(x) / (counts[0] + counts[1])
    return Model(model.good, model.bad, *calibrate(x, y[rest], weight[y[rest]]))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append size_difference and score (probability of label 1); input columns with these names are replaced."""
    df = df.drop("size_difference", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("size_difference", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model) if model.good or model.bad else None
        for batch in batches:
            x = np.array([difference(t.encode("utf-8", "surrogatepass"), *pair) if pair and (t := v.as_py()) else 0.0 for v in batch.column(text)], np.float64)
            p = np.interp(x, model.at, model.p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x), pa.array(p)], names=[*batch.schema.names, "size_difference", "score"])

    return df.mapInArrow(run, schema)
