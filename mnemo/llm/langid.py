"""Language identification by rank-order n-gram profiles.

A profile lists the ``profile`` most frequent character n-grams (1 to 3 letters, case folded, every run
of other characters one blank) of a language in order. A text's own list is compared to each profile:
an n-gram costs the difference of its two ranks, or ``profile`` if the language lacks it. The least
total wins (ties: the lesser name).

Profiles are learned from at most about ``per_language`` rows of each language, chosen by a hash of the
id; that bound is a parameter. Prediction reads whole texts. A null text or one without a letter is
``und`` with score 0; without any training rows every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import discard, materialize, small_batches

MAX_N = 3
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def folded(text: str) -> np.ndarray:
    """Code points of the case-folded text; each run of non-letters is one 0, at both ends too."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, 0)[keep]
    return np.concatenate(([0] if is_letter[0] else [0], out, [0] if out[-1] else [])).astype(np.uint32)


def grams(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the distinct n-grams of up to MAX_N symbols below ``base``; no blank stands inside."""
    c = codes.astype(np.int64)
    parts = [c[c > 0]]
    value = c
    for n in range(2, MAX_N + 1):
        value = value[:-1] * base + c[n - 1 :]
        inner = np.ones(len(value), bool)
        for i in range(1, n - 1):
            inner &= c[i : len(c) - n + 1 + i] > 0
        if n == 2:
            inner &= (c[:-1] > 0) | (c[1:] > 0)
        parts.append(value[inner] + n * base**MAX_N)
    return np.unique(np.concatenate(parts), return_counts=True)


def spelt(code: int, base: int, alphabet: str) -> str:
    n, code = divmod(code, base**MAX_N)
    n = n or 1
    out = ""
    for _ in range(n):
        code, r = divmod(code, base)
        out = alphabet[r] + out
    return out


def train(rows: DataFrame, lang: str, text: str, order: Column, per_language: int = 2000, profile: int = 400) -> list[tuple[str, list[str]]]:
    """[(language, n-grams in order)] from rows with a non-null language."""
    sample = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text, F.pmod(order, F.lit(1 << 20)).alias("__at"))
    # Written first, so that Spark knows it to be small and texts are not dealt out by their few languages.
    sizes = materialize(sample.groupBy(lang).agg(F.count("*").alias("__n")))
    sample = sample.join(sizes, lang).filter(F.col("__at") * F.col("__n") < F.lit(per_language * (1 << 20)).cast("bigint")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = folded(t)
                if not len(codes):
                    continue
                alphabet, small = np.unique(np.concatenate(([0], codes)), return_inverse=True)
                chars = " " + "".join(map(chr, alphabet[1:]))
                at, n = grams(small[1:], len(alphabet))
                seen = found.setdefault(name, Counter())
                for c, k in zip(at.tolist(), n.tolist(), strict=True):
                    seen[spelt(c, len(alphabet), chars)] += k
            out = [(name, g, k) for name, seen in found.items() for g, k in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["lang", "gram", "n"])

    total = sample.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", rank).filter(F.col("rank") <= profile)  # languages x profile rows
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("list")).orderBy("lang").collect()
    discard(sizes)
    return [(r["lang"], [x["gram"] for x in r["list"]]) for r in lists]


class Profiles:
    """Profiles laid out for array look-ups."""

    def __init__(self, lists: list[tuple[str, list[str]]], profile: int):
        self.names = [name for name, _ in lists]
        self.profile = profile
        chars = sorted({c for _, x in lists for g in x for c in g} - {" "})
        self.base = len(chars) + 2  # 0: blank, 1: any other letter
        self.symbol = np.ones(0x110000, np.int64)
        self.symbol[0] = 0
        for i, c in enumerate(chars):
            self.symbol[ord(c)] = i + 2
        code = {}
        for _, x in lists:
            for g in x:
                s = [0 if c == " " else int(self.symbol[ord(c)]) for c in g]
                v = 0
                for y in s:
                    v = v * self.base + y
                code[g] = v + (len(s) * self.base**MAX_N if len(s) > 1 else 0)
        self.codes = np.array(sorted(code.values()), np.int64)
        self.ranks = np.full((len(lists), len(self.codes) + 1), -1, np.int64)
        for i, (_, x) in enumerate(lists):
            for r, g in enumerate(x):
                self.ranks[i, np.searchsorted(self.codes, code[g])] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = folded(text) if text else np.zeros(0, np.uint32)
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        at, n = grams(self.symbol[codes], self.base)
        own = at[np.lexsort((at, -n))[: self.profile]]
        where = np.searchsorted(self.codes, own)
        where[where < len(self.codes)] = np.where(self.codes[where[where < len(self.codes)]] == own[where < len(self.codes)], where[where < len(self.codes)], len(self.codes))
        ranks = self.ranks[:, where]
        cost = np.where(ranks < 0, self.profile, np.minimum(np.abs(ranks - np.arange(len(own))), self.profile)).sum(axis=1)
        best = int(cost.argmin())
        return self.names[best], float(1 - cost[best] / (self.profile * len(own)))


def predict(df: DataFrame, lists: list[tuple[str, list[str]]], text: str = "text", profile: int = 400, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Append lang_pred and score (1: the text's list is the profile, 0: nothing in common).

    Input columns with these names are replaced.
    """
    df = df.drop(*out)
    small_batches(df.sparkSession)
    names = [*df.columns, *out]
    schema = T.StructType([*df.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(lists, profile)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [model.predict(t.as_py()) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=names)

    return df.mapInArrow(run, schema)


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id (in no fold, and never trained on)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
