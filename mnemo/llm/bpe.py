"""Byte-level BPE over whole texts.

Short texts are pre-tokenised and encoded row by row. A text longer than ``chunk_chars`` is dealt out
as overlapping chunks that tasks pre-tokenise in parallel; neighbouring chunks are stitched at the
first boundary that both of them found inside the overlap. The pre-token pattern only looks ahead, so
from a shared boundary on both chunks agree. A chunk whose overlap shows no shared boundary (one giant
pre-token) makes its text fall back to a single sequential pass, which is exact too.

Nulls count as empty texts and give an empty list; an empty table gives an empty one; repeated rows are
kept; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import materialize, small_batches, spare
from ._text import list_array

CACHE_PIECES = 1 << 15


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Pieces of one vocabulary; a bounded cache keeps frequent pieces."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.ranks = load_ranks(path)
        self._merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self._cache: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self._cache.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            one = self.ranks.get(raw)
            ids = [one] if one is not None else self._merge(raw)
            if len(text) <= 64:
                if len(self._cache) >= CACHE_PIECES:
                    self._cache.clear()
                self._cache[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, piece = self._cache.get, self.piece
        for p in self.pattern.findall(text):
            out += get(p) or piece(p)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Start of every pre-token, and the end of the text."""
    return [m.start() for m in pattern.finditer(text)] + [len(text)]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", chunk_chars: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """Append ``out`` (array<int>): the token ids of ``text`` under the rank file at ``path``.

    ``path`` must be readable on every executor (it belongs to an installed package). An input column
    named ``out`` is replaced.
    """
    df = df.drop(out)
    small_batches(df.sparkSession)
    is_long = F.coalesce(F.length(text), F.lit(0)) > chunk_chars
    fields, names = list(df.schema.fields), df.columns
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [enc.encode(t) if t else [] for t in part.column(text).to_pylist()]
                flat = np.fromiter((x for y in ids for x in y), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(flat, np.fromiter(map(len, ids), np.int64, len(ids)))], names=[*part.schema.names, out])

    direct = df.filter(~is_long).mapInArrow(short, schema)

    # Long texts: (row, chunk number, text of the chunk and the overlap behind it). They are written with
    # their numbers first: both sides of the join below must see the same ones, whatever is computed again.
    key, n = spare(df, "__row", "__chunk")
    long_rows = materialize(df.filter(is_long).withColumn(key, F.monotonically_increasing_id()))
    parts = (
        long_rows.select(key, F.col(text).alias("__text"), F.explode(F.sequence(F.lit(0), (F.length(text) - 1).cast("int"), F.lit(chunk_chars))).alias(n))
        .select(key, n, F.substring("__text", F.col(n) + 1, F.lit(chunk_chars + overlap)).alias("__part"))
        .repartition(key, n)
    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for row, start, part in zip(*(batch.column(c).to_pylist() for c in (key, n, "__part")), strict=True):
                cuts = boundaries(enc.pattern, part)
                ids = [enc.piece(part[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([start], pa.int32()), pa.array([[start + c for c in cuts]], pa.list_(pa.int32())), pa.array([[len(x) for x in ids]], pa.list_(pa.int32())), pa.array([[x for y in ids for x in y]], pa.list_(pa.int32()))],
                    names=[key, n, "cuts", "sizes", "ids"],
                )

    done = parts.mapInArrow(pretokenise, f"{key} long, {n} int, cuts array<int>, sizes array<int>, ids array<int>")
    pieces = spare(long_rows, "__parts")[0]
    stitched = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(n, "cuts", "sizes", "ids"))).alias(pieces))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                chunks = row.column(pieces).to_pylist()[0]
                ids = join_chunks([(c["cuts"], c["sizes"], c["ids"]) for c in chunks])
                if ids is None:
                    ids = enc.encode(row.column(text)[0].as_py())
                keep = [row.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([ids], pa.list_(pa.int32()))], names=[*names, out])

    whole = long_rows.join(stitched, key).mapInArrow(stitch, schema)
    return direct.unionByName(whole)


def join_chunks(chunks: list[tuple[list[int], list[int], list[int]]]) -> list[int] | None:
    """Ids of a text from its chunks (boundaries in the text, ids per piece, ids), or None if two never meet.

    The last two boundaries of a chunk that is followed by another may be an effect of where it was
    cut, so they don't count; nor does its final piece.
    """
    out: list[int] = []
    begin = 0
    for i, (cuts, sizes, ids) in enumerate(chunks):
        if i + 1 == len(chunks):
            end = cuts[-1]
        else:
            following = chunks[i + 1][0]
            end = min(set(cuts[:-2]) & set(following[:-2] if i + 2 < len(chunks) else following), default=-1)
            if end < 0:
                return None
        if end < begin:
            return None
        at = np.concatenate(([0], np.cumsum(sizes))).tolist()
        where = {c: k for k, c in enumerate(cuts)}
        if begin not in where:
            return None
        out += ids[at[where[begin]] : at[where[end]]]
        begin = end
    return out


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out`` (binary, replacing one of that name): the raw bytes of the tokens, one after another; null for null."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            table[i] = raw
        size = np.fromiter(map(len, table), np.int64)
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        pool = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for x in part.column(ids):
                    if not x.is_valid:
                        made.append(None)
                        continue
                    t = x.values.to_numpy(zero_copy_only=False)
                    n = size[t]
                    ends = np.cumsum(n)
                    total = int(ends[-1]) if len(t) else 0
                    made.append(pool[np.repeat(start[t] - ends + n, n) + np.arange(total)].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def ids_text(ids: str) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
