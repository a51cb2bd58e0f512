"""Benchmark decontamination by winnowing.

Both sides keep, for every run of ``window`` words, the least hash among its k-grams; two equal runs
keep the same fingerprint, so every shared span of ``window`` words meets in the join. Fingerprints of
the benchmark also set bits of a map (eight bits a window, 32 MB at most) by which tasks drop almost all
other runs before anything is shuffled. What is left joins on the fingerprint and
is confirmed on the words themselves, then extended to the words each occurrence covers.

An item with fewer words than ``window`` is one window of its own length, found by hashing every run of
that length. Nulls and texts without words hit nothing; items without words never occur; repeated rows
and ids are kept (an id counts once in the item lists).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._io import materialize

LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28
PIECE = 4096  # bytes of a bitmap that Spark's bitmap functions build


def _runs(batch: pa.RecordBatch, text: str):
    data, offsets = tx.column_bytes(batch.column(text))
    data = tx.LOWER[data]
    starts, ends, row = tx.word_spans(data, offsets, tx.ALNUM_WORDS)
    return data, starts, ends, row, tx.word_hashes(data, starts, ends)


def _window_prints(hashes: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, least k-gram hash) of every run of ``window`` words within a row."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = tx.gram_hashes(hashes, k)
    least = grams[:n].copy()
    for i in range(1, window - k + 1):
        np.minimum(least, grams[i : n + i], out=least)
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    return inside, least[inside]


def _short_prints(hashes: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    return inside, tx.gram_hashes(hashes, length)[inside]


def _spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, length: int) -> str:
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(first, first + length)).decode("utf-8", "replace")


def windows(items: DataFrame, key: str, text: str, window: int = 10, k: int = 5) -> DataFrame:
    """(item, print, size, words) of every window of every item."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text, 1 << 18):
                data, starts, ends, row, hashes = _runs(part, text)
                count = np.bincount(row, minlength=part.num_rows)
                first, prints = _window_prints(hashes, row, window, k)
                size = np.full(len(first), window)
                for length in range(1, window):
                    at, found = _short_prints(hashes, row, length)
                    whole = count[row[at]] == length
                    first, prints, size = np.concatenate((first, at[whole])), np.concatenate((prints, found[whole])), np.concatenate((size, np.full(int(whole.sum()), length)))
                words = [_spell(data, starts, ends, int(f), int(n)) for f, n in zip(first, size, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row[first])), pa.array(prints.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(words, pa.string())], names=["item", "print", "size", "words"])

    return items.select(key, text).mapInArrow(run, f"item {kind}, print bigint, size int, words string")


def print_slots(wanted: DataFrame, least: int = LEAST_SLOTS, most: int = MOST_SLOTS) -> np.ndarray:
    """Bits (least first in a byte) of the slots that the prints of ``wanted`` fill.

    There are eight slots a window or more, ``most`` (a power of two) at most; executors fill them in pieces of
    4 KB. With more windows than that the map lets more prints through to the join, which decides.
    """
    slots = min(most, max(least, 1 << (8 * wanted.count()).bit_length()))
    place = F.pmod("print", F.lit(slots)) + 1
    pieces = wanted.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for at, bits in pieces.collect():  # most / 32,768 rows at most
        out[(at - 1) * PIECE : at * PIECE] = np.frombuffer(bits, np.uint8)
    return out


def occurrences(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has (row, id, n_words) of every document row; hits has (row, start, size, item), one for each window found."""
    spark = docs.sparkSession
    wanted = materialize(windows(items, item_key, text, window, k).distinct())
    lengths = sorted(r[0] for r in wanted.filter(F.col("size") < window).select("size").distinct().collect())  # below ``window`` values
    filled = print_slots(wanted)
    shared = spark.sparkContext.broadcast(filled)
    kind = docs.schema[doc_key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        last = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            for part in tx.pieces(batch, text):
                data, starts, ends, row, hashes = _runs(part, text)
                found = [(*_window_prints(hashes, row, window, k), window)] + [(*_short_prints(hashes, row, n), n) for n in lengths]
                firsts, prints, sizes = [], [], []
                for first, value, n in found:
                    slot = (value & last).astype(np.int64)
                    may = ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                    firsts.append(first[may])
                    prints.append(value[may])
                    sizes.append(np.full(int(may.sum()), n, np.int32))
                first, value, size = map(np.concatenate, (firsts, prints, sizes))
                order = np.argsort(row[first], kind="stable")
                first, value, size = first[order], value[order], size[order]
                base = np.searchsorted(row, np.arange(part.num_rows))
                spelt = pa.StructArray.from_arrays(
                    [pa.array((first - base[row[first]]).astype(np.int64)), pa.array(size), pa.array(value.view(np.int64)), pa.array([_spell(data, starts, ends, int(f), int(n)) for f, n in zip(first, size, strict=True)], pa.string())],
                    names=["start", "size", "print", "words"],
                )
                cuts = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=part.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), part.column(doc_key), pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), spelt)],
                    names=["row", "id", "n_words", "maybe"],
                )

    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("__row"), doc_key, text).mapInArrow(run, f"row bigint, id {kind}, n_words bigint, maybe array<struct<start:bigint,size:int,print:bigint,words:string>>")
    )
    maybe = rows.filter(F.size("maybe") > 0).select("row", F.inline("maybe"))
    hits = maybe.join(wanted, ["print", "size", "words"]).select("row", "start", "size", "item")
    return rows.select("row", "id", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """(id, n_words, n_hit, items) of every document row; items: sorted ids, as strings, of items that occur."""
    rows, hits = occurrences(docs, items, doc_key, item_key, text, window, k)
    hits = materialize(hits)
    covered = hits.select("row", "start", "size").distinct().select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.join(covered, "row", "left").join(named, "row", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
