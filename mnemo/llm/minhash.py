"""Near-duplicate classes by b-bit MinHash, confirmed on whole shingle sets.

1. Each text gives its set of word shingles (64-bit hashes), ``BANDS`` x ``ROWS`` minima, the band keys
   and a packed sketch of the low ``BITS`` bits of every minimum. Texts with equal sets fall into one
   class by a grouped minimum, so exact copies never meet as pairs.
2. Classes that share a band key form stars around the least class of that key, not all pairs: each
   class first meets only the least of its centres. The collision-corrected estimate from the sketches
   drops hopeless pairs, whole sets confirm the rest, and the links give components.
3. Band keys that still hold several components are worked on: members of other components meet the
   key's centre, and what then is still apart meets across components only. So no link between
   components that share any band key is lost, while members of one component are never paired again.

A pair at similarity 0.75 shares one of 32 bands of 4 rows with probability 1 - 5e-6; the sketch test
keeps pairs down to an estimate of 0.55, five standard deviations below the threshold; the wide one
(2,048 one-bit minima, read only where components are still apart) down to 0.684, four and a half.

Texts without words (null, empty, blank) have an empty set and link with nothing. Null or repeated ids
are kept; a class's id is the least non-null id in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._io import discard, materialize
from .graph import components

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
SLOTS = 64 // BITS
WORDS = HASHES // SLOTS
SKETCH_FLOOR = 0.55
WIDE = 2048
WIDE_FLOOR = 0.684

_seeds = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64)
_wide = np.random.Generator(np.random.PCG64(20240207)).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL, _ADD = _seeds[0] * np.uint64(2) + np.uint64(1), _seeds[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words."""
    data = tx.LOWER[data]
    starts, ends, _ = tx.word_spans(data, offsets, tx.SPACE_WORDS)
    hashes = tx.word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, offsets)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.unique(tx.gram_hashes(hashes[lo:hi], min(size, hi - lo))) if hi > lo else np.zeros(0, np.uint64)


def digest(grams: np.ndarray) -> int:
    """A 64-bit digest of a set, whatever its order."""
    return int(tx.mix(np.array([tx.mix(grams ^ tx.BASE).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def minima(grams: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(out, (grams[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = tx.mix(key * tx.WORD_BASE + low[i::ROWS])
    return key


def sketch(low: np.ndarray) -> np.ndarray:
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(WORDS, SLOTS) << (np.arange(SLOTS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, axis=1)


def wide_sketch(grams: np.ndarray) -> np.ndarray:
    """One bit of each of WIDE further minima, packed."""
    low = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
    mixed = tx.mix(grams ^ tx.WORD_BASE)
    for at in range(0, len(grams), 64):
        np.minimum(low, (mixed[at : at + 64, None] * _wide).min(axis=0), out=low)
    # The lowest bit of an odd multiple is that of the hash: take one from the mixed minimum instead.
    return np.packbits((tx.mix(low) & np.uint64(1)).astype(np.uint8)).view(np.uint64)


def signatures(df: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """(id, text_hash, n, node, bands, sketch) of every row; node is the 64-bit digest of the set (null if empty)."""
    kind = df.schema[key].dataType.simpleString()
    out = f"id {kind}, text_hash bigint, n bigint, node bigint, bands array<bigint>, sketch array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "__text"):
                sets = list(shingle_sets(*tx.column_bytes(part.column("__text")), size))
                n = np.array([len(s) for s in sets], np.int64)
                node = [digest(s) if len(s) else None for s in sets]
                lows = [minima(s) for s in sets]
                some = (n > 0).astype(np.int64)
                cat = lambda xs, t=np.uint64: (np.concatenate(xs) if xs else np.zeros(0, t)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n),
                        pa.array(node, pa.int64()),
                        tx.list_array(cat([band_keys(x) for x, k in zip(lows, n, strict=True) if k]), some * BANDS),
                        tx.list_array(cat([sketch(x) for x, k in zip(lows, n, strict=True) if k]), some * WORDS),
                    ],
                    names=["id", "text_hash", "n", "node", "bands", "sketch"],
                )

    return df.select(key, F.col(text).alias("__text"), F.xxhash64(text)).mapInArrow(run, out)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Collision-corrected similarity of two packed sketches."""
    low = sum(1 << (BITS * i) for i in range(SLOTS))
    low -= (1 << 64) if low >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(d, i) for i in range(1, BITS)], d)
        return F.bit_count(folded.bitwiseAND(F.lit(low)))

    same = (HASHES - reduce(lambda p, q: p + q, map(differing, a, b))) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def _sketch_columns(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("node").alias(side), *[F.col("sketch")[i].alias(f"{side}{i}") for i in range(WORDS)])


def _near(a: str, b: str) -> Column:
    return estimate([F.col(f"{a}{i}") for i in range(WORDS)], [F.col(f"{b}{i}") for i in range(WORDS)]) >= SKETCH_FLOOR


def whole_sets(df: DataFrame, key: str, text: str, size: int, need: DataFrame, wide: bool = False) -> DataFrame:
    """(node, grams, wide) of the classes in ``need`` (node, least), read again from one text of each.

    ``need`` is a written table, so its size is known when the join is planned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text):
                sets = [s for s in shingle_sets(*tx.column_bytes(part.column(text)), size) if len(s)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), tx.list_array(flat.view(np.int64), np.array([len(s) for s in sets], np.int64)), tx.list_array(np.concatenate([wide_sketch(s) for s in sets]).view(np.int64) if sets and wide else np.zeros(0, np.int64), np.full(len(sets), WIDE // 64 if wide else 0))], names=["node", "grams", "wide"])

    rows = df.select(F.col(text).alias(text), F.xxhash64(key).alias("__at")).join(need.select(F.xxhash64("least").alias("__at")), "__at", "left_semi")
    made = rows.select(text).mapInArrow(run, "node bigint, grams array<bigint>, wide array<bigint>")
    return made.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _sets_of(nodes: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str, size: int, wide: bool = False) -> DataFrame:
    need = materialize(classes.select("node", "least").join(nodes.distinct(), "node"))
    out = materialize(whole_sets(df, key, text, size, need, wide))
    discard(need)
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    two = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    # The array of b travels with the pair; that of a, which may be the centre of a large star, does not.
    both = pairs.join(one, "b").join(two, "a").withColumn("i", F.size(F.array_intersect("ga", "gb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("ga") + F.size("gb") - F.col("i"))).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, text_hash, n, node, component) of every row: set size, class of equal sets, least id reachable over links.

    Links join sets with 100 * intersection >= percent * union. ``percent`` below 75 would need more bands.
    """
    if percent < 75:
        raise ValueError("bands are laid out for similarities of 0.75 and more")
    sig = materialize(signatures(df, key, text, size))
    classes = materialize(sig.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    members = classes.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("band", "centre")
    members = materialize(members.join(shared, "band"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the sketches and then the whole sets."""
        near = pairs.join(_sketch_columns(classes, "b"), "b").join(_sketch_columns(classes, "a"), "a").filter(_near("a", "b")).select("a", "b")
        near = materialize(near)
        sets = _sets_of(near.select(F.col("a").alias("node")).union(near.select("b")), classes, df, key, text, size)
        out = materialize(_confirm(near, sets, percent))
        discard(near, sets)
        return out

    # First each class meets one other only: the least centre of all its band keys.
    first = members.filter("node <> centre").groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b"))
    links = confirmed(first)
    found = components(links)
    discard(links)

    def still_open() -> DataFrame:
        """(band, node, comp) of the band keys that hold several components."""
        labelled = members.select("band", "node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        keys = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
        return materialize(labelled.join(keys, "band", "left_semi"))

    def grown(more: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))

    # Then the members of other components meet the centre of each such key.
    rest = still_open()
    centres = rest.groupBy("band").agg(F.min(F.struct("node", "comp")).alias("c")).select("band", F.col("c.node").alias("a"), F.col("c.comp").alias("ca"))
    more = confirmed(rest.join(centres, "band").filter("comp <> ca").select("a", F.col("node").alias("b")).distinct())
    if not more.isEmpty():
        old, found = (found, rest), grown(more)
        rest = still_open()
        discard(*old)
    discard(more)

    # Last, what is still apart meets across components only, by the small and then a wide sketch, once
    # for all band keys that a pair shares.
    sets = _sets_of(rest.select("node"), classes, df, key, text, size, wide=True)
    about = classes.select("node", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS)]).join(sets.select("node", "wide"), "node")
    old, rest = rest, materialize(rest.join(about, "node"))
    discard(old)
    left = rest.select("band", *[F.col(c).alias(f"l_{c}") for c in rest.columns if c != "band"])
    right = rest.select("band", *[F.col(c).alias(f"r_{c}") for c in rest.columns if c != "band"])
    small = estimate([F.col(f"l_s{i}") for i in range(WORDS)], [F.col(f"r_s{i}") for i in range(WORDS)]) >= SKETCH_FLOOR
    apart = F.aggregate(F.zip_with("l_wide", "r_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    first_shared = F.get(F.filter(F.zip_with("l_bands", "r_bands", lambda x, y: F.when(x == y, x)), lambda z: z.isNotNull()), F.lit(0))
    meets = (left["band"] == right["band"]) & (F.col("l_comp") < F.col("r_comp")) & small & (apart <= int(WIDE * (1 - WIDE_FLOOR) / 2)) & (first_shared == left["band"])
    across = materialize(left.join(right, meets).select(F.col("l_node").alias("a"), F.col("r_node").alias("b")))
    if not across.isEmpty():
        more = materialize(_confirm(across, sets, percent))
        if not more.isEmpty():
            old, found = found, grown(more)
            discard(old)
        discard(more)
    discard(across, sets, rest, members)

    named = classes.select("node", "least").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named)
    ids = named.groupBy("comp").agg(F.min("least").alias("component"))
    ids = named.join(ids, "comp").select("node", "component")
    out = sig.select("id", "text_hash", "n", "node").join(ids, "node", "left").select("id", "text_hash", "n", "node", F.coalesce("component", "id").alias("component"))
    out = materialize(out)
    discard(sig, classes, found, named)
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``df`` that are the least of their component, once each; rows with a null id stay."""
    found = near_duplicates(df, key, text, size, percent)
    gone = materialize(found.filter("id <> component").select(F.col("id").alias(key), F.col("text_hash").alias("__hash")).distinct())
    kept = df.withColumn("__hash", F.xxhash64(text)).join(gone, [key, "__hash"], "left_anti")
    again = found.filter("id = component AND n > 0").groupBy("id", "text_hash").agg(F.count("*").alias("c")).filter("c > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates([key, "__hash"])
    discard(found)
    return kept.select(*df.columns)
