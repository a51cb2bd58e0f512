"""Repeated substrings across and within documents, by a run-length Burrows-Wheeler index.

A byte is marked if a string of ``length`` bytes that covers it also starts anywhere else. Texts are
UTF-8 bytes; matches never cross documents.

1. Every window of ``length`` bytes names its anchor: the leftmost least hash among its ``KMER``-byte
   substrings. Equal windows have equal anchors at equal places. A task emits each anchor once, with the
   context it serves (the union of its windows) and a hash of that context.
2. Anchors that occur once can't hold a repeat and are dropped by a grouped count. Contexts that occur
   more than once are marked as a whole.
3. Anchors with several different contexts go, one copy of each context, to blocks of bounded size. A
   block's contexts are indexed by a run-compressed Burrows-Wheeler transform with the text positions at
   both ends of each run. The matches of these sampled positions with their neighbours are the only ones
   measured; matching statistics of all other positions follow by streaming through the text, where each
   loses one per step. Places with statistics of ``length`` or more start a repeated string.
4. An anchor with more than ``max_variants`` contexts (a very common line, say) would not fit a block. Its
   contexts are halved by the place of the anchor in the window; the windows of a half have more bytes in
   common than the anchor, and a hash of these is the half's new anchor. This goes on until no anchor
   has too many contexts (a half of one place holds equal windows only), and the index does the rest.

Null texts count as empty. Equal texts, whatever their ids, are handled as one text that occurs several
times. Hashes have 64 bits (texts: 96). Input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._io import discard, materialize, small_batches, spare

KMER = 32
PACK = 7
SEGMENT = 1 << 18
POSITION = np.uint64((1 << 22) - 1)
INVERSE = np.uint64(pow(int(tx.BASE), -1, 1 << 64))


class Rolling:
    """Hashes of arbitrary ranges of a byte array of at most a few MB."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tx.powers(tx.BASE, n + 1)[:n], out=self.sums[1:])
        self.back = tx.powers(INVERSE, n + 1)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tx.mix((self.sums[b] - self.sums[a]) * self.back[a])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return tx.mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, context hash, start, size, place in the context) of the anchors of all windows; ``ends[i]``: where the text at byte i ends."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    roll = Rolling(data)
    hashes = roll.all(KMER)
    least = sliding_min((hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64), length - KMER + 1)
    valid = np.arange(length, n + length) <= ends[:n]
    at = (least & POSITION).astype(np.int64)
    first = np.flatnonzero(valid & np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((at[1:] != at[:-1]) | ~valid[1:], [True])))
    p, size = at[first], last - first + length
    key = hashes[p]
    return key, tx.mix(roll.ranges(first, first + size) ^ tx.mix((p - first).astype(np.uint64) * tx.WORD_BASE + size.astype(np.uint64))), first, size, p - first


def emit_anchors(df: DataFrame, keys: list[str], text: str, length: int) -> DataFrame:
    """(keys..., key, ctx, a, size, p) of every anchor of every text."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text, SEGMENT):
                data, offsets = tx.column_bytes(part.column(text))
                # Long texts (one row to a piece) go segment by segment; segments share length - 1 bytes.
                for lo in range(0, max(1, len(data) - length + 1), SEGMENT * 2):
                    cut = data[lo : lo + SEGMENT * 2 + length - 1]
                    ends = np.repeat(offsets[1:] - lo, np.diff(np.clip(offsets - lo, 0, len(cut))))
                    key, ctx, a, size, p = anchors(cut, ends, length)
                    row = np.searchsorted(offsets, a + lo, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(pa.array(row)) for k in keys), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(a + lo - offsets[row]), pa.array(size.astype(np.int32)), pa.array(p.astype(np.int32))],
                        names=[*keys, "key", "ctx", "a", "size", "p"],
                    )

    return df.select(*keys, text).mapInArrow(run, f"{kinds}, key bigint, ctx bigint, a bigint, size int, p int")


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some byte strings, with text positions at run ends.

    While it is built some 50 bytes are held for each byte of the strings.
    """

    def __init__(self, strings: list[bytes]):
        n_strings = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, n_strings)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if n_strings else np.zeros(0, np.int64)
        self.sizes = sizes
        self.n = n = int((sizes + 1).sum())
        # Bytes are 1 to 256, every terminator is 0 but differs from the others by its string.
        text = np.zeros(n + PACK, np.int16)
        body = np.ones(n, bool)
        body[self.starts + sizes] = False
        text[:n][body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + np.int16(1)
        del body
        left = np.repeat((self.starts + sizes).astype(np.int32), sizes + 1) - np.arange(n, dtype=np.int32)  # to the string's terminator
        # The first PACK symbols as one integer; what holds a terminator is told apart by its string.
        self.packed = packed = np.zeros(n, np.int64)
        for i in range(PACK):
            packed <<= 9
            packed |= np.where(left >= i, text[i : n + i], np.int16(0))
        string = np.where(left < PACK, np.repeat(np.arange(1, n_strings + 1, dtype=np.int32), sizes + 1), np.int32(0))
        del left
        order = np.argsort(packed, kind="stable")  # equal packs that end stay in the order of their strings
        new = np.ones(n, bool)
        new[1:] = packed[order[1:]] != packed[order[:-1]]
        new[1:] |= string[order[1:]] != string[order[:-1]]
        del string
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        # Prefix doubling: ranks order prefixes of PACK * 2**d symbols.
        step = PACK
        while n and step < int(sizes.max(initial=0)) + 1 and rank.max() < n - 1:
            key = rank.astype(np.int64) * (n + 1)
            if step < n:
                key[: n - step] += rank[step:]
                key[: n - step] += 1
            order = np.argsort(key)
            new[1:] = key[order[1:]] != key[order[:-1]]
            del key
            rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            step *= 2
        del new
        order = np.empty(n, np.int32)
        order[rank] = np.arange(n, dtype=np.int32)
        del rank
        before = text[:n][order - 1].astype(np.int32) if n else np.zeros(0, np.int32)
        ends = before == 0
        before[ends] = -np.flatnonzero(ends)  # terminators differ, so each is a run
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))) if n else np.zeros(0, np.int64)
        self.run_symbols = before[heads]
        self.run_lengths = np.diff(np.concatenate((heads, [n])))
        #: Text positions at the first and last row of each run, and those of the rows beyond.
        tails = heads + self.run_lengths - 1
        self.first, self.last = order[heads], order[tails]
        self.above = order[np.maximum(heads - 1, 0)]
        self.below = order[np.minimum(tails + 1, n - 1)] if n else order

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j (terminators differ, so strings bound it)."""
        out = np.zeros(len(i), np.int32)
        live = np.flatnonzero(i != j)
        while len(live):
            a, b = i[live] + out[live], j[live] + out[live]
            inside = (a < self.n) & (b < self.n)
            live, x, y = live[inside], self.packed[a[inside]], self.packed[b[inside]]
            full = (x == y) & (x & 511 > 0)
            part, x, y = live[~full], x[~full], y[~full]
            same = np.ones(len(part), bool)
            for k in range(PACK - 1, -1, -1):
                u = x >> 9 * k & 511
                same &= (u == y >> 9 * k & 511) & (u > 0)
                out[part] += same
            live = live[full]
            out[live] += PACK
        return out

    def statistics(self) -> np.ndarray:
        """For every text position the longest match with another position, streamed from the sampled ones."""
        reach = np.zeros(self.n, np.int32)
        for at, other in ((self.first, self.above), (self.last, self.below)):
            reach[at] = np.maximum(reach[at], self.common(at, other) + at)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n, dtype=np.int32), 0)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the offsets at which a string of ``length`` bytes starts that occurs elsewhere."""
    index = RunLengthIndex(contexts)
    long = index.statistics() >= length
    return [np.flatnonzero(long[s : s + max(0, z - length + 1)]) for s, z in zip(index.starts, index.sizes, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist(), strict=True))


CONTEXT = "key bigint, ctx bigint, c bigint, t1 bigint, t2 int, a bigint, p int, lo int, hi int, bytes binary"


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in CONTEXT.split(", ")])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def halves(row: tuple, length: int) -> Iterator[tuple]:
    """The windows of a context in two contexts of new anchors: those whose anchor stands far in, and the others."""
    key, _, c, t1, t2, a, p, lo, hi, raw = row
    middle = (lo + hi + 1) // 2
    for low, high in ((lo, middle - 1), (middle, hi)):
        x, y = max(0, p - high), min(len(raw) - length, p - low)  # first and last window whose anchor stands low to high in
        if low <= high and x <= y:
            core, part = raw[p - low : p - high + length], raw[x : y + length]
            named = xxhash.xxh3_64_intdigest(core, seed=(key ^ low * 1_000_003) & 0xFFFFFFFF)
            yield _signed(named), _signed(xxhash.xxh3_64_intdigest(part, seed=p - x)), c, t1, t2, a + x, p - x, low, high, part


def _split_hot(contexts: DataFrame, max_variants: int, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(contexts of anchors with ``max_variants`` contexts at most, spans (t1, t2, a, e) found whole on the way)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(*(part.column(x.split()[0]).to_pylist() for x in CONTEXT.split(", ")), strict=True)
                yield _contexts([h for row in rows for h in halves(row, length)])

    names = [x.split()[0] for x in CONTEXT.split(", ")]
    settled, spans = [contexts.filter(F.col("v") <= max_variants).select(*names)], []
    hot = materialize(contexts.filter(F.col("v") > max_variants).select(*names))
    while not hot.isEmpty():
        parts = materialize(hot.mapInArrow(split, CONTEXT))
        groups = materialize(parts.groupBy("key", "ctx").agg(F.sum("c").alias("c"), F.any_value(F.struct("t1", "t2", "a", "p", "lo", "hi", "bytes")).alias("x")))
        again = groups.filter("c > 1").select("key", "ctx")
        spans.append(materialize(parts.filter("c = 1").join(again, ["key", "ctx"], "left_semi").select("t1", "t2", "a", (F.col("a") + F.octet_length("bytes")).alias("e"))))
        variants = materialize(groups.groupBy("key").agg(F.count("*").alias("v"), F.min("c").alias("least")).filter("v > 1 AND least = 1").select("key", "v"))
        kept = groups.join(variants, "key").select("key", "ctx", "c", "x.*", "v")
        settled.append(materialize(kept.filter(F.col("v") <= max_variants).select(*names)))
        old, hot = (hot, parts), materialize(kept.filter(F.col("v") > max_variants).select(*names))
        discard(*old, groups, variants)
    discard(hot)
    return settled, spans


def repeated_spans(df: DataFrame, text: str = "text", length: int = 200, max_variants: int = 2048, block_bytes: int = 1 << 18) -> DataFrame:
    """(t1, t2, spans) of every distinct text that holds repeats; spans: array of (a, e), unmerged; t1, t2: text hashes."""
    rows = df.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.col(text).alias("text"))
    found = materialize(emit_anchors(rows, ["t1", "t2"], "text", length))
    # Written first: a join with a plain table on both sides can be broadcast by size, and its hot keys split.
    often = materialize(found.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    first, found = found, materialize(found.join(often, "key"))
    discard(first, often)
    groups = materialize(found.groupBy("key", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "a", "size", "p")).alias("at")))
    whole = found.join(groups.filter("c > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("t1", "t2", "a", (F.col("a") + F.col("size")).alias("e")).distinct()

    variants = groups.groupBy("key").agg(F.count("*").alias("v"), F.min("c").alias("least")).filter("v > 1 AND least = 1").select("key", "v")
    wanted = materialize(groups.join(variants, "key").select("key", "ctx", "c", "v", "at.*"))
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "ctx", "c", "v", "a", "size", "p")).alias("list"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, offsets = tx.column_bytes(part.column("text"))
                items = part.column("list")
                row = np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy())
                x = items.flatten()
                a, size = x.field("a").to_numpy(), x.field("size").to_numpy().astype(np.int64)
                begin, full = offsets[row] + a, np.concatenate(([0], np.cumsum(size)))
                at = 0
                while at < len(row):
                    to = max(at + 1, int(np.searchsorted(full, full[at] + SEGMENT, "right")) - 1)
                    ends = full[at : to + 1] - full[at]
                    chosen = data[np.repeat(begin[at:to] - ends[:-1], size[at:to]) + np.arange(ends[-1])]
                    cuts = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(chosen.tobytes())])
                    some = x.slice(at, to - at)
                    which = pa.array(row[at:to])
                    yield pa.RecordBatch.from_arrays([*(some.field(c) for c in ("key", "ctx", "c", "v")), part.column("t1").take(which), part.column("t2").take(which), some.field("a"), some.field("p"), cuts], names=["key", "ctx", "c", "v", "t1", "t2", "a", "p", "bytes"])
                    at = to

    # Copies of a text are put together before it is cut.
    texts = rows.dropDuplicates(["t1", "t2"]).join(lists, ["t1", "t2"]).select("t1", "t2", "text", "list")
    contexts = materialize(texts.mapInArrow(cut, "key bigint, ctx bigint, c bigint, v bigint, t1 bigint, t2 int, a bigint, p int, bytes binary"))
    discard(wanted)
    settled, more = _split_hot(contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - KMER)), max_variants, length)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a block ends at a change of key once it is full."""
        held: list[tuple] = []
        size = 0

        def solve() -> pa.RecordBatch:
            out = []
            for (_, c, t1, t2, a, _), starts in zip(held, repeated_starts([h[5] for h in held], length), strict=True):
                if c == 1:
                    out += [(t1, t2, a + x, a + y + length) for x, y in _runs(starts)]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["t1", "t2", "a", "e"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for row in zip(*(part.column(c).to_pylist() for c in ("key", "c", "t1", "t2", "a", "bytes")), strict=True):
                    if size >= block_bytes and row[0] != held[-1][0]:
                        yield solve()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
        if held:
            yield solve()

    normal = reduce(DataFrame.union, settled).select("key", "c", "t1", "t2", "a", "bytes").repartition("key").sortWithinPartitions("key")
    spans = reduce(DataFrame.union, [whole, normal.mapInArrow(index, "t1 bigint, t2 int, a bigint, e bigint"), *more])
    out = materialize(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "e")).alias("spans")))
    discard(found, groups, contexts, *settled, *more)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def remove_repeats(df: DataFrame, text: str = "text", length: int = 200, max_variants: int = 2048, as_text: bool = False, out: tuple[str, str, str] = ("n_bytes", "removed", "kept")) -> DataFrame:
    """Append n_bytes, removed (array of byte ranges, merged) and kept (the remaining bytes).

    kept is binary, or with ``as_text`` a string without the characters that a range cut apart. Input
    columns with these names are replaced.
    """
    df = df.drop(*out)
    small_batches(df.sparkSession)
    spans = repeated_spans(df, text, length, max_variants)
    schema = T.StructType([*df.schema.fields, T.StructField(out[0], T.LongType()), T.StructField(out[1], T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField(out[2], T.StringType() if as_text else T.BinaryType())])
    names = df.columns
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text):
                data, offsets = tx.column_bytes(part.column(text))
                gone, kept = [], []
                for i, found in enumerate(part.column(mine).to_pylist()):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    ranges = merged([(x["a"], x["e"]) for x in found or ()])
                    at, rest = 0, []
                    for a, e in ranges:
                        rest.append(raw[at:a])
                        at = e
                    gone.append([{"start": a, "end": e} for a, e in ranges])
                    rest.append(raw[at:])
                    kept.append("".join(x.decode("utf-8", "ignore") for x in rest) if as_text else b"".join(rest))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(gone, span), pa.array(kept, pa.string() if as_text else pa.binary())], names=[*names, *out])

    t1, t2, mine = spare(df, "__t1", "__t2", "__spans")
    joined = df.withColumn(t1, F.xxhash64(text)).withColumn(t2, F.hash(text)).join(spans.toDF(t1, t2, mine), [t1, t2], "left")
    return joined.select(*names, mine).mapInArrow(run, schema)
