"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Counts of all words come from all training rows by grouped sums. The ``shortlist`` most frequent words
are classes of their own, all others share ``BUCKETS`` classes by their last two bytes. The model
predicts the next class from the embeddings of the last two, each through a matrix of its position;
within a bucket words follow the smoothed unigram distribution. Its weights are fitted on all training
rows through what the model can see of them: the counts of all class trigrams, by grouped sums. These are
dealt by context and written once; every task takes an epoch over its part of the table (``SHARD`` trigrams
at a time) from the same weights, and the results are averaged by tokens (in two steps, so that the driver
gathers the square root of the number of parts) before the next epoch. The first weights are random, with the class
frequencies as bias.

Scoring normalises over all classes with batched matrix products, once per distinct context in a piece
of text. Counts of the ``frequent`` most frequent words travel with the tasks (a fixed number of rows);
rarer words leave the tasks as (word, times) per row and meet their counts in a join, so no table that
grows with the vocabulary is broadcast or collected.

Null and empty texts are the end token alone. Repeated rows are kept. A null id is in no fold: it is
not held out and not learned from. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._io import discard, materialize

BUCKETS = 256
END = np.uint64(0x5EED0E2DE2D0E2D1)
SMOOTH = 0.1
#: Trigrams that a task holds and shuffles at a time.
SHARD = 1 << 19
#: Most tokens that one presentation of a trigram stands for.
WEIGHT = 8
EPOCHS = 3
#: Presentations that an epoch over a shard makes at least; a small shard is gone through again and again.
LEAST = 1 << 16
WEIGHTS = ["context", "target", "near", "far", "bias"]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, row) of every token: the words of each row, then its end (bucket -1)."""
    data = tx.LOWER[data]
    starts, ends, row = tx.word_spans(data, offsets, tx.SPACE_WORDS)
    n_rows = len(offsets) - 1
    at = np.arange(len(starts)) + row
    total = len(starts) + n_rows
    hashes = np.full(total, END, np.uint64)
    hashes[at] = tx.word_hashes(data, starts, ends)
    bucket = np.full(total, -1, np.int64)
    before = np.where(ends - 2 >= starts, data[ends - 2] if len(ends) else 0, 0).astype(np.int64)
    suffix = (data[ends - 1].astype(np.int64) if len(ends) else before) * 256 + before
    bucket[at] = (tx.mix(suffix.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    rows = np.repeat(np.arange(n_rows), np.bincount(row, minlength=n_rows) + 1)
    return hashes, bucket, rows


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, bucket, c) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text, 16 * tx.PIECE_BYTES):
                hashes, bucket, _ = tokens(*tx.column_bytes(part.column(text)))
                word, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bucket[at].astype(np.int32)), pa.array(n)], names=["word", "bucket", "c"])

    return df.select(text).mapInArrow(run, "word bigint, bucket int, c bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words (sorted by hash) with counts and classes, and totals over all words."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n: int
    v: int
    n_classes: int
    class_counts: np.ndarray
    log_mass: np.ndarray

    @property
    def log_z(self) -> float:
        return float(np.log10(self.n + SMOOTH * (self.v + 1)))

    def look_up(self, hashes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 if the word is not among the frequent ones; class) of each token."""
        word, inverse = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.words, word)
        at[at == len(self.words)] = 0
        found = self.words[at] == word if len(self.words) else np.zeros(len(word), bool)
        count = np.where(found, self.counts[at] if len(self.words) else 0, -1)[inverse]
        own = np.where(found, self.classes[at] if len(self.words) else -1, -1)[inverse]
        return count, np.where(own >= 0, own, np.where(bucket < 0, 0, self.n_classes - BUCKETS + bucket))


def vocabulary(counts: DataFrame, shortlist: int, frequent: int) -> Vocabulary:
    """Class 0 is the end, then the shortlist, then the buckets."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow().to_pydict()  # ``frequent`` rows at most
    words = np.array(top["word"], np.int64).view(np.uint64)
    c, bucket = np.array(top["c"], np.int64), np.array(top["bucket"], np.int64)
    classes = np.full(len(words), -1, np.int64)
    classes[words == END] = 0
    rest = np.flatnonzero(words != END)[:shortlist]
    classes[rest] = np.arange(1, len(rest) + 1)
    n_classes = 1 + len(rest) + BUCKETS
    listed = np.flatnonzero(classes >= 0)
    class_counts = np.zeros(n_classes)
    class_counts[classes[listed]] = c[listed]
    # Words outside the shortlist, by bucket: all of them less the listed ones.
    for b, total, kinds in counts.groupBy("bucket").agg(F.sum("c"), F.count("*")).collect():  # BUCKETS + 1 rows
        if b >= 0:
            own = listed[(bucket[listed] == b) & (classes[listed] > 0)]
            class_counts[n_classes - BUCKETS + b] = total - c[own].sum() + SMOOTH * (kinds - len(own))
    z = n + SMOOTH * (v + 1)
    log_mass = np.log10((class_counts[n_classes - BUCKETS :] + SMOOTH) / z)
    order = np.argsort(words)
    return Vocabulary(words[order], c[order], classes[order], int(n), int(v), n_classes, class_counts, log_mass)


@dataclass
class Model:
    context: np.ndarray  # classes x width
    target: np.ndarray  # classes x width
    near: np.ndarray  # width x width
    far: np.ndarray
    bias: np.ndarray

    def log10(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray, block: int = 2048) -> np.ndarray:
        """log10 P(target | last class, the one before), normalised over all classes.

        The normaliser of a context is kept for later calls where that takes a few MB at most.
        """
        k = len(self.bias)
        a, b = self.context @ self.near, self.context @ self.far
        pair = c2 * k + c1
        kept = self.__dict__.setdefault("_z", np.full(k * k, np.nan, np.float32)) if k <= 1 << 11 else None
        need = np.unique(pair if kept is None else pair[np.isnan(kept[pair])])
        z = np.empty(len(need), np.float32)
        for lo in range(0, len(need), block):
            some = need[lo : lo + block]
            logits = (a[some % k] + b[some // k]) @ self.target.T + self.bias
            top = logits.max(axis=1, keepdims=True)
            logits -= top
            z[lo : lo + block] = top[:, 0] + np.log(np.exp(logits, out=logits).sum(axis=1))
        if kept is not None:
            kept[need] = z
        out = np.empty(len(target), np.float64)
        for lo in range(0, len(target), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            own = np.einsum("ij,ij->i", a[c1[at]] + b[c2[at]], self.target[target[at]]) + self.bias[target[at]]
            out[at] = own - (z[np.searchsorted(need, pair[at])] if kept is None else kept[pair[at]])
        return out / np.log(10)


def contexts(classes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last class and the one before; a row starts as after two ends."""
    first = np.concatenate(([True], rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
    c1 = np.concatenate(([0], classes[:-1])) if len(rows) else classes
    c1 = np.where(first, 0, c1)
    c2 = np.concatenate(([0], c1[:-1])) if len(rows) else classes
    return c1, np.where(first, 0, c2)


def start(class_counts: np.ndarray, width: int = 32, seed: int = 5) -> tuple[Model, dict[str, np.ndarray]]:
    """Random weights with the class frequencies as bias, and Adagrad's sums of squares."""
    rng = np.random.default_rng(seed)
    k = len(class_counts)
    draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = (class_counts + 0.5) / (class_counts + 0.5).sum()
    m = Model(draw(k, width), draw(k, width), np.eye(width, dtype=np.float32), np.eye(width, dtype=np.float32) * np.float32(0.5), np.log(p).astype(np.float32))
    return m, {x: np.full_like(getattr(m, x), 1e-2) for x in WEIGHTS}


def presented(key: np.ndarray, n: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(context, class, weight) of the trigrams in the order of an epoch.

    A trigram seen n times is presented ceil(n / WEIGHT) times with equal weights, so that no step is
    ruled by a frequent one. The presentations of a context are spread over rounds of it, and the rounds
    of all contexts shuffled.
    """
    times = -(-n // WEIGHT)
    weight = np.repeat((n / times).astype(np.float32), times)
    turn = np.arange(len(weight)) - np.repeat(np.cumsum(times) - times, times)
    key = np.repeat(key, times)
    group, inverse = np.unique((key // k) * (int(times.max(initial=0)) + 1) + turn, return_inverse=True)
    order = np.argsort(rng.permutation(len(group))[inverse], kind="stable")
    return (key // k)[order], (key % k)[order], weight[order], inverse[order]


def learn(m: Model, seen: dict[str, np.ndarray], key: np.ndarray, n: np.ndarray, class_counts: np.ndarray, rng: np.random.Generator, noise: int = 64, batch: int = 512, rate: float = 0.2) -> None:
    """A pass of noise-contrastive estimation over counted trigrams, against the class frequencies, by Adagrad, in place.

    Noise is drawn once a step and costs once a context, whatever the number of its continuations.
    """
    k = len(class_counts)
    p = (class_counts + 0.5) / (class_counts + 0.5).sum()
    floor = (np.log(p) + np.log(noise)).astype(np.float32)
    cumulative = np.cumsum(p)
    small = np.int16 if k < 1 << 15 else np.int64

    def sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices and the sum of the values of each."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[cuts], np.add.reduceat(values[order], cuts, axis=0)

    def move(x: str, at: np.ndarray | slice, g: np.ndarray, total: np.float32) -> None:
        step = g / total
        w, s = getattr(m, x), seen[x]
        s[at] = now = s[at] + step * step
        w[at] += np.float32(rate) * step / np.sqrt(now)

    context, classes, weights, group = presented(key, n, k, rng)
    classes = classes.astype(small)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    far, near = (context[heads] // k).astype(small), (context[heads] % k).astype(small)
    edges = np.append(heads, len(group))
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + batch, "right")) - 1)
        lo, hi = edges[at], edges[to]
        starts, y, w = edges[at:to] - lo, classes[lo:hi], weights[lo:hi]
        size = np.diff(edges[at : to + 1])
        x1, x2, total = near[at:to], far[at:to], w.sum()
        e1, e2 = m.context[x1], m.context[x2]
        q = e1 @ m.near + e2 @ m.far
        qs = np.repeat(q, size, axis=0)
        other = np.minimum(np.searchsorted(cumulative, rng.random(noise)), k - 1).astype(small)
        t_true, t_noise = m.target[y], m.target[other]
        lead = m.bias - floor
        g_true = w / (1 + np.exp(np.einsum("ij,ij->i", qs, t_true) + lead[y]))  # gradient of the log likelihood
        g_noise = q @ -t_noise.T
        g_noise -= lead[other]
        np.exp(g_noise, out=g_noise)
        g_noise += 1
        np.divide(-np.add.reduceat(w, starts)[:, None], g_noise, out=g_noise)
        gq = np.add.reduceat(g_true[:, None] * t_true, starts, axis=0) + g_noise @ t_noise
        target, g_target = sums(np.concatenate((y, other)), np.concatenate((np.column_stack((g_true[:, None] * qs, g_true)), np.column_stack((g_noise.T @ q, g_noise.sum(axis=0))))))
        words, g_context = sums(np.concatenate((x1, x2)), np.concatenate((gq @ m.near.T, gq @ m.far.T)))
        g_near, g_far = e1.T @ gq, e2.T @ gq
        move("target", target, g_target[:, :-1], total)
        move("bias", target, g_target[:, -1], total)
        move("context", words, g_context, total)
        move("near", slice(None), g_near, total)
        move("far", slice(None), g_far, total)
        at = to


def counted(classes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, times): trigrams are (class before last * k + last) * k + class."""
    c1, c2 = contexts(classes, rows)
    return np.unique((c2 * k + c1) * k + classes, return_counts=True)


def epoch(m: Model, seen: dict[str, np.ndarray], key: np.ndarray, n: np.ndarray, class_counts: np.ndarray, rng: np.random.Generator) -> None:
    """``learn`` once, or until ``LEAST`` presentations have been made."""
    made = 0
    while len(key) and made < LEAST:
        learn(m, seen, key, n, class_counts, rng)
        made += int((-(-n // WEIGHT)).sum())


def fit(classes: np.ndarray, rows: np.ndarray, class_counts: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """The model of tokens that one process holds."""
    m, seen = start(class_counts, seed=seed)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        epoch(m, seen, *counted(classes, rows, len(class_counts)), class_counts, rng)
    return m


def fit_all(trigrams: DataFrame, class_counts: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """The model of all trigrams (key, n) of a written table, whose tasks are the shards."""
    spark = trigrams.sparkSession
    shards = max(1, -(-trigrams.count() // SHARD))  # about
    m, seen = start(class_counts, seed=seed)
    shapes = [a.shape for a in [*(getattr(m, x) for x in WEIGHTS), *(seen[x] for x in WEIGHTS)]]
    cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    flat = lambda m, seen: np.concatenate([*(getattr(m, x).ravel() for x in WEIGHTS), *(seen[x].ravel() for x in WEIGHTS)])

    def parts(state: np.ndarray) -> tuple[Model, dict[str, np.ndarray]]:
        arrays = [state[a:b].reshape(s).copy() for a, b, s in zip(cuts, cuts[1:], shapes, strict=False)]
        return Model(*arrays[: len(WEIGHTS)]), dict(zip(WEIGHTS, arrays[len(WEIGHTS) :], strict=True))

    def mean(found: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray] | None:
        """Tokens and the mean state, added in order of the shards."""
        n = sum(x[1] for x in found)
        total = np.zeros(int(cuts[-1]))
        for _, c, state in sorted(found, key=lambda x: x[0]):
            total += np.frombuffer(state, np.float32).astype(np.float64) * (c / n)
        return (n, total.astype(np.float32)) if found else None

    lanes = max(1, int(np.ceil(np.sqrt(shards))))
    schema = "shard bigint, n bigint, state binary"
    as_table = lambda shard, n, state: pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "state": pa.array([state.tobytes()], pa.binary())})
    triples = lambda t: list(zip(t["shard"].to_pylist(), t["n"].to_pylist(), t["state"].to_pylist(), strict=True))
    for turn in range(epochs):
        state = spark.sparkContext.broadcast(flat(m, seen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One pass over a task's rows, SHARD at a time, each from where the last one ended."""
            shard = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, turn, shard])
            m, seen = parts(state.value)
            total = 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
                size += batch.num_rows
                if size >= 2 * SHARD:  # so that no small rest is left
                    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    epoch(m, seen, key[:SHARD], n[:SHARD], class_counts, rng)
                    total += int(n[:SHARD].sum())
                    held, size = [(key[SHARD:], n[SHARD:])], size - SHARD
            if size:
                key, n = (np.concatenate(x) for x in zip(*held, strict=True))
                epoch(m, seen, key, n, class_counts, rng)
                yield from as_table(shard, total + int(n.sum()), flat(m, seen)).to_batches()

        def gather(table: pa.Table) -> pa.Table:
            n, total = mean(triples(table))
            return as_table(min(table["shard"].to_pylist()), n, total)

        found = trigrams.mapInArrow(run, schema)
        if lanes > 1:
            found = found.withColumn("lane", F.col("shard") % lanes).groupBy("lane").applyInArrow(gather, schema)
        if got := mean(triples(found.toArrow())):  # ``lanes`` rows
            m, seen = parts(got[1])
        state.unpersist()
    return m


def score(docs: DataFrame, key: str, text: str, train: DataFrame, shortlist: int = 767, frequent: int = 1 << 16) -> tuple[DataFrame, Vocabulary]:
    """((row, id, n_tokens, n_known, base_score, score) of every row of ``docs``, vocabulary of ``train``)."""
    spark = docs.sparkSession
    counts = materialize(word_counts(train, text))
    vocab = vocabulary(counts, shortlist, frequent)
    shared = spark.sparkContext.broadcast(vocab)  # ``frequent`` words

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text, 16 * tx.PIECE_BYTES):
                hashes, bucket, rows = tokens(*tx.column_bytes(part.column(text)))
                found, n = counted(shared.value.look_up(hashes, bucket)[1], rows, shared.value.n_classes)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["key", "n"])

    trigrams = train.select(text).mapInArrow(classify, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    trigrams = materialize(trigrams.repartition(F.expr(f"key DIV {vocab.n_classes}")))  # a context has n_classes rows at most
    model = spark.sparkContext.broadcast(fit_all(trigrams, vocab.class_counts))
    discard(trigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, m = shared.value, model.value
        first_bucket = vocab.n_classes - BUCKETS
        for batch in batches:
            for part in tx.pieces(batch, text, 16 * tx.PIECE_BYTES):
                n = part.num_rows
                hashes, bucket, rows = tokens(*tx.column_bytes(part.column(text)))
                count, classes = vocab.look_up(hashes, bucket)
                top = count >= 0
                base = np.where(top, np.log10(np.maximum(count, 0) + SMOOTH) - vocab.log_z, 0.0)
                own = m.log10(*contexts(classes, rows), classes)
                spread = classes >= first_bucket
                own += np.where(spread, base - vocab.log_mass[np.where(spread, classes - first_bucket, 0)], 0.0)
                rare = np.flatnonzero(~top)
                rare = rare[np.lexsort((hashes[rare], rows[rare]))]
                new = np.flatnonzero(np.concatenate(([True], (hashes[rare][1:] != hashes[rare][:-1]) | (rows[rare][1:] != rows[rare][:-1])))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((new, [len(rare)])))
                per_row = np.bincount(rows[rare[new]], minlength=n)
                sums = lambda w: np.bincount(rows, weights=w, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__row"), part.column(key), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(np.bincount(rows[top], minlength=n).astype(np.int64)),
                        pa.array(sums(base)), pa.array(sums(own)), tx.list_array(hashes[rare[new]].view(np.int64), per_row), tx.list_array(times.astype(np.int32), per_row),
                    ],
                    names=["row", "id", "n_tokens", "known", "base", "own", "words", "times"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_tokens bigint, known bigint, base double, own double, words array<bigint>, times array<int>"
    scored = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), key, text).mapInArrow(run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select("word", "c"), "word", "left")
    per_token = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH) - F.lit(vocab.log_z)
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * per_token).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"))
    out = scored.drop("words", "times").join(rare, "row", "left").select(
        "row", "id", "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
    return out, vocab
