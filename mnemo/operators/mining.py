"""Topics, entities, intents, frequent step sequences, chunks and sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X
from mnemo.operators import graph as G
from mnemo.operators import pairs as P

# Fixed values: (cue, weight, pattern) of the intent classes.
INTENTS = [
    ("correction", 0.28, r"(?i)\b(actually|no,|not\s+\w+\s+but|instead of|i\s+meant|correction|rather than|stop\s+\w+ing|don'?t\s+(?:do|use|say))\b|\bthat'?s\s+(?:not\s+right|wrong|incorrect)\b"),
    ("preference", 0.24, r"(?i)\b(i|we)\s+(prefer|like|love|hate|always|never|usually|tend to)\b|\bprefer(?:s|red)?\b|\bi'?d\s+rather\b|\bmy\s+preference\b|\bplease\s+always\b|\bgoing\s+forward\b"),
    ("decision", 0.22, r"(?i)\b(we|i|let'?s)\s+(decided|chose|will use|are going to|should use|going with|settled on)\b|\bthe plan is\b|\bdecision:"),
    ("health", 0.26, r"(?i)(?:allergic|nauseous|dizzy|fever|headache|injured|bleeding|rash|threw up)"),
    ("boundary", 0.26, r"(?i)\b(?:please\s+)?never\s+(?:share|send|post|tell|mention|give|use)\b|\bfrom\s+now\s+on\b|\bdon'?t\s+(?:send|share|text|message|call|post|tell|schedule|book)\b|\bmake\s+sure\s+(?:to|you|we)\b|\bbe\s+sure\s+to\b"),
    ("gotcha", 0.18, r"(?i)\b(turns out|gotcha|the trick is|note that|remember to|important:|caveat|watch out|by default|the fix (?:is|was)|root cause)\b"),
    ("procedural", 0.16, r"(?i)^(?:to\s+\w+|first|then|next|step\s*\d|(?:npm|git|make|go|docker|kubectl|cargo|pip|yarn|pnpm)\s+\w)|\b(?:run|deploy|install|configure)\s+\S+"),
    ("fact", 0.12, r"(?i)\b(my|our)\s+(?:\w+\s+){1,3}(?:is|are|=)\b|\bi'?m\s+(?:a|an|the)\b|\bis\s+(?:located|based|set to)\b|\b\d+(?:\.\d+)?\s*(?:%|kg|lb|mb|gb|ms|hrs?|hours?|days?|px|x)\b"),
]
FREQUENT = 65_536  # words whose document counts travel with tasks
EMPHASIS = r"(?i)\b(important|critical|must|always|never|essential|required|urgent)\b|!"


def topics(docs: DataFrame, k: int, key: str = "id", text: str = "content", common: list[str] | None = None) -> DataFrame:
    """(id, term, score, rank): the k words of a document with the greatest TF-IDF (ties by word).

    ``common`` words don't count; by default the stop words.
    """
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if not texts.groupBy("id").count().filter("count > 1").isEmpty():  # one document, whatever its rows
        texts = texts.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    tokens = F.filter(X.words(F.coalesce("text", F.lit("")), 3), lambda w: ~w.isin(common or X.STOP_WORDS))
    tf = G.written(P.mapped(texts.filter("id IS NOT NULL").select("id", tokens.alias("terms")), _counted, "id bigint, term string, tf bigint, len bigint"))
    df = G.written(tf.groupBy("term").agg(F.count("*").alias("df")))
    n = docs.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    # frequent words, most of the rows, get their count from a table of bounded size, so only the others are shuffled
    often = G.written(df.orderBy(F.desc("df"), "term").limit(FREQUENT))
    known = tf.join(F.broadcast(often), "term", "left")
    rare = tf.join(F.broadcast(often.select("term")), "term", "left_anti").join(df, "term")
    rows = known.filter("df IS NOT NULL").unionByName(rare)
    scored = rows.select("id", "term", F.round(S.tfidf(F.col("tf"), F.col("len"), F.col("df"), n), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, tf, len): each term of a row (id, terms) once, with its count and that of all the row's terms."""
    for batch in batches:
        lists = batch.column(1)
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        codes = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(length)), length)
        cell, tf = np.unique(row * max(1, len(codes.dictionary)) + codes.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(cell, max(1, len(codes.dictionary)))
        for at in range(0, len(cell), 1 << 16):
            here = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[here])), codes.dictionary.take(pa.array(code[here])), pa.array(tf[here]), pa.array(length[row[here]])], names=["id", "term", "tf", "len"])


def topic_overlap(listed: DataFrame, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """(qid, id, shared, cosine) of documents whose topic lists point the same way as a query document's."""
    return P.list_pairs(listed, queries, least)


def topic_classes(docs: DataFrame, listed: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, class, links) of every document: least id of its component of ``topic_overlap``, number of its links."""
    return P.list_classes(docs, listed.filter("score > 0"), least)


def entities(docs: DataFrame, key: str = "id", text: str = "content", common: list[str] | None = None) -> DataFrame:
    """(id, entity, n): runs of capitalised words that do not start a sentence or line, joined and lower-cased.

    At the start of a sentence a run counts from two words on.
    """
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "t"))
    sentences = lines.select("id", F.explode(F.split("t", r"(?<=[.!?])\s+")).alias("s"))
    word = r"\p{Lu}[\p{L}\p{N}'_-]+"
    runs = F.regexp_extract_all("s", F.lit(rf"(?<![\p{{L}}\p{{N}}]){word}(?: {word})*"), F.lit(0))
    first = F.regexp_extract("s", rf"^\W*({word}(?: {word})*)", 1)
    found = sentences.select("id", F.posexplode(runs).alias("i", "run"), first.alias("first"))
    opens = (F.col("i") == 0) & (F.col("run") == F.col("first"))
    rows = found.filter(~opens | F.contains(F.col("run"), F.lit(" "))).select("id", F.lower("run").alias("entity"))
    return rows.filter(~F.col("entity").isin(common or X.STOP_WORDS) & (F.length("entity") >= 2)).groupBy("id", "entity").agg(F.count("*").alias("n"))


def entity_overlap(found: DataFrame, queries: DataFrame, least: float = 0.15) -> DataFrame:
    """(qid, id, jaccard) of documents that share entities with a query document."""
    size = found.groupBy("id").agg(F.count("*").alias("size"))
    asked = found.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("qid"), "entity")
    shared = found.join(asked, "entity").filter("id <> qid").groupBy("qid", "id").agg(F.count("*").alias("shared"))
    rows = shared.join(size, "id").join(size.select(F.col("id").alias("qid"), F.col("size").alias("qsize")), "qid")
    return rows.withColumn("jaccard", F.round(F.col("shared") / (F.col("size") + F.col("qsize") - F.col("shared")), 6)).filter(F.col("jaccard") >= least).select("qid", "id", "jaccard")


def overlap_classes(docs: DataFrame, listed: DataFrame, items: list[str], overlap: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, class, links) of every document: least id of its component, number of documents that ``overlap`` links to it.

    Documents of equal lists are one set first, so only different lists are compared.
    """
    listed = G.written(listed.select("id", *items))
    hashes = listed.groupBy("id").agg(F.sha2(F.array_sort(F.collect_list(F.struct(*items))).cast("string"), 256).alias("hash"))
    members = G.written(docs.select("id").join(hashes, "id", "left"))
    sets = G.written(members.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    ones = sets.select(F.col("least").alias("id"))
    links = overlap(listed.join(ones, "id", "left_semi"), ones).filter("qid < id").select(F.col("qid").alias("a"), F.col("id").alias("b"))
    return G.classes(members, sets, G.written(links))


def sequences(sessions: DataFrame, shortest: int = 2, longest: int = 5, support: int = 2, steps: str = "steps", sid: str = "sid") -> DataFrame:
    """(pattern, length, support): contiguous runs of steps found in at least ``support`` sessions."""
    spans = F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.when(F.size(steps) >= n, F.transform(F.sequence(F.lit(1), F.size(steps) - n + 1), lambda i: F.array_join(F.slice(steps, i, n), ">"))).otherwise(F.array().cast("array<string>"))))
    rows = sessions.select(sid, F.explode(F.array_distinct(spans)).alias("pattern")).groupBy("pattern").agg(F.countDistinct(sid).alias("support"))
    return rows.filter(F.col("support") >= support).select("pattern", F.size(F.split("pattern", ">")).alias("length"), "support")


def maximal(patterns: DataFrame) -> DataFrame:
    """Patterns that are no part of a longer one with equal support: each longer one names its parts, which are removed."""
    steps = F.split("pattern", ">")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(steps) - n + 1), lambda i: F.array_join(F.slice(steps, i, n), ">"))))
    inner = patterns.filter("length > 1").select("support", F.explode(F.array_distinct(parts)).alias("pattern")).distinct()
    return patterns.join(inner, ["pattern", "support"], "left_anti")


def workflow_importance(support: Column) -> Column:
    return F.least(F.lit(0.85), F.lit(0.4) + F.lit(0.05) * support)


def segments(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, pos, segment): sentences of lines, speaker prefixes and URLs removed, of at least eight characters."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    body = F.regexp_replace(F.regexp_replace("t", r"^\s*[A-Za-z0-9_]{1,19}: ", ""), r"https?://\S+", "")
    parts = lines.select("id", "line", F.posexplode(F.split(body, r"(?<=[.!?])\s+")).alias("i", "s")).withColumn("segment", F.trim("s")).filter(F.length("segment") >= 8)
    w = Window.partitionBy("id").orderBy("line", "i")
    return parts.select("id", F.row_number().over(w).cast("bigint").alias("pos"), "segment")


def cues(segment: Column) -> Column:
    """Names of the intents whose pattern fires, strongest class first as listed."""
    return F.array_compact(F.array(*[F.when(segment.rlike(p), F.lit(n)) for n, _, p in INTENTS]))


def salience(segment: Column, entity_count: Column) -> Column:
    """0.4 and the strongest cue, a quarter of the second, emphasis, capitals and entities; at most 1."""
    weights = F.sort_array(F.array(*[F.when(segment.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for _, w, p in INTENTS]), False)

    def total(w: Column) -> Column:
        out = 0.4 + w[0] + 0.25 * w[1]
        out = out + F.when(segment.rlike(EMPHASIS), 0.08).otherwise(0.0) + F.when(segment.rlike(r"(?:^|\s)[A-Z]{3,}(?:\s|$)"), 0.04).otherwise(0.0)
        return F.least(F.lit(1.0), out + F.when(entity_count >= 2, 0.10).when(entity_count == 1, 0.05).otherwise(0.0))

    return X.bind(weights, total)


def capture(docs: DataFrame, k: int = 12, key: str = "id", text: str = "text", least: float = 0.45) -> DataFrame:
    """(id, segment, cues, importance, kind, priority, rank): the k most salient segments of a text that fire a cue.

    Pure questions are left out; segments of equal words count once, the first.
    """
    rows = segments(docs, key, text)
    rows = rows.withColumn("cues", cues(F.col("segment"))).filter((F.size("cues") > 0) & ~F.endswith(F.col("segment"), F.lit("?")))
    names = F.size(F.regexp_extract_all("segment", F.lit(r"(?<=[a-z,;] )\p{Lu}\p{L}+"), F.lit(0)))
    rows = rows.withColumn("importance", F.round(salience(F.col("segment"), names), 6)).filter(F.col("importance") >= least)
    norm = F.array_join(X.words(F.col("segment")), " ")
    once = Window.partitionBy("id", "norm").orderBy("pos")
    rows = rows.withColumn("norm", norm).withColumn("c", F.row_number().over(once)).filter("c = 1")
    kind = F.when(F.array_contains("cues", "procedural"), "procedural").when(F.arrays_overlap("cues", X.strings(["preference", "fact", "decision", "boundary", "gotcha"])), "semantic").otherwise("episodic")
    priority = F.when(F.col("importance") >= 0.75, "high").when(F.col("importance") >= 0.55, "normal").otherwise("low")
    w = Window.partitionBy("id").orderBy(F.desc("importance"), "pos")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("id", "segment", F.array_join("cues", ",").alias("cues"), "importance", kind.alias("kind"), priority.alias("priority"), "rank")


def sections(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, pos, heading, key, body): parts of markdown under '## ' headings; what comes before is the preamble."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=## )")
    rows = docs.select(F.col(key).alias("id"), F.posexplode(parts).alias("pos", "part")).withColumn("part", F.btrim("part", F.lit(" \n\t\r")))
    heading = F.regexp_extract("part", r"^## (.*)", 1)
    body = F.btrim(F.regexp_replace("part", r"^## .*\n?", ""), F.lit(" \n\t\r"))
    name = F.when(heading != "", X.slug(heading)).otherwise(F.lit("preamble"))
    return rows.filter("part <> ''").select("id", F.col("pos").cast("bigint").alias("pos"), heading.alias("heading"), name.alias("key"), body.alias("body"))


def split_text(text: str, target: int = 400, most: int = 600) -> list[str]:
    """Blocks at headings and double blank lines, small ones joined up to ``target`` bytes, large ones cut at ``most``."""
    blocks, now, blank = [], [], False
    for line in text.split("\n"):
        bare = line.strip()
        if now and (bare.startswith("#") or (not bare and blank)):
            blocks.append("\n".join(now).strip())
            now = []
        blank = not bare
        now.append(line)
    blocks.append("\n".join(now).strip())
    out: list[str] = []
    for b in filter(None, blocks):
        if out and len(out[-1].encode()) + len(b.encode()) + 2 <= target:
            out[-1] += "\n\n" + b
        else:
            out.append(b)
    cut: list[str] = []
    for b in out:
        while len(b.encode()) > most:
            head = b.encode()[:target].decode("utf-8", "ignore")
            at = max(head.rfind("\n"), head.rfind(". ") + 1, head.rfind(" "))
            at = at if at > 0 else len(head)
            cut.append(b[:at].strip())
            b = b[at:].strip()
        cut.append(b)
    return [c for c in cut if c]


def chunks(docs: DataFrame, key: str = "id", text: str = "content", target: int = 400, most: int = 600) -> DataFrame:
    """(id, seq, text): search units of each text; cutting is an ordered fold, one Arrow batch at a time."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [split_text(t or "", target, most) for t in part.column(1).to_pylist()]
                rows = [i for i, x in enumerate(lists) for _ in x]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array([n for x in lists for n in range(len(x))], pa.int64()), pa.array([c for x in lists for c in x], pa.string())], names=["id", "seq", "text"])

    return docs.select(key, text).mapInArrow(run, f"id {kind}, seq bigint, text string")


def speaker_turns(turns: DataFrame, target: int = 500, least: int = 50) -> DataFrame:
    """(id, speaker, window, text): what each human speaker says, in windows of about ``target`` bytes with one turn of overlap.

    ``turns`` is (id, turn, role, text); windows follow from running byte counts.
    """
    said = turns.filter(~F.lower("role").isin(X.AI_ROLES))
    w = Window.partitionBy("id", "role").orderBy("turn")
    size = F.octet_length("text")
    placed = said.withColumn("window", F.floor((F.sum(size).over(w) - size) / target))
    placed = placed.withColumn("after", F.lead("window").over(w))
    later = F.when(F.col("after") > F.col("window"), F.col("after"))
    both = placed.select("id", "role", "turn", "text", F.explode(F.array_compact(F.array("window", later))).alias("window"))
    out = both.groupBy("id", F.col("role").alias("speaker"), "window").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return out.select("id", "speaker", "window", F.expr("array_join(transform(l, x -> x.text), '\n')").alias("text")).filter(F.octet_length("text") >= least)


def numbered_keys(rows: DataFrame, key: str = "key", order: str = "id", group: str = "ns") -> DataFrame:
    """Rows whose keys are unique in their namespace up to the 26th of a name (later ones end in -x).

    Only the first 27 rows of a name are numbered, so a name that very many rows share is never sorted whole.
    """
    w = Window.partitionBy(group, key).orderBy(order)
    first = rows.select(group, key, order).withColumn("__n", F.row_number().over(w)).filter("__n <= 27").select(F.col(order), (F.col("__n") - 1).alias("__n"))
    out = rows.join(first, order, "left").withColumn("__n", F.coalesce("__n", F.lit(27)))
    return out.withColumn(key, X.dedupe_key(F.col(key), F.col("__n"))).drop("__n")


def mined_memories(patterns: DataFrame) -> DataFrame:
    """(key, kind, content, importance, support) of mined step sequences 'a>b'."""
    key = X.short_key(X.kebab(F.col("pattern")), "steps")
    return patterns.select(key.alias("key"), F.lit("procedural").alias("kind"), F.replace(F.col("pattern"), F.lit(">"), F.lit(" -> ")).alias("content"), "importance", "support")
