"""The queries without SQL against plain Python, column by column, over the whole smallest tables."""

import collections
import hashlib
import html as entities
import math
import re
import zlib

import pytest

pytest.importorskip("mnemo.llm")

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import public_tokenizers as P  # noqa: E402

from mnemo.llm import bpe, cws, langid, queries, zquality  # noqa: E402

SPACE = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def documents(sf):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: (t or "", lang) for i, t, lang in rows}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def rows_of(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows)
    return got


def test_op1_against_the_library(spark, sf, documents):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows_of(spark, sf, "op1_byte_bpe")
    assert set(got) == set(documents)
    for i, (t, _) in documents.items():
        ids = ref.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))


def jaccard(a, b):
    a, b = (collections.Counter(re.findall(SPACE, t)) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_op2_edits_and_likeness(spark, sf, documents):
    got = rows_of(spark, sf, "op2_weighted_sampling")
    order = sorted(documents, reverse=True)
    off = []
    for k, i in enumerate(order):
        t, after = documents[i][0], documents[order[(k + 1) % len(order)]][0]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited.encode()))
        off += [(r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after))]
        assert r["near_next"] == (sum(a == b for a, b in zip(re.findall("." * 6, r["fingerprint"]), re.findall("." * 6, got[order[(k + 1) % len(order)]]["fingerprint"]), strict=True)) / 32 if t.split() and after.split() else float(not t.split() and not after.split()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12
    by = collections.defaultdict(set)
    for i, (t, _) in documents.items():
        by[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert cws.SAMPLE_BITS == 24


def out_of_place(documents, size=400, n=3):
    """Rank-order profiles by plain counting, learned from all training rows."""

    def grams(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        t = re.sub(" +", " ", t)
        found = collections.Counter()
        for k in range(1, n + 1):
            for i in range(len(t) - k + 1):
                g = t[i : i + k]
                if g.strip() and (k < 3 or " " not in g[1:-1]):
                    found[g] += 1
        return found

    total = collections.defaultdict(collections.Counter)
    for i, (t, lang) in documents.items():
        if lang and fold(i, 5):
            total[lang].update(grams(t))
    profiles = {name: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for name, c in total.items()}

    def cost(t):
        own = [g for g, _ in sorted(grams(t).items(), key=lambda x: (-x[1], x[0]))[:size]]
        return {name: sum(min(abs(p[g] - r), size) if g in p else size for r, g in enumerate(own)) / max(1, len(own) * size) for name, p in profiles.items()}

    return cost


def test_op4_against_plain_profiles(spark, sf, documents):
    got, cost = rows_of(spark, sf, "op4_rank_order_langid"), out_of_place(documents)
    assert set(got) == set(documents)
    right = []
    for i, (t, lang) in documents.items():
        r = got[i]
        assert r["held_out"] == (fold(i, 5) == 0)
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        costs = cost(t)
        # Ties of equal counts may be cut elsewhere, so costs agree nearly and so do the decisions.
        assert abs(1 - costs[r["lang_pred"]] - r["score"]) < 0.05
        assert costs[r["lang_pred"]] <= min(costs.values()) + 0.02
        if lang and r["held_out"]:
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) >= 0.95 and langid.UNDETERMINED == "und"


def test_op5_keeps_the_article(spark, sf):
    pages = {i: h or "" for i, h in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()}
    got = {r["page_id"]: r for r in queries.QUERIES["op5_site_templates"](spark, sf).collect()}
    assert set(got) == set(pages)
    for i, h in pages.items():
        text = got[i]["text"]
        assert got[i]["n_chars"] == len(text) and (h or not text)
        assert all(x and x == " ".join(x.split()) for x in text.split("\n")) or not text
        # These articles hold headings and paragraphs only, some of them never closed.
        inside = re.search(r"(?is)<article\b[^>]*>(.*)</article>", h)
        parts = re.split(r"(?i)</?(?:p|h1)\b[^>]*>", inside[1]) if inside else []
        want = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\b[^>]*>", " ", x))).split()) for x in parts]
        assert not inside or text.split("\n") == [x for x in want if x]


def test_op6_against_counting(spark, sf, documents):
    raws = {i: t.encode() for i, (t, _) in documents.items()}
    seen = collections.Counter(hash(r[k : k + 200]) for r in raws.values() for k in range(len(r) - 199))
    got = rows_of(spark, sf, "op6_run_length_index")
    assert set(got) == set(documents)
    for i, r in raws.items():
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - 199):
            if seen[hash(r[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~hit].tobytes()
        x = got[i]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (len(r), int(hit.sum()), spans, sha(kept))


def test_op8_scores_and_folds(spark, sf, documents):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = rows_of(spark, sf, "op8_zstd_quality")
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    same = collections.defaultdict(set)
    for i, (t, _) in documents.items():
        same[t].add(got[i]["score"])
    assert all(len(x) == 1 for x in same.values())
    learned = [(got[i]["score"], y) for i, y in labels.items() if i in got and y is not None]
    good, bad = [s for s, y in learned if y == 1], [s for s, y in learned if y == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.75


def test_op8_learns_from_whole_texts(spark):
    """Labelled texts of any length take part: here every one is longer than 20,000 characters."""
    make = lambda words, n: " ".join(words[k * k % len(words)] for k in range(n))
    good, bad = ["river", "stone", "forest", "meadow", "harbour"], ["zxq", "vvkj", "qqp", "wxz", "jjk"]
    docs = spark.createDataFrame([(i, make(good if i % 2 else bad, 5200 + i)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = zquality.train(docs, labels, "doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in zquality.score(docs, model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)


def test_op10_counts_and_base(spark, sf, documents):
    split = lambda t: re.findall(SPACE, t.translate(LOWER)) + [None]
    seen = collections.Counter(w for i, (t, _) in documents.items() if fold(i, 10) for w in split(t))
    n, v = sum(seen.values()), len(seen)
    got = rows_of(spark, sf, "op10_log_bilinear")
    assert set(got) == set(documents)
    held = []
    for i, (t, _) in documents.items():
        r, w = got[i], split(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 10) == 0, len(w), sum(seen[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)
        if r["held_out"]:
            held.append((r["score"], r["base_score"]))
    assert sum(a for a, _ in held) > sum(b for _, b in held)
