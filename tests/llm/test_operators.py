"""Each operator against brute force or an exact round trip, with nulls, empty, long and repeated texts."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("mnemo.llm")

import numpy as np  # noqa: E402
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mnemo.llm import bpe, cws, html, langid, lbl, minhash, rlbwt, warc, winnow, zquality  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, score double, n bigint, ids string"
PATH = P.path("byte_bpe_50k.tiktoken")


def frame(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with outputs and inner names."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, l, 0.5, 7, "x") for i, t, l in zip(ids, texts, langs or ["en"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [None, "", "   \n", "word", "Ünïcödé 東京 \U0001f600 it's 12.5%  x\n\n y ", "A" * 3000]


def test_bpe_round_trip_and_long_texts(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, ODD[4], prose(1, 400) + "\n\n  don't  " + prose(2, 300), " " * 900 + "x", "ab  " * 700]
    for chunk, overlap in ((1 << 16, 1 << 10), (97, 31), (50, 5)):
        ids = bpe.encode(frame(spark, texts), PATH, P.PATTERN, chunk_chars=chunk, overlap=overlap)
        got = {r["doc_id"]: r for r in bpe.decode(ids, PATH).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i]["ids"] == ref.encode_ordinary(t or "")
            assert bytes(got[i]["decoded"]) == (t or "").encode()


def generalised_jaccard(a, b):
    words = lambda t: collections.Counter(w for w in re.split("[ \t-\r]+", t) if w)
    a, b = words(a), words(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_weighted_sampling_estimates_generalised_jaccard(spark):
    texts = [prose(i, 120) + " " + prose(99, 120) for i in range(12)] + [None, "", "same words here", "same words here"]
    ids = [*range(12), 12, 13, 14, 14]
    got = cws.edited_fingerprints(frame(spark, texts, ids), samples=64).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts), key=lambda x: (-x[0], x[1] or ""))
    errors = []
    by = collections.defaultdict(list)
    for r in got:
        by[r["id"]].append(r)
    for at, (i, t) in enumerate(order):
        t, nxt = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in by[i] if x["edited_sha256"] == sha)
        assert r["n_chars"] == len(t)
        assert (r["fp"] is None) == (not t.split())
        if t.split() and edited.split():
            errors.append(np.mean(np.array(r["fp"]) == np.array(r["edited_fp"])) - generalised_jaccard(t, edited))
    assert abs(np.mean(errors)) < 0.06 and np.std(errors) < 0.12
    assert by[14][0]["fp"] == by[14][1]["fp"]


def test_weighted_sampling_parts_of_ranges_find_every_neighbour(spark):
    rng = random.Random(8)
    ids = [None, None, *(rng.choice([rng.randrange(50), rng.randrange(10**6), 7]) for _ in range(120))]
    docs = frame(spark, [f"t{rng.randrange(40)}" for _ in ids], ids)
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = [(k, t, n) for (k, t), (_, n) in zip(want, want[1:] + want[:1], strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for per, ranges, parts in ((2, 4, 5), (1, 3, 100), (1000, 4, 5)):
        rows, behind = cws.neighbours(docs, "doc_id", "text", rows_per_bucket=per, max_ranges=ranges, max_parts=parts)
        assert sorted(((r["k"], r["t"], r["next_text"]) for r in rows.collect()), key=order) == sorted(want, key=order)
        used = {r["bucket"] for r in rows.collect()}
        assert {r["bucket"] for r in behind.collect()} == {r["next_bucket"] for r in behind.collect()} == used
        assert len(used) > ranges or per == 1000


def test_weighted_sampling_buckets_find_every_neighbour(spark):
    docs = frame(spark, [f"t{i}" for i in range(50)], [i * i for i in range(50)])
    rows, _ = cws.neighbours(docs, "doc_id", "text", rows_per_bucket=5)
    got = {r["k"]: r["next_text"] for r in rows.collect()}
    assert got == {i * i: f"t{(i - 1) % 50}" for i in range(50)}
    assert cws.edited_fingerprints(docs.limit(0)).count() == 0


def shingles(t):
    w = [x for x in re.split("[ \t-\r]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[a if ids[a] > ids[b] else b] = b if ids[a] > ids[b] else a
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(texts))}


def test_minhash_matches_all_pairs(spark):
    rng = random.Random(5)
    base = [prose(i, 150).split() for i in range(6)]
    texts = list(ODD)
    for b in base:
        for edits in (0, 0, 2, 4, 6, 9, 14, 25):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w).upper() if edits == 2 else " ".join(w))
    ids = rng.sample(range(1000), len(texts))
    got = {r["id"]: (r["n"], r["component"]) for r in minhash.near_duplicates(frame(spark, texts, ids)).collect()}
    assert got == brute_components(texts, ids)
    kept = {r["doc_id"] for r in minhash.keep_one(frame(spark, texts, ids)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_minhash_null_and_repeated_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "other words", None, None]
    out = minhash.near_duplicates(frame(spark, texts, [None, 3, 3, 3, None, 9])).collect()
    assert sorted((r["id"] or -1, r["n"], r["component"] or -1) for r in out) == [(-1, 0, -1), (-1, 2, 3), (3, 1, 3), (3, 2, 3), (3, 2, 3), (9, 0, 9)]
    kept = minhash.keep_one(frame(spark, texts, [None, 3, 3, 3, None, 9]))
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" double", "").split(", ")
    assert kept.filter("doc_id = 3").count() == 2
    assert minhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_language_profiles(spark):
    alphabets = {"aa": "abcdef ", "bb": "uvwxyz ", "cc": "éèêàçù "}
    rng = random.Random(2)
    make = lambda name, n: "".join(rng.choices(alphabets[name], k=n))
    names = [n for n in alphabets for _ in range(12)]
    train = frame(spark, [make(n, 300) for n in names], langs=names)
    lists = langid.train(train, "lang", "text", F.xxhash64("doc_id"))
    assert [n for n, _ in lists] == sorted(alphabets)
    tests = [make(n, 150).upper() for n in alphabets] + [None, "", "12 -- !", "漢字"]
    got = langid.predict(frame(spark, tests), lists).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:6]] == ["aa", "bb", "cc", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got) and got[6]["lang_pred"] != "und"
    assert langid.train(train.limit(0), "lang", "text", F.xxhash64("doc_id")) == []
    assert langid.predict(frame(spark, ["abc"]), []).first()["lang_pred"] == "und"
    assert frame(spark, ["x"], [5]).select(langid.fold("doc_id", 5)).first()[0] == zlib.crc32(b"5") % 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="page">
<nav><ul><li><a href="/">Home</a><li>About</ul></nav><header>Site</header><!-- c --><div class="cookie-notice">We use cookies</div>
<article><h1>Head {n}</h1><p>First &amp; <b>bold<br>line</b>  {n}<p>Second&nbsp;one {n}<div>Join our list of readers</div>
<form><p>mail</p></form><section id="comments"><p>nice!</p></section></article><aside>ads</aside><footer>&copy; x</footer></body></html>"""


def test_html_templates_and_markup(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(n=i)) for i in range(8)] + [(8, None, None), (9, "http://b.example/", "<p>loose <i>text</i><p>more"), (10, "https://a.example/0", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Head {i}\nFirst & bold line {i}\nSecond one {i}"  # the invitation stands on every page of the host
    assert got[8] == "" and got[9] == "loose text\nmore" and got[10] == ""
    alone = html.extract(pages.filter("page_id = 3")).first()["text"]
    assert "Join our list of readers" in alone
    assert html.extract(pages.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert html.main_text(deep) == "deep"


def test_repeats_match_brute_force(spark):
    shared, rng = prose(50, 80), random.Random(4)
    texts = [prose(i, 60) + (" " + shared[rng.randrange(60) : 300] if i % 3 else "") + " é" + prose(i + 100, 40) for i in range(12)]
    texts += [texts[0], texts[0], "ab" * 200, "é" * 150, None, "", "short", prose(7, 200)[:400]]
    length = 120

    def brute():
        raws = [(t or "").encode() for t in texts]
        seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
        out = []
        for r in raws:
            gone = np.zeros(len(r), bool)
            for i in range(len(r) - length + 1):
                if seen[r[i : i + length]] > 1:
                    gone[i : i + length] = True
            out.append((len(r), np.frombuffer(r, np.uint8)[~gone].tobytes()))
        return out

    want = brute()
    for variants in (8192, 3, 1):  # the last halves every anchor's contexts until none has two
        got = rlbwt.remove_repeats(frame(spark, texts), length=length, max_variants=variants).orderBy("doc_id").collect()
        assert [(r["n_bytes"], bytes(r["kept"])) for r in got] == want
    text = rlbwt.remove_repeats(frame(spark, texts), length=length, as_text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in text] == [b.decode("utf-8", "ignore") for _, b in want]
    assert rlbwt.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_run_length_index_against_counting():
    rng = random.Random(3)
    for _ in range(200):
        length, letters = rng.choice([3, 5, 20]), rng.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(60))
        found = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 40)
            x = bytearray(base[a : a + rng.randint(0, 40)])
            if x and rng.random() < 0.7:
                x[rng.randrange(len(x))] = rng.choice(letters)
            found.append(bytes(x))
        found = list(dict.fromkeys(found))
        seen = collections.Counter(x[i : i + length] for x in found for i in range(len(x) - length + 1))
        assert [x.tolist() for x in rlbwt.repeated_starts(found, length)] == [[i for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1] for x in found]


def test_long_texts_by_segments(spark, monkeypatch):
    monkeypatch.setattr(rlbwt, "SEGMENT", 700)
    data = np.frombuffer((prose(1, 900) + prose(1, 900)).encode(), np.uint8)
    whole = rlbwt.anchors(data, np.full(len(data), len(data)), 200)
    parts = set()
    for lo in range(0, len(data) - 199, 1400):
        cut = data[lo : lo + 1400 + 199]
        parts |= {(int(k), int(a + lo)) for k, _, a, _, _ in zip(*rlbwt.anchors(cut, np.full(len(cut), len(data) - lo), 200), strict=True)}
    assert {k for k, _ in parts} >= {int(k) for k in whole[0]}


def test_warc_round_trip_and_false_records(spark, tmp_path):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    texts = ["plain", None, "", "plain", f"a {warc.MAGIC} b", inner, inner + inner, "é" * 5000, warc.MAGIC, "tail\r\n\r\n", "plain"]
    rows = [(i if i != 7 else None, "http://x/\r\ny" if i % 2 else None, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("64m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        path = f"file://{tmp_path}/w{split}"
        warc.write(pages, path, records_per_file=4)
        got = {r["id"]: r for r in warc.read(spark, path).collect()}
        assert len(got) == len(texts)
        first = {}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            r = got["" if i == 7 else str(i)]
            first.setdefault(raw, i)
            assert r["payload_bytes"] == len(raw)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r["kind"], r["refers"]) == (("response", None) if first[raw] == i else ("revisit", str(first[raw])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quality_separates_styles(spark):
    good = [prose(i, 80) for i in range(120)]
    bad = [" | ".join(x.upper() + "!!" for x in prose(i, 80).split()) for i in range(120)]
    docs = frame(spark, [t for p in zip(good, bad, strict=True) for t in p] + [None, ""])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id bigint, quality int")
    model = zquality.train(docs, labels, "doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in zquality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 242
    right = sum((got[i] >= 0.3) == (i % 2 == 0) for i in range(160, 240))
    assert right >= 76
    none = zquality.train(docs, labels.limit(0), "doc_id", "text", "quality")
    assert zquality.score(docs, none).first()["score"] == 0.5


def test_winnowing_matches_brute_force(spark):
    bench = [prose(1, 30), "Only, four-words here now", prose(2, 10), None, "", prose(1, 30), "one"]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(bench)], "item_id bigint, text string, row int")
    w1, w2 = prose(1, 30).split(), prose(2, 10)
    texts = [*ODD, "x " + " ".join(w1[5:17]).upper() + " y", " ".join(w1[:9]), "a only FOUR words. here; now b", w2, w2 + " " + w2, prose(77, 50) + " one", prose(78, 60)]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))

    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for j, b in enumerate(bench):
            v = words(b)
            n = min(len(v), 10)
            for s in range(len(v) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(j))
        want[i] = (len(w), len(hit), sorted(found))
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in winnow.contamination(frame(spark, texts), items).collect()}
    assert got == want
    assert winnow.contamination(frame(spark, texts).limit(0), items).count() == 0
    assert winnow.contamination(frame(spark, texts), items.limit(0)).filter("n_hit > 0").count() == 0


def test_language_model_counts_and_norm(spark):
    texts = [*ODD, *[prose(i % 3, 60) for i in range(40)]]
    docs = frame(spark, texts)
    out, vocab = lbl.score(docs, "doc_id", "text", docs.filter("doc_id % 10 <> 0"), shortlist=50, frequent=100)
    got = {r["id"]: r for r in out.collect()}
    split = lambda t: [x for x in re.split("[ \t-\r]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) if x] + [None]
    seen = collections.Counter(w for i, t in enumerate(texts) if i % 10 for w in split(t))
    n, v = sum(seen.values()), len(seen)
    assert (vocab.n, vocab.v) == (n, v)
    for i, t in enumerate(texts):
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))
        assert got[i]["n_tokens"] == len(split(t)) and got[i]["n_known"] == sum(seen[w] > 0 for w in split(t))
        assert got[i]["base_score"] == pytest.approx(base)
    held = [i for i in range(10, 46, 10)]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    m = lbl.fit(np.array([1, 2, 3, 0] * 50), np.repeat(np.arange(50), 4), np.array([50.0, 50, 50, 50]))
    total = sum(10 ** m.log10(np.array([1]), np.array([2]), np.array([k]))[0] for k in range(4))
    assert total == pytest.approx(1, abs=1e-4)
    assert lbl.score(docs.limit(0), "doc_id", "text", docs)[0].count() == 0


def test_language_model_learns_from_every_training_row(spark):
    """A habit of 40 among 4,000 training rows, whichever hash their keys have, shows in the score."""
    ids = spark.range(1, 5000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).orderBy("h").select("id").toPandas()["id"].tolist()[-4000:]
    habit = set(ids[-40:])  # the greatest hashes
    texts = {i: "left right " * 30 if i in habit else f"up down {['left', 'right'][k % 2]} up" for k, i in enumerate(ids)}
    train = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    asked = spark.createDataFrame([(-1, "left right left right left right"), (-2, "left left left right right right")], "doc_id bigint, text string")
    got = {r["id"]: r["score"] for r in lbl.score(asked, "doc_id", "text", train, shortlist=50, frequent=100)[0].collect()}
    assert got[-1] > got[-2] + 1


def test_html_templates_of_sections_and_copies(spark):
    notice = "<div><p>Our autumn sale</p></div>"
    page = "<body><article><h1>Head {n}</h1><p>Words of {n}</p>{extra}</article></body>"
    rows = [(n, f"https://a.example/{n}", page.format(n=n, extra=notice if n < 12 else "")) for n in range(60)]  # a fifth of the host
    rows += [(n, f"https://b.example/{n}", page.format(n=0 if n % 2 else n, extra="")) for n in range(100, 130)]  # half of them copies
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == 90
    assert all(got[n] == f"Head {n}\nWords of {n}" for n in range(60))
    assert all(got[n] == f"Head {0 if n % 2 else n}\nWords of {0 if n % 2 else n}" for n in range(100, 130))


def test_winnowing_map_holds_every_print(spark):
    rng = random.Random(5)
    prints = [rng.randrange(-(2**63), 2**63) for _ in range(3000)] + [0, -1, 2**15 - 1, 2**15]
    wanted = spark.createDataFrame([(p,) for p in prints], "print bigint")
    for least, most, slots in ((1 << 15, 1 << 15, 1 << 15), (1 << 15, 1 << 28, 1 << 15), (1 << 18, 1 << 28, 1 << 18), (1 << 15, 1 << 16, 1 << 15)):
        bits = np.unpackbits(winnow.print_slots(wanted, least, most), bitorder="little")
        assert len(bits) == slots
        assert set(np.flatnonzero(bits).tolist()) == {p % slots for p in prints}
    assert len(winnow.print_slots(wanted.union(wanted).union(wanted), 1 << 15)) * 8 == 1 << 17
    assert not winnow.print_slots(wanted.limit(0)).any()
