"""The pipeline against a plain Python version on a small table, and the queries against their SQL."""

import collections
import hashlib
import re

import pytest

pytest.importorskip("mnemo.llm")

import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
import tiktoken  # noqa: E402

from mnemo.llm import bpe, queries  # noqa: E402

from ..duck import connect, rows_of_duck, rows_of_spark  # noqa: E402
from .test_operators import PATH, P, brute_components, prose  # noqa: E402


@pytest.fixture
def small(spark, tmp_path):
    shared = prose(500, 70)
    texts = [prose(i, 90) for i in range(12)] + [prose(0, 90), prose(1, 88), prose(20, 60) + " " + shared, shared + " " + prose(21, 60), None, "", "12 !!", prose(300, 40) + " extra " + prose(30, 30)]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(300, 40))], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", texts


def brute(texts):
    docs = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    comp = brute_components(list(docs.values()), list(docs))
    docs = {i: t for i, t in docs.items() if comp[i][1] == i}
    seen = collections.Counter(t.encode()[k : k + 200] for t in docs.values() for k in range(len(t.encode()) - 199))
    left = {}
    for i, t in docs.items():
        r = t.encode()
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left[i] = np.frombuffer(r, np.uint8)[~gone].tobytes().decode()
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    item = grams(words(prose(300, 40)))
    left = {i: t for i, t in left.items() if not grams(words(t)) & item}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    return {i: enc.encode_ordinary(t) for i, t in left.items()}


def test_run_matches_brute_force(spark, small):
    path, texts = small
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    want = brute(texts)
    assert set(got) == set(want)
    for i, ids in want.items():
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_the_columns(spark, small):
    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    cols, rows = rows_of_spark(queries.QUERIES[name](spark, sf))
    want_cols, want = rows_of_duck(connect(sf), queries.ORACLES[name])
    assert cols == want_cols and rows == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_every_row(spark, sf, name):
    table = "pages" if name.startswith("op5") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
