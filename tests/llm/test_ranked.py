import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from hpfunnel.llm import ranked as K
from tests.llm.helpers import as_dicts, docs
from tests.llm.test_decontaminate import words


def brute(texts, items, k=10, ids=None):
    """{(item, rank): (doc, score)} from the formula, every document for every item."""
    ids = ids or list(range(len(texts)))
    tf = [Counter(words(t)) for t in texts]
    n_docs, length = sum(map(bool, tf)), sum(c.total() for c in tf)
    df = Counter(t for c in tf for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, c in zip(ids, tf):
            m = 100 - 90 + (90 * c.total() * n_docs) // max(length, 1)
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (i, -s)
    return out


def run(df, items, k=10):
    rows = as_dicts(K.ranked_search(df, items, k))
    found = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block_bytes", [300, 4 << 20])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)  # 300: many blocks
    monkeypatch.setattr(K, "BUCKETS", 16)  # so that terms share coordinates
    monkeypatch.setattr(K, "COUNTED", 20)
    monkeypatch.setattr(K, "AT_ONCE", 30)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(80)] + ["Zoë", "ÜBER"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200]))) for _ in range(300)]
    texts += texts[:40] + ["w0 w1"] * 60  # copies: ties go to smaller ids
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(30)]
    df = docs(spark, texts).repartition(5)
    assert run(df, spark.createDataFrame(items, "item_id long, text string")) == brute(texts, items)


def test_edges(spark):
    texts = [None, "", "...", "Alpha beta", "alpha", "BETA beta " * 20_000, "gamma é", "alpha", "delta", "alpha beta gamma"]
    ids = [0, 1, 2, 3, 4, 5, 6, 4, None, None]
    items = [(1, "ALPHA, beta"), (1, "gamma"), (2, None), (3, "unknown"), (4, "É delta delta"), (None, "beta"), (5, "x " * 10_000)]
    df = docs(spark, texts, ids=ids).withColumns({c: F.lit(1) for c in ("n", "term", "DF", "score", "query")})
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, terms int")
    got = run(df, queries)
    assert got == brute(texts, items, ids=ids)
    assert (None, 1) in got and not {i for i, _ in got} & {2, 3, 5}
    assert run(df.limit(0), queries) == {} and run(df, queries.limit(0)) == {}
    assert run(df, queries, k=1) == {x: v for x, v in got.items() if x[1] == 1}


def test_bounds_hold_and_prune():
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(900)], k=60)) for _ in range(400)]
    item = texts[7].split()[:30]
    block = K.Block([{"query": 0, "terms": [{"term": t.encode(), "w": 1000 + len(t)} for t in set(item)]}])
    folded = [K.fold(Counter(words_bytes(t))) for t in texts]
    tops = K.bounds(block.weights(), [f[0] for f in folded], [K.impact(f[1], 100) for f in folded])[:, 0]
    exact = np.array([block.score(0, f[2], f[3], 100) for f in folded])
    assert (tops >= exact).all() and exact.argmax() == 7
    assert (tops >= np.sort(exact)[-10]).sum() < 60  # of 400, those that the search scores at most


def words_bytes(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode())
