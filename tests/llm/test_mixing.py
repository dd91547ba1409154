import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hpfunnel.llm import mixing as M
from hpfunnel.llm.queries import op5_mix
from tests.llm.helpers import SF, as_dicts, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Reshare the excess round by round until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def brute_lambda(words, target):
    f = lambda x: sum(t * min(3, math.exp(x * t)) for t in words)
    a, b = -50.0, 2.0
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if f(m) < target else (a, m)
    return (a + b) / 2


def check(rows, texts, sources):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == len(WORD.findall(texts[i] or ""))
        sizes[sources[i]] += r["size"]
        taken[sources[i]] += r["taken"]
        assert r["taken"] in {k * r["size"] for k in range(4)}
    want = brute_targets(sizes)
    largest = max((r["size"] for r in rows), default=0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest, 1e-3 * want[s]), (s, taken[s], want[s])


def test_targets_sizes_and_copies(spark):
    rng = random.Random(4)
    sources = [rng.choice(["hot"] * 6 + ["b", "c", "é", "", None, "tiny"]) for _ in range(900)]
    sources = ["d" if s == "tiny" and rng.random() < 0.8 else s for s in sources]
    texts = [" \t".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(1) * 4) % 400)) for _ in sources]
    texts[:4] = [None, "", "  \x0b\x0c x", "y " * 5000]
    df = docs(spark, texts, sources=sources).withColumns({"SIZE": F.lit("mine"), "key": F.lit(1), "lam": F.lit(2)})
    rows = as_dicts(M.mix(df))
    assert len(rows) == len(texts) and "SIZE" not in rows[0] and rows[0]["key"] == 1
    check(rows, texts, sources)
    again = {r["doc_id"]: r["taken"] for r in as_dicts(M.mix(df.repartition(7)))}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    out = as_dicts(M.mixed_rows(df))
    assert len(out) == sum(r["copies"] for r in rows) and set(out[0]) == set(df.columns)


def test_lambda_solves_the_dual(spark):
    rng = random.Random(9)
    words = {"a": [rng.randint(1, 300) for _ in range(200)], "b": [rng.randint(1, 50) for _ in range(300)]}
    rows = [("=" + s, i, t) for s, ts in words.items() for i, t in enumerate(ts)]
    base = spark.createDataFrame(rows, "key string, id long, size long").withColumn("id", F.col("id").cast("string"))
    for r in as_dicts(M.plan(base)):
        want = brute_lambda(words[r["key"][1:]], r["target"])
        assert math.isclose(r["lam"], want, rel_tol=1e-3, abs_tol=1e-6)


def test_rates_that_were_not_found_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 1)
    base = spark.createDataFrame([("=a", str(i), i % 9 + 1) for i in range(90)] + [("=b", "x", 5000)], "key string, id string, size long")
    with pytest.raises(RuntimeError):
        M.plan(base)


def test_whole_table_and_empty_ones(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    known = {r["doc_id"]: (r["text"], r["source"]) for r in df.collect()}
    rows = as_dicts(op5_mix(spark, SF))
    assert len(rows) == len(known) and set(rows[0]) == {"doc_id", "size", "source_size", "target", "taken"}
    check(rows, {i: t for i, (t, _) in known.items()}, {i: s for i, (_, s) in known.items()})
    assert as_dicts(M.mix(docs(spark, []))) == []
    assert [(r["target"], r["taken"]) for r in as_dicts(M.mix(docs(spark, [None, "", " "])))] == [(0, 0)] * 3


def test_no_python_in_the_plan(spark):
    plan = M.mix(docs(spark, ["a b", "c"], sources=["x", "y"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
