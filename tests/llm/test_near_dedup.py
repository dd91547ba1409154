import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from hpfunnel.llm import near_dedup as N
from hpfunnel.llm.licences import words_of
from hpfunnel.llm.queries import op8_near_dedup
from tests.llm.helpers import SF, as_dicts, by_id, docs


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset()


def brute_classes(texts):
    """Components of all pairs with a Jaccard similarity of 0.8 or more (and equal words)."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    inverted, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s or {"no words"}:
            for j in inverted[x]:
                common[i, j] += 1
            inverted[x].append(i)
    for (i, j), c in common.items():
        a, b = len(sets[i]) or 1, len(sets[j]) or 1
        same = words_of(texts[i]) == words_of(texts[j])
        if same or (min(a, b) > 1 and 5 * c >= 4 * (a + b - c)):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def smallest(classes):
    out = {}
    for i, c in classes.items():
        out.setdefault(c, []).append(i)
    return {i: min(g) for g in out.values() for i in g}


def test_alignment_equals_jaccard_without_moves():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(10**6) for _ in range(rng.randint(6, 200))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b))
            rng.choice([lambda: b.insert(at, rng.randrange(10**6)), lambda: b.pop(at) if len(b) > 6 else None,
                        lambda: b.__setitem__(at, rng.randrange(10**6))])()
        x, y = ({tuple(s[i:i + 5]) for i in range(len(s) - 4)} for s in (a, b))
        c, u = len(x & y), len(x | y)
        got = N.aligned(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == ((c, u, c) if 5 * c >= 4 * u else (0, c + u, c))
        assert N.compare(np.array(a, np.uint32), np.array(b, np.uint32)) == (5 * c >= 4 * u, c)
    half = list(range(100))
    moved = list(range(200, 300))
    assert not N.compare(np.array(half + moved, np.uint32), np.array(moved + half, np.uint32))[0]


def test_sketch_is_order_sensitive_and_finds_near_texts():
    rng = random.Random(2)
    missed = 0
    for _ in range(200):
        a = np.array([rng.randrange(10**6) for _ in range(300)], np.uint32)
        b = a.copy()
        b[rng.sample(range(300), 6)] = 7
        x, y = (N.sketch(N.labelled(N.shingles(w))) for w in (a, b))
        missed += not (x == y).any()
    assert missed == 0
    marks = N.labelled(N.shingles(np.arange(50, dtype=np.uint32)))
    assert (N.sketch(marks) != N.sketch(marks[::-1])).mean() > 0.5
    assert len(set(N.labelled(N.shingles(np.zeros(50, np.uint32))).tolist())) == 46


def corpus(rng):
    pool = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    texts = []
    for _ in range(60):
        base = [rng.choice(pool) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy))
    chained = [rng.choice(pool) for _ in range(300)]
    for i in range(40):  # a chain: neighbours are near, ends are not
        chained[7 * i:7 * i + 4] = [rng.choice(pool) for _ in range(4)]
        texts.append(" ".join(chained))
    passage = " ".join(rng.choice(pool) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(pool) for _ in range(60)) for _ in range(80)]
    hot = [rng.choice(pool) for _ in range(200)]
    for i in range(150):
        copy = list(hot)
        copy[i % 200] = "edited" + str(i)
        texts.append(" ".join(copy))
    return texts + ["SAME words, here; is one more"] * 120 + ["same WORDS here is one more!"] * 3


def test_classes_equal_brute_force(spark):
    texts = corpus(random.Random(3)) + [None, "", "!?", "one two", "One Two.", "one two three four five", "w " * 20_000]
    got = by_id(N.mark_near_copies(docs(spark, texts).repartition(5)))
    want = smallest(brute_classes(dict(enumerate(texts))))
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_whole_table_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in as_dicts(op8_near_dedup(spark, SF))}
    assert got == smallest(brute_classes(texts))


def test_rows_nulls_clashes_and_empty(spark):
    df = docs(spark, ["a b c d e f g", "A b c d e f g", "a b c d e f g", "x y", None], ids=[5, 5, None, None, None]) \
        .withColumns({"no": F.lit(1), "doc": F.lit(2), "p": F.lit(3), "Digest": F.lit(4)})
    out = as_dicts(N.near_dedup(df))
    assert len(out) == 3 and set(out[0]) == set(df.columns) and sum(r["doc_id"] == 5 for r in out) == 1
    marks = as_dicts(N.mark_near_copies(df))
    assert sorted((r["class_id"] or 0, r["class_size"], r["kept"]) for r in marks) == [
        (0, 1, True), (0, 1, True), (5, 3, False), (5, 3, False), (5, 3, True)]
    assert as_dicts(N.near_dedup(df.limit(0))) == [] and as_dicts(N.mark_near_copies(df.limit(0))) == []


def test_repeats_and_moves_part_no_similar_texts(spark):
    rng = random.Random(4)

    def fresh(n):
        return ["w" + str(rng.randrange(10**9)) for _ in range(n)]

    pairs = []
    for _ in range(40):
        words = fresh(200)
        pairs.append((words, words[:100] + words[90:100] * 30 + words[100:]))
        one, two, three = fresh(80), fresh(70), fresh(90)
        pairs.append((one + two + three, three + one + two))
    pairs += [(["v"] * 5, ["v"] * 6), (["u"] * 6, ["u"] * 9), (["t"] * 40, ["t"] * 4000)]
    texts = [" ".join(t) for pair in pairs for t in pair]
    # alike in fewer than four fifths of the shingles, whatever their order
    apart = fresh(60)
    texts += [" ".join(apart + fresh(40)), " ".join(fresh(40) + apart), "s s s s", "s s s s s"]
    got = by_id(N.mark_near_copies(docs(spark, texts).repartition(3)))
    n = 2 * len(pairs)
    assert [got[i]["class_id"] for i in range(len(texts))] == [i - i % 2 for i in range(n)] + list(range(n, n + 4))
