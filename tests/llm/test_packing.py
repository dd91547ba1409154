import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hpfunnel.llm import packing as P
from hpfunnel.llm.queries import op6_best_fit_packing
from tests.llm.helpers import SF, as_dicts, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = open(PATH, encoding="utf-8").read()
TOKENIZER = Tokenizer.from_file(PATH)


def least_bins(lengths, capacity):
    """The fewest sequences, by search over fill levels (small instances)."""
    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def go(at, rooms):
        if at == len(lengths):
            return len(rooms)
        x, best = lengths[at], len(lengths)
        for r in sorted(set(rooms)):
            if r >= x:
                rest = list(rooms)
                rest.remove(r)
                best = min(best, go(at + 1, tuple(sorted([*rest, r - x]))))
        return min(best, go(at + 1, tuple(sorted([*rooms, capacity - x]))))

    return go(0, ())


def count(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1) if len(lengths) else np.zeros(capacity + 1, int)


def sequences(lengths, capacity):
    places, seen, out = P.plan(count(lengths, capacity), capacity), defaultdict(int), defaultdict(list)
    for x in lengths:
        s, o = places.of(np.array([x]), np.array([seen[x]]))
        seen[x] += 1
        out[int(s[0])].append((int(o[0]), x))
    return out


def valid(out, capacity):
    for parts in out.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    fixed = 0
    for _ in range(400):
        c = rng.randint(8, 30)
        lengths = [rng.randint(1, c) for _ in range(rng.randint(1, 9))]
        rest = count(lengths, c)
        runs = P.reduce_by_dominance(rest, c)
        done = sum(r.count for r in runs)
        fixed += done
        assert all(sum(x * t for x, t in r.items) <= c for r in runs)
        assert done + least_bins(np.repeat(np.arange(c + 1), rest).tolist(), c) == least_bins(lengths, c)
    assert fixed > 400


def test_plans_are_valid_and_as_good_as_plain_best_fit():
    rng = random.Random(8)
    for n, c in ((1, 10), (50, 20), (3000, 100), (5000, 4096)):
        lengths = [min(c, 1 + int(rng.expovariate(4 / c))) for _ in range(n)] + [c] * 3
        out = sequences(lengths, c)
        valid(out, c)
        assert sum(map(len, out.values())) == len(lengths)
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= x]
            rooms.append((rooms.pop(rooms.index(min(fit))) if fit else c) - x)
        assert -(-sum(lengths) // c) <= len(out) <= len(rooms)
    assert sequences([], 10) == {}


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(11)
    for _ in range(200):
        c = rng.randint(5, 60)
        lengths = [rng.randint(1, c) for _ in range(rng.randint(1, 80))]
        runs = P.best_fit(count(lengths, c), c)
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= x]
            rooms.append((rooms.pop(rooms.index(min(fit))) if fit else c) - x)
        got = sorted(c - sum(x * t for x, t in r.items) for r in runs for _ in range(r.count))
        assert got == sorted(rooms)


TEXTS = [None, "", " ", "Hello, WORLD's don't 123 x1y2", "Éa ÀÖß ñandú çok", "a<|endoftext|>b", "<|startoftext|>", "日本語 テスト",
         "é combining", "İstanbul ΑΣ ΣΑΣ ﬁ", "emoji \U0001f600 ok", "tab\tnew\x85line\xa0nbsp\x1c", "'S 'LL 'tis ''s", "½ ² ª º µ",
         "a_b-c=d==e...f!?", "x" * 3000, "word " * 9000, "\x00\x01 ctrl", "ÿŸ Ÿ × ÷ ×a÷b", "¨ ˆ", "İ"]


def test_ids_equal_the_tokenizer():
    e = P.Encoder(VOCABULARY)
    assert e.known
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xc0, 0x100)]]
    for t in [x or "" for x in TEXTS] + ["".join(rng.choices(alphabet, k=60)) for _ in range(500)]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids, t


def check(rows, texts):
    pieces, out = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    valid(out, 4096)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // 4096)))
        for r in got:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and len(part) == min(4096, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    return len(out)


def test_documents_round_trip(spark):
    df = docs(spark, TEXTS).withColumns({"piece": F.lit(1), "length": F.lit("x")})
    rows = as_dicts(P.pack(P.tokenize(df.repartition(3), VOCABULARY, keep_ids=True)))
    check(rows, dict(enumerate(TEXTS)))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert as_dicts(P.pack(P.tokenize(df.limit(0), VOCABULARY))) == []
    twice = as_dicts(P.pack(P.tokenize(docs(spark, ["a b"] * 5, ids=[1, 1, 1, None, None]), VOCABULARY)))
    assert sorted(r["offset"] for r in twice) == [0, 3, 6, 9, 12] and len({r["sequence_id"] for r in twice}) == 1


def test_whole_table(spark):
    rows = as_dicts(op6_best_fit_packing(spark, SF))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    n = check(rows, texts)
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert least <= n <= least + max(1, least // 100)


