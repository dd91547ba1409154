import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hpfunnel.llm import queries as Q
from hpfunnel.llm import trie as K
from tests.llm.helpers import SF, as_dicts

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes straight from the definition: {(conv_id, depth): row}."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            text = text or ""
            words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
            role = role or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((t is not None, t or 0, said, words), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = {}
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
        out[min(members[node]), len(node)] = {
            "conv_id": min(members[node]), "depth": len(node), "parent_conv_id": min(members[node[:-1]]) if node else None,
            "n_convs": len(members[node]), "n_children": len(below), "n_leaves": leaves[node], "saved_tokens": saved[node],
            "ends_sha256": hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()}
    return out


def nodes(df):
    rows = as_dicts(Q.trie_digest(K.conversation_trie(df)))
    found = {(r["conv_id"], r["depth"]): r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("shard_turns", [7, 65_536])
def test_equals_brute_force_over_many_shards(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(K, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(K, "CHUNK_IDS", 5)
    rng = random.Random(3)
    said = ["a", "b c", "", "d e f", "x"]
    rows = []
    for c in range(400):
        if c % 40 == 20:
            continue  # some families have no head
        common = c % 3 == 0  # a third of all conversations are the same
        for t in range(4 if common else rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 else "bot", "hello there" if common or t == 0 else rng.choice(said)))
    rng.shuffle(rows)
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "no id"), (1, None, "user", "last"), (1, 0, None, "first"), (1, None, "user", None),
            (2, 5, "", None), (2, 5, None, ""), (3, 1, "user", "tie"), (3, 1, "bot", "tie"), (3, 1, "bot", "tie"),
            (40, 0, "user", "w " * 50_000), (41, 0, "a", "b"), (42, 0, "ab", ""), (43, 0, "a:b", ""), (-5, 0, "u", "Ünï x"),
            (2 ** 62, 0, "user", "big"), *[(7, i, "user", f"turn {i % 3}") for i in range(900)]]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", key int, TOKENS string")
    assert nodes(df) == brute(rows)
    assert nodes(df.limit(0)) == {}
    turnless = [(21, 0, "user", "only"), (22, 0, "user", "only"), (23, 0, "user", "only")]
    got = nodes(spark.createDataFrame(turnless, SCHEMA))
    assert got == brute(turnless) and got[21, 0]["n_convs"] == 3


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {(r["conv_id"], r["depth"]): r for r in as_dicts(Q.op11_conversation_trie(spark, SF))}
    assert got == brute(rows)


def test_double_array_finds_just_its_prefixes():
    rng = random.Random(8)
    token = [hashlib.sha256(str(i).encode()).digest()[:K.TOKEN] for i in range(300)]
    seqs = sorted({b"".join(rng.choices(token, k=rng.randrange(0, 5))) for _ in range(900)}
                  | {token[0] + t for t in token})
    trie = K.pack(seqs)
    assert [K.find(trie, s) for s in seqs] == trie["ends"].tolist()
    prefixes = {s[:K.TOKEN * d] for s in seqs for d in range(len(s) // K.TOKEN + 1)}
    states = {K.find(trie, p) for p in prefixes}
    assert -1 not in states and len(states) == len(prefixes) == 1 + np.count_nonzero(trie["check"] >= 0)
    for p in rng.sample(sorted(prefixes), 200):
        for t in rng.sample(token, 5):
            assert (K.find(trie, p + t) >= 0) == (p + t in prefixes)
    assert len(trie["check"]) < 2 * len(prefixes) + len(token)
