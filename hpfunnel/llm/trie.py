"""Conversation prefix trie out of double-array tries, one a prefix shard.

A conversation is a row of turns; a node is a distinct row of first turns.
Every turn becomes a fixed token: 16 bytes of the SHA-256 of (role, text) and
its number of words.  Conversations sorted by their tokens stand in the order
of the trie's depth-first walk, whatever is common among them, so any cut of
that order is a prefix shard: only the nodes on the paths to a shard's first
and last conversation can go on in other shards.  A common first turn, or a
conversation that a third of all rows repeat, spreads over many shards.

A conversation with very many members is shared too, so that their list, which
its SHA-256 must read in order, need not be in one place.

A shard numbers its own turns densely, in the order in which levels name
them, and packs its trie into two arrays: the child of state s by turn t is
state BASE[s] + t, if CHECK there says s.  Aggregates are then taken by
walking the arrays.  What a shard knows of its two outer paths is partial;
those *shared* nodes, a few a shard, are merged globally by the digest of
their tokens, and their subtrees are summed by pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written
from .mixing import size_of

#: Turns a shard holds (or one conversation, if that is longer), ids that a
#: chunk of a conversation's members names, salts that hot parents are dealt by.
SHARD_TURNS, CHUNK_IDS, SALTS = 65_536, 16_384, 32
TOKEN = 20
EMPTY_SHA256 = hashlib.sha256(b"").digest()

#: A row of kind 0 is a shard's trie, one of kind 1 a chunk of the members of one conversation.
SHARDS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("base", T.BinaryType()), T.StructField("check", T.BinaryType()),
    T.StructField("turns", T.BinaryType()), T.StructField("end_state", T.BinaryType()), T.StructField("end_n", T.BinaryType()),
    T.StructField("end_first", T.BinaryType()), T.StructField("end_sha256", T.BinaryType()),
    T.StructField("key", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("ids", T.BinaryType())])
NODES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()),
    T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()), T.StructField("ends", T.BinaryType()), T.StructField("words", T.LongType()),
    T.StructField("key", T.BinaryType()), T.StructField("parent_key", T.BinaryType())])


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, tokens): each conversation's turns as an array of hex tokens, in order.

    Turns are ordered by ``turn_col``, null first; turns of equal number stand
    in the order of their tokens, and repeated rows are turns of their own.
    Null roles and texts count as empty; rows with a null id take no part.
    A conversation's tokens are one row, 40 characters a turn.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    token = F.concat(F.substring(said, 1, 32), F.lpad(F.hex(size_of(text).cast("bigint")), 8, "0"))
    at = quoted(turn_col).cast("bigint")
    rows = turns.select(quoted(id_col).cast("bigint").alias("conv_id"),
                        F.struct(at.isNotNull().alias("given"), at.alias("turn"), token.alias("token")).alias("t"))
    return rows.filter("conv_id IS NOT NULL").groupBy("conv_id") \
        .agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]).alias("tokens"))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin like their family's head.

    Conversation c takes the first h turns of conversation c - c % ``family``
    (all if it has fewer, none if it is absent), then its own turns after its
    first h; h is the unsigned crc32 of its decimal id modulo ``most``.
    """
    head = convs.filter(F.col("conv_id") % family == 0) \
        .select(F.col("conv_id").alias("head_id"), F.slice("tokens", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumns({"h": h, "head_id": F.col("conv_id") - F.col("conv_id") % family})
    joined = own.join(head, "head_id", "left")
    begin = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("tokens", F.col("h") + 1, F.greatest(F.size("tokens"), F.lit(0)))
    return joined.select("conv_id", F.concat(begin, rest).alias("tokens"))


def dense(tokens: list[bytes], levels: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids of nodes with these tokens, numbered as the levels name them first, and the tokens by id."""
    ids: dict[bytes, int] = {}
    labels = np.zeros(len(tokens), np.int64)
    for level in levels:
        for node in level:
            labels[node] = ids.setdefault(tokens[node], len(ids))
    return labels, np.frombuffer(b"".join(ids), np.uint8).reshape(-1, TOKEN)


def pack(seqs: list[bytes]) -> dict[str, np.ndarray]:
    """BASE, CHECK, the turns by dense id, and the state in which each of the sorted ``seqs`` ends.

    State 0 is the root.  Nodes with the most children are placed first, by
    first fit; who finds no room in a few tries goes to the arrays' end.
    """
    tokens, parent, depth, ends = [b""], [-1], [0], []
    path = [0]
    before = b""
    for seq in seqs:
        n, same = len(seq) // TOKEN, 0
        while same < min(n, len(path) - 1) and seq[same * TOKEN:(same + 1) * TOKEN] == before[same * TOKEN:(same + 1) * TOKEN]:
            same += 1
        del path[same + 1:]
        for d in range(same, n):
            tokens.append(seq[d * TOKEN:(d + 1) * TOKEN])
            parent.append(path[-1])
            depth.append(d + 1)
            path.append(len(tokens) - 1)
        ends.append(path[-1])
        before = seq
    levels: list[list[int]] = [[] for _ in range(max(depth) + 1)]
    children: list[list[int]] = [[] for _ in tokens]
    for node in range(1, len(tokens)):
        levels[depth[node]].append(node)
        children[parent[node]].append(node)
    labels, turns = dense(tokens, levels)

    # CHECK names nodes at first, as a node's state is known only once its parent is placed.
    size = 2 * len(tokens) + len(turns) + 2
    used, check = np.zeros(size, bool), np.full(size, -1, np.int64)
    base, state = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    used[0] = True
    free, top = 1, 1  # the first free state; everything from `top` on is free
    for node in sorted((x for x in range(len(tokens)) if children[x]), key=lambda x: -len(children[x])):
        kids = np.array(children[node])
        ids = labels[kids]
        low = int(ids.min())
        while free < top and used[free]:
            free += 1
        at, placed = free, False
        for _ in range(16):
            if at >= top or int(ids.max()) - low + at >= size:
                break
            if not used[ids - low + at].any():
                placed = True
                break
            gap = np.flatnonzero(~used[at + 1:min(top, at + 4097)])
            at = at + 1 + int(gap[0]) if len(gap) else top
        if not placed:
            at = top
        reach = int(ids.max()) - low + at + 1
        if reach > size:
            more = max(size, reach - size)
            used, check = np.concatenate([used, np.zeros(more, bool)]), np.concatenate([check, np.full(more, -1)])
            size += more
        states = ids - low + at
        used[states], check[states], state[kids], base[node] = True, node, states, at - low
        top = max(top, reach)
    check = check[:top]
    owned = check >= 0
    check[owned] = state[check[owned]]
    packed_base = np.zeros(top, np.int64)
    packed_base[state] = base
    return {"base": packed_base, "check": check, "turns": turns, "ends": state[np.array(ends, np.int64)]}


def child(base: np.ndarray, check: np.ndarray, state: int, turn: int) -> int:
    """The state that ``turn`` leads to, or -1."""
    to = int(base[state]) + turn
    return to if 0 < to < len(check) and check[to] == state else -1


def find(trie: dict[str, np.ndarray], seq: bytes) -> int:
    """The state of a row of tokens, or -1 if no conversation of the shard begins so."""
    ids = {bytes(t): i for i, t in enumerate(trie["turns"])}
    state = 0
    for at in range(0, len(seq), TOKEN):
        state = child(trie["base"], trie["check"], state, ids.get(seq[at:at + TOKEN], len(ids)))
        if state < 0:
            return -1
    return state


def shard_rows(seqs: list[bytes], n: list[int], first: list[int], sha256: list[bytes]) -> pd.DataFrame:
    trie = pack(seqs)
    row = (0, trie["base"].tobytes(), trie["check"].tobytes(), trie["turns"].tobytes(), trie["ends"].tobytes(),
           np.array(n, np.int64).tobytes(), np.array(first, np.int64).tobytes(), b"".join(sha256), None, None, None)
    return pd.DataFrame([row], columns=SHARDS.names)


def build_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tries and chunks of one task's rows (conv_id, seq), sorted by (seq, conv_id).

    The members of a conversation are hashed here if the task has all of
    them and they are few.  A task's first and last conversation may go on
    in other tasks, and one with many members is handed on in chunks: those
    have 32 zero bytes for a hash.
    """
    seqs: list[bytes] = []
    n: list[int] = []
    first: list[int] = []
    sha256: list[bytes] = []
    turns, tasks_first, current, ids, chunked = 0, True, None, [], False

    def chunk() -> pd.DataFrame:
        key = hashlib.sha256(current).digest()
        row = (1, *[None] * 7, key, ids[0], ",".join(map(str, ids)).encode())
        return pd.DataFrame([row], columns=SHARDS.names)

    def closed(last: bool) -> Iterator[pd.DataFrame]:
        """Ends the conversation at hand, and with it the shard if that is full."""
        nonlocal ids, turns, chunked, tasks_first
        if chunked or tasks_first or last:
            if ids:
                yield chunk()
            sha256.append(bytes(32))
        else:
            sha256.append(hashlib.sha256(",".join(map(str, ids)).encode()).digest())
        turns += 1 + len(current) // TOKEN
        ids, chunked, tasks_first = [], False, False
        if last or turns >= SHARD_TURNS:
            yield shard_rows(seqs, n, first, sha256)
            for x in (seqs, n, first, sha256):
                x.clear()
            turns = 0

    for batch in batches:
        for conv_id, seq in zip(batch["conv_id"].tolist(), batch["seq"]):
            if current is None or seq != current:
                if current is not None:
                    yield from closed(last=False)
                current = seq
                seqs.append(seq)
                n.append(0)
                first.append(conv_id)
            n[-1] += 1
            ids.append(conv_id)
            if len(ids) == CHUNK_IDS:
                yield chunk()
                ids, chunked = [], True
    if current is not None:
        yield from closed(last=True)


def walk(row: pd.Series) -> pd.DataFrame:
    """All nodes of one shard's trie.  Shared nodes have a key, and count only what is private to the shard."""
    base, check, end_state, end_n, end_first = (np.frombuffer(row[c], np.int64) for c in (
        "base", "check", "end_state", "end_n", "end_first"))
    turns = np.frombuffer(row["turns"], np.uint8).reshape(-1, TOKEN)
    size = len(check)
    words, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
    first = np.full(size, np.iinfo(np.int64).max)
    depth = np.zeros(size, np.int64)
    owned = np.flatnonzero(check >= 0)
    by_parent = owned[np.argsort(check[owned], kind="stable")]
    parents = check[by_parent]
    levels = [np.zeros(1, np.int64)]
    while len(levels[-1]):
        a, b = np.searchsorted(parents, levels[-1]), np.searchsorted(parents, levels[-1], side="right")
        many = b - a
        offsets = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        levels.append(by_parent[np.repeat(a, many) + offsets])
        depth[levels[-1]] = len(levels) - 1
    label = owned - base[check[owned]]
    words[owned] = np.ascontiguousarray(turns[label, 16:]).view(">u4").ravel() if len(owned) else 0

    n[end_state] = end_n
    first[end_state] = end_first
    shared = np.zeros(size, bool)
    key: dict[int, bytes] = {}
    handed_on = [i for i in range(len(end_state)) if row["end_sha256"][32 * i:32 * i + 32] == bytes(32)]
    for end in {int(end_state[i]) for i in (0, -1, *handed_on)}:
        path = [end]
        while path[-1]:
            path.append(int(check[path[-1]]))
        h = hashlib.sha256()
        for state in reversed(path):
            if state:
                h.update(turns[state - base[check[state]]].tobytes())
            shared[state], key[state] = True, h.copy().digest()
    for level in reversed(levels[1:]):
        np.add.at(n, check[level], n[level])
        np.minimum.at(first, check[level], first[level])
    children = np.bincount(check[owned[~shared[owned]]], minlength=size)
    leaves = ((children == 0) & ~shared).astype(np.int64)
    saved = np.where(shared, 0, (n - 1) * words)
    for level in reversed(levels[1:]):
        own = level[~shared[level]]
        np.add.at(leaves, check[own], leaves[own])
        np.add.at(saved, check[own], saved[own])
    ends = np.full(size, None, object)
    for i, state in enumerate(end_state.tolist()):
        ends[state] = row["end_sha256"][32 * i:32 * i + 32]
    states = np.concatenate(levels).astype(np.int64)
    above = np.where(states > 0, check[states], 0)
    out = pd.DataFrame({
        "conv_id": first[states], "depth": depth[states],
        "parent_conv_id": pd.array(first[above], "Int64"), "n_convs": n[states], "n_children": children[states],
        "n_leaves": leaves[states], "saved_tokens": saved[states], "ends": ends[states], "words": words[states],
        "key": [key.get(int(s)) for s in states],
        "parent_key": [key.get(int(p)) if s else None for s, p in zip(states, above)]})
    out.loc[out["parent_key"].notna() | (states == 0), "parent_conv_id"] = pd.NA
    return out[NODES.names]


def walk_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, row in batch.iterrows():
            yield walk(row)


def joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's chunks in a row; they come sorted by key and first id, one at a time."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"]):
            if k != key:
                if key is not None:
                    done.append((key, h.digest()))
                key, h = k, hashlib.sha256(ids)
            else:
                h.update(b"," + ids)
        if done:
            yield pd.DataFrame(done, columns=["key", "members"])
    if key is not None:
        yield pd.DataFrame([(key, h.digest())], columns=["key", "members"])


def build_tries(convs: DataFrame) -> DataFrame:
    """The written shards of (conv_id, tokens): tries (kind 0) and chunks of members (kind 1)."""
    rows = written(convs.select("conv_id", F.unhex(F.array_join("tokens", "")).alias("seq")), "conversations")
    ordered = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return written(ordered.mapInPandas(build_shards, SHARDS), "tries")


def merged(shared: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whole shared nodes, one a key, from what the shards know of them."""
    members = chunks.select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first") \
        .select("key", "ids").mapInPandas(joined_ids, "key binary, members binary")
    nodes = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.max("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends").alias("ends"))
    kids = nodes.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "key", "left").join(members, "key", "left") \
        .withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    return nodes.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children",
        F.coalesce("members", "ends").alias("ends"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))


def summed(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) over whole subtrees of the shared nodes.

    Pointer jumping: after round k a node has the sum of its descendants
    nearer than 2^k, and points 2^k nodes up.
    """
    sums = written(nodes.select("key", F.col("parent_key").alias("up"), "n_leaves", "saved_tokens"), "shared-sums")
    while sums.filter("up IS NOT NULL").limit(1).count():
        given = sums.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")) \
            .agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        jump = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = written(sums.join(given, "key", "left").join(jump, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens")), "shared-sums")
    return sums.select("key", "n_leaves", "saved_tokens")


def trie_nodes(tries: DataFrame) -> DataFrame:
    """One row a node of the whole trie, from the shards that ``build_tries`` wrote.

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256 of the ids of
    the conversations that end there, binary).  No conversations, no nodes.
    """
    nodes = written(tries.filter("kind = 0").select("base", "check", "turns", "end_state", "end_n", "end_first", "end_sha256")
                    .mapInPandas(walk_shards, NODES), "shard-nodes")
    shared = nodes.filter("key IS NOT NULL")
    whole = written(merged(shared, tries.filter("kind = 1")), "shared-nodes")
    sums = summed(whole)
    parent = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    upper = whole.drop("n_leaves", "saved_tokens").join(sums, "key").join(parent, "parent_key", "left") \
        .withColumn("parent_conv_id", F.col("parent"))
    # Children of a common turn all ask for one parent: they are dealt by salt, and the few shared nodes go to every salt.
    private = nodes.filter("key IS NULL")
    asking = private.filter("parent_key IS NOT NULL") \
        .withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    salted = parent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    below = asking.join(salted, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out = private.filter("parent_key IS NULL").select(*columns).unionByName(below.select(*columns)) \
        .unionByName(upper.select(*columns))
    return out.withColumn("ends", F.coalesce("ends", F.lit(EMPTY_SHA256)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``turns``; see ``conversations`` and ``trie_nodes``.

    Empty tables give no nodes; columns beyond conv_id, turn, role and text
    take no part, whatever their names.
    """
    own = written(conversations(turns), "own-conversations")
    return trie_nodes(build_tries(rebuilt(own)))
