"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids (and the closing id); those over the capacity
are cut into pieces.  Packing looks at nothing but lengths, and there are at
most ``capacity`` different ones, so the instance is their histogram: a
few thousand counts however many documents there are.  Only that histogram
comes to the driver.  There

* the reduction fixes sets of up to three lengths that provably dominate
  every other way to fill the longest one's sequence, as often as the counts
  allow, and removes them;
* best-fit decreasing packs what remains, runs of equal sequences at a time.

Either yields runs "this many sequences with these lengths".  A piece's rank
among the pieces of its length, a running count over tasks, picks its place
in the runs.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted, release_memory, written

CAPACITY, END = 4096, 1
#: Bytes of runs and pre-tokens, with their ids, that a task remembers, and what one takes beside its characters.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 200

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("shard", T.IntegerType()), T.StructField("nth", T.LongType())])
PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

# The pre-token pattern of the word_bpe vocabulary, for texts of
# ASCII and Latin-1 letters only, and what such texts are.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xff]*")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


class Encoder(dict):
    """Token ids of texts, as little-endian unsigned 32-bit values.

    A BPE's ids of a text are those of its pre-tokens in a row, and no
    pre-token holds white space.  So each pre-token goes through the
    vocabulary's model once, and the ids of every run between white space
    are remembered, until they take ``REMEMBERED_BYTES``.  Texts with characters beyond ASCII and Latin-1 letters,
    or with a special token's brackets, go through the tokenizer whole, as
    does everything if the vocabulary's pre-tokens are not the known ones.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.tokens = self.model.tokenize
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.mapped = {c: as_bytes(chr(c))[0][0] for c in range(0xc0, 0x100)}
        self.pretokens: dict[str, bytes] = {}
        self.held = 0
        probe = "It's 3 o'clock: café & ÀÉ--x's, you'll_see!? (2x4)\n\tend 'tis"
        self.known = True
        self.known = self.whole(probe) == self.encode(probe)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def model_ids(self, word: str) -> bytes:
        ids = [t.id for t in self.tokens(word if word.isascii() else word.translate(self.mapped))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def remembered(self, known: dict[str, bytes], word: str, ids: bytes) -> bytes:
        self.held += ENTRY_BYTES + len(word) + len(ids)
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.pretokens.clear()
            self.held = 0
        known[word] = ids
        return ids

    def pretoken(self, word: str) -> bytes:
        ids = self.pretokens.get(word)
        return self.remembered(self.pretokens, word, self.model_ids(word)) if ids is None else ids

    def __missing__(self, run: str) -> bytes:
        # letters alone are one pre-token: the run itself, no need to remember it twice
        words = [run] if run.isalpha() else PRETOKEN.findall(run)
        if len(words) == 1:
            return self.remembered(self, run, self.pretokens.get(run) or self.model_ids(run))
        return self.remembered(self, run, b"".join([self.pretoken(w) for w in words]))

    def encode(self, text: str) -> bytes:
        if self.known and PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return self.whole(text)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document's ids, in pieces of at most ``capacity``."""
    for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
        yield piece, at, ids[4 * at:4 * (at + capacity)]


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
             text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The written pieces of all documents, numbered within task and length.

    Every document ends with the id ``end``; a null text is empty, so it has
    that id alone.  ``keep_ids`` keeps the ids themselves.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        encoder, shard, close = Encoder(vocabulary), TaskContext.get().partitionId(), struct.pack("<I", end)
        release_memory()  # what reading the vocabulary took
        seen = [0] * (capacity + 1)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].astype(object), b["text"]):
                for piece, start, ids in cut(encoder.encode(text or "") + close, capacity):
                    n = len(ids) // 4
                    rows.append((None if pd.isna(doc_id) else doc_id, piece, start, n, zlib.crc32(ids),
                                 ids if keep_ids else None, shard, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=PIECES.names)
        del encoder
        release_memory()

    rows = bounded_batches(docs).select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    return written(rows.mapInPandas(run, PIECES), "pieces")


@dataclass
class Run:
    """``count`` sequences that each hold these (length, times)."""

    items: list[tuple[int, int]]
    count: int


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Run]:
    """Fix dominating sets and take them out of ``counts`` (by length, changed in place).

    A set that holds length j dominates another one if the other's lengths,
    j apart, can be parted so that each part fits under one length of the
    set.  Then some best packing uses the set.  Checked for every j, longest
    first, again and again until nothing more is fixed:

    * nothing fits beside j: {j};
    * j and the longest a that fits fill the sequence, or no two fit beside
      j, or no two that fit are longer than a: {j, a};
    * at most two fit beside j, b is the longest that fits with a, and every
      pair with both longer than b is no longer than a: {j, a, b}.

    What holds for j holds on while these lengths last, as the others only
    get fewer; so a set is fixed as often as its lengths last.
    """
    runs: list[Run] = []

    def fix(*lengths: int) -> None:
        times = {x: lengths.count(x) for x in lengths}
        n = min(int(counts[x]) // t for x, t in times.items())
        for x, t in times.items():
            counts[x] -= n * t
        runs.append(Run(sorted(times.items(), reverse=True), n))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                chosen = _dominating(counts, capacity, j)
                if not chosen:
                    break
                fix(*chosen)
                changed = True
    return runs


def _dominating(counts: np.ndarray, capacity: int, j: int) -> tuple[int, ...]:
    """A set with j that dominates all others, or nothing."""
    room = capacity - j
    rest = counts[:room + 1].copy()
    if j <= room:
        rest[j] -= 1
    fits = np.flatnonzero(rest[1:] > 0) + 1
    if not len(fits):
        return (j,)
    a = int(fits[-1])
    if a == room:
        return j, a
    smallest = np.repeat(fits[:3], np.minimum(rest[fits[:3]], 3))[:3].astype(int)
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return j, a
    if len(smallest) == 3 and smallest.sum() <= room:
        return ()

    def partner(x: int, limit: int) -> int:
        """The longest y <= limit that fits beside j and x, x itself only if there are two."""
        ys = fits[fits <= min(limit, room - x)]
        if len(ys) and ys[-1] == x and rest[x] < 2:
            ys = ys[:-1]
        return int(ys[-1]) if len(ys) else 0

    pairs = [(int(x), partner(int(x), int(x))) for x in fits]
    pairs = [(x, y) for x, y in pairs if y]
    if all(x + y <= a for x, y in pairs):
        return j, a
    b = partner(a, a)
    # y is each x's longest partner: if even that is no longer than b, or fits under a with x, x's other pairs do too
    if b and all(y <= b or x + y <= a for x, y in pairs):
        return j, a, b
    return ()


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing, whole runs of equal sequences at a time."""
    open_runs: dict[int, list[Run]] = {}
    rooms: list[int] = []  # sorted rooms that have runs

    def put(room: int, run: Run) -> None:
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        open_runs[room].append(run)

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                run, room = Run([], n), capacity
            else:
                room = rooms[at]
                run = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            times = room // length  # the tightest run stays the tightest until it is full
            full = min(run.count, n // times)
            if full:
                put(room - times * length, Run([*run.items, (length, times)], full))
            n -= full * times
            left = run.count - full
            if left and 0 < n < times:
                put(room - n * length, Run([*run.items, (length, n)], 1))
                n, left = 0, left - 1
            if left and run.items:
                put(room, Run(run.items, left))
    return [r for runs in open_runs.values() for r in runs]


@dataclass(frozen=True)
class Places:
    """Where the ranks of each length go: sorted starts of rank intervals and, for
    each, the first sequence, pieces a sequence and first offset."""

    start: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, (length << 48) + rank, side="right") - 1
        step, turn = np.divmod((length << 48) + rank - self.start[at], self.times[at])
        return self.sequence[at] + step, self.offset[at] + turn * length


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Places:
    """Reduce, best-fit the remainder, and deal the ranks of each length to the runs."""
    rest = counts.astype(np.int64).copy()
    runs = reduce_by_dominance(rest, capacity) + best_fit(rest, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for run in runs:
        offset = 0
        for length, times in run.items:
            rows.append(((length << 48) + int(used[length]), first, times, offset))
            used[length] += run.count * times
            offset += length * times
        first += run.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*table.T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces that ``tokenize`` wrote.

    Sequences hold at most ``capacity`` tokens and have no gaps.  Equal
    lengths are interchangeable: ties go by task and order.  No pieces, no
    sequences.
    """
    by_task = written(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    places = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    ranks = by_task.select("shard", "length", before.alias("before"))

    @F.pandas_udf(PLACE)
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            sequence, offset = places.of(length.to_numpy(np.int64), rank.to_numpy(np.int64))
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = pieces.join(ranks, ["shard", "length"]).withColumn("p", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "p.sequence_id", "p.offset")
