"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark texts are cut into segments of bounded size that overlap by one
word less than a window, so that every window stands in exactly one segment.
Segments are dealt into parts whose measured size is bounded; a part is what
is broadcast at a time: its vocabulary, the hashes of its windows, and the
windows themselves as word numbers.

A document's words become word numbers of the part (a word that the part
has not ends every window), their rolling hashes are looked up in the hash
set, and each hit is verified word by word.  Documents are scanned once a
part; nothing of them is shuffled for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, packed, parts_of, quoted, unpacked, written
from .licences import words_of

WINDOW = 10
#: Windows and bytes a segment holds, bytes of segments that are broadcast at a time (parts may reach twice that).
SEGMENT_WINDOWS, SEGMENT_BYTES, PART_BYTES = 4_096, 262_144, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
                      T.StructField("items", T.ArrayType(T.LongType()))])
#: A word as ``words_of`` finds it, in a text whose letters are as they were.
WORD_AS_WRITTEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def segments(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words, bytes): the items' words, a space apart, in overlapping segments.

    An item of fewer words than a window is one segment and one window; an
    item without words has none.  Equal segments of an item are one.
    """
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.BinaryType()),
                           T.StructField("bytes", T.LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"].astype(object), b["text"]):
                words = words_of(text)
                at = 0
                while at < max(1, len(words) - window + 1) and words:
                    last, size = at + window, sum(map(len, words[at:at + window]))
                    while last < len(words) and last - at - window + 1 < SEGMENT_WINDOWS and size < SEGMENT_BYTES:
                        size += len(words[last])
                        last += 1
                    joined = b" ".join(words[at:last])
                    rows.append((None if pd.isna(item) else item, joined, len(joined)))
                    at = last - window + 1
            yield pd.DataFrame(rows, columns=schema.names)

    items = bounded_batches(benchmark).select(quoted(id_col).cast("bigint").alias("item_id"), quoted(text_col).alias("text"))
    return items.mapInPandas(cut, schema).distinct()


@dataclass(frozen=True)
class Windows:
    """All windows of one length: sorted hashes, the window's words a row, and which items have it.

    Windows of equal hash stand side by side; ``owners[first[i]:first[i + 1]]`` are the items of window i.
    """

    hashes: np.ndarray
    words: np.ndarray
    first: np.ndarray
    owners: np.ndarray


def hashed(columns: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of rows of numbers, given column by column."""
    h = np.zeros(1, np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64)) * _STEP
        h = h ^ (h >> np.uint64(29))
    return h


def index_part(rows: list[tuple[int | None, bytes]], window: int) -> tuple[dict[bytes, int], list[Windows], np.ndarray]:
    """The vocabulary of a part's segments, their windows by length, and the items (0: without id)."""
    vocabulary: dict[bytes, int] = {}
    items = sorted({i for i, _ in rows if i is not None})
    number = {i: k + 1 for k, i in enumerate(items)}
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for item, joined in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in joined.split(b" ")], np.int32)
        n = min(window, len(ids))
        by_length.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number.get(item, 0)))
    out = []
    for n, found in sorted(by_length.items()):
        words = np.concatenate([w for w, _ in found])
        owner = np.repeat([i for _, i in found], [len(w) for w, _ in found])
        both = np.unique(np.column_stack([words, owner]), axis=0)
        words, owner = both[:, :n], both[:, n]
        new = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        words, ends = np.ascontiguousarray(words[first]), np.append(first, len(owner))
        hashes = hashed(words.T)
        order = np.argsort(hashes, kind="stable")
        many = (ends[1:] - ends[:-1])[order]
        starts = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(ends[:-1][order] - starts[:-1], many) + np.arange(starts[-1])
        out.append(Windows(hashes[order], words[order], starts, owner[at]))
    return vocabulary, out, np.array([0, *items], np.int64)


def hits(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every verified occurrence in a document's word numbers (-1: unknown word)."""
    n = windows.words.shape[1]
    none = np.zeros(0, np.int64)
    if len(ids) < n:
        return none, none
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    places = np.flatnonzero(unknown[n:] == unknown[:-n])
    if not len(places):
        return none, none
    h = hashed(ids[places + i] for i in range(n))
    low, high = np.searchsorted(windows.hashes, h), np.searchsorted(windows.hashes, h, side="right")
    many = high - low
    places, h_at = np.repeat(places, many), np.repeat(low, many)
    if not len(places):
        return none, none
    h_at = h_at + np.arange(len(h_at)) - np.repeat(np.cumsum(many) - many, many)
    same = (ids[places[:, None] + np.arange(n)] == windows.words[h_at]).all(axis=1)
    return places[same], h_at[same]


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of word intervals, as intervals with gaps between them."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)
    return list(zip(starts[new].tolist(), ends[last].tolist()))


def scanner(part: list[tuple[int | None, bytes]], window: int) -> Callable[[Column], Column]:
    """A column function from a text to its ``FOUND``, by one part of the benchmark."""
    vocabulary, tables, items = index_part(part, window)

    def scan_text(text: str | None) -> tuple[int, list[tuple[int, int]], np.ndarray]:
        words = words_of(text)
        ids = np.fromiter((vocabulary.get(w, -1) for w in words), np.int32, len(words))
        starts, ends, owners = [], [], [np.zeros(1, np.int64)]
        for t in tables:
            places, which = hits(ids, t)
            if len(places):
                starts.append(places)
                ends.append(places + t.words.shape[1])
                owners += [t.owners[t.first[w]:t.first[w + 1]] for w in np.unique(which)]
        spans = joined_spans(np.concatenate(starts), np.concatenate(ends)) if starts else []
        return len(words), spans, items[np.unique(np.concatenate(owners))[1:]]

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [scan_text(t) for t in texts]
            yield pd.DataFrame([(n, _as_spans(s), i) for n, s, i in rows], columns=FOUND.names)

    return scan


def _as_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


@F.pandas_udf(SPANS)
def union_of_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for spans in batches:
        yield pd.Series([_as_spans(joined_spans(np.array([x["start"] for x in s], np.int64),
                                                np.array([x["end"] for x in s], np.int64))) for s in spans], dtype=object)


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, ``spans`` (word intervals, words from 0, end exclusive), ``items`` and contaminated.

    A word is hit if it lies in an occurrence of ``window`` words in a row of
    an item, or of a shorter item's words in whole.  ``items`` are the
    distinct ids of the items found, ascending; an item without an id still
    hits words but is not listed, and rows that share an id are one item.
    Null and empty texts have no words.  Input columns named like an output
    are replaced; an empty benchmark hits nothing.
    """
    cut = parts_of(segments(benchmark, item_col, item_text_col, window), "bytes", PART_BYTES)
    parts = [r["part"] for r in cut.select("part").distinct().orderBy("part").collect()]
    rows = packed(bounded_batches(docs), text=text_col)

    def scan(part: int | None) -> Column:
        held = cut.filter(F.col("part") == part).collect() if part is not None else []  # bounded by parts_of
        return scanner([(r["item_id"], bytes(r["words"])) for r in held], window)("text").alias("f")

    if len(parts) <= 1:
        found = rows.select("doc", scan(parts[0] if parts else None)).select("doc", "f.*")
    else:
        rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "numbered-documents")
        every = None
        for k, part in enumerate(parts):
            seen = rows.select("no", scan(part)).select("no", "f.*")
            seen = written(seen if not k else seen.filter(F.size("spans") > 0), "part-hits")
            every = every.unionByName(seen) if k else seen
        found = rows.join(every.groupBy("no").agg(  # at most one row a part and document
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "no") \
            .withColumn("spans", union_of_spans("spans"))
    return unpacked(found, docs.columns, {
        "n_words": F.col("n_words"), "n_hit": n_hit(F.col("spans")), "spans": F.col("spans"), "items": F.col("items"),
        "contaminated": F.size("spans") > 0})


@F.pandas_udf(T.StringType())
def without_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without what lies between the first and the last letter of each span's words."""
    for texts, spans in batches:
        out = []
        for text, cuts in zip(texts, spans):
            if len(cuts):
                words = [m.span() for m in WORD_AS_WRITTEN.finditer(text)]
                at, kept = 0, []
                for c in cuts:
                    kept.append(text[at:words[c["start"]][0]])
                    at = words[c["end"] - 1][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages (``remove="spans"``) or without the documents that hold one
    (``"documents"``); the columns stay as they are.  See ``scan_benchmark`` for what is found."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    packed_docs = docs.select(F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"), quoted(text_col).alias("text"))
    found = scan_benchmark(packed_docs, benchmark, window, "text", item_col, item_text_col)
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return found.select(*[(without_spans("text", "spans") if c == text_col else F.col("row").getField(c)).alias(c)
                          for c in docs.columns])
