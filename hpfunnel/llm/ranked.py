"""Ranked lexical search over hashed max-sketches.

The index is made once and knows no query.  A document's terms are hashed
into ``BUCKETS`` coordinates; its sketch keeps each coordinate's largest term
frequency.  A term's impact grows with its frequency, so the impact of that
maximum bounds the impact of every term of the coordinate, whether the
document has the term or not.

Queries are looked up in blocks.  For a block, every coordinate holds the
weights of each query's terms there; one product of a batch of sketches with
them bounds the scores of all its (document, query) pairs.  A task goes
through a query's documents by descending bound and scores them exactly,
until the next bound is below the k-th best score that it has found.  The
k best of each task meet in a window; that is all that is shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, parts_of, quoted, written
from .licences import words_of

#: Coordinates of a sketch; terms that a task counts before it hands the counts on; bytes of
#: query terms, and queries, that a block holds (blocks may reach twice that); sketch entries looked up at a time.
BUCKETS, COUNTED, BLOCK_BYTES, BLOCK_QUERIES, AT_ONCE = 4_096, 200_000, 4 << 20, 256, 8_192

INDEX = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("buckets", T.BinaryType()),
    T.StructField("most", T.BinaryType()), T.StructField("terms", T.BinaryType()), T.StructField("tf", T.BinaryType()),
    T.StructField("term", T.BinaryType()), T.StructField("df", T.LongType())])
FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("score", T.LongType())])


def coordinates(terms: np.ndarray) -> np.ndarray:
    """The leading bits of term hashes, so that sorted terms are sorted by coordinate."""
    return (terms >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.uint16)


def fold(counts: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's sketch (coordinates ascending, largest frequency of each) and its term hashes
    (ascending) with their frequencies."""
    tf = np.fromiter(counts.values(), np.uint32, len(counts))
    terms = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in counts), np.uint64, len(counts))
    order = np.argsort(terms)
    terms, tf = terms[order], tf[order]
    at = coordinates(terms)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.maximum.reduceat(tf, first), terms, tf


def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document with terms, and rows (term, df) for what the task has seen."""
    df: Counter = Counter()

    def counted() -> pd.DataFrame:
        out = pd.DataFrame({"term": list(df), "df": list(df.values())}).reindex(columns=INDEX.names)
        df.clear()
        return out

    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"].astype(object), b["text"]):
            counts = Counter(words_of(text))
            if counts:
                df.update(counts.keys())
                rows.append((None if pd.isna(doc_id) else doc_id, counts.total(), *(x.tobytes() for x in fold(counts)), None, None))
        if rows:
            yield pd.DataFrame(rows, columns=INDEX.names)
        if len(df) >= COUNTED:
            yield counted()
    if df:
        yield counted()


class SketchIndex:
    """What ``build_index`` makes: ``docs`` (a row a document with terms: doc_id, n, sketch, hashed terms),
    ``terms`` (term, df), and the numbers of documents with terms and of terms with repeats."""

    def __init__(self, docs: DataFrame, terms: DataFrame) -> None:
        self.docs, self.terms = docs, terms
        n, length = docs.agg(F.count("*"), F.sum("n")).first()
        self.n_docs, self.length = n, length or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SketchIndex:
    """The written sketches, hashed terms and term counts of all documents.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased.  Null and empty texts have none and are not indexed; each
    repeated row is a document.  Terms are kept as 64-bit hashes: two terms
    count as one if those are equal.
    """
    rows = bounded_batches(docs).select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    made = written(rows.mapInPandas(index_rows, INDEX), "sketches")
    terms = made.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    return SketchIndex(made.filter("term IS NULL").drop("term", "df"), written(terms, "term-counts"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def distinct_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(words_of(t))) for t in texts], dtype=object)


def weighted_queries(index: SketchIndex, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, query, terms: array of (term, w), bytes): the indexed terms of each query, and their weights.

    Rows that share an id are one query with the terms of all; a null id is
    a query of its own.  ``query`` numbers the queries.
    """
    asked = bounded_batches(queries).select(quoted(id_col).cast("bigint").alias("item_id"), quoted(text_col).alias("text"))
    asked = asked.select("item_id", F.explode(distinct_terms("text")).alias("term")).distinct()
    w = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    terms = asked.join(index.terms, "term").withColumn("w", w).filter("w > 0")
    grouped = terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"),
                                           (F.sum(F.octet_length("term")) + 16 * F.count("*")).alias("bytes"))
    return written(grouped.withColumn("query", F.monotonically_increasing_id()), "weighted-queries")


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """A frequency's share of its term's weight, in millionths."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """A block of queries: each one's sorted term hashes and their weights."""

    def __init__(self, rows: list) -> None:
        self.queries = np.array([r["query"] for r in rows], np.int64)
        self.terms, self.w = [], []
        for r in rows:
            terms = np.array([xxhash.xxh3_64_intdigest(bytes(t["term"])) for t in r["terms"]], np.uint64)
            order = np.argsort(terms)
            self.terms.append(terms[order])
            self.w.append(np.array([t["w"] for t in r["terms"]], np.int64)[order])

    def weights(self) -> np.ndarray:
        """Sums of weights by (coordinate, query)."""
        out = np.zeros((BUCKETS, len(self.queries)))
        for q, (terms, w) in enumerate(zip(self.terms, self.w)):
            np.add.at(out[:, q], coordinates(terms), w)
        return out

    def score(self, q: int, terms: np.ndarray, tf: np.ndarray, m: int) -> int:
        """The exact score of a document's sorted term hashes."""
        at = np.minimum(np.searchsorted(terms, self.terms[q]), len(terms) - 1)
        has = terms[at] == self.terms[q]
        return int((self.w[q][has] * impact(tf[at[has]], m)).sum())


def bounds(weights: np.ndarray, buckets: list[np.ndarray], impacts: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the scores, a row a document and a column a query, beyond any rounding."""
    starts = np.cumsum([0, *map(len, buckets[:-1])])
    return np.add.reduceat(weights[np.concatenate(buckets)] * np.concatenate(impacts)[:, None], starts, axis=0) * (1 + 1e-9)


def offer(best: list[tuple], entry: tuple, k: int) -> None:
    if len(best) < k:
        heapq.heappush(best, entry)
    elif entry > best[0]:
        heapq.heapreplace(best, entry)


def search_block(docs: DataFrame, block: Block, n_docs: int, length: int, k: int) -> DataFrame:
    """The k best documents of each task for each query: (query, doc_id, score), scores above 0."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in block.queries]
        weights = block.weights()

        def lookup(rows: list[tuple]) -> None:
            m = [10 + (90 * n * n_docs) // length for _, n, *_ in rows]
            tops = bounds(weights, [r[2] for r in rows], [impact(r[3], x) for r, x in zip(rows, m)])
            least = np.array([b[0][0] if len(b) == k else 1 for b in best])
            for q in np.flatnonzero((tops >= least).any(axis=0)):
                for d in np.argsort(-tops[:, q], kind="stable"):
                    if tops[d, q] < (best[q][0][0] if len(best[q]) == k else 1):
                        break  # no later document's bound reaches the k-th score
                    doc_id, _, _, _, terms, tf = rows[d]
                    score = block.score(q, terms, tf, m[d])
                    if score > 0:  # ties go to the smaller id, null ids last
                        offer(best[q], (score, doc_id is not None, -(doc_id or 0)), k)

        rows, entries = [], 0
        for b in batches:
            for doc_id, n, buckets, most, terms, tf in zip(b["doc_id"].astype(object), b["n"].tolist(), b["buckets"], b["most"],
                                                           b["terms"], b["tf"]):
                rows.append((None if pd.isna(doc_id) else int(doc_id), n, np.frombuffer(buckets, np.uint16),
                             np.frombuffer(most, np.uint32), np.frombuffer(terms, np.uint64), np.frombuffer(tf, np.uint32)))
                entries += len(rows[-1][2])
                if entries >= AT_ONCE:
                    lookup(rows)
                    rows, entries = [], 0
        if rows:
            lookup(rows)
        found = [(int(block.queries[q]), -i if given else None, score) for q, b in enumerate(best) for score, given, i in b]
        if found:
            yield pd.DataFrame(found, columns=FOUND.names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "n", "buckets", "most", "terms", "tf").mapInPandas(search, FOUND)


def search(index: SketchIndex, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every query: item_id, rank (from 1), doc_id, score.

    A document's score sums w * (10^9 tf div (1000 tf + 8 m)) over the
    query's distinct terms; w = floor(1000 ln((2N + 2) / (2 df + 1))) and m =
    10 + 90 n N div L, for N documents with L terms in all, df of them with
    the term, and n terms in this one.  Only scores above 0 are returned, so
    queries without a term in any document (null and empty ones too) have no
    rows; equal scores go by ascending doc_id, null last.  Scores must fit a
    long.
    """
    asked = weighted_queries(index, queries, id_col, text_col)
    dealt = parts_of(asked.withColumn("load", F.greatest("bytes", F.lit(BLOCK_BYTES // BLOCK_QUERIES))), "load", BLOCK_BYTES)
    blocks = [r["part"] for r in dealt.select("part").distinct().orderBy("part").collect()]
    found = index.docs.sparkSession.createDataFrame([], FOUND)
    for at in blocks:
        rows = dealt.filter(F.col("part") == at).orderBy("query").collect()  # bounded by parts_of
        found = found.unionByName(written(search_block(index.docs, Block(rows), index.n_docs, index.length, k), "block-results"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                                         "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``search`` for all rows of ``queries`` (item_id, text) over ``docs`` (doc_id, text); an empty side gives no rows."""
    return search(build_index(docs), queries, k)
