"""Exact top-k inner products over KD-trees, one tree a shard.

Median splits fitted on a bounded sample of vectors deal all of them into
cells of neighbouring vectors; a cell of more rows than a shard may hold is
dealt over several shards.  Each shard is built once into a KD-tree (median
splits on the widest side, a tight bounding box a node) and written.  Within
a shard a query walks the tree best-first: the largest inner product that a
box admits bounds everything below it, and boxes under the k-th best score
found so far are never opened.

That k-th score is propagated: every query first searches one shard of its
own cell, and is then sent only to the shards of cells whose tight box admits
a score of at least the k-th found there.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

#: Rows a shard, rows a leaf, most queries and bytes of queries a block: what one task holds.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 16_384, 64, 65_536, 32 << 20
#: Vectors (those of the smallest hashes) on which the cells' splits are fitted, and fewest of them a cell.
SAMPLE_ROWS, CELL_ROWS = 8_192, 8
#: Queries whose box bounds a task computes at once.
CHUNK = 1_024
#: Stands for "no k-th score yet".
NO_SCORE = -(1 << 63)
FOUND = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): each component becomes floor(1024 * x), x as double.

    Rows with a null id take no part, nor do vectors that are null or hold a
    null or non-finite component.
    """
    v = quoted(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.select(quoted(id_col).cast("bigint").alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite) \
        .select("vec_id", F.transform("v", lambda x: F.floor(F.lit(1024.0) * x)).alias("vec"))


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in preorder: box, children (0: leaf) and the rows below, rows in leaf order."""
    order = np.arange(len(ids))
    low, high, left, right, spans = [], [], [], [], []

    def grow(a: int, b: int) -> int:
        node, rows = len(low), vectors[order[a:b]]
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        left.append(0)
        right.append(0)
        spans.append((a, b))
        side = high[node] - low[node]
        if b - a > LEAF_ROWS and len(side) and side.max() > 0:
            at = rows[:, side.argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(at, half)]
            left[node] = grow(a, a + half)
            right[node] = grow(a + half, b)
        return node

    if len(ids):
        grow(0, len(ids))
    return {"ids": ids[order], "vectors": vectors[order], "low": np.array(low), "high": np.array(high),
            "left": np.array(left), "right": np.array(right), "spans": np.array(spans)}


def fit_cells(vectors: np.ndarray, most: float) -> dict[str, list]:
    """Median splits in preorder until a cell holds at most ``most`` rows or equal ones.

    ``left`` is 0 for a cell; rows with less than ``at`` on ``side`` go left.
    """
    out: dict[str, list] = {"side": [], "at": [], "left": [], "right": [], "cell": []}
    cells = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal cells
        node = len(out["side"])
        for name in out:
            out[name].append(0)
        width = rows.max(axis=0).astype(float) - rows.min(axis=0) if len(rows) else np.zeros(0)
        if len(rows) > most and len(width) and width.max() > 0:
            x = rows[:, width.argmax()]
            at = np.partition(x, len(x) // 2)[len(x) // 2]
            if not (x < at).any():
                at = x[x > at].min()
            out["side"][node], out["at"][node] = int(width.argmax()), int(at)
            out["left"][node] = grow(rows[x < at])
            out["right"][node] = grow(rows[x >= at])
        else:
            out["cell"][node] = cells
            cells += 1
        return node

    grow(vectors)
    return out


def route(splits: dict[str, list], vectors: np.ndarray) -> np.ndarray:
    """The cell of each vector."""
    cell, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not splits["left"][node]:
            cell[rows] = splits["cell"][node]
            continue
        less = vectors[rows, splits["side"][node]] < splits["at"][node]
        todo += [(splits["left"][node], rows[less]), (splits["right"][node], rows[~less])]
    return cell


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, box): at least the largest inner product, as doubles; exact while sums stay below 2^52."""
    q, low, high = queries.astype(float), low.astype(float), high.astype(float)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds, size = up @ high.T + down @ low.T, up @ np.abs(high).T - down @ np.abs(low).T
    return np.where(size < 2.0 ** 52, bounds, bounds + size * (q.shape[1] + 4) * 2.0 ** -52)


def search_tree(tree: dict[str, np.ndarray], query_id: int, bounds: np.ndarray, query: np.ndarray, k: int,
                kth: int | None) -> list[tuple[int, int]]:
    """Up to k best (score, vec_id) of a tree with score at least ``kth``; ties to the smaller id.

    ``bounds``: for every node, the largest inner product its box admits.
    """
    best: list[tuple[int, int]] = []  # a heap of (score, -id): its least is the worst kept
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if kth is not None and -bound < kth:
            break
        if tree["left"][node]:
            for child in (tree["left"][node], tree["right"][node]):
                if kth is None or bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], int(child)))
            continue
        a, b = tree["spans"][node]
        scores = tree["vectors"][a:b] @ query
        for at in range(b - a) if kth is None else np.flatnonzero(scores >= kth):
            i = int(tree["ids"][a + at])
            if i == query_id:
                continue
            entry = (int(scores[at]), -i)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == k:
            kth = best[0][0] if kth is None else max(kth, best[0][0])
    return [(s, -i) for s, i in best]


def stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.int64) if dim else np.zeros((len(vectors), 0), np.int64)


def cell_splits(vectors: DataFrame, rows: int) -> dict[int, dict[str, list]]:
    """Length of vectors -> splits, fitted in tasks on at most ``SAMPLE_ROWS`` vectors."""
    most = max(CELL_ROWS, min(rows, SAMPLE_ROWS) * SHARD_ROWS / max(1, rows))

    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "splits": [pickle.dumps(fit_cells(stacked(sample["vec"], key[0]), most))]})

    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE_ROWS)
    fitted = sample.groupBy(F.size("vec").alias("dim")).applyInPandas(fit, "dim int, splits binary")
    return {r["dim"]: pickle.loads(r["splits"]) for r in fitted.collect()}


def with_cell(df: DataFrame, splits: dict[int, dict[str, list]]) -> DataFrame:
    """``df`` with dim and cell of ``vec``; vectors of a length not in the sample share cell 0."""
    @F.pandas_udf("int")
    def cell(vec: pd.Series) -> pd.Series:
        out, dims = pd.Series(0, vec.index, "int32"), vec.map(len)
        for dim in dims.unique():
            if dim in splits:
                here = dims == dim
                out[here] = route(splits[dim], stacked(vec[here], dim))
        return out

    return df.withColumns({"dim": F.size("vec"), "cell": cell("vec")})


def crowded_cells(vectors: DataFrame) -> DataFrame:
    """(dim, cell, parts) of cells of more than one shard: at most rows / ``SHARD_ROWS`` of them."""
    return written(vectors.groupBy("dim", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_ROWS)
                   .select("dim", "cell", F.ceil(F.col("n") / SHARD_ROWS).alias("parts")), "crowded-cells")


def with_parts(df: DataFrame, crowded: DataFrame) -> DataFrame:
    return df.join(F.broadcast(crowded), ["dim", "cell"], "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))


def build_index(vectors: DataFrame, crowded: DataFrame) -> DataFrame:
    """One written row a shard: (dim, cell, part, low, high, tree); low and high are the whole shard's box."""
    # Row numbers come from the written files' scan; a crowded cell's rows spread evenly over its shards.
    dealt = with_parts(vectors.withColumn("no", F.monotonically_increasing_id()), crowded) \
        .select("vec_id", "vec", "dim", "cell", F.pmod("no", "parts").alias("part"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(rows["vec_id"].to_numpy(np.int64), stacked(rows["vec"], key[0]))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "low": [tree["low"][0]],
                             "high": [tree["high"][0]], "tree": [pickle.dumps(tree, protocol=5)]})

    return written(dealt.groupBy("dim", "cell", "part").applyInPandas(
        build, "dim int, cell int, part bigint, low array<bigint>, high array<bigint>, tree binary"), "kd-trees")


def cell_boxes(index: DataFrame, dims: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (cells, low, high): the tight box of each cell, for the sample's lengths.

    The sample bounds the cells, and so what reaches the driver.
    """
    ends = index.filter(F.col("dim").isin(dims)).select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "b")) \
        .groupBy("dim", "cell", "at").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")) \
        .groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("ends")) \
        .select("dim", "cell", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
    by_dim: dict[int, list] = {}
    for r in ends.collect():
        by_dim.setdefault(r["dim"], []).append((r["cell"], r["low"], r["high"]))
    return {d: tuple(np.array(x, np.int64) for x in zip(*cells)) for d, cells in by_dim.items()}


def sent(asked: DataFrame, boxes: dict[int, tuple], crowded: DataFrame) -> DataFrame:
    """One row a query and shard whose cell's box admits a score of at least ``kth``, the home shard left out."""
    @F.pandas_udf("array<int>")
    def admitted(vec: pd.Series, kth: pd.Series) -> pd.Series:
        out, dims = [np.zeros(1, np.int32)] * len(vec), vec.map(len).to_numpy()
        for dim in np.unique(dims):
            if dim not in boxes:
                continue
            cells, low, high = boxes[dim]
            here = np.flatnonzero(dims == dim)
            for a in range(0, len(here), CHUNK):
                some = here[a:a + CHUNK]
                bounds = box_bounds(stacked(vec.iloc[some], dim), low, high)
                for i, row in zip(some, bounds):
                    out[i] = cells[row >= kth.iloc[i]].astype(np.int32)
        return pd.Series(out, vec.index)

    home = (F.col("cell") == F.col("home_cell")) & (F.col("part") == F.col("home_part"))
    rest = asked.withColumnsRenamed({"cell": "home_cell", "part": "home_part"}) \
        .withColumn("cell", F.explode(admitted("vec", "kth")))
    return with_parts(rest, crowded).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))) \
        .filter(~home).select("dim", "cell", "part", "query_id", "vec", "kth")


def search(index: DataFrame, queries: DataFrame, asked: int, k: int) -> DataFrame:
    """Best k of each (query, shard) pair given: queries have dim, cell, part, query_id, vec, kth.

    A shard's queries are cut into blocks by what ``asked`` of them weigh; a
    tree is sent once a block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(asked) / BLOCK_QUERIES), F.ceil(F.lit(asked * 8) * F.col("dim") / BLOCK_BYTES)) \
        .cast("int")

    def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(trees) and len(asked):
            tree, dim = pickle.loads(trees["tree"].iloc[0]), int(trees["dim"].iloc[0])
            low, high = tree["low"], tree["high"]
            most = np.abs(tree["vectors"].astype(float)).max(initial=0)
            for a in range(0, len(asked), CHUNK):
                some = asked.iloc[a:a + CHUNK]
                q = stacked(some["vec"], dim)
                limits = box_bounds(q, low, high)
                exact = most * np.abs(q.astype(float)).max(initial=0) * max(1, dim) < 2.0 ** 52
                q, kind = (q.astype(float), float) if exact else (q, np.int64)
                tree["vectors"] = tree["vectors"].astype(kind, copy=False)
                for i, (query_id, kth) in enumerate(zip(some["query_id"], some["kth"])):
                    for score, vec_id in search_tree(tree, query_id, limits[i], q[i], k, None if kth == NO_SCORE else int(kth)):
                        found.append((query_id, vec_id, score))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    trees = index.drop("low", "high").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    keys = ["dim", "cell", "part", "block"]
    return trees.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(lambda a, b: run(a, b), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each query.

    Both are (vec_id, vec) as ``integer_vectors`` makes them.  Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a
    query with fewer candidates gets all.  Rows that share the query's id
    are the query's own and never candidates; other repeated rows all count.
    Queries that share an id are asked once, with the smallest vector.
    Vectors are only compared with vectors of their own length.  An empty
    side gives an empty result.  Scores must fit a long.
    """
    vectors = written(vectors, "integer-vectors")
    splits = cell_splits(vectors, vectors.count())
    vectors = written(with_cell(vectors, splits), "vectors")
    crowded = crowded_cells(vectors)
    index = build_index(vectors, crowded)
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    asked = written(with_parts(with_cell(asked, splits), crowded)
                    .withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).drop("parts"), "queries")
    n = asked.count()
    first = written(search(index, asked.withColumn("kth", F.lit(NO_SCORE).cast("bigint")), n, k), "home-results")
    # the k-th score of a query's home shard, where there are k: nothing below it can be among the best
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")) \
        .select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("kth"))
    bounded = asked.join(reached, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NO_SCORE).cast("bigint")))
    rest = sent(bounded, cell_boxes(index, list(splits)), crowded)
    return best(first.unionByName(search(index, rest, n, k)), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
