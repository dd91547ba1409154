"""Random forests grown on all their rows, a tree a task.

``fit`` writes the encoded rows to the shared folder, sorted, so that neither
cores nor files choose the model; each task draws its tree's bootstrap and
grows it level by level, all open nodes of a level at once.  Numbers are split
at exact quantiles of all rows, or between all their values if those are few;
a nominal feature's categories are ordered by their mean target in every node,
categories that a node has not seen go right.  A node becomes a leaf if its
targets are equal, at ``max_depth``, or if no split leaves ``min_instances``
rows on both sides.  A task holds the rows that its tree has drawn.

A full tree has about as many nodes as rows, so a forest is larger than its
rows: it stays a table of nodes in the shared folder, never in the driver.
Tasks read the tree that they walk; a chunk of rows walks one tree after the
other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .quantiles import value_ranges

NODES = "tree int, node int, depth int, feature int, threshold int, left int, leaf int, value double, gain double, members array<int>"
#: Rows that a forest's trees are read for, rows that walk a tree together, bytes of trees that a task keeps for its next rows.
WALKED_ROWS = 60_000
CLOSE_ROWS = 16_384
KEPT_TREES = 128 << 20
#: Rows of a bootstrap that are drawn together.
DRAWN_TOGETHER = 1 << 22
#: Categories of a feature up to which a node's left side is a row of bits.
BITS = 1024


def split_points(rows: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[float]]:
    """Where numbers may be split, ascending: between any two of their values, or, if there are more than
    ``most`` values, at fewer than ``most`` of them that part all rows into about equal shares."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_var"), F.col(c).alias("_val")) for c in columns])).alias("_kv")).select("_kv.*")
    values = value_ranges(long, ["_var"], "_val")
    var = Window.partitionBy("_var")  # over one row a range
    totals = values.groupBy("_var", "_b").agg(F.sum("_c").alias("_in"), F.count(F.lit(1)).alias("_different")).withColumns({
        "_n": F.sum("_in").over(var), "_different": F.sum("_different").over(var),
        "_before": F.coalesce(F.sum("_in").over(var.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    inside = Window.partitionBy("_var", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(totals, ["_var", "_b"]).withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    share = [F.floor(c * most / F.col("_n")) for c in (F.col("_end"), F.col("_end") - F.col("_c"))]
    few = F.col("_different") <= most
    found: dict[str, list[float]] = {c: [] for c in columns}
    every = set()
    for r in ranked.where(few | (share[0] > share[1])).select("_var", "_v", few.alias("few")).orderBy("_var", "_v").collect():
        found[r["_var"]].append(r["_v"])
        every |= {r["_var"]} if r["few"] else set()
    return {c: [(a + b) / 2 for a, b in zip(v, v[1:])] if c in every else v[:-1] for c, v in found.items()}


@dataclass
class Tree:
    """One tree's nodes in the order of their numbers; the right child follows the left one."""
    feature: np.ndarray          # -1 for a leaf
    threshold: np.ndarray        # the largest bin that goes left; -1 for nominal features
    left: np.ndarray
    leaf: np.ndarray             # number among the leaves; -1 for the others
    value: np.ndarray
    members: np.ndarray          # the nodes' left categories, one after the other
    starts: np.ndarray           # where each node's begin, and the end


def _groups(key: np.ndarray, size: int, *sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys (below ``size``), ascending, and the sums of their rows; the last sum is positive for every row."""
    if size <= 4 * len(key) + 1024:
        found = [np.bincount(key, s, size) for s in sums]
        have = np.flatnonzero(found[-1])
        return have, [s[have] for s in found]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], [np.add.reduceat(s[order], first) for s in sums]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _best_splits(code, node, w, s, n, bins: int, nominal: bool, totals, least: int):
    """The best split of one feature for each node that has one.

    Of ``totals`` (weights, weighted targets and counts of the nodes) the left
    side takes the groups ``start`` to ``at`` of the returned order of codes.
    """
    weights, targets, counts = totals
    have, (gw, gs, gn) = _groups(node * bins + code, len(weights) * bins, w, s, n)
    of, value = np.divmod(have, bins)
    if nominal:
        order = np.lexsort((gs / gw, of))
        value, gw, gs, gn = value[order], gw[order], gs[order], gn[order]  # ``of`` stays sorted
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    lengths = np.diff(np.append(first, len(of)))

    def before(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - np.repeat(total[first] - x[first], lengths)

    lw, ls, ln = before(gw), before(gs), before(gn)
    rw, rs, rn = weights[of] - lw, targets[of] - ls, counts[of] - ln
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((ln >= least) & (rn >= least), ls * ls / lw + rs * rs / rw, -np.inf)
    top = np.maximum.reduceat(score, first)
    at = np.minimum.reduceat(np.where(score == np.repeat(top, lengths), np.arange(len(of)), len(of)), first)
    return of[first], top, first, at, value


def bootstrap(rows: int, rng: np.random.Generator) -> np.ndarray:
    """How often each row is drawn; as small as the counts are."""
    times = np.zeros(rows, np.uint8)
    for first in range(0, rows, DRAWN_TOGETHER):
        drawn, often = np.unique(rng.integers(0, rows, min(DRAWN_TOGETHER, rows - first)), return_counts=True)
        times[drawn] += often.astype(np.uint8)
    return times


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, times: np.ndarray, bins: np.ndarray, nominal: np.ndarray, max_depth: int,
         min_instances: int, tried: int, rng: np.random.Generator) -> dict[str, np.ndarray | list]:
    """The nodes of one tree over rows that each count ``times`` times; ``x`` has the bins or codes, a line a feature."""
    features = len(x)
    n = times.astype(float)
    w = n * weight
    centre = np.average(y, weights=w)
    s = w * (y - centre)
    node, size, at_id, levels = np.zeros(len(y), np.int64), 1, 1, []
    for depth in range(max_depth + 1):
        weights, targets, counts = (np.bincount(node, v, size) for v in (w, s, n))
        squares = np.bincount(node, s * (y - centre), size)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(low, node, y)
        np.maximum.at(high, node, y)
        level = {"feature": np.full(size, -1), "threshold": np.full(size, -1), "left": np.full(size, -1), "gain": np.zeros(size),
                 "value": np.where(low == high, low, np.clip(centre + targets / weights, low, high)), "depth": np.full(size, depth),
                 "members": [np.zeros(0, np.int64)] * 2}
        levels.append(level)
        can = (low < high) & (counts >= 2 * min_instances) & (depth < max_depth)
        if not can.any():
            break
        mine = np.flatnonzero(can)
        own = np.cumsum(can) - 1
        live = can[node]
        x, y, w, s, n, node = x[:, live], y[live], w[live], s[live], n[live], own[node[live]]
        totals = weights[mine], targets[mine], counts[mine]
        none = totals[1] ** 2 / totals[0]
        # gains below what rounding makes of a node's spread are none
        best = none + 1e-10 * np.maximum(squares[mine] - none, 0)
        base, took, threshold = best.copy(), np.full(len(mine), -1), np.full(len(mine), -1)
        start, end, order = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64), {}
        if tried < features:
            choice = np.argpartition(rng.random((len(mine), features)), tried - 1, axis=1)[:, :tried]
            allowed = np.zeros((features, len(mine)), bool)
            allowed[choice, np.arange(len(mine))[:, None]] = True
        for f in range(features):
            part = np.flatnonzero(allowed[f][node]) if tried < features else slice(None)
            code, of = x[f][part], node[part]
            if not len(code):
                continue
            of, top, first, at, value = _best_splits(code, of, w[part], s[part], n[part], int(bins[f]), bool(nominal[f]), totals, min_instances)
            better = top > best[of]
            win = of[better]
            best[win], took[win] = top[better], f
            if nominal[f]:
                start[win], end[win], order[f], threshold[win] = first[better], at[better] + 1, value, -1
            else:
                threshold[win] = value[at[better]]
        split = took >= 0
        if not split.any():
            break
        goes_left = np.zeros(len(node), bool)
        mnodes, mcodes = [], []
        for f in np.unique(took[split]):
            here = np.flatnonzero((took == f)[node])
            if not nominal[f]:
                goes_left[here] = x[f][here] <= threshold[node[here]]
                continue
            win = np.flatnonzero(took == f)
            lengths = end[win] - start[win]
            codes, of = order[f][_spans(start[win], lengths)], np.repeat(win, lengths)
            mnodes.append(of)
            mcodes.append(codes)
            keys, wanted = np.sort(of * int(bins[f]) + codes), node[here] * int(bins[f]) + x[f][here]
            goes_left[here] = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        rank = np.cumsum(split) - 1
        level["feature"][mine], level["threshold"][mine] = took, threshold
        level["left"][mine] = np.where(split, at_id + 2 * rank, -1)
        level["gain"][mine] = np.where(split, best - none, 0)
        if mnodes:
            level["members"] = [mine[np.concatenate(mnodes)], np.concatenate(mcodes)]
        kept = split[node]
        x, y, w, s, n = x[:, kept], y[kept], w[kept], s[kept], n[kept]
        node = 2 * rank[node[kept]] + ~goes_left[kept]
        size = 2 * int(split.sum())
        at_id += size
    out = {c: np.concatenate([v[c] for v in levels]) for c in ("feature", "threshold", "left", "gain", "value", "depth")}
    offsets = np.cumsum([0] + [len(v["feature"]) for v in levels])
    mnode = np.concatenate([v["members"][0] + o for v, o in zip(levels, offsets)])
    mcode = np.concatenate([v["members"][1] for v in levels])
    by_node = np.lexsort((mcode, mnode))
    out["members"] = mcode[by_node].astype(np.int32)
    out["starts"] = np.searchsorted(mnode[by_node], np.arange(len(out["feature"]) + 1)).astype(np.int32)
    is_leaf = out["feature"] < 0
    out["leaf"] = np.where(is_leaf, np.cumsum(is_leaf) - 1, -1)
    return out


class Keys:
    """A set of numbers from 0 on, asked for many of them at once: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(2 * len(keys), 2).bit_length())
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        at, keys = self._place(keys), keys.astype(np.int64)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]
            rest = self.slots[at] != keys
            at, keys = (at[rest] + 1) % len(self.slots), keys[rest]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def have(self, wanted: np.ndarray) -> np.ndarray:
        at = self._place(wanted)
        slot = self.slots[at]
        out = slot == wanted
        rest = np.flatnonzero(~out & (slot >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.slots)
            slot = self.slots[at[rest]]
            out[rest] = slot == wanted[rest]
            rest = rest[(slot != wanted[rest]) & (slot >= 0)]
        return out


class Walker:
    """Leads rows to a tree's leaves."""

    def __init__(self, tree: Tree, bins: np.ndarray, nominal: np.ndarray):
        self.tree, self.left, self.threshold = tree, tree.left.astype(np.int32), tree.threshold
        listed = np.append(nominal & (bins > BITS), False)  # the last one is for leaves
        narrow = np.append(nominal & (bins <= BITS), False)
        self.feature = tree.feature
        # 1: few categories, a node's left side is a row of bits; 2: many, left sides are a set of (node, category)
        self.kind = (narrow + 2 * listed).astype(np.int8)[tree.feature]
        of = np.repeat(np.arange(len(self.kind)), np.diff(tree.starts))
        long = self.kind[of] == 2
        self.widest = int(bins.max())
        keys = Keys(of[long] * self.widest + tree.members[long])
        self.slots, self.have = keys.slots, keys.have
        self.width = int(bins[narrow[:-1]].max()) if narrow.any() else 1
        word = np.cumsum(self.kind == 1) - 1
        self.bits = np.zeros((int(word[-1]) + 1) * self.width, bool)
        self.bits[word[of[~long]] * self.width + tree.members[~long]] = True
        self.word = word * self.width

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf node that each row of ``x`` (a line a feature) comes to."""
        rows = x.shape[1]
        flat, at = x.ravel(), np.zeros(rows, np.int32)
        live, node = np.arange(rows), at.copy()
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.all():
                at[live] = node
                live, node, f = live[inner], node[inner], f[inner]
                if not len(live):
                    return at
            code = flat[f * rows + live]
            right = code > self.threshold[node]
            kind = self.kind[node]
            some = np.flatnonzero(kind == 1)
            if len(some):
                right[some] = ~self.bits[self.word[node[some]] + code[some]]
            some = np.flatnonzero(kind == 2)
            if len(some):
                wanted = node[some] * np.int64(self.widest) + code[some]
                right[some] = ~self.have(wanted)
            node = self.left[node] + right


def coded(values: np.ndarray, edges: Sequence[Sequence[float] | None]) -> np.ndarray:
    """Bins or codes, a line a feature, of the rows' feature vectors."""
    out = np.empty(values.shape[::-1], np.int32)
    for f, points in enumerate(edges):
        out[f] = values[:, f] if points is None else np.searchsorted(np.asarray(points), values[:, f])
    return out


def shared_dataset(path: str):
    """A Parquet table of the shared folder for a task: its files in the order of their names."""
    import pyarrow.dataset as ds
    import pyarrow.fs as fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    store, path = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    files = sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".parquet"))
    return ds.dataset(files, format="parquet", filesystem=store)


def _list_matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def read_tree(path: str, tree: int) -> Tree:
    names = ["node", "feature", "threshold", "left", "leaf", "value", "members"]
    t = shared_dataset(f"{path}/tree={tree}").to_table(columns=names, use_threads=False).sort_by("node").combine_chunks()
    column = {c: t[c].to_numpy() for c in ("feature", "threshold", "left", "leaf", "value")}
    lists = pa.concat_arrays(t["members"].chunks) if t["members"].num_chunks != 1 else t["members"].chunk(0)
    starts = lists.offsets.to_numpy()
    return Tree(**column, members=lists.flatten().to_numpy(), starts=starts - starts[0])


class Trees:
    """The trees of a stored forest; the first ones read are kept, up to ``KEPT_TREES`` bytes."""

    def __init__(self, path: str, bins: np.ndarray, nominal: np.ndarray):
        self.path, self.bins, self.nominal, self.kept, self.bytes = path, bins, nominal, {}, 0

    def __getitem__(self, number: int) -> Walker:
        if number in self.kept:
            return self.kept[number]
        walker = Walker(read_tree(self.path, number), self.bins, self.nominal)
        size = sum(v.nbytes for v in [*vars(walker).values(), *vars(walker.tree).values()] if isinstance(v, np.ndarray))
        if self.bytes + size <= KEPT_TREES:
            self.kept[number], self.bytes = walker, self.bytes + size
        return walker


def scorer(path: str, info: dict, schema: str, result: Callable[[np.ndarray, np.ndarray | None], list[pa.Array]], leaves: bool = False):
    """A function of feature vectors (array<double>): the columns of ``schema`` that ``result`` makes of
    the rows' leaf values, a column a tree, and their leaf numbers, if ``leaves``."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    @F.arrow_udf(schema)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width, trees = len(info["bins"]), Trees(path, np.asarray(info["bins"]), np.asarray(info["nominal"]))

        def walked(waiting: list[pa.Array]) -> Iterator[pa.Array]:
            x = coded(np.concatenate([_list_matrix(b, width) for b in waiting]), info["edges"])
            parts = [(i, np.ascontiguousarray(x[:, i:i + CLOSE_ROWS])) for i in range(0, x.shape[1], CLOSE_ROWS)]
            values = np.empty((x.shape[1], info["trees"]))
            numbers = np.empty((x.shape[1], info["trees"]), np.int32) if leaves else None
            for t in range(info["trees"] if parts else 0):
                walker = trees[t]
                for i, part in parts:
                    at = walker.leaves(part)
                    values[i:i + len(at), t] = walker.tree.value[at]
                    if leaves:
                        numbers[i:i + len(at), t] = walker.tree.leaf[at]
            out, done = pa.StructArray.from_arrays(result(values, numbers), names), 0
            for b in waiting:
                yield out.slice(done, len(b))
                done += len(b)

        waiting, rows = [], 0
        for b in batches:
            waiting.append(b)
            rows += len(b)
            if rows >= WALKED_ROWS:
                yield from walked(waiting)
                waiting, rows = [], 0
        if waiting:
            yield from walked(waiting)

    return scored


def mean_of_trees(values: np.ndarray) -> np.ndarray:
    """The sum runs in the order of the trees, whatever the number of rows."""
    return values.cumsum(axis=1)[:, -1] / values.shape[1]


def _lists(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * width, pa.array(matrix.astype(float).ravel()))


@dataclass
class TreeSize:
    numNodes: int
    depth: int


class ForestModel(Model, MLWritable, MLReadable):
    """A forest whose nodes are a table at ``path``; ``info`` has what is as small as the features.

    ``transform`` adds ``prediction``, and of a classifier ``probability``, of a regressor ``leaves``.
    """

    def __init__(self, path: str | None = None, info: dict | None = None):
        super().__init__()
        self.path, self.info = path, info

    @property
    def nodes(self) -> DataFrame:
        return SparkSession.active().read.schema(NODES).parquet(self.path)

    @property
    def numFeatures(self) -> int:
        return len(self.info["bins"])

    @property
    def getNumTrees(self) -> int:
        return self.info["trees"]

    def getMaxDepth(self) -> int:
        return self.info["max_depth"]

    def getFeatureSubsetStrategy(self) -> str:
        return self.info["tries"]

    @property
    def trees(self) -> list[TreeSize]:
        sizes = self.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).orderBy("tree")
        return [TreeSize(r["n"], r["d"]) for r in sizes.collect()]

    @property
    def featureImportances(self) -> DenseVector:
        """Each tree's gains as shares of its sum, averaged over the trees."""
        found = np.zeros((self.getNumTrees, self.numFeatures))
        for r in self.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g")).collect():
            found[r["tree"], r["feature"]] = r["g"]
        total = found.sum(axis=1, keepdims=True)
        shares = np.divide(found, total, out=np.zeros_like(found), where=total > 0).sum(axis=0)
        return Vectors.dense(shares / shares.sum() if shares.sum() > 0 else shares)

    def scored(self, features: Column, schema: str, result, leaves: bool = False) -> Column:
        """What ``result`` makes of the trees' values of each row (``scorer``)."""
        return scorer(self.path, self.info, schema, result, leaves)(features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = vector_to_array(self.info["column"])
        if self.info["classes"]:
            found = dataset.withColumn("_p", self.scored(features, "p double", lambda v, _: [pa.array(mean_of_trees(v))])["p"])
            return found.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))) \
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")
        found = dataset.withColumn("_f", self.scored(
            features, "prediction double, leaves array<double>", lambda v, n: [pa.array(mean_of_trees(v)), _lists(n)], True))
        return found.withColumn("prediction", F.col("_f.prediction")).withColumn("leaves", array_to_vector("_f.leaves")).drop("_f")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"info": self.instance.info})
        _write_nodes(self.instance.nodes.repartition("tree"), f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(f"{path}/nodes", metadata["info"])
        model._resetUid(metadata["uid"])
        return model


def _write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.partitionBy("tree").parquet(path)


def fit(train: DataFrame, features: str, label: str, weight: str | None, key: str, nominal: Sequence[int], edges: Sequence[Sequence[float] | None],
        num_trees: int, max_depth: int, min_instances: int, tries: str, seed: int, classes: bool) -> ForestModel:
    """A forest of all rows of ``train``.

    ``edges`` are the split points of every feature, None for the nominal ones, whose number of codes ``nominal`` has
    (0 for the others).  ``tries``: features tried a split, "all" or "sqrt".
    """
    spark = train.sparkSession
    path, rows_path = shared_path(spark, "forest"), shared_path(spark, "forest-rows")
    rows = train.select(F.col(key).alias("key"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    rows.orderBy("key", "x", "y").write.parquet(rows_path)
    bins = [len(e) + 1 if e is not None else n for e, n in zip(edges, nominal)]
    info = {"trees": num_trees, "max_depth": max_depth, "tries": tries, "classes": classes, "column": features,
            "bins": bins, "nominal": [n > 0 for n in nominal], "edges": [list(e) if e is not None else None for e in edges]}
    tried = len(bins) if tries == "all" else math.ceil(math.sqrt(len(bins)))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (t for b in batches for t in b.column(0).to_pylist()):
            rng, found = np.random.default_rng([seed, number]), shared_dataset(rows_path)
            times, read, parts = bootstrap(found.count_rows(), rng), 0, []
            if not len(times):
                raise ValueError("no rows to fit a forest on")
            for r in found.to_batches(columns=["x", "y", "w"], batch_readahead=1, fragment_readahead=1, use_threads=False):
                own = np.flatnonzero(times[read:read + r.num_rows])
                parts.append((coded(_list_matrix(r["x"], len(bins))[own], info["edges"]), r["y"].to_numpy()[own], r["w"].to_numpy()[own]))
                read += r.num_rows
            x, y, w = (np.concatenate(p, axis=-1) for p in zip(*parts))
            del parts
            found = grow(x, y, w, times[times > 0], np.asarray(bins), np.asarray(info["nominal"]), max_depth, min_instances, tried, rng)
            size = len(found["feature"])
            columns = [np.full(size, number), np.arange(size), *[found[c] for c in ("depth", "feature", "threshold", "left", "leaf")]]
            arrays = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(found["value"]), pa.array(found["gain"]),
                                                                        pa.ListArray.from_arrays(found["starts"], pa.array(found["members"]))]
            whole = pa.RecordBatch.from_arrays(arrays, names=[c.strip().split()[0] for c in NODES.split(",")])
            yield from (whole.slice(i, 10_000) for i in range(0, size, 10_000))

    _write_nodes(spark.range(0, num_trees, 1, num_trees).mapInArrow(grown, NODES), path)
    return ForestModel(path, info)
