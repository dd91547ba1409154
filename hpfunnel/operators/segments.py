"""Client segmentation by K-Means and PCA.

Model selection tries every k with several restarts.  All of those runs
share their passes over the z-scored client table: a pass computes, for a
batch of clients, the distances to the centres of all runs at once, and
sends on one sum a run and cluster from each task.  So the number of jobs
depends on the passes that the slowest run needs, not on how many runs there
are; what reaches the driver are centres (k x features a run).

The silhouette is that of squared Euclidean distances, which needs only sums
of clusters (linear time); the all-pairs form is not built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import dealt, materialize
from .clients import label_segments, scaled_features

X = "x"


@dataclass
class Segmentation:
    clients: DataFrame        # features + cluster + segment + PCA coordinates
    scores: DataFrame         # k, silhouette_score
    k: int
    silhouette: float
    explained_variance: list


@dataclass
class Run:
    """One restart of one k: its centres, and what the last pass found of its clusters."""

    k: int
    seed: int
    centres: np.ndarray
    counts: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None   # sums of squared lengths
    cost: float = float("inf")
    moving: bool = True


def points_of(scaled: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, h, x0, x1, ...): a hash of the key for sampling, and the features."""
    return scaled.select(key, F.xxhash64(key).alias("h"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return batch[[c for c in batch.columns if c[0] == "x"]].to_numpy(float)


#: Points whose distances to all runs' centres are handled together, so that they stay in a core's cache.
BLOCK_POINTS = 256


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[i:i + BLOCK_POINTS] for i in range(0, len(x), BLOCK_POINTS))


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = x @ (-2 * centres.T)
    d += (x ** 2).sum(axis=1)[:, None]
    d += (centres ** 2).sum(axis=1)
    return np.maximum(d, 0, out=d)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on hash and salt alone, not on partitions."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53 + 2.0 ** -54


def _drawn(points: DataFrame, width: int, weights: Callable[[np.ndarray], np.ndarray], salts: list[int]) -> np.ndarray:
    """One point a salt, drawn with the weight that ``weights`` gives it in the salt's column.

    The point of the largest log(u) / weight is such a draw; each task sends its best.
    """
    schema = "draw int, rank double, " + ", ".join(f"x{i} double" for i in range(width))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, rows = np.full(len(salts), -np.inf), np.zeros((len(salts), width))
        for b in batches:
            if not len(b):
                continue
            x, h = _matrix(b), b["h"].to_numpy()
            with np.errstate(divide="ignore"):
                r = np.log(np.column_stack([_uniform(h, s) for s in salts])) / weights(x)
            at = r.argmax(axis=0)
            top = r[at, np.arange(len(salts))]
            rows[top > rank] = x[at[top > rank]]
            rank = np.maximum(rank, top)
        found = np.flatnonzero(rank > -np.inf)
        yield pd.DataFrame({"draw": found.astype(np.int32), "rank": rank[found], **{f"x{i}": rows[found, i] for i in range(width)}})

    x = F.array(*[f"x{i}" for i in range(width)])
    drawn = points.mapInPandas(best, schema).groupBy("draw").agg(F.max_by(x, F.struct("rank", x)).alias("x")).collect()
    out = np.full((len(salts), width), np.nan)
    for r in drawn:
        out[r["draw"]] = r["x"]
    return out


def start_runs(points: DataFrame, width: int, ks: list[int], restarts: int, seed: int) -> list[Run]:
    """k-means++ starts of all runs, a centre of each run a pass."""
    runs = [Run(k, seed + r, np.zeros((0, width))) for k in ks for r in range(restarts)]
    for step in range(max(ks, default=0)):
        open_runs = [r for r in runs if r.k > step]
        chosen = [r.centres for r in open_runs]

        def weights(x: np.ndarray, chosen: list[np.ndarray] = chosen, first: bool = step == 0) -> np.ndarray:
            if first:
                return np.ones((len(x), len(chosen)))
            return np.column_stack([_square_distances(x, c).min(axis=1) for c in chosen])

        salts = [(r.seed * 1009 + r.k) * 64 + step for r in open_runs]
        for run, x in zip(open_runs, _drawn(points, width, weights, salts)):
            if np.isnan(x).any():  # fewer distinct points than k: the cluster stays empty
                x = run.centres[0]
            run.centres = np.vstack([run.centres, x])
    return runs


def update(points: DataFrame, runs: list[Run]) -> None:
    """One pass: counts, sums, squares and cost of all runs' clusters, into the runs."""
    width = runs[0].centres.shape[1]
    centres, first = np.vstack([r.centres for r in runs]), np.cumsum([0] + [r.k for r in runs])
    schema = "cluster int, n long, cost double, square double, " + ", ".join(f"x{i} double" for i in range(width))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(centres), 3 + width))
        for x in (x for b in batches for x in _blocks(_matrix(b))):
            d, at = _square_distances(x, centres), np.arange(len(x))[:, None]
            nearest = np.column_stack([a + d[:, a:z].argmin(axis=1) for a, z in zip(first[:-1], first[1:])])
            hot = np.zeros_like(d)
            hot[at, nearest] = 1
            sums[:, [0, *range(2, 3 + width)]] += hot.T @ np.column_stack([np.ones(len(x)), (x ** 2).sum(axis=1), x])
            sums[first[:-1], 1] += d[at, nearest].sum(axis=0)  # a run's cost, with its first cluster
        out = pd.DataFrame(sums[:, 1:], columns=["cost", "square", *[f"x{i}" for i in range(width)]])
        yield out.assign(cluster=np.arange(len(centres), dtype=np.int32), n=sums[:, 0].astype(np.int64))[schema_names]

    schema_names = ["cluster", "n", "cost", "square", *[f"x{i}" for i in range(width)]]
    totals = np.zeros((len(centres), 3 + width))
    agg = points.mapInPandas(partial, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in schema_names[1:]])
    for r in agg.collect():  # one row a centre
        totals[r["cluster"]] = [r[c] for c in schema_names[1:]]
    for run, a, z in zip(runs, first[:-1], first[1:]):
        run.counts, run.cost, run.squares, run.sums = totals[a:z, 0], totals[a:z, 1].sum(), totals[a:z, 2], totals[a:z, 3:]


def settle(points: DataFrame, runs: list[Run], max_iter: int = 300, tol: float = 1e-4) -> int:
    """Lloyd passes for all runs together until no run's centres move; returns the number of passes.

    A run stops when the squares of its centres' moves sum to ``tol`` or less
    (z-scored features have unit variance); an empty cluster keeps its centre.
    """
    passes = 0
    while passes < max_iter and any(r.moving for r in runs):
        moving = [r for r in runs if r.moving]
        update(points, moving)
        passes += 1
        for r in moving:
            filled = r.counts > 0
            to = r.centres.copy()
            to[filled] = r.sums[filled] / r.counts[filled, None]
            r.moving = ((to - r.centres) ** 2).sum() > tol
            r.centres = to
    update(points, runs)
    return passes + 1


def silhouettes(points: DataFrame, runs: list[Run]) -> list[float]:
    """Mean silhouette of each run's clustering (squared Euclidean), in one pass; see ``update``."""
    schema = "run int, n long, total double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, totals = 0, np.zeros(len(runs))
        for b in batches:
            x = _matrix(b)
            n += len(x)
            square = (x ** 2).sum(axis=1)
            at = np.arange(len(x))
            for i, r in enumerate(runs):
                own = _square_distances(x, r.centres).argmin(axis=1)
                sums = r.counts * square[:, None] + r.squares - 2 * x @ r.sums.T  # of distances to each cluster's points
                inside = sums[at, own] / np.maximum(r.counts[own] - 1, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = np.where(r.counts > 0, sums / r.counts, np.inf)
                mean[at, own] = np.inf
                other = mean.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(inside < other, 1 - inside / other, other / inside - 1)
                totals[i] += np.where((r.counts[own] > 1) & (inside != other), s, 0).sum()
        yield pd.DataFrame({"run": np.arange(len(runs), dtype=np.int32), "n": n, "total": totals})

    agg = points.mapInPandas(partial, schema).groupBy("run").agg((F.sum("total") / F.sum("n")).alias("s"))
    return [r["s"] for r in agg.orderBy("run").collect()]


def clusters_of(points: DataFrame, run: Run, key: str) -> DataFrame:
    """(key, cluster_validado): the nearest centre of every point."""
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "cluster_validado": _square_distances(_matrix(b), run.centres).argmin(axis=1)})

    return points.mapInPandas(nearest, f"`{key}` string, cluster_validado int")


def k_sweep(points: DataFrame, width: int, n: int, restarts: int = K.KMEANS_RESTARTS, seed: int = K.RANDOM_STATE,
            max_k: int = K.KMEANS_MAX_K) -> list[tuple[Run, float]]:
    """The run of least cost for each k from 2 on, and its silhouette."""
    runs = start_runs(points, width, list(range(2, min(max_k, n - 1) + 1)), restarts, seed)
    settle(points, runs)
    best = [min((r for r in runs if r.k == k), key=lambda r: (r.cost, r.seed)) for k in sorted({r.k for r in runs})]
    return list(zip(best, silhouettes(points, best)))


def build_segments(client_table: DataFrame, restarts: int = K.KMEANS_RESTARTS,
                   seed: int = K.RANDOM_STATE) -> Segmentation:
    """Scale -> k sweep -> best k (highest silhouette, smallest k on
    ties) -> labels -> business segment (P22) -> 2-D PCA (M12)."""
    spark = client_table.sparkSession
    scaled = materialize(dealt(scaled_features(client_table), "NomCliente"))
    points = materialize(points_of(scaled, K.CLIENT_FEATURES, "NomCliente"))
    results = k_sweep(points, len(K.CLIENT_FEATURES), points.count(), restarts, seed)
    scores = spark.createDataFrame([(r.k, s) for r, s in results], "k int, silhouette_score double")
    best, best_s = max(results, key=lambda t: (t[1], -t[0].k))
    clusters = materialize(clusters_of(points, best, "NomCliente"))
    segmented = label_segments(client_table, clusters)

    data = VectorAssembler(inputCols=K.CLIENT_FEATURES, outputCol=X).transform(scaled)
    pca = PCA(k=2, inputCol=X, outputCol="_pca").fit(data)
    pc = pca.pc.toArray()
    # sign convention: the largest-magnitude loading of each component is positive
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    coords = pca.transform(data).select(
        "NomCliente", (vector_to_array("_pca")[0] * F.lit(signs[0])).alias("PCA_1"),
        (vector_to_array("_pca")[1] * F.lit(signs[1])).alias("PCA_2"))
    clients = materialize(segmented.join(coords, "NomCliente"))
    return Segmentation(clients, scores, best.k, best_s, [float(v) for v in pca.explainedVariance.toArray()])


def segment_meta(seg: Segmentation) -> DataFrame:
    """One-row metadata of the chosen segmentation."""
    spark = seg.clients.sparkSession
    return spark.createDataFrame(
        [(seg.k, seg.silhouette, seg.explained_variance)],
        "k int, silhouette double, pca_varianza_explicada array<double>").select(
        "*", seg.clients.agg(F.count(F.lit(1))).scalar().alias("clientes"))
