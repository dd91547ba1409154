"""Toxicity by boosted trees over dense features, with isotonic calibration.

Every text becomes a dozen dense rates: density and clustering of lexicon
words, second-person words and how near they stand to lexicon words,
capitals, punctuation, and obfuscated spellings.  The lexicon is a fixed
seed list plus the words and stems that labelled training rows mark as toxic.  Trees
are fitted to histograms of the features by gradient boosting on log loss;
rows of a fold that neither the lexicon nor the trees have seen calibrate
the sum of the trees into a probability by isotonic regression.

Only the fit uses a sample: about ``TRAIN_ROWS`` labelled rows, dealt by a
hash of doc_id from those that are not held out.  Scoring reads every whole
text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, packed, quoted, unpacked, written

#: Labelled rows that are learnt from (documented bound of the sample); one
#: part in ``CALIBRATE`` of them only calibrates.
TRAIN_ROWS, CALIBRATE = 20_000, 4
#: Learnt lexicon: lengths of stems, least toxic texts with a term, least
#: log-odds and likelihood ratio (G squared), most terms.
STEMS, LEAST_ROWS, LEAST_ODDS, LEAST_G2, LEXICON_SIZE = (4, 6), 5, 3.0, 25.0, 300
#: Trees, their depth, learning rate, histogram bins, least rows in a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 15
#: Words around a lexicon word in which a second-person word counts as near,
#: and the window in which lexicon words cluster.
NEAR, WINDOW = 5, 50

# Seed lexicon, second-person words, look-alike characters.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown "
    "clowns fool fools ugly filthy vermin hate shut kill imbecile jerk coward liar bastard dummkopf arschloch "
    "idiota imbécil estúpido basura connard débile crétin".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                   "tú ti usted ustedes vosotros".split())
LOOKALIKE = str.maketrans("@4031!$5|7+€", "aaoeiissltte")

WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[@4031!$5|7+€*])[^\s,;:\"()<>]{3,24}(?!\S)")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")

NAMES = ("lexicon_rate", "lexicon_log", "lexicon_kinds", "lexicon_window", "second_rate", "second_near", "capital_rate",
         "shouted_rate", "exclaim_rate", "question_rate", "symbol_rate", "disguised_rate", "disguised_hits", "words_log")


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """Word -> whether it, or a stem of it, is in the lexicon; answers are remembered."""

    def __init__(self, terms: frozenset[str]) -> None:
        self.terms = terms

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        hit = self[word] = any(t in self.terms for t in terms_of(word))
        return hit


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a text, in the order of ``NAMES``; null counts as empty."""
    text = text or ""
    raw = WORD.findall(text)
    words = [w.lower() for w in raw]
    n, size = len(words) or 1, len(text) or 1
    at = [i for i, w in enumerate(words) if lexicon[w]]
    second = [i for i, w in enumerate(words) if w in SECOND]
    widest = near = 0
    lo = 0
    for hi, i in enumerate(at):
        while i - at[lo] >= WINDOW:
            lo += 1
        widest = max(widest, hi - lo + 1)
    if at and second:
        s = np.array(second)
        k = np.searchsorted(s, at)
        near = sum(min(abs(i - s[j]) for j in (max(x - 1, 0), min(x, len(s) - 1))) <= NEAR for i, x in zip(at, k))
    disguised = [m.lower().strip(".,!?").translate(LOOKALIKE) for m in DISGUISED.findall(text)]
    spaced = [re.sub(r"[^\w]|_", "", m.lower()) for m in SPACED.findall(text)]
    hits = sum(lexicon[w] for w in disguised + spaced) \
        + sum(lexicon[re.sub(r"(.)\1+", r"\1", w)] for w in words if STRETCHED.search(w))
    plain = text.encode("utf-8", "surrogatepass")
    capitals = len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(plain) - len(plain.translate(None, b"#$%&*@~^+=|<>"))
    return [len(at) / n, float(np.log1p(len(at))), float(len({words[i] for i in at})), float(widest), len(second) / n,
            float(near), capitals / size, sum(len(w) > 2 and w.isupper() for w in raw) / n, text.count("!") / size,
            text.count("?") / size, symbols / size, (len(disguised) + len(spaced)) / n, float(hits), float(np.log1p(len(words)))]


@dataclass(frozen=True)
class Trees:
    """Boosted trees over bin numbers: per tree the split features, cuts and leaf values
    of a complete binary tree of depth ``DEPTH``."""

    edges: list[np.ndarray]
    base: float
    split: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for split, cut, value in zip(self.split, self.cut, self.value):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, split[node]] > cut[node])
            out += value[node - len(split)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting on log loss, level by level over feature histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
             for j in range(x.shape[1])]
    # rates that are zero nearly everywhere still get a cut just above zero
    edges = [np.unique(np.append(e, np.nextafter(0, 1))) for e in edges]
    rate = float(np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3))
    base, inner = float(np.log(rate / (1 - rate))), 2 ** DEPTH - 1
    trees = Trees(edges, base, np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return trees
    b, width = trees.bins(x), max(len(e) for e in edges) + 1
    score, splits, cuts, values = np.full(len(x), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        split, cut, node = np.zeros(inner, int), np.full(inner, width), np.zeros(len(x), int)
        for depth in range(DEPTH):
            first, nodes = 2 ** depth - 1, 2 ** depth
            best = np.zeros(nodes)
            for j in range(x.shape[1]):
                slot = (node - first) * width + b[:, j]
                g, h, c = (np.bincount(slot, w, nodes * width).reshape(nodes, width).cumsum(axis=1)
                           for w in (grad, hess, np.ones(len(x))))
                gain = g ** 2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < LEAF) | (c[:, -1:] - c < LEAF)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best + 1e-9
                best[better] = top[better]
                split[first:first + nodes][better] = j
                cut[first:first + nodes][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), split[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        score += value[leaf]
        splits.append(split)
        cuts.append(cut)
        values.append(value)
    return Trees(edges, base, np.array(splits), np.array(cuts), np.array(values))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising (raw score, probability) steps by pooling adjacent violators.

    Each pool is smoothed by half a row of either label, so that scores stay
    within (0, 1).
    """
    pools: list[list[float]] = []
    for r, t in sorted(zip(raw.tolist(), y.tolist())):
        pools.append([r, t, 1, r])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            a = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + a[1], pools[-1][2] + a[2], a[3]]
    middle = np.array([(p[0] + p[3]) / 2 for p in pools])
    chance = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return middle, np.maximum.accumulate(chance)


@dataclass(frozen=True)
class Model:
    lexicon: frozenset[str]
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, lexicon) for t in texts]))
        if len(self.steps[0]) < 2:
            return 1 / (1 + np.exp(-raw))
        return np.interp(raw, *self.steps)


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Terms that stand in clearly more toxic than other texts of (text, toxic), with the seed.

    Equal texts count once.  A term covered by a stem that tells more is left out.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(b["text"], b["toxic"]):
                for term in {x for w in {w.lower() for w in WORD.findall(t or "")} for x in terms_of(w)}:
                    seen.setdefault(term, [0, 0])[y] += 1
            yield pd.DataFrame([(t, g, n) for t, (g, n) in seen.items()], columns=["term", "g", "b"])

    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    good, bad = n["n"] - n["bad"], n["bad"]
    if not good or not bad:
        return SEED
    counted = texts.select("text", "toxic").mapInPandas(count, "term string, g bigint, b bigint").groupBy("term") \
        .agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    rate = bad / (good + bad)

    def part(n, share):
        return F.when(n > 0, n * F.log(n / ((F.col("b") + F.col("g")) * share))).otherwise(0.0)

    g2 = 2 * (part(F.col("b"), rate) + part(F.col("g"), 1 - rate))
    top = counted.filter((F.col("b") >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (g2 >= LEAST_G2)) \
        .orderBy(F.desc(g2), F.length("term"), "term").limit(10 * LEXICON_SIZE).collect()
    kept: dict[str, None] = {}
    for r in top:
        whole = r["term"].rstrip("*")
        if not any(whole[:k] + "*" in kept for k in STEMS if len(whole) >= k):
            kept[r["term"]] = None
    return SEED | set(list(kept)[:LEXICON_SIZE])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that are not held out; one row an id (a repeated id takes its
    highest label and one of its texts).  Without both labels every text gets the labels' rate."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("toxic")) \
        .filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    # about `rows` rows of 12 bytes: the bound of this broadcast
    sample = bounded_batches(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(known), "id") \
        .groupBy("id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(CALIBRATE)) == 0), "toxic-sample")
    terms = learn_lexicon(sample.filter(~F.col("fold")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "toxic": b["toxic"], "fold": b["fold"],
                                "x": [features(t, lexicon) for t in b["text"]]})

    got = sample.mapInPandas(measure, "id bigint, toxic int, fold boolean, x array<double>").orderBy("id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    y, fold = got["toxic"].to_numpy(float), got["fold"].to_numpy(bool)
    trees = boost(x[~fold], y[~fold])
    return Model(terms, trees, isotonic(trees.raw(x[fold]), y[fold]))


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    A null text counts as empty, and empty texts are scored too.  Repeated
    rows get the same score; an empty table gives an empty result; input
    columns named like an output are replaced.
    """
    columns = df.columns

    @F.pandas_udf(T.DoubleType())
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.lexicon)
        for texts in batches:
            yield pd.Series(model.score(texts.tolist(), lexicon), dtype=float)

    scored = packed(bounded_batches(df), text=text_col).select("doc", rate("text").alias("s"))
    return unpacked(scored, columns, {"score": F.col("s"), "predicted": (F.col("s") >= 0.5).cast("int")})
