"""Language ID by error-correcting output codes.

Each language has a codeword of bits.  One binary n-gram classifier a bit
tells the languages whose bit is set from the others: its weight of an
n-gram is the log-odds of that n-gram between the two sides, and its margin
for a text is the mean weight of the text's 1- to 3-grams.  Decoding takes
the codeword of least logistic loss, bits weighted by how well their
classifier separates its sides; a text whose two nearest codewords are about
as near is flagged ambiguous.

Learning needs n-gram counts by language only, which Spark sums over the
tasks.  They come from about ``TRAIN_ROWS`` labelled rows, dealt by a hash of
doc_id from those that are not held out, and cover those rows' whole texts.
Half of them go to the languages by their numbers of rows and half in equal
parts, so that a rare language is learnt from as many rows in a large table
as in a small one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, packed, quoted, release_memory, unpacked, written

#: Labelled rows that are learnt from (documented bound of the sample).
TRAIN_ROWS = 50_000
#: Hashed n-gram features; smoothing of their counts.
FEATURES, ALPHA = 1 << 14, 0.5
#: Sharpness of the loss, temperature of scores, and the gap in loss between the
#: two nearest codewords under which a text is ambiguous (a clear one has about 0.9).
SHARP, HEAT, GAP = 2.0, 6.0, 0.05
UNKNOWN = "und"

SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("ambiguous", T.BooleanType())])

#: Code points below 0x250 that are letters; above, punctuation and symbol blocks are not.
_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def lettered(text_col: str) -> Column:
    """``has_letter`` of a column; null has none."""
    return F.coalesce(quoted(text_col).rlike(r"\p{L}"), F.lit(False))


def grams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the lower-cased letters; the rest counts as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(c < 0x250, _LETTER[np.minimum(c, 0x24F)],
                      ~((c >= 0x2000) & (c < 0x2C00)) & ~((c >= 0x3000) & (c < 0x3040)) & (c < 0x1F000))
    c = np.where(letter, c, 32)
    c = c[np.concatenate(([True], letter[1:] | letter[:-1]))]  # one space a gap
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    return np.concatenate([one >> shift, two >> shift, three >> shift])


def codewords(n: int) -> np.ndarray:
    """A code of +1/-1 rows for ``n`` languages.

    Up to five languages: every way to part them in two (the exhaustive
    code, least distance half its length).  Beyond: seeded random columns,
    no constant or repeated one, the widest of a few draws.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if i == 0 or k >> (i - 1) & 1 else -1 for k in range(2 ** (n - 1) - 1)] for i in range(n)])
    rng, bits, best, wide = np.random.default_rng(7), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(50):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = np.where(rng.random(n) < 0.5, 1, -1)
            if abs(c.sum()) < n and (-c).tobytes() not in columns:
                columns[c.tobytes()] = c
        m = np.array(list(columns.values())).T
        apart = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if apart > wide:
            best, wide = m, apart
    return best


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, and a weight for each n-gram and bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        g = grams(text)
        margin = np.bincount(g, minlength=FEATURES) @ self.weights / len(g)
        loss = np.logaddexp(0, -SHARP * self.code * margin) @ self.trust
        order = np.argsort(loss, kind="stable")
        chance = np.exp(-HEAT * (loss - loss[order[0]]))
        gap = loss[order[1]] - loss[order[0]]
        return self.langs[order[0]], float(1 / chance.sum()), bool(gap < GAP)


def fit(counts: dict[str, np.ndarray]) -> Model:
    """A model from n-gram counts by language (ties between languages go by name)."""
    langs = sorted(counts)
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((FEATURES, 1)), np.ones(1))
    p = np.array([(counts[x] + ALPHA) / (counts[x].sum() + ALPHA * FEATURES) for x in langs])
    columns, trust = [], []
    for bit in code.T:
        yes, no = p[bit > 0].mean(axis=0), p[bit < 0].mean(axis=0)
        w = np.log(yes / no)
        parted = float(((yes - no) * w).sum())  # the gap between the sides' mean margins
        middle = float(((yes + no) * w).sum()) / 2
        columns.append((w - middle) * 2 / max(parted, 1e-9))  # the sides' means at +1 and -1
        trust.append(parted)
    return Model(langs, code, np.array(columns).T, np.array(trust) / sum(trust))


def sampled(known: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the (id, text, lang) rows; all of them, if there are no more.

    Half of them are dealt to the languages by their numbers of rows, half in
    equal parts; a language with fewer rows than its part gives all it has.
    """
    per = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n, langs = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n <= rows:
        return known
    share = F.lit(rows / 2) * (F.lit(1 / n) + 1 / (langs * F.col("n")))
    dealt = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
    return known.join(per.select("lang", share.alias("share")), "lang").filter(dealt).select("id", "text", "lang")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows that are not held out, whose text and label are not null.

    About ``rows`` of them if there are more (``sampled``).  The counts of all
    languages, 16,384 each, come to the driver: labels are a short list.
    """
    known = bounded_batches(df).select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                if has_letter(text):
                    sums.setdefault(lang, np.zeros(FEATURES, np.int64))
                    sums[lang] += np.bincount(grams(text), minlength=FEATURES)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": c[at]})
        release_memory()

    total = sampled(known, rows).select("text", "lang").mapInPandas(count, "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in total.groupby("lang"):
        counts[lang] = np.bincount(part["gram"], part["n"], FEATURES)
    return fit(counts)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to every row.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if nothing could be learnt.  Repeated rows get the same result; an
    empty table gives an empty one; input columns named like an output are
    replaced.
    """
    columns = df.columns

    @F.pandas_udf(SCHEMA)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=SCHEMA.names)
        release_memory()

    scored = packed(bounded_batches(df), text=text_col).select("doc", decode("text").alias("s"))
    return unpacked(scored, columns, {c: F.col("s").getField(c) for c in SCHEMA.names})
