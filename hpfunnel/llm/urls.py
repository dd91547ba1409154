"""URL filter: a bit-parallel automaton that runs all glob rules at once.

Every rule is a glob over the canonical url (host with A-Z lower-cased, then
the path): ``?`` is one character but ``/``, ``*`` any run without ``/``
and ``**`` any run.  The states of all rules ("the first i items of this rule
match") are packed one after the other into 64-bit words.  A character moves
all of them at once (Shift-And with self-loops)::

    D' = ((D << 1) & enter[c]) | (D & stay[c])

where the shift carries over from word to word.  Urls of a batch are stepped
together, longest first, so that no url is padded.
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

from .common import packed, unpacked

#: Urls that are stepped together (a bound on the automaton's memory).
BLOCK = 4096

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


# The rules of the registered query.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Globs that block a url to which no host rule applies.
BLOCK_GLOBS = (
    "*adult*.**",
    "*ads-*.**",
    "*casino*.**",
    "*-bets*.**",
    "*-pills*.**",
    "*spam*.**",
)


@dataclass(frozen=True)
class Automaton:
    """Packed states: masks by character class and word."""

    classes: dict[str, int]
    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, np.uint64]]


def compile_globs(globs: list[str]) -> Automaton:
    """Pack the globs' states into words; class 0 is any character not named."""
    items = [re.findall(r"\*\*|\*|\?|[^*?]", g) for g in globs]
    literals = sorted({x for g in items for x in g if x not in ("*", "**", "?")} | {"/"})
    classes = {c: i + 1 for i, c in enumerate(literals)}
    slash = classes["/"]
    every = range(len(classes) + 1)
    enter: list[tuple[int, int]] = []
    stay: list[tuple[int, int]] = []
    start, accept, at = [], [], 0
    for g in items:
        start.append(at)
        for x in g:
            if x in ("*", "**"):
                stay += [(c, at) for c in every if x == "**" or c != slash]
            else:
                at += 1
                enter += [(c, at) for c in every if (c != slash if x == "?" else c == classes[x])]
        accept.append(at)
        at += 1
    words = at // 64 + 1

    def masks(bits: list[tuple[int, int]], rows: int) -> np.ndarray:
        out = np.zeros((rows, words), np.uint64)
        for row, bit in bits:
            out[row, bit // 64] |= np.uint64(1 << bit % 64)
        return out

    return Automaton(classes, masks(enter, len(classes) + 1), masks(stay, len(classes) + 1),
                     masks([(0, b) for b in start], 1)[0], [(b // 64, np.uint64(1 << b % 64)) for b in accept])


def run(auto: Automaton, urls: list[str]) -> np.ndarray:
    """Which globs accept which url: booleans, a row for each url."""
    out = np.zeros((len(urls), len(auto.accept)), bool)
    lookup = np.zeros(128, np.int16)  # literals are ASCII here; anything else is class 0
    for c, k in auto.classes.items():
        lookup[ord(c)] = k
    for base in range(0, len(urls), BLOCK):
        part = urls[base:base + BLOCK]
        sizes = np.array([len(u) for u in part])
        order = np.argsort(-sizes, kind="stable")
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(points < 128, lookup[np.minimum(points, 127)], 0)
        first = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(auto.start, (len(part), 1))
        for p in range(int(sizes[0]) if len(part) else 0):
            live = int(np.searchsorted(-sizes, -p, side="left"))  # urls longer than p
            c, d = kinds[first[:live] + p], state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & auto.enter[c]) | (d & auto.stay[c])
        for k, (word, bit) in enumerate(auto.accept):
            out[base + order, k] = (state[:, word] & bit) != 0
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def judge_urls(df: DataFrame, url_col: str = "url", rules: tuple[HostRule, ...] = HOST_RULES,
               block: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    The longest host rule that fits decides (ties: the first listed) and is
    named in ``rule``.  Where none fits, ``rule`` is null and the verdict is
    block if a glob of ``block`` accepts the url, else allow.  A null url or
    one without ``://`` has an empty host and path, and is allowed.  Repeated
    rows are judged alike; an empty table gives an empty result; input
    columns named like an output are replaced.
    """
    columns = df.columns
    globs = [g for r in rules for g in r.globs] + list(block)
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = compile_globs(globs)
        for urls in batches:
            parts = [split_url(u) for u in urls]
            hit = run(auto, [h + p for h, p in parts])
            rule = np.full(len(parts), None, object)
            verdict = np.where(hit[:, 2 * len(rules):].any(axis=1), "block", "allow").astype(object)
            for i in reversed(ranked):  # the longest last, so that it wins
                fits = hit[:, 2 * i] | hit[:, 2 * i + 1]
                rule[fits], verdict[fits] = rules[i].name, rules[i].verdict
            yield pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts],
                                "rule": rule, "verdict": verdict})

    judged = packed(df, url=url_col).select("doc", judge("url").alias("u"))
    return unpacked(judged, columns, {c: F.col("u").getField(c) for c in SCHEMA.names})
