"""Secret scan: pattern spans plus dictionary-primed zstandard novelty.

Patterns give the base spans.  Beyond them every long string that stands
shortly after or before a sensitive word is a candidate, whatever its
characters.  Its novelty is its marginal
compressed size: the bytes a zstandard frame of (context + candidate) needs
beyond the frame of the context alone, for each character of the candidate,
with a compressor primed by a dictionary of identifiers.  Strings that the
context and the identifiers explain cost little; keys do not compress, and
are reported.

The dictionary holds the identifiers that stand around sensitive words most
often, counted over all documents, up to ``DICT_BYTES``.  A key must not
explain itself or its copies, so words inside a string of candidate length
count only if that string reads as words, by its pairs of letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, packed, unpacked

#: The base patterns, as (kind, pattern, measured group, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The kind of spans that novelty adds; listed after the base kinds.
NOVEL = "novel"
KINDS = (*(k for k, *_ in BASE), NOVEL)

#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer"
    r"|authorization|signature", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What joins two candidates to one dotted string.
DOTS = re.compile(r"\.(?:[A-Za-z0-9+/_=-]+\.)*")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")

#: The most frequent letter pairs of written words, and the least share of
#: them in a string that reads as words (random letters have about 0.15).
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne"
    " ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa"
    " ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os".split())
READS = 0.5

#: Characters after and before a sensitive word in which candidates are looked for, and
#: characters of context on either side of a candidate.
REACH, CONTEXT = 64, 256
#: Least novelty (marginal bytes a character), and bytes of the dictionary.
LEAST, DICT_BYTES = 0.55, 16_384

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; too short ones are dropped."""
    return [(kind, m.start(), m.end()) for kind, rx, group, least in BASE
            for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]


def candidates(text: str) -> list[tuple[int, int]]:
    """Long strings that begin within reach after a sensitive word or end within reach before it.

    The reach bounds the near end only.  Strings joined by dots (the parts of
    a signed token) are in reach together.  A string with a sensitive word in
    it is cut there.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    strings = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in strings], [b for _, b in strings]
    joined = [False, *(bool(DOTS.fullmatch(text, b, a)) for b, a in zip(ends, starts[1:])), False]
    found = set()
    for _, b in reversed(words):
        first = i = bisect_right(ends, b)
        while i < len(strings) and (max(starts[i], b) < b + REACH or i > first and joined[i]):
            if strings[i] in found:
                break  # the rest was found from a later word
            found.add((max(starts[i], b), ends[i]))
            i += 1
    last = 0  # end of the word before, from which all that begins earlier was found
    for a, b in words:
        first = i = bisect_left(starts, a) - 1
        while i >= 0 and starts[i] >= last and (min(ends[i], a) > a - REACH or i < first and joined[i + 1]):
            found.add((starts[i], min(ends[i], a)))
            i -= 1
        last = b
    return sorted((x, y) for x, y in found if CANDIDATE.fullmatch(text, x, y))


def reads(string: str) -> bool:
    """Whether a string's neighbouring letters and digits are mostly pairs that words have."""
    t = string.lower()
    pairs = [p for p in map("".join, zip(t, t[1:])) if p.isalnum()]
    return sum(p in PAIRS for p in pairs) >= READS * len(pairs)


def identifiers(texts: DataFrame) -> bytes:
    """Identifiers around sensitive words, most frequent last, as a raw dictionary.

    Counted over all rows of the column ``text``; ties go to the smaller
    word.  Only the ``DICT_BYTES`` // 5 most frequent ones (an identifier has
    four characters at least) come to the driver.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter[str] = Counter()
            for t in b["text"]:
                plain = None
                for s in SENSITIVE.finditer(t or ""):
                    if plain is None:  # places stay, so that a key cut by the reach is no word either
                        plain = CANDIDATE.sub(lambda m: m[0] if reads(m[0]) else " " * len(m[0]), t)
                    around = plain[max(0, s.start() - REACH):s.end() + REACH]
                    seen.update(w for w in IDENTIFIER.findall(around) if sum(c.isdigit() for c in w) < 3)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": "object", "n": "int64"})

    top = texts.select("text").mapInPandas(count, "word string, n bigint").groupBy("word") \
        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(DICT_BYTES // 5).collect()
    out: list[bytes] = []
    room = DICT_BYTES
    for r in top:
        w = r["word"].encode() + b" "
        if len(w) > room:
            break
        out.append(w)
        room -= len(w)
    return b"".join(reversed(out))


class Novelty:
    """Marginal compressed bytes a character, under a primed compressor."""

    def __init__(self, words: bytes) -> None:
        primed = {"dict_data": zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} \
            if len(words) >= 8 else {}
        self._size = zstandard.ZstdCompressor(level=12, write_content_size=False, **primed)

    def __call__(self, text: str, start: int, end: int) -> float:
        # surrounding text on both sides, so that a key repeated nearby is no novelty
        around = (text[max(0, start - CONTEXT):start] + "\n" + text[end:end + CONTEXT]).encode("utf-8", "surrogatepass")
        with_it = around + text[start:end].encode("utf-8", "surrogatepass")
        return (len(self._size.compress(with_it)) - len(self._size.compress(around))) / (end - start)


def spans_of(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind as listed, each with its novelty."""
    text = text or ""
    base = base_spans(text)
    found = [(k, a, b, novelty(text, a, b)) for k, a, b in base]
    for a, b in candidates(text):
        if not any(x < b and a < y for _, x, y in base):
            n = novelty(text, a, b)
            if n >= LEAST:
                found.append((NOVEL, a, b, n))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans`` (kind, start, end, novelty; code points, end exclusive) to every row.

    A null or empty text has no spans.  Candidates that overlap a base span
    are not reported again.  Repeated rows get the same spans, ties are
    ordered by kind as listed, an empty table gives an empty result, and an
    input column named ``spans`` is replaced.
    """
    columns = df.columns
    rows = packed(bounded_batches(df), text=text_col)
    words = identifiers(rows)

    @F.pandas_udf(T.ArrayType(SPAN))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty, names = Novelty(words), SPAN.names
        for texts in batches:
            yield pd.Series([[dict(zip(names, s)) for s in spans_of(t, novelty)] for t in texts], dtype=object)

    return unpacked(rows.select("doc", find("text").alias("s")), columns, {"spans": F.col("s")})


def span_summary(scanned: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, counts by base kind, the base spans' digest and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != NOVEL)
    counts = [count(k) for k, *_ in BASE]
    return scanned.select(*keep, *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                          listed(F.col("spans")).alias("spans"))
