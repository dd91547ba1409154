"""Native text expressions: Unicode-aware trim, accent folding, reason rules.

All functions return ``Column`` expressions built from Spark built-ins, so
they stay inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# --- fixed values: characters Python treats as whitespace -------------------
# (str.isspace / str.strip / str.split): ASCII controls 0x09-0x0D, 0x1C-0x1F,
# space, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F,
# U+205F, U+3000.
PY_WHITESPACE_CLASS = (
    "[\\x{09}-\\x{0D}\\x{1C}-\\x{1F}\\x{20}\\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# After accent folding only ASCII is left; of the class above that is:
ASCII_WHITESPACE_CLASS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{1F}\\x{20}]"


# The same set as literal characters, for the native trim.
PY_WHITESPACE_CHARS = "".join(
    [chr(c) for c in range(0x09, 0x0E)] + [chr(c) for c in range(0x1C, 0x21)]
    + ["\x85", "\xa0", "\u1680"] + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])


def _plain_ends(col: Column) -> Column:
    """True if the first and the last character are ASCII and no whitespace (0x21-0x7F), by two comparisons each."""
    last = F.substring(col, -1, 1)
    return (col >= "!") & (col < "\x80") & (last >= "!") & (last < "\x80")


def py_strip(col: Column) -> Column:
    """Trim leading/trailing whitespace exactly like Python's ``str.strip``.

    Only values that may have some at their ends are trimmed; no regex runs.
    """
    return F.when(_plain_ends(col), col).otherwise(F.btrim(col, F.lit(PY_WHITESPACE_CHARS)))


@functools.lru_cache(maxsize=1)
def _fold_tables():
    """Compatibility-decomposition tables derived from ``unicodedata``.

    Rule: NFKD-decompose every code point and keep only its ASCII part.
    One-character results go to a ``translate`` map; multi-character
    results (ligatures, fractions, ellipsis, ...) get a per-character slow
    path.  Code points whose ASCII part is empty are dropped later by the
    non-ASCII filter, so they need no entry.
    """
    single_from, single_to = [], []
    multi = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFKD", ch)
        if folded == ch:
            continue
        ascii_part = folded.encode("ascii", "ignore").decode("ascii")
        if len(ascii_part) == 1:
            single_from.append(ch)
            single_to.append(ascii_part)
        elif len(ascii_part) > 1:
            multi.append((ch, ascii_part))
    return "".join(single_from), "".join(single_to), multi


def _expand_multi(col: Column) -> Column:
    """Replace every multi-character-expansion code point by its ASCII text."""
    _, _, multi = _fold_tables()
    if not multi:
        return col
    longest = max(len(a) for _, a in multi)
    multi_chars = "".join(c for c, _ in multi)

    def has_multi(x: Column) -> Column:
        # translate() is a hash lookup per character; a large regex
        # character class would be scanned linearly at every position.
        return F.length(F.translate(x, multi_chars, "")) != F.length(x)

    # position j of the expansion: characters with a j-th letter map to it,
    # shorter ones are listed last without a target and so are deleted.
    parts = []
    for j in range(longest):
        has = [(c, a[j]) for c, a in multi if len(a) > j]
        lacks = [c for c, a in multi if len(a) <= j]
        src = "".join(c for c, _ in has) + "".join(lacks)
        dst = "".join(t for _, t in has)
        parts.append((src, dst))

    def per_char(c: Column) -> Column:
        expanded = F.concat(*[F.translate(c, s, d) for s, d in parts])
        return F.when(has_multi(c), expanded).otherwise(c)

    chars = F.regexp_extract_all(col, F.lit("(?s)."), 0)
    slow = F.array_join(F.transform(chars, per_char), "")
    return F.when(has_multi(col), slow).otherwise(col)


def normalize_text(col: Column) -> Column:
    """NFKD fold, keep ASCII, upper-case, trim and collapse whitespace.

    Null becomes the empty string.
    """
    src, dst, _ = _fold_tables()
    s = F.coalesce(col.cast("string"), F.lit(""))
    # pure-ASCII text (one byte per character) skips the folding tables
    folded = F.regexp_replace(F.translate(_expand_multi(s), src, dst), "[^\\x{00}-\\x{7F}]", "")
    s = F.when(F.octet_length(s) == F.length(s), s).otherwise(folded)
    s = F.upper(s)
    s = F.regexp_replace(s, f"{ASCII_WHITESPACE_CLASS}+", " ")
    return F.trim(s)  # only single spaces are left as whitespace


def _any_contains(text: Column, words) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def categorize_reason(col: Column, already_normalized: bool = False) -> Column:
    """Map a free-text non-conversion reason to its business category."""
    t = col if already_normalized else normalize_text(col)
    expr = F.when((t == "") | (t == "NO ESPECIFICADO"), F.lit(K.REASON_NOT_SPECIFIED))
    for label, words in K.REASON_RULES_BEFORE_STAFF:
        expr = expr.when(_any_contains(t, words), F.lit(label))
    expr = expr.when(_any_contains(t, K.STAFF_GROUP_A) & _any_contains(t, K.STAFF_GROUP_B),
                     F.lit(K.REASON_STAFF))
    for label, words in K.REASON_RULES_AFTER_STAFF:
        expr = expr.when(_any_contains(t, words), F.lit(label))
    return expr.otherwise(F.lit(K.REASON_OTHER))


def clean_category(col: Column) -> Column:
    """Null -> sentinel, strip, empty -> sentinel (string categoricals)."""
    v = F.coalesce(col.cast("string"), F.lit(K.NOT_SPECIFIED))
    stripped = F.btrim(v, F.lit(PY_WHITESPACE_CHARS))
    return F.when(_plain_ends(v), v).when(stripped == "", F.lit(K.NOT_SPECIFIED)).otherwise(stripped)


def shorten(col: Column, max_length: int = K.SHORTEN_LENGTH) -> Column:
    """Truncate with an ellipsis; null/empty become the sentinel."""
    v = F.when(col.isNull() | (col.cast("string") == ""), F.lit(K.NOT_SPECIFIED)) \
        .otherwise(col.cast("string"))
    head = F.regexp_replace(F.substring(v, 1, max_length - 1), f"{PY_WHITESPACE_CLASS}+$", "")
    cut = F.concat(head, F.lit(K.ELLIPSIS))
    return F.when(F.length(v) <= max_length, v).otherwise(cut)
