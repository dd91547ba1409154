"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every text into one cell of a register-blocked Bloom filter
(a 64-bit word and three bits in it), counts the cells with a map-side
aggregate and keeps the bits of cells hit at least twice.  Pass two probes
every row against that filter: rows that miss are certainly alone and pass
straight through without a shuffle; rows that hit are *possibly* repeated
and only those shuffle, to be grouped by their full SHA-256.

What shuffles: pass one sends one small record (word, bits, count) for every
distinct text of a task, since a repeat may be in any other task; whole rows
shuffle only if they are possibly repeated.

The filter has at most ``max_words`` words, whatever the input, so its
broadcast is bounded: by default ``MAX_WORDS`` (16 MiB of bits, meant for 8.4
million texts).  Raise it with the broadcast budget.  With more repeated texts
than it can tell apart more rows count as possibly repeated and take the exact
way; the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, packed, quoted, unpacked, written

#: Most 64-bit words of the broadcast filter, and rows a word is meant for.
MAX_WORDS = 1 << 21
ROWS_PER_WORD = 4
#: Parts into which the copies of one text are dealt.
SALTS = 1024


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null is empty."""
    return F.unhex(F.sha2(fold_ascii(text), 256))


def filter_words(rows: int, max_words: int | None = None) -> int:
    """Words for about ``rows`` texts: a power of two, at most ``max_words`` (rounded down to one)."""
    most = MAX_WORDS if max_words is None else max(1, max_words)
    words = 1
    while words * 2 <= most and (words < 1024 or words * ROWS_PER_WORD < rows):
        words *= 2
    return words


def _cell(digest: Column, words: int) -> tuple[Column, Column]:
    """The word and the bits of a digest in the filter."""
    h = F.xxhash64(digest)

    def bit(shift: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"),
                               F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))

    bits = bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))
    return h.bitwiseAND(words - 1), bits


def repeat_filter(digests: DataFrame, words: int) -> DataFrame:
    """Pass one over the column ``digest``: (word, seen) of cells hit twice or more."""
    word, bits = _cell(F.col("digest"), words)
    cells = digests.select(word.alias("word"), bits.alias("bits")) \
        .groupBy("word", "bits").agg(F.count("*").alias("n"))
    again = cells.filter("n > 1").groupBy("word").agg(F.expr("bit_or(bits)").alias("seen"))
    return written(again, "bloom")


def mark_copies(df: DataFrame, id_col: str = "doc_id", digest_col: str = "digest",
                max_words: int | None = None) -> DataFrame:
    """Group rows by digest; the one with the largest id of a group stays.

    ``max_words``: most words of the broadcast filter (``MAX_WORDS`` if not given).

    Returns every input row (without ``digest_col``) with ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``.  Of rows that share text
    and id exactly one is kept; a null id counts as the smallest; an empty
    table gives an empty result.  Input columns named like an output are
    replaced.
    """
    columns = [c for c in df.columns if c != digest_col]
    rows = packed(df.select(*[quoted(c) for c in df.columns]), id=id_col, digest=digest_col)
    rows = rows.withColumn("doc", F.struct(*[F.col("doc").getField(c).alias(c) for c in columns]))
    words = filter_words(df.count()) if max_words is None else filter_words(df.count(), max_words)
    seen = repeat_filter(rows.select("digest"), words)
    word, bits = _cell(F.col("digest"), words)
    probed = rows.withColumns({"word": word, "bits": bits}) \
        .join(F.broadcast(seen), "word", "left") \
        .withColumn("maybe", F.coalesce(F.col("seen").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))

    alone = probed.filter("not maybe").select(
        "doc", "digest", F.col("id").alias("keep"), F.lit(1).cast("bigint").alias("size"), F.lit(True).alias("kept"))

    # The possibly repeated rows; their numbers are fixed by the written files.
    some = written(probed.filter("maybe").select("doc", "id", "digest", F.monotonically_increasing_id().alias("no")),
                   "possible-copies")
    some = some.withColumn("salt", F.pmod(F.xxhash64("no"), F.lit(SALTS)).cast("int"))
    # Copies of one text are counted by (digest, salt) first; the group then
    # has at most SALTS rows, and hands its outcome back to just the salts it has.
    parts = some.groupBy("digest", "salt").agg(F.max(F.struct("id", "no")).alias("last"), F.count("*").alias("n"))
    groups = parts.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("size"),
                                         F.collect_list("salt").alias("salts"))
    outcome = groups.select("digest", "last", "size", F.explode("salts").alias("salt"))
    grouped = some.join(outcome, ["digest", "salt"]).select(
        "doc", "digest", F.col("last.id").alias("keep"), "size", (F.col("no") == F.col("last.no")).alias("kept"))

    return unpacked(alone.unionByName(grouped), columns, {
        "keep_id": F.col("keep"), "group_size": F.col("size"), "kept": F.col("kept"),
        "text_sha256": F.lower(F.hex("digest"))})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_words: int | None = None) -> DataFrame:
    """``docs`` without exact copies: of equal texts (A-Z lower-cased; null is
    empty) the row with the largest id stays, with all its columns.

    Rows that share text and id leave one of them; a null id counts as the
    smallest; an empty table gives an empty one; columns may have any name.
    ``max_words`` as in ``mark_copies``.
    """
    columns = docs.columns
    digest = "digest"
    while digest in columns:
        digest += "_"
    marked = mark_copies(docs.withColumn(digest, text_digest(quoted(text_col))).select(
        F.struct(*[quoted(c).alias(c) for c in columns]).alias("row"), quoted(id_col).alias("id"),
        quoted(digest).alias("digest")), "id", "digest", max_words)
    return marked.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in columns])
