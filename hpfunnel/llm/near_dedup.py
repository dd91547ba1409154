"""Near-duplicate classes by Order MinHash and banded alignment.

Words are those of the licence scan; shingles are five words in a row.
Texts with the same words are one class from the start, so that only
distinct texts go on.  A text's shingles are labelled by their occurrence
(the second time one occurs differs from the first).  Each of ``BANDS`` hash
functions picks the ``PICK`` smallest labelled shingles and keeps them in
text order: texts agree in a band if they share those shingles in the same
order, which is likely at high edit similarity and unlikely otherwise.
As many further bands sketch the distinct shingles without labels and order,
so that repeated lines and moved paragraphs part no similar texts.

Texts that agree in a band share a bucket and are candidates.  A shingle that
no other candidate has counts against every pair of its text: a similar
pair's texts have at most a ninth of their shingles on one side only.  So a
text's *slack* is a ninth of its shingles less its private ones, and a pair
of negative slack in sum cannot be similar.  That is exact, and splits large
groups of copies that are edited too much to be near each other without
looking at their pairs.

Everyone is aligned with its bucket's leader, the text with most slack; that
settles nearly all.  Texts that then still share a bucket with the leader
but not its class may be linked to another member.  Two members differ at
least by the difference of what they lost of the leader's shingles, region
by region of the leader, beyond their private ones; who has no partner left
by that exact bound is settled too.  The few others are aligned with the
bucket's other classes, with no cap, so that no link between classes is
lost.  Classes are the connected components of the links.

A pair is linked if an alignment of the labelled shingles, within a band
around the diagonal, matches distinct shingles worth at least ``SIMILAR`` of
the union, or else if the distinct shingles that both have anywhere are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, packed, quoted, release_memory, written
from .licences import words_of

SHINGLE, BANDS, PICK = 5, 20, 3
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Regions of a leader by which losses are counted.
REGIONS = 32
#: Parts into which the members of one bucket or class are dealt.
SALTS = 1024
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of five words in a row; a shorter text is one shingle of all its words."""
    w = words.astype(np.uint64)
    k = min(SHINGLE, len(w))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mixed(h * _P + w[i:len(w) - k + 1 + i])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles hashed with their occurrence number in the text."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if new.all():
        return _mixed(h + _P)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return _mixed(h + _P * (nth + np.uint64(1)))


_SEEDS = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _P)


def sketch(marks: np.ndarray) -> np.ndarray:
    """One hash a band: its ``PICK`` smallest labelled shingles in text order."""
    take = min(PICK, len(marks))
    picked = np.empty((BANDS, take), np.uint64)
    step = max(1, (1 << 20) // len(marks))  # bands at a time, for very long texts
    for b in range(0, BANDS, step):
        values = (marks ^ _SEEDS[b:b + step, None]) * _P
        values ^= values >> np.uint64(31)
        picked[b:b + step] = marks[np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)]
    x = _SEEDS.copy()
    for i in range(take):
        x = _mixed(x * _P + picked[:, i])
    return x


def sketches(h: np.ndarray) -> np.ndarray:
    """The bands of the labelled shingles in text order, then those of the distinct shingles
    in the order of their hashes, whatever their places and repeats."""
    return np.concatenate([sketch(labelled(h)), sketch(np.unique(h))])


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Distinct shingles that the best alignment of two word sequences matches, their
    union, and how many distinct shingles both have anywhere.

    A match joins equal labelled shingles; matches may not cross (their
    longest chain is the alignment) and lie within a band around the
    diagonal.  A similar pair without repeats and moves leaves under a ninth
    of its shingles unmatched, so positions drift by less than the band's
    quarter of the longer text.
    Matches are not counted where the pair cannot be similar.
    """
    ha, hb = shingles(a), shingles(b)
    sa, sb = np.unique(ha), np.unique(hb)
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    total = len(sa) + len(sb)
    if (SIMILAR[0] + SIMILAR[1]) * both < SIMILAR[0] * total:
        return 0, total, both
    _, ia, ib = np.intersect1d(labelled(ha), labelled(hb), assume_unique=True, return_indices=True)
    near = np.abs(ia - ib) <= max(64, max(len(ha), len(hb)) // 4)
    ia, ib = ia[near], ib[near]
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    if (np.diff(ib) < 0).any():
        ia = ia[chain(ib)]
    matched = len(np.unique(ha[ia]))
    return matched, total - matched, both


def chain(values: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence (the values are distinct)."""
    tails: list[int] = []
    ends: list[int] = []
    back = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        if at:
            back[i] = ends[at - 1]
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = int(back[i])
    return np.array(out[::-1], int)


def compare(a: np.ndarray, b: np.ndarray) -> tuple[bool, int]:
    """Whether the pair is similar as aligned, and the shingles both have."""
    matched, union, both = aligned(a, b)
    return matched > 0 and SIMILAR[1] * matched >= SIMILAR[0] * union, both


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the pair is similar as aligned, or by all distinct shingles wherever they stand."""
    matched, union, both = aligned(a, b)
    if matched > 0 and SIMILAR[1] * matched >= SIMILAR[0] * union:
        return True
    return both > 0 and SIMILAR[1] * both >= SIMILAR[0] * (matched + union - both)


def lost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct shingles of ``a`` that ``b`` has not, by region of ``a``."""
    ha = shingles(a)
    own, first = np.unique(ha, return_index=True)
    gone = ~np.isin(own, shingles(b))
    return np.bincount(first[gone] * REGIONS // max(1, len(ha)), minlength=REGIONS)


PREPARED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("words", T.BinaryType()),
                         T.StructField("bands", T.ArrayType(T.LongType()))])


def prepare(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digest of the words, the words' hashes, and both sketches (null under ``SHINGLE`` words:
    such texts are similar to texts with the same words only)."""
    for batch in texts:
        rows = []
        for t in batch:
            words = words_of(t)
            w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            bands = sketches(shingles(w)).view(np.int64) if len(w) >= SHINGLE else None
            rows.append((blake2b(b" ".join(words), digest_size=16).digest(), w.tobytes(), bands))
        yield pd.DataFrame(rows, columns=PREPARED.names)
    release_memory()


def hand_back(rows: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Join ``rows`` (with a column ``no``) to the one ``outcome`` of their key, however many share it.

    The rows of a key are dealt by salt, and the outcome goes to just the
    salts that the key has; so it never grows beyond the rows.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("no"), F.lit(SALTS)).cast("int"))
    salts = dealt.groupBy(key).agg(F.collect_set("salt").alias("salts"))
    sent = outcome.join(salts, key).withColumn("salt", F.explode("salts")).drop("salts")
    return dealt.join(sent, [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(no, label): the smallest number in each node's component; nodes without links are left out.

    Every round takes the smallest label among the neighbours and then the
    label's own label, which halves the distance to go.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("no")).agg(F.least(F.col("no"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["no"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["no"] == near["a"]).select(
            "no", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        least = written(least, "least-labels")
        jump = least.select(F.col("no").alias("at"), F.col("label").alias("next"))
        after = least.join(jump, least["label"] == jump["at"], "left").select(
            "no", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        after = written(after, "labels")
        discard(least, labels)
        if not after.filter("was <> label").limit(1).count():
            discard(both)
            return after.select("no", "label")
        labels = after


def verify(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``similar``, and what each lost of the other by region, from
    the texts' words (no, words).

    A text that is in many pairs makes its key hot; both joins are plain
    sort-merge joins of fresh shuffles, whose hot partitions AQE splits.
    """
    @F.pandas_udf("similar boolean, lost_a array<int>, lost_b array<int>")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            rows = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                rows.append((near(a, b), lost(a, b), lost(b, a)))
            yield pd.DataFrame(rows, columns=["similar", "lost_a", "lost_b"])
        release_memory()

    a = blobs.select(F.col("no").alias("a"), F.col("words").alias("left"))
    b = blobs.select(F.col("no").alias("b"), F.col("words").alias("right"))
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", check("left", "right").alias("v"))
    return written(checked.select("a", "b", "v.*"), "verified")


def slacks(words: DataFrame) -> DataFrame:
    """(no, size, slack) of texts (no, words): distinct shingles, and nine times the slack.

    Private shingles are those that no other text of the table has; any pair
    that is looked at lies within the table.
    """
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield pd.Series([np.unique(shingles(np.frombuffer(x, np.uint32))).view(np.int64) for x in blobs], dtype=object)
        release_memory()

    own = words.select("no", distinct("words").alias("shingles"))
    counted = own.select("no", F.explode("shingles").alias("shingle")).groupBy("shingle") \
        .agg(F.count("*").alias("n"), F.min("no").alias("no"))
    private = counted.filter("n = 1").groupBy("no").agg(F.count("*").alias("private"))
    size = own.select("no", F.size("shingles").cast("bigint").alias("size"))
    return size.join(private, "no", "left").select(
        "no", "size", (F.col("size") - 9 * F.coalesce("private", F.lit(0))).alias("slack"))


def find_links(texts: DataFrame, words: DataFrame) -> DataFrame:
    """All links (a, b) needed for the classes of distinct texts (no, bands); ``words``: (no, words)."""
    buckets = texts.filter(F.col("bands").isNotNull()).select(
        "no", F.posexplode("bands").alias("band", "hash")).select("no", F.xxhash64("band", "hash").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("no").alias("low"), F.max("no").alias("high")) \
        .filter("low < high").select("bucket")
    members = written(buckets.join(shared, "bucket", "left_semi"), "bucket-members")  # AQE splits a hot bucket
    blobs = written(words.join(members.select("no").distinct(), "no", "left_semi"), "candidate-words")
    known = written(slacks(blobs), "slacks")

    with_slack = written(members.join(known, "no"), "known-members")
    discard(members, known)
    leaders = with_slack.groupBy("bucket").agg(F.max(F.struct("slack", "no", "size")).alias("lead"), F.count("*").alias("n")) \
        .filter("n > 1").select("bucket", "lead")
    # who cannot be similar to the text of most slack cannot be similar to anyone in the bucket
    led = written(hand_back(with_slack, leaders, "bucket").filter(F.col("slack") + F.col("lead.slack") >= 0), "led-members")
    discard(with_slack)
    pairs = led.filter((F.col("no") != F.col("lead.no")) & _of_a_size(F.col("size"), F.col("lead.size"))) \
        .select(F.least("no", "lead.no").alias("a"), F.greatest("no", "lead.no").alias("b")).distinct()
    pairs = written(pairs, "leader-pairs")
    verified = verify(pairs, blobs)
    discard(pairs)
    links = verified.filter("similar").select("a", "b")

    # The same outcome seen from either side, to hand it back to the buckets' members.
    seen = verified.select(F.col("a").alias("no"), F.col("b").alias("lead_no"), F.col("lost_b").alias("regions")) \
        .union(verified.select(F.col("b").alias("no"), F.col("a").alias("lead_no"), F.col("lost_a").alias("regions")))
    labels = written(components(links), "leader-classes")
    of_leader = labels.select(F.col("no").alias("lead_no"), F.col("label").alias("lead_label"))
    classed = led.select("bucket", "no", "size", "slack", F.col("lead.no").alias("lead_no")) \
        .join(labels, "no", "left").join(of_leader, "lead_no", "left").join(seen, ["no", "lead_no"], "left")
    # shingles of the leader that a member has not; unknown (null) where sizes are too far apart
    regions = F.when(F.col("no") == F.col("lead_no"), F.array_repeat(F.lit(0), REGIONS)).otherwise(F.col("regions"))
    loss = F.aggregate(regions, F.lit(0), lambda x, y: x + y)
    classed = written(classed.select(
        "bucket", "no", "size", "slack", regions.alias("regions"), loss.alias("loss"), F.coalesce("label", "no").alias("label"),
        (F.coalesce("label", "no") != F.coalesce("lead_label", "lead_no")).alias("outside")), "classed-members")
    discard(led, labels)

    def of(*names: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_x") for c in names]

    room = F.col("slack") + F.col("slack_x") - 9 * F.coalesce(F.abs(F.col("loss") - F.col("loss_x")), F.lit(0))
    profile = classed.groupBy("bucket", "loss").agg(F.max("slack").alias("slack"))
    apart = F.aggregate(F.zip_with("regions", "regions_x", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    close = F.col("slack") + F.col("slack_x") - 9 * F.coalesce(apart, F.lit(0)) >= 0
    outside = classed.filter("outside").select("bucket", *of("no", "size", "slack", "regions", "loss", "label"))
    hopeful = outside.join(profile, "bucket").filter(room >= 0).select("bucket", "no_x").distinct()
    hopeful = written(hopeful, "open-members")
    outside = outside.join(hopeful, ["bucket", "no_x"], "left_semi")
    across = outside.join(classed, "bucket").filter(
        (F.col("label") != F.col("label_x")) & (room >= 0) & _of_a_size(F.col("size"), F.col("size_x")) & close) \
        .select(F.least("no", "no_x").alias("a"), F.greatest("no", "no_x").alias("b")).distinct()
    across = written(across.join(verified, ["a", "b"], "left_anti"), "class-pairs")
    discard(classed, hopeful)
    more = verify(across, blobs).filter("similar").select("a", "b")
    discard(across, blobs)
    return links.union(more)


def _of_a_size(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(x, y) * SIMILAR[1] >= F.greatest(x, y) * SIMILAR[0]


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows as written (id, no, digest; with ``whole`` also doc, all columns) and their classes
    (no, class_id, class_size, kept).

    See ``mark_near_copies`` for what counts as near.
    """
    columns = packed(bounded_batches(df), id=id_col, text=text_col)
    rows = written(columns.select(*["doc"] * whole, F.col("id").cast("bigint").alias("id"),
                                  F.pandas_udf(prepare, PREPARED)("text").alias("p"),
                                  F.monotonically_increasing_id().alias("no")), "near-rows")
    facts = rows.select("no", "id", F.col("p.digest").alias("digest"), F.col("p.bands").alias("bands"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("no")))
    texts = written(facts.groupBy("digest").agg(
        first.alias("first"), F.count("*").alias("n"), F.min_by("bands", "no").alias("bands"),
        F.min("no").alias("no")), "distinct-texts")
    links = find_links(texts.select("no", "bands"), rows.select("no", F.col("p.words").alias("words")))
    classed = texts.select("digest", "first", "n", "no").join(components(links), "no", "left") \
        .withColumn("label", F.coalesce("label", "no"))
    classed = written(classed, "classed-texts")
    discard(texts)
    groups = classed.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
    of_text = hand_back(classed.select("digest", "no", "label"), groups, "label").drop("no", "label")
    marked = hand_back(facts.select("no", "digest"), of_text, "digest").select(
        "no", F.col("first.id").alias("class_id"), F.col("size").alias("class_size"),
        (F.col("no") == F.col("first.no")).alias("kept"))
    marked = written(marked, "near-marks")
    discard(classed)
    return rows.select(*["doc"] * whole, "id", "no"), marked


def mark_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col`` with ``class_id`` (smallest id of its class), ``class_size`` and ``kept``.

    Linked texts have a similarity of 0.8 or more on their shingles of five
    words; texts under five words are near only to texts with the same words,
    and all texts without words (null and empty too) are one class.  One row
    a class is kept: the smallest id, of repeated rows one; a null id comes
    last.  An empty table gives an empty result.
    """
    rows, marked = near_classes(df.select(quoted(id_col), quoted(text_col)), id_col, text_col)
    return rows.select("no", F.col("id").alias(id_col)).join(marked, "no").drop("no")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each near-duplicate class, with all its columns, whatever their names.

    Which rows are a class, and which one stays, is as in ``mark_near_copies``.
    """
    rows, marked = near_classes(df, id_col, text_col, whole=True)
    dropped = written(marked.filter("not kept").select("no"), "near-dropped")
    kept = rows.join(dropped, "no", "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
