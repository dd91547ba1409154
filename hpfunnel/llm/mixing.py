"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of ``t`` words gets a rate ``r`` (how often the mix takes it).
The rates closest to one in Kullback-Leibler divergence, at most ``MOST``,
whose words add up to each source's target are exponentially tilted::

    r = min(MOST, exp(lambda_source * t))

Each source's lambda solves the convex dual; Newton steps (on the logarithm
of the source's words, kept inside a bracket) take a distributed sum over a
histogram of sizes each.  Sums are decimal, so their order changes nothing
and reruns agree.

Rates become whole copies: everyone gets floor(r), and the fractions are
settled in the order of a hash, shifted by the fraction, up to the place
where the source's words come nearest its target.  That place is found by
two rounds of 4096 buckets, not by sorting a source.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, unpacked, written

#: Most copies of a document, and the sources' weights in code-point order.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Newton steps at most; residual (share of the target, words) that ends them.
STEPS, CLOSE, WORDS = 60, 1e-7, 0.5
#: At this lambda every document of a word or more is at its cap.
TOP = log(MOST) + 1e-3
BUCKET_BITS = 12
EXACT = "decimal(38,6)"


def size_of(text: Column) -> Column:
    """Words of a text: runs without space, tab, line breaks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) from (key, source_size): water filling by weight.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; no target goes
    over ``MOST`` times its source's size.  Sorted by cap over weight, the
    capped sources come first, so running sums find the common level.  The
    windows run over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("key") == "", "key"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "left": F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "share": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = F.when(F.col("cap") * F.col("share") >= F.col("weight") * F.col("left"),
                   F.struct("place", (F.col("left") / F.col("share")).alias("level")))
    rows = rows.withColumn("first", F.min(level).over(every))
    return rows.select("key", "source_size", F.when(F.col("place") < F.col("first.place"), F.col("cap"))
                       .otherwise(F.col("weight") * F.col("first.level")).alias("target"))


def _rate(size: Column, lam: Column) -> Column:
    return F.when(size > 0, F.least(F.lit(float(MOST)), F.exp(lam * size))).otherwise(F.lit(0.0))


def solve(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Add ``lam`` to (key, source_size, target); ``histogram`` is (key, size, n).

    One job a Newton step; whether any source is off its target comes to the
    driver.  Sources that are still off after ``STEPS`` steps are an error.
    """
    capped = F.col("target") >= MOST * F.col("source_size")
    state = goals.withColumns({
        "lam": F.when(capped, F.lit(TOP)).otherwise(F.lit(0.0)),
        "low": F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)),
        "high": F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(F.lit(TOP))})
    for _ in range(STEPS):
        state = written(state, "lambda")
        r, t = _rate(F.col("size"), F.col("lam")), F.col("size")
        sums = histogram.join(state.select("key", "lam"), "key").groupBy("key").agg(
            F.sum((F.col("n") * t * r).cast(EXACT)).cast("double").alias("words"),
            F.sum(F.when(r < MOST, F.col("n") * t * t * r).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        state = state.join(sums, "key", "left").withColumns({
            "words": F.coalesce("words", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})
        state = written(state, "newton")
        off = F.abs(F.col("words") - F.col("target"))
        if not state.filter(~capped & (off > CLOSE * F.col("target") + WORDS)).limit(1).count():
            break
        low = F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("words") < F.col("target"), F.col("high")).otherwise(F.col("lam"))
        step = F.col("lam") + F.when((F.col("slope") > 0) & (F.col("words") > 0) & (F.col("target") > 0),
                                     F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope"))
        lam = F.when((step > F.col("low_")) & (step < F.col("high_")), step).otherwise((F.col("low_") + F.col("high_")) / 2)
        state = state.withColumns({"low_": low, "high_": high}).select(
            "key", "source_size", "target", F.when(capped, F.col("lam")).otherwise(lam).alias("lam"),
            F.col("low_").alias("low"), F.col("high_").alias("high"))
    else:
        raise RuntimeError(f"no rates found for every source in {STEPS} Newton steps")
    return state.select("key", "source_size", "target", "lam")


def _fraction(size: Column, lam: Column) -> tuple[Column, Column]:
    r = _rate(size, lam)
    whole = F.floor(r)
    return whole, r - whole


def _place(number: Column, size: Column, lam: Column) -> Column:
    """Order in which fractions become copies: a hash less the fraction, as an integer."""
    _, part = _fraction(size, lam)
    u = F.xxhash64(number, F.lit("mix")).bitwiseAND((1 << 48) - 1) / float(1 << 48)
    return F.floor((u - part + 1) * float(1 << (2 * BUCKET_BITS - 1))).cast("bigint")


def cuts(base: DataFrame, solved: DataFrame) -> DataFrame:
    """Add ``cut`` to the solved sources: places below it get one copy more."""
    size, lam = F.col("size"), F.col("lam")
    whole, part = _fraction(size, lam)
    rows = base.select("key", "id", "size").join(solved.select("key", "lam"), "key").select(
        "key", (whole * size).alias("whole"), F.when(part > 0, size).otherwise(F.lit(0)).cast("bigint").alias("more"),
        _place(F.col("id"), size, lam).alias("place"))

    def boundary(rows: DataFrame, bucket: Column, need: DataFrame) -> DataFrame:
        """The bucket of each source in which its running words pass ``need``, and the words before it."""
        sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("more").alias("more"))
        run = Window.partitionBy("key").orderBy("bucket")  # at most 4096 rows a source
        sums = sums.withColumn("upto", F.sum("more").over(run)).join(need, "key") \
            .filter(F.col("upto") >= F.col("need"))
        return sums.groupBy("key").agg(F.min(F.struct("bucket", "upto", "more", "need")).alias("b")).select(
            "key", F.col("b.bucket").alias("at"), (F.col("b.need") - (F.col("b.upto") - F.col("b.more"))).alias("need"),
            F.col("b.more").alias("inside"))

    need = solved.join(rows.groupBy("key").agg(F.sum("whole").alias("whole")), "key") \
        .select("key", (F.col("target") - F.col("whole")).alias("need"))
    need = written(need, "fraction-words")
    coarse = written(boundary(rows, F.shiftright("place", BUCKET_BITS), need), "coarse-cut")
    inner = rows.join(coarse.select("key", "at"), "key").filter(F.shiftright("place", BUCKET_BITS) == F.col("at"))
    fine = boundary(inner, F.col("place"), coarse.select("key", "need"))
    # the boundary's own place is taken if that comes nearer the target
    fine = fine.select("key", (F.col("at") + F.when(2 * F.col("need") > F.col("inside"), 1).otherwise(0)).alias("cut"))
    everyone = F.lit(1 << (2 * BUCKET_BITS + 1))
    return written(solved.join(fine, "key", "left").withColumn("cut", F.coalesce("cut", everyone)), "mix")


def plan(base: DataFrame) -> DataFrame:
    """The mix of (key, id, size) rows: (key, source_size, target, lam, cut) a source."""
    histogram = written(base.groupBy("key", "size").agg(F.count("*").alias("n")), "sizes")
    goals = targets(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    return cuts(base, solve(histogram.filter("size > 0"), goals))


def copies_of(number: Column, size: Column, lam: Column, cut: Column) -> Column:
    whole, part = _fraction(size, lam)
    more = (part > 0) & (_place(number, size, lam) < cut)
    return (whole + F.when(more, 1).otherwise(0)).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        size_col: str | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every row.

    ``size_col`` names sizes that are known already.  A null source is a
    source of its own; null and empty texts have size 0 and no copies, as
    has every row where no source has words.  Rows that share id, source and
    size get the same number of copies.  An empty table gives an empty
    result; input columns named like an output are replaced.

    Sources' plans are joined by Catalyst's size check: broadcast while their
    file is small, else a sort-merge join whose skew AQE splits.
    """
    columns = df.columns
    size = {"size": size_col} if size_col else {"text": text_col}
    rows = packed(df, id=id_col, source=source_col, **size).withColumn("key", _key(F.col("source")))
    if not size_col:
        rows = rows.withColumn("size", size_of(F.col("text")))
    base = written(rows.select("key", F.col("id").cast("string").alias("id"), "size"), "mix-base")
    joined = rows.join(plan(base), "key")
    n = copies_of(F.col("id").cast("string"), F.col("size"), F.col("lam"), F.col("cut"))
    return unpacked(joined, columns, {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": n,
        "taken": n * F.col("size")})


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as many times as it has copies, with its own columns."""
    row = F.struct(*[quoted(c).alias(c) for c in df.columns]).alias("row")
    rows = df.select(row, quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(source_col).alias("source"))
    again = mix(rows, "id").filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
