"""Helpers shared by the operators: tables, written intermediates, row packing."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Later stages start from the files: nothing upstream runs twice, row
    numbers given by a task stay as they were written, and a lost executor
    costs a re-read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release_memory() -> None:
    """Give memory that this Python worker has freed back to the system; workers are kept for later stages."""
    import ctypes

    import pyarrow
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once all that was derived from them is written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_of(df: DataFrame, size_col: str, limit: int) -> DataFrame:
    """``df``, written, with ``part``: rows dealt into as many parts as keep each one's ``size_col`` bounded.

    No part's sizes sum to more than twice ``limit``, or than the largest row
    if that is more; this is measured, so a part can be broadcast.
    """
    rows = written(df.withColumn("part_no", F.monotonically_increasing_id()), "parted-rows")
    total, largest = rows.agg(F.sum(size_col), F.max(size_col)).first()
    parts = max(1, -(-(total or 0) // limit))
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("part_no"), F.lit(parts)).cast("int"))
        most = dealt.groupBy("part").agg(F.sum(size_col).alias("size")).agg(F.max("size")).first()[0]
        if parts == 1 or (most or 0) <= max(2 * limit, largest):
            return dealt.drop("part_no")
        parts *= 2


#: Most rows, with whole texts, that a Python worker gets at a time.
BATCH_ROWS = 1_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, after lowering the session's Arrow batches to ``BATCH_ROWS`` rows.

    Spark's default of 10,000 rows would make a worker hold that many whole
    texts.  A smaller setting is left as it is; a lowered one stays, as
    plans read it only when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def quoted(name: str) -> Column:
    """Column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **needed: str) -> DataFrame:
    """All columns of ``df`` in one struct ``doc`` beside the needed ones.

    ``needed`` maps a working name to an input column.  Working names can
    then never clash with columns of the caller.
    """
    row = F.struct(*[quoted(c).alias(c) for c in df.columns])
    return df.select(row.alias("doc"), *[quoted(c).alias(k) for k, c in needed.items()])


def unpacked(df: DataFrame, inputs: list[str], outputs: dict[str, Column]) -> DataFrame:
    """Undo ``packed``: the caller's columns, then the operator's outputs.

    An input column named like an output (in either case) is replaced.
    """
    taken = {k.lower() for k in outputs}
    keep = [F.col("doc").getField(c).alias(c) for c in inputs if c.lower() not in taken]
    return df.select(*keep, *[v.alias(k) for k, v in outputs.items()])


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null counts as empty.

    For pure ASCII texts that is ``lower``, which is much cheaper than
    ``translate``'s walk over code points.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)) \
        .otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32(doc_id as text) mod 5 = 0.

    A null id counts as held out: its labels are never learnt.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
