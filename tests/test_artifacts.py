"""Readers of the tables that a run leaves: declared schemas, float-text integers, bad cells."""
import pytest
from pyspark.sql import functions as F

from hpfunnel.functions.typing import coerce
from hpfunnel.session import shared_path
from hpfunnel.sources import sinks
from hpfunnel.sources.artifacts import ARTIFACTS, artifact_schema, read_artifact


def test_coerce_keeps_whole_numbers_and_drops_what_is_no_number(spark):
    cells = [None, "", "x", "2020", "2020.0", "2020.5", "1e3", "NaN", "inf", "-Infinity", " 7 ", "-0.25", "9999999999"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(*[coerce(F.col("c"), t).alias(t) for t in ("int", "bigint", "double")]).collect()
    assert [r["int"] for r in got] == [None, None, None, 2020, 2020, None, 1000, None, None, None, 7, None, None]
    assert [r["bigint"] for r in got] == [None, None, None, 2020, 2020, None, 1000, None, None, None, 7, None, 9999999999]
    assert [r["double"] for r in got] == [None, None, None, 2020.0, 2020.0, 2020.5, 1000.0, None, None, None, 7.0, -0.25, 9999999999.0]


@pytest.mark.parametrize("table", sorted(ARTIFACTS))
def test_every_table_comes_back_as_declared(spark, table):
    fields = artifact_schema(table).fields
    value = {"string": 'á "b", c\nd', "int": "2024.0", "bigint": "12345678901.0", "double": "0.125", "boolean": "True",
             "timestamp_ntz": "2024-05-06 07:08:09", "decimal(18,2)": "1234.50"}
    bad = {k: "inf" if k == "double" else "?" for k in value} | {"string": "?"}
    kinds = [f.dataType.simpleString() for f in fields]
    text = spark.createDataFrame([[v[k] for k in kinds] + ["x"] for v in (value, bad)],
                                 ", ".join(f"`{f.name}` string" for f in fields) + ", extra string")
    path = shared_path(spark, "artifact")
    sinks.write_csv(text.coalesce(1), path, gzip=True)
    back = read_artifact(spark, path, table)
    assert back.schema.simpleString() == artifact_schema(table).simpleString()
    good, broken = back.collect()
    for f, k in zip(fields, kinds):
        assert str(good[f.name]) == {"int": "2024", "bigint": "12345678901"}.get(k, value[k]), f.name
        assert broken[f.name] == ("?" if k == "string" else None), f.name
    sinks.write_csv(text.select(fields[0].name).limit(0), path)
    assert read_artifact(spark, path, table).count() == 0  # columns that the file lacks are null


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        read_artifact(spark, "/nowhere", "nothing")
