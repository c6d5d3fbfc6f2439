"""Numbering by ranges, joins of hot groups and queue batches against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import tables


@pytest.mark.parametrize("parts", [1, 2, 5, 300])
def test_numbered(spark, parts):
    draw = random.Random(parts)
    names = [None, "", "www.", "é", "z"] + sorted({"www." + "".join(draw.choices("ab", k=8)) for _ in range(150)})
    got = tables.numbered(spark.createDataFrame([(n,) for n in draw.sample(names, len(names))], "name string"), "name", parts=parts)
    assert got.columns == ["name", "id"]
    order = [None] + sorted(n for n in names if n is not None)
    assert {r.name: r.id for r in got.collect()} == {n: i for i, n in enumerate(order, 1)}


def test_numbered_empty_and_null(spark):
    t = spark.createDataFrame([(None,)], "name string")
    assert [r.id for r in tables.numbered(t, "name").collect()] == [1] and tables.numbered(t.where("false"), "name").count() == 0


def test_join_groups(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got, want = tables.join_groups(rows, groups, "k", "id"), rows.join(groups, "k")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert tables.join_groups(rows.where("false"), groups, "k", "id").count() == 0
    assert sorted(tables.join_groups(rows.withColumn("id", F.lit(None).cast("bigint")), groups, "k", "id").select("k").collect()) == sorted(want.select("k").collect())


def test_batches_over_wide_ids(spark):
    draw = random.Random(3)
    ids = sorted({draw.randrange(-10**9, 10**9) for _ in range(500)} | set(range(40)))
    got = {r.batch: r.ids for r in tables.batches(spark.createDataFrame([(i,) for i in ids], "id bigint"), size=7).collect()}
    assert got == {b: ids[b * 7:b * 7 + 7] for b in range(-(-len(ids) // 7))}
