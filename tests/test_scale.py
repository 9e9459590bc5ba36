"""Skew helpers give the same rows as the plain operation, however the input is laid out."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from msgrisk.operators import corpus, scale


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = [(i, random.choice(["hot"] * 6 + [None, "a", "b"]), random.randint(0, 40)) for i in range(600)]
    return spark.createDataFrame(data, "id long, k string, v long")


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
@pytest.mark.parametrize("min_rows", [1, 10**9])
def test_salted_join(spark, rows, how, min_rows):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    want = sorted(map(tuple, rows.join(right, "k", how).select("id").collect()))
    got = sorted(map(tuple, scale.salted_join(rows, right, ["k"], how, ["id"], min_rows=min_rows).select("id").collect()))
    assert got == want and (how == "left_anti" or len(got) > 0)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ordered_within_key(rows, parts):
    df = rows.where("k is not null").repartition(parts)
    bucketed = scale.range_bucket(df, "id", scale.range_cuts(df, "id", 16))
    got = scale.ordered_within_key(bucketed, ["k"], ["id"], "_bucket", previous={"v": "pv"}, running={"v": "sv"})
    w = Window.partitionBy("k").orderBy("id")
    want = df.select(
        "id", F.row_number().over(w).alias("position"), F.lag("v").over(w).alias("pv"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sv"))
    assert sorted(map(tuple, got.select("id", "position", "pv", "sv").collect())) == sorted(map(tuple, want.collect()))


def test_cumulate(rows):
    got = scale.cumulate(rows.withColumn("n", F.lit(1)), "v", ["n"], descending=True).collect()
    ids = [r.v for r in rows.collect()]
    for r in got:
        assert r.cum_n == sum(x >= r.v for x in ids) and r.all_n == len(ids)


def test_small_or_none(spark):
    assert scale.small_or_none(spark.range(5), 4) is None
    assert scale.small_or_none(spark.range(4), 4) is not None


@pytest.mark.parametrize("broadcast_edges", [0, 1000])
def test_components_match_union_find(spark, broadcast_edges):
    random.seed(5)
    pairs = [(f"n{random.randint(0, 60):02d}", f"n{random.randint(0, 60):02d}") for _ in range(45)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = dict(map(tuple, corpus.connected_groups(spark.createDataFrame(pairs, "u string, v string"), broadcast_edges=broadcast_edges).collect()))
    assert got == {n: find(n) for n in parent}
