"""Chunked windows give what plain windows give, for a hot key and NULL keys too."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probefleet.operators import chunks


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("a", 30), ("b", 1), (None, 20)):
        for at in rnd.sample(range(-2000, 5000), n):
            data.append((key, at, rnd.randint(-5, 9), rnd.choice([None, "x", "y", "z"])))
    return spark.createDataFrame(data, "k STRING, at BIGINT, v BIGINT, s STRING").cache()


def as_set(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("width", [1, 7, 100, 100000])
def test_running_sums(skewed, width):
    got = chunks.running_sums(skewed, ["k"], "at", {"run": "v"}, width, totals={"total": "v"}, firsts={"first": "at"})
    plain = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("k")
    want = skewed.select(
        "*", F.sum("v").over(plain).alias("run"), F.sum("v").over(whole).alias("total"), F.min("at").over(whole).alias("first")
    )
    columns = ("k", "at", "v", "s", "run", "total", "first")
    assert as_set(got, *columns) == as_set(want, *columns)


@pytest.mark.parametrize("width", [13, 1000])
def test_rank_within(skewed, width):
    got = chunks.rank_within(skewed, ["k"], "at", "n", width)
    want = skewed.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("at")))
    assert as_set(got, "k", "at", "n") == as_set(want, "k", "at", "n")


@pytest.mark.parametrize("width", [3, 50, 100000])
def test_last_before(skewed, width):
    got = chunks.last_before(skewed, ["k"], "at", {"before": "s"}, width)
    plain = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    want = skewed.withColumn("before", F.last("s", True).over(plain))
    assert as_set(got, "k", "at", "v", "before") == as_set(want, "k", "at", "v", "before")


def test_last_before_breaks_ties(rows):
    df = rows("k STRING, at BIGINT, id INT, s STRING", ("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, None), ("a", 9, 0, "z"))
    got = chunks.last_before(df, ["k"], "at", {"before": "s"}, 5, ties=["id"]).orderBy("at", "id").collect()
    assert [r.before for r in got] == [None, "x", "y", "y"]


@pytest.mark.parametrize("back, ahead, width", [(50, 0, 60), (0, 50, 64), (20, 30, 500)])
def test_border(skewed, back, ahead, width):
    frame = W.orderBy("at").rangeBetween(-back, ahead)
    got = (
        chunks.with_border(skewed, "at", width, back, ahead)
        .withColumn("n", F.sum("v").over(frame.partitionBy("k", chunks.CHUNK)))
        .where(chunks.HOME)
    )
    want = skewed.withColumn("n", F.sum("v").over(frame.partitionBy("k")))
    assert as_set(got, "k", "at", "n") == as_set(want, "k", "at", "n")


def test_border_needs_room(skewed):
    with pytest.raises(ValueError):
        chunks.with_border(skewed, "at", 10, back=10)


@pytest.mark.parametrize("width", [1, 90, 100000])
def test_following(skewed, width):
    got = chunks.running_sums(skewed, ["k"], "at", {"run": "v"}, width, following="next")
    want = skewed.withColumn("next", F.lead("at").over(W.partitionBy("k").orderBy("at")))
    assert as_set(got, "k", "at", "next") == as_set(want, "k", "at", "next")


@pytest.mark.parametrize("levels", [2, 3])
@pytest.mark.parametrize("width", [1, 7])
def test_blocks_of_chunks(skewed, monkeypatch, levels, width):
    monkeypatch.setattr(chunks, "BLOCK", 4)
    plain = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("k")
    got = chunks.running_sums(
        skewed, ["k"], "at", {"run": "v"}, width, totals={"total": "v"}, firsts={"first": "at"}, following="next", levels=levels
    )
    want = skewed.select(
        "*", F.sum("v").over(plain).alias("run"), F.sum("v").over(whole).alias("total"), F.min("at").over(whole).alias("first"),
        F.lead("at").over(whole.orderBy("at")).alias("next"),
    )
    columns = ("k", "at", "v", "s", "run", "total", "first", "next")
    assert as_set(got, *columns) == as_set(want, *columns)
    before = chunks.last_before(skewed, ["k"], "at", {"before": "s"}, width, levels=levels)
    earlier = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    wanted = skewed.withColumn("before", F.last("s", True).over(earlier))
    assert as_set(before, "k", "at", "v", "before") == as_set(wanted, "k", "at", "v", "before")
