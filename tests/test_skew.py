"""Distributed ranks against window ranks."""

import random

from pyspark.sql import functions as F

from lodestitch.operators.skew import ranked


def test_ranked_counts_what_comes_before(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", rnd.choice([None, 1.0, 2.0, 3.0, 4.5])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    got, _ = ranked(spark, df, "g", [F.col("v").desc_nulls_last()], ["v"])
    key = lambda v: -1e9 if v is None else v
    for r in got.collect():
        own = [key(v) for g, v in rows if g == r.g]
        assert r.before == sum(v > key(r.v) for v in own)
        assert r.n == own.count(key(r.v))
        assert r.total == len(own)


def test_ranked_of_an_empty_table(spark):
    got, _ = ranked(spark, spark.createDataFrame([], "g string, v double"), "g", [F.col("v")], ["v"])
    assert got.count() == 0


def test_ranks_of_rows_with_hot_ties(spark):
    import random

    from pyspark.sql import functions as F

    from lodestitch.operators.skew import with_ranks

    rnd = random.Random(3)
    # a hot group, a hot value in it, nulls, many small groups
    rows = [(k, "hot", None if rnd.random() < 0.5 else float(rnd.randrange(3))) for k in range(3000)] + [(k, f"g{k % 40}", rnd.choice([None, 1.0, 2.5])) for k in range(3000, 3400)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.id: (r.n, r.before, r.total) for r in with_ranks(spark, df, ["g"], ["v"], [F.col("v").desc_nulls_last()]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by: dict = {}
    for _, g, v in rows:
        by.setdefault(g, []).append(v)
    high = lambda v: float("-inf") if v is None else v
    assert got == {i: (sum(x == v for x in by[g]), sum(high(x) > high(v) for x in by[g]), len(by[g])) for i, g, v in rows}
    assert with_ranks(spark, df.limit(0), ["g"], ["v"], [F.col("v")]).count() == 0
