import random

import pytest
from pyspark.sql import functions as F

from spanwright.llm.common import free_names, join_hot, named, ranked, shared_root


def test_hot_keys_are_dealt_out(spark):
    r = random.Random(1)
    rows = [(k, None if k % 50 == 0 else "hot" if k % 3 == 0 else f"k{r.randint(0, 900)}") for k in range(6000)]
    left = spark.createDataFrame(rows, "i int, key string").repartition(4)
    told = {f"k{n}": n for n in range(0, 900, 2)} | {"hot": -1, "unused": -2}
    table = spark.createDataFrame(list(told.items()), "key string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            got = join_hot(left, table, "key", how).withColumn("part", F.spark_partition_id()).collect()
            assert sorted((x.i, x.key, x.v) for x in got) == sorted((i, k, told.get(k)) for i, k in rows if how == "left" or k in told)
            assert set(got[0].asDict()) == {"i", "key", "v", "part"}
            assert len({x.part for x in got if x.key == "hot"}) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert join_hot(left.limit(0), table, "key").count() == 0


def test_ranks_and_sums_over_ranges(spark):
    r = random.Random(2)
    rows = [(k, r.randint(0, 30), r.randint(0, 9)) for k in range(500)]
    got = {x.k: x for x in ranked(spark.createDataFrame(rows, "k int, a int, n bigint").repartition(6), ["a", "k"], ("n",)).collect()}
    before = 0
    for nth, (k, _, n) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1):
        assert (got[k].nth, got[k].before_n) == (nth, before)
        before += n
    assert ranked(spark.createDataFrame([], "k int, n int"), ["k"], ("n",)).count() == 0


def test_names(spark):
    assert free_names(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, e int")
    assert df.select(F.struct(*named(df)).alias("r")).select("r.*").columns == df.columns


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, told = Context(), None

        class conf:
            get = staticmethod(lambda *_: Session.told)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session())
    Session.told = "hdfs://host/shared/"
    assert shared_root(Session()) == "hdfs://host/shared"
    Session.told, Context.master = None, "local[4]"
    assert shared_root(Session()).startswith("file:///")
