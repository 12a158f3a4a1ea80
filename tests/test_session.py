"""What a written table leaves behind."""

import time

import pytest

from depotflow.session import CLEANUP, durable


def shuffled(spark):
    """Names of the shuffle files that there are."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (blocks.apply(i).getName() for i in range(blocks.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_written_tables_leave_no_shuffles(spark):
    before = shuffled(spark)
    table = durable(spark.range(2000).selectExpr("id % 7 AS k", "id").groupBy("k").count())
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert sorted(map(tuple, table.collect())) == [(k, 286 if k < 5 else 285) for k in range(7)]


def test_shuffles_of_other_queries_stay(spark):
    """A table that is asked for twice is shuffled once; writing another one in between does not change that."""
    before = shuffled(spark)
    rdd = spark.range(2000).selectExpr("id % 7 AS k").groupBy("k").count().rdd
    assert rdd.count() == 7
    own = shuffled(spark) - before
    assert own
    durable(spark.range(100).repartition(3))
    assert own <= shuffled(spark)


@pytest.mark.parametrize("old", [None, "false", "true"])
def test_the_setting_is_as_before(spark, old):
    if old:
        spark.conf.set(CLEANUP, old)
    try:
        was = spark.conf.get(CLEANUP)
        durable(spark.range(3))
        assert spark.conf.get(CLEANUP) == was
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            durable(spark.range(3).selectExpr("raise_error('DIVIDE_BY_ZERO') AS x"))
        assert spark.conf.get(CLEANUP) == was
    finally:
        spark.conf.unset(CLEANUP)
