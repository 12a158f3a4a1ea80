"""Tables read from files count as large as their rows are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from depotflow import session
from depotflow.plans import sales
from depotflow.schemas import MODEL
from depotflow.session import setting
from depotflow.sources.star import StarWarehouse
from depotflow.stored import FACTOR, durable, row_width

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def told_bytes(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


@pytest.fixture(scope="module")
def challans(spark):
    """Challans whose files are some fifty times smaller than their rows."""
    given = {"dc_id": F.col("id") * 2, "so_id": F.col("id"), "created_by": F.lit(1).cast("bigint"), "status": F.lit("Pending")}
    return session.durable(spark.range(200_000).select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MODEL["delivery_challans"].schema]))


def test_a_stored_table_counts_as_large_as_its_rows(spark, challans):
    before = spark.conf.get(FACTOR)
    table = durable(challans)
    assert told_bytes(table) == pytest.approx(200_000 * row_width(challans), rel=0.01)
    assert told_bytes(session.durable(challans)) < told_bytes(table) / 20
    assert table.schema == challans.schema and table.exceptAll(challans).isEmpty() and table.count() == 200_000
    assert spark.conf.get(FACTOR) == before


def test_small_stored_tables_are_not_counted_and_still_broadcast(spark, challans):
    few = durable(spark.range(50))
    assert told_bytes(few) < 10_000
    assert "BroadcastHashJoin" in plan(durable(challans).join(few, F.col("id") == F.col("dc_id")))


def test_ids_of_a_large_table_are_not_gathered_by_the_driver(spark, challans):
    with setting(spark, THRESHOLD, "1m"):
        assert "BroadcastExchange" in plan(challans.join(challans.select("dc_id"), "dc_id", "left_semi"))
        table = durable(challans)
        assert "BroadcastExchange" not in plan(table.join(table.select("dc_id"), "dc_id", "left_semi"))
        tables = {"delivery_challans": table}
        result = sales.deliver_dc(tables, table.select(F.col("dc_id").alias("req_seq"), "dc_id"), "2026-02-01 00:00:00")
        assert "BroadcastExchange" not in plan(result.outcome) + plan(result.changed["delivery_challans"])
        assert result.outcome.groupBy("outcome", "not_dispatched").count().collect() == [("accepted", True, 200_000)]


def test_raw_tables_count_as_large_as_their_rows(spark, tmp_path):
    spark.range(300_000).select(
        F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("c").alias("p_type"),
        F.lit(1).alias("p_size"), F.lit(1.5).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    with setting(spark, THRESHOLD, "1m"):
        w = StarWarehouse(spark, str(tmp_path))
        items = w["items"].select("item_id")
        assert "BroadcastExchange" not in plan(spark.range(10).join(items, F.col("id") == F.col("item_id"), "left"))
        assert "BroadcastExchange" not in plan(w.raw("part").join(w.raw("part"), "p_partkey"))
        assert w.raw("part").count() == 300_000
