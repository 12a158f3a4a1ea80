"""Running totals of keys with few rows take one window."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from depotflow.operators import allocate as allocation
from depotflow.operators.running import running_totals


def plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet, so told once


def test_keys_with_few_rows_are_not_cut(spark):
    rows = spark.range(300).selectExpr("id % 7 AS k", "id * 1000000000000 AS at", "IF(id % 5 = 0, NULL, id) AS v")
    rows = rows.unionByName(spark.createDataFrame([(None, 1, 2), (3, None, 4)], "k long, at long, v long"))
    cut = running_totals(rows, ["k"], "at", {"t": F.col("v")})
    whole = running_totals(rows, ["k"], "at", {"t": F.col("v")}, busiest=44)
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() == 300
    assert plan(whole).count("Exchange ") == 1 < plan(cut).count("Exchange ")
    busy = running_totals(rows, ["k"], "at", {"t": F.col("v")}, span=40, busiest=44)
    assert plan(busy).count("Exchange ") > 1 and sorted(busy.collect()) == sorted(cut.collect())


def test_documents_of_resources_with_few_lines_are_settled_by_one_window(spark, monkeypatch):
    told = []
    monkeypatch.setattr(allocation, "running_totals", lambda *args: told.append(args[5]) or running_totals(*args))
    lines = spark.createDataFrame(
        [(d * 10**12, r, D(2), r, D(5)) for d in range(4) for r in (1, 2)],
        "doc long, resource long, need decimal(12,2), line_no long, free decimal(12,2)")
    got = allocation.allocate(lines.select("doc").distinct(), lines, ["resource"])
    assert {r.doc: r.accepted for r in got.verdicts.collect()} == {0: True, 10**12: True, 2 * 10**12: False, 3 * 10**12: False}
    turns = spark.createDataFrame([(d * 10**12, d * 10**12 + n) for d in range(4) for n in (0, 1)], "doc long, turn long")
    assert sorted(got.failed(turns).collect()) == [(d * 10**12, d * 10**12 + n, 1) for d in (2, 3) for n in (0, 1)]
    # four lines of a resource; then two that were accepted, and two that ask twice
    assert told[0] == 4 and told[-1] == 6
