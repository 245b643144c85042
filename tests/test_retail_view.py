"""Joins of the invoice view."""
from __future__ import annotations

from datetime import date

from patronage.sources.retail_view import raw_lines


def _tables(spark, folder):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("lineitem", [(1, 7, 1, 5.0, 50.0, "N", "O"), (2, 8, 1, 2.0, 30.0, "R", "F"), (3, 9, 1, 1.0, 9.0, "N", "O")],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    spark.createDataFrame([(1, 4, date(1997, 1, 2)), (2, 4, date(1997, 2, 3)), (3, 99, date(1997, 2, 3))], "o_orderkey long, o_custkey long, o_orderdate date") \
        .selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate AS timestamp_ntz) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    put("part", [(7, "red bolt"), (8, "blue gear"), (9, "rod")], "p_partkey long, p_name string")
    put("customer", [(4, 1), (5, None)], "c_custkey long, c_nationkey int")
    put("nation", [(1, "KENYA")], "n_nationkey int, n_name string")


def test_lines_take_part_in_two_joins(spark, tmp_path):
    """Each further join of the lines is a further shuffle of the largest table, where no side is small enough to be sent."""
    _tables(spark, str(tmp_path))
    found = raw_lines(spark, str(tmp_path))
    assert sorted((r["invoice"], r["stock_code"], r["country"]) for r in found.collect()) == [("1", "P000007", "KENYA"), ("C2", "P000008", "KENYA")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "l_orderkey" in line and "Relation" in line)
    above, low = [], depth(plan[at])
    for line in plan[at::-1]:
        if depth(line) < low:
            low, above = depth(line), [*above, line]
    assert sum(line.lstrip(" :+-").startswith("Join") for line in above) == 2
