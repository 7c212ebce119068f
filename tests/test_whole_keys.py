"""Whole tables against each other, with planted differences."""

from flowspark.plans.tables import category_set_diff_whole, left_complete_whole


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_no_key_is_left_out(spark, tmp_path):
    put(spark, tmp_path, "customer", [(7, 1), (1, 2), (2, 21)], "c_custkey long, c_nationkey int")
    put(spark, tmp_path, "supplier", [(1, 21), (2, 2), (3, 22)], "s_suppkey long, s_nationkey int")
    put(spark, tmp_path, "orders", [(1, 7), (2, 1), (3, 8)], "o_orderkey long, o_custkey long")
    assert sorted(tuple(r) for r in category_set_diff_whole(spark, str(tmp_path)).collect()) == [(1, "customers"), (22, "suppliers")]
    assert left_complete_whole(spark, str(tmp_path)).first() == (3, 1)
