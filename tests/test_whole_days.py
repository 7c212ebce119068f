"""Overlap of all pairs of days, on a small table."""

import datetime

from flowspark.plans.tables import host_overlap_days


def test_overlap_of_all_days(spark, tmp_path):
    at = [("2024-01-12", 1, "a"), ("2024-02-12", 1, "b"), ("2024-02-25", 2, "1")]
    rows = [(k, u, e, datetime.datetime.fromisoformat(d), 1.0, "{}") for k, (d, u, e) in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.day, r.other, r.src_shared, r.dst_shared, r.any_shared) for r in host_overlap_days(spark, str(tmp_path)).collect())
    assert got == [("2024-01-12", "2024-02-12", 1, 0, 1), ("2024-01-12", "2024-02-25", 0, 0, 1), ("2024-02-12", "2024-02-25", 0, 0, 1)]
