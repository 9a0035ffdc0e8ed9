"""Interval operators against plain scans."""

from isoweave.operators import intervals

SCHEMA = "k int, a int, b int"
ROWS = [(k % 7, k * k % 40, k * k % 40) for k in range(400)] + [(None, 3, 3)] * 2 + [(1, None, None)] * 3


def test_distinct_rows_take_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 10)
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = intervals.distinct_rows(df, ["k"], ["a", "b"])
    assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert got.rdd.getNumPartitions() == -(-len(ROWS) // 10)
    assert intervals.distinct_rows(df.limit(0), ["k"], ["a", "b"]).count() == 0


def test_reading_frame_ranges_take_more_tasks_for_more_rows(spark, monkeypatch):
    from isoweave.plans import queries

    monkeypatch.setattr(intervals, "ROWS_A_TASK", 300)
    got = queries.QUERIES["reading_frame_ranges"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() > 4
