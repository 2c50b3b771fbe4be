"""The session stream hands on every session, those that are open at the log's end and those of files out of order too."""

import datetime as dt

from meridian.plans import streams


def test_open_and_late_sessions_are_there(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    folder = tmp_path / "events.parquet"
    # Nine files, the newest first: with four files a trigger the older ones come late.
    for k in range(9):
        rows = [(10 * k + i, k, "view", at + dt.timedelta(hours=100 - 10 * k, minutes=i), '{"k": "1"}', 1.0) for i in range(3)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, props string, value double").coalesce(1).write.mode("append").parquet(str(folder))
    got = sorted((r.user_id, r.seconds, r.events) for r in streams.L6_stream_sessions(spark, str(tmp_path)).collect())
    assert got == [(k, 120, 3) for k in range(9)]
