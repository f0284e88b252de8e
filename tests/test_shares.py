"""Bursts of one root, dealt over tasks by path."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from tessella.sources.files import read_changes
from tessella.streaming import changes as st


def test_paths_of_a_root_are_shared(spark, tmp_path):
    """One root is no longer one task's: its paths are dealt, each share sees all times; runs and counts are those of the batch operator, in however many batches the events come."""
    df = pd.DataFrame({"root": "/w", "path": [f"/w/p{i % 100}" for i in range(1000)], "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([i * 37 % 1000 for i in range(1000)], unit="s")})
    dealt = next(st._to_shares(iter([df])))
    assert len(dealt) == st.SHARES and dealt["times"].nunique() == 1 and dealt["paths"].map(len).max() < 250 and dealt["paths"].map(len).sum() == 1000
    assert st._untimes(dealt["times"][0]).tolist() == sorted(df["ts"].astype("datetime64[us]").astype("int64"))
    r, feed, out = random.Random(5), str(tmp_path / "feed"), str(tmp_path / "out")
    rows = [(i, f"/{r.choice('abc')}/p{r.randint(0, 30)}", "change", i * 7 + r.randint(0, 60), 1, 1) for i in range(900)] + [(9999, "/a/last", "change", 9000, 1, 1)]
    events = spark.createDataFrame(rows, "event_id long, path string, kind string, ts long, mtime long, size long").withColumn("ts", F.timestamp_seconds("ts"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
            events.filter(part).filter("event_id < 9999").coalesce(1).write.mode("append").parquet(feed)
        write = lambda x, n: x.write.mode("overwrite").parquet(f"{out}/n={n}")
        for last in (False, True):
            if last:
                events.filter("event_id = 9999").coalesce(1).write.mode("append").parquet(feed)
            st.follow(st.stream_bursts(read_changes(spark, feed), 25, "2 hours"), write, str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.unset(key)
    whole = lambda d: sorted(map(tuple, d.select("root", "began", "ended", "n_events", "n_paths").collect()))
    want = [x for x in whole(st.coalesce_bursts(events, 25)) if x[2].timestamp() < 9000 - 7200]
    assert len(want) > 20 and whole(spark.read.parquet(out)) == want
