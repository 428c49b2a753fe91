from rolecast.streaming.snapshots import board_state_machine

OUT = "key string, status string, failures int, synced_at string, next_sync_at string"


def test_failures_are_counted_across_batches(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("b", "error", "2026-07-21T00:00:00.000Z"), ("b", "error", "2026-07-21T01:00:00.000Z"), ("c", "active", "2026-07-21T00:00:00.000Z"), ("b", "empty", "2026-07-21T02:00:00.000Z")]
        for i, part in enumerate((rows[:1], rows[1:3], rows[3:])):
            spark.createDataFrame(part, "key string, status string, synced_at string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema("key string, status string, synced_at string").parquet(str(tmp_path / "in"))
            states = source.groupBy("key").transformWithStateInPandas(board_state_machine(), OUT, "append", "none")
            states.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        found = sorted((r.key, r.synced_at[11:13], r.status, r.failures, r.next_sync_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert found == [
        ("b", "00", "error", 1, "2026-07-21T00:30:00.000Z"),
        ("b", "01", "error", 2, "2026-07-21T02:00:00.000Z"),
        ("b", "02", "empty", 0, "2026-07-25T02:00:00.000Z"),
        ("c", "00", "active", 0, "2026-07-21T12:00:00.000Z"),
    ]
