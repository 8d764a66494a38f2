from textquarry.streaming import signals


def test_windows_and_redaction(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01 00:00:01", "error from 10.0.0.1"), ("2024-01-01 00:01:00", "error"), ("2024-01-01 00:07:00", "all ok")], "ts string, line string").selectExpr("timestamp(ts) AS ts", "line")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("windows", signals.severity_windows(stream), "complete"), ("clean", signals.redacted_stream(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.severity, r.n) for r in spark.table("windows").collect()) == [("error", 2), ("info", 1)]
    assert "error from [REDACTED_IP]" in [r.line for r in spark.table("clean").collect()]


def test_sessions(spark):
    from textquarry.streaming import signals

    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:20:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-01 10:00:00")]
    lines = spark.createDataFrame(rows, "host string, ts string").selectExpr("host", "CAST(ts AS timestamp) AS ts")
    assert sorted((r.host, r.n) for r in signals.sessions(lines, "host").collect()) == [("a", 1), ("a", 2), ("b", 1)]
