import datetime as dt

from quaver.streaming import sessions


def test_sessions_and_hops_of_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("H1", at(0), 1.0), ("H1", at(4), 5.0), ("L1", at(5), 9.0), ("H1", at(30), 2.0), ("H1", at(33), 2.5), ("H1", at(600), 0.0)]
    spark.createDataFrame(rows, "det string, ts timestamp, stat double").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("det string, ts timestamp, stat double").parquet(f"file://{tmp_path}/in")
    found = {}
    for name, out in (("peaks", sessions.session_peaks(stream, ["det"], "10 seconds", "1 minute")), ("hops", sessions.hopping_counts(stream, ["det"], "10 seconds", "5 seconds", "1 minute"))):
        query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c{name}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        found[name] = sorted((r["det"], (r["start"] - at(0)).total_seconds(), r["n"], r["stat"]) for r in spark.table(name).collect())
    # The last session is still open: the watermark has not passed its end.
    assert found["peaks"] == [("H1", 0, 2, 5.0), ("H1", 30, 2, 2.5), ("L1", 5, 1, 9.0)]
    assert found["hops"] == [("H1", -5, 2, 5.0), ("H1", 0, 2, 5.0), ("H1", 25, 2, 2.5), ("H1", 30, 2, 2.5), ("L1", 0, 1, 9.0), ("L1", 5, 1, 9.0)]
