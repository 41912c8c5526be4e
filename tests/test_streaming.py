from datetime import datetime, timedelta

from lidarlake.streaming import sync

T0 = datetime(2024, 1, 1)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def test_package_in_stream_and_batch(spark, tmp_path):
    scans = spark.createDataFrame([(1, at(100 * k), k) for k in range(5)], "run int, ts timestamp, scan_id int")
    samples = spark.createDataFrame([(1 + (k % 7 == 0), at(10 * k), float(k)) for k in range(45)], "run int, ts timestamp, value double")
    for name, df in (("scans", scans), ("samples", samples)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = sync.package(read(scans, "scans"), read(samples, "samples")).writeStream.format("memory").queryName("packed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.scan_id, r.value) for r in df.collect())
    want = sorted((s, float(k)) for s in range(5) for k in range(45) if k % 7 and 100 * s - 100 < 10 * k <= 100 * s)
    assert key(spark.table("packed")) == want == key(sync.package(scans, samples))


def test_diagnostics_sink_and_evidence(spark, tmp_path):
    hits = spark.createDataFrame([(at(1000 * k), k % 2, 0, 0, k % 3 == 0) for k in range(10)], "ts timestamp, vx int, vy int, vz int, occupied boolean")
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sync.append_diagnostics(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    windows = sync.evidence(hits).where("vx = 0").collect()
    assert sum(r.occupied_hits + r.free_hits for r in windows) == 5 * 5  # each hit is in five windows
