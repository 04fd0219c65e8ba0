"""Streaming ingest end to end over files."""

import json

from skein.sources import collections as c
from skein.streaming import ingest


def test_ingest_is_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        rows = [{"id": f * 10 + i, "vector": [float(i), 1.0], "metadata": {"f": str(f)}, "ts": f"2024-01-0{f + 1}T00:00:00Z"} for i in range(5)]
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        ingest.sink(ingest.from_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_windows_stream_like_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = ingest.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="60 days")
    stream.writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = ingest.windowed(events)
    assert sorted(map(tuple, spark.table("metrics").select("window_start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("window_start", "event_type", "n").collect()))


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], {"a": "b"}), (2, [0.5, 0.0], None)], c.SCHEMA)
    c.export_json(df, str(tmp_path / "x"))
    assert sorted(map(str, c.import_json(spark, str(tmp_path / "x")).collect())) == sorted(map(str, df.collect()))
    assert [len(p) for p in c.pages(df, 1)] == [1, 1]
