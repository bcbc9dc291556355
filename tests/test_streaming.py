import datetime

from pyspark.sql import functions as F

from docloom.streaming import ingest


def test_known_content_is_dropped_and_chunks_are_kept(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(1, "a", "one two\nthree", at), (2, "a", "one two\nthree", at), (3, "b", "one two\nthree", at), (4, "a", "four", at)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, at timestamp")
    for i in range(2):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.keyed(ingest.stream_rows(spark, str(tmp_path / "in"), frame.schema, 1), "source")
    chunks = ingest.chunk_stream(ingest.new_only(stream, "at"), size=2, overlap=0)
    for _ in range(2):  # the second run finds nothing new
        ingest.run_once(chunks, str(tmp_path / "state"), lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["chunk"] for r in found.collect()) == ["four", "one two", "one two", "three", "three"]
    assert found.select("id").distinct().count() == 5


def test_windows_count_events(spark, tmp_path):
    events = spark.range(120).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("e").alias("event_type"), F.lit(1.0).alias("value"))
    assert [(r["n"], r["total"]) for r in ingest.windowed_counts(events).collect()] == [(60, 60.0), (60, 60.0)]
