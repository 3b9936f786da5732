"""Streams give what a batch gives."""

from pyspark.sql import functions as F

from pagefold.sources.writer import from_text
from pagefold.streaming.files import arriving, keep_newest, parsed_stream, sessions, windowed_decisions


def test_files_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.pdf").write_bytes(from_text(f"text {k}\nmore"))
    query = parsed_stream(arriving(spark, str(folder)), "spans").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrived").count() == 6


def test_newest_wins_over_batches(spark, tmp_path):
    source = tmp_path / "events"
    schema = "obj long, at long, v string"
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "x")], [(2, 0, "old"), (3, 1, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        keep_newest(stream, str(tmp_path / "target"), ["obj"], ["at"], str(tmp_path / "check")).awaitTermination()
        del k
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "target")).select("obj", "at", "v").collect()}
    assert found == {(1, 3, "c"), (2, 1, "b"), (3, 1, "d")}


def test_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", (F.length("event_type") % 3).alias("severity"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, make in (("windows", lambda s: windowed_decisions(s, "ts")), ("sessions", lambda s: sessions(s, "user_id", "ts"))):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    want = events.groupBy(F.window("ts", "1 hour"), "severity").count().count()
    assert spark.table("windows").count() == want and spark.table("sessions").count() > 0
