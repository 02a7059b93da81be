"""Logs on the driver, times, and live counters."""

from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.sinks.log import BatchLog
from folioflow.streaming import usage


def test_a_log_never_stops_a_run(tmp_path):
    log = BatchLog(str(tmp_path / "deep" / "run.log"), every=2)
    for i in range(5):
        log.write(f"line {i}\n")
    log.close()
    log.write("after the end")
    assert [x.split(" ", 1)[1] for x in (tmp_path / "deep" / "run.log").read_text().splitlines()] == [f"line {i}" for i in range(5)] and log.error is None
    (tmp_path / "file").write_text("")
    broken = BatchLog(str(tmp_path / "file" / "run.log"))
    broken.write("x")
    broken.close()
    assert broken.error and broken.lines == 0


def test_times(spark):
    row = spark.sql("select timestamp'2024-05-01 10:00:00.25+02:00' as a, timestamp'2024-05-01 08:00:02.7504+00:00' as b").select(text.utc_text(F.col("a")), text.elapsed_seconds(F.col("a"), F.col("b")), text.elapsed_seconds(F.col("b"), F.col("a"))).first()
    assert tuple(row) == ("2024-05-01T08:00:00.250000+00:00", 2.5, 0.0)


def test_live_counters_never_fall(spark, tmp_path):
    for rows in ([(1, 3, 30), (2, 1, 5)], [(1, 2, 40)]):
        spark.createDataFrame(rows, "doc int, done int, tokens long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc int, done int, tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    usage.drain(usage.live_status(stream), "status")
    assert sorted(map(tuple, spark.table("status").collect())) == [(1, 3, 40), (2, 1, 5)]
