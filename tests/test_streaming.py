import time
from datetime import datetime

from quillveil.streaming.liveness import redact_stream, watch


def test_redact_stream(spark, tmp_path):
    spark.createDataFrame([(1, "write a@b.org"), (2, "none"), (3, None)], "id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, text string").parquet(f"{tmp_path}/in")
    q = redact_stream(stream, ["email"]).writeStream.format("memory").queryName("redacted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.text, r.status) for r in spark.table("redacted").collect()) == [(1, "write ", "pass"), (2, "none", "pass"), (3, None, "pass")]


def test_watchdog(spark, tmp_path):
    ts = datetime(2024, 1, 1)
    rows = [(1, "open", ts), (1, "beat", ts), (2, "open", ts), (3, "beat", ts), (3, "close", ts)]
    spark.createDataFrame(rows, "key bigint, kind string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key bigint, kind string, ts timestamp").parquet(f"{tmp_path}/in")
    q = watch(stream, silence=2, first_beat=3).writeStream.format("memory").queryName("fired").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", f"{tmp_path}/cp").start()
    until = time.time() + 60
    while time.time() < until and spark.table("fired").count() < 3:
        time.sleep(1)
        assert q.exception() is None
    q.stop()
    assert sorted((r.key, r.reason) for r in spark.table("fired").collect()) == [(1, "silence"), (2, "no_beat"), (3, "close")]
