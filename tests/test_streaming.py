from panelspark.operators.panels import event_trades, ohlcv
from panelspark.streaming.resample import streaming_bars


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    trades = event_trades(spark, "/root/testdata/sf0.001").select("timestamp", "symbol", "price", "volume")
    trades.orderBy("timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(trades.schema).parquet(f"{tmp_path}/in")
    q = streaming_bars(stream, 3600).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("bars").collect()}
    assert got == {tuple(r) for r in ohlcv(trades, 3600).collect()}
