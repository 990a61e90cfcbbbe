import datetime as dt

from pyspark.sql import functions as F

from gridrisk.operators.daily import daily_aggregates, with_weather
from gridrisk.streaming.daily import daily_stream


def test_closed_days_equal_the_batch(spark, tmp_path):
    start = dt.datetime(2003, 1, 1, 23)
    rows = [
        (c, start + dt.timedelta(hours=h), float(h % 24 + c), 1.0, 900.0, 1.0, 0.0, float(h % 3))
        for c in (0, 1)
        for h in range(24 * 3)
    ]
    schema = "cell_id int, ts timestamp_ntz, temp_c double, dewpoint_c double, pres_hpa double, u10 double, v10 double, precip_mm double"
    hourly = spark.createDataFrame(rows, schema)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hourly.write.parquet(source)
    stream = daily_stream(spark.readStream.schema(schema).parquet(source))
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    closed = {(r.cell_id, r.date): r for r in spark.read.parquet(out).collect()}
    # the last day is still open: the watermark has not passed its end
    assert {d for _, d in closed} == {dt.date(2003, 1, 2), dt.date(2003, 1, 3)}
    batch = daily_aggregates(with_weather(hourly))
    for r in batch.where(F.col("date") < "2003-01-04").collect():
        got = closed[(r.cell_id, r.date)]
        assert (got.n_hours, got.temp_mean, got.temp_max, got.precip_sum) == (24, r.temp_mean, r.temp_max, r.precip_sum)
