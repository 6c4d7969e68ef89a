from tagloom.streaming.votes import windowed_votes


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id track", "event_type tag_name", "value tag_count")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_votes(stream, "7 days", "100 days").writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(120)
    rows = lambda df: sorted((r.start, r.tag_name, round(r.votes, 6), r.n) for r in df.collect())
    assert rows(spark.table("weekly")) == rows(windowed_votes(events, "7 days")) != []
