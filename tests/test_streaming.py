"""Column expressions also run on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import text as X
from keelson.operators.joins import route

from .conftest import SF


def test_routing_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    k = X.metadata_field(F.col("props"), "k").try_cast("int")
    name = route(F.when(k < 10, None).when(k < 30, "unknown").otherwise(F.col("event_type")), ["click", "view"])
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).select("event_id", name.alias("route"))
    run = stream.writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("routed")
    assert got.exceptAll(events.select("event_id", name.alias("route"))).isEmpty() and got.count() == events.count()
