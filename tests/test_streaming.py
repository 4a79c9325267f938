"""Roll-ups of a stream against the same roll-ups of the table."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewright.streaming import windows


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_stream_equals_table(spark, tmp_path, name):
    roll = {
        "tumbling": lambda e: windows.tumbling(e, "1 day", "event_type", "value"),
        "sliding": lambda e: windows.sliding(e, "2 days", "1 day", "event_type", "value"),
        "sessions": lambda e: windows.sessions(e, "6 hours", "user_id", "value"),
    }[name]
    table = spark.read.parquet(f"{SF}/events.parquet")
    # The last row, far ahead, moves the watermark past all windows.
    ahead = table.limit(1).withColumns({"ts": F.lit("2025-01-01").cast(table.schema["ts"].dataType), "event_type": F.lit("none"), "user_id": F.lit(-1).cast("long")})
    table.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    ahead.select(table.columns).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/a").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = roll(stream).writeStream.format("memory").queryName(f"got_{name}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    rows = lambda df: sorted((tuple(r)[:4] + (round(r.total, 4),) for r in df.collect()), key=str)
    got = rows(spark.table(f"got_{name}"))
    assert got and got == rows(roll(table))
