"""Alarms with state: a stream tells what a batch tells."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.streaming import alarms, windows

START = dt.datetime(2024, 1, 1)


def streamed(spark, path, schema, steps, make, name):
    """All rows that a stream tells, one trigger after another, a step's rows to each."""
    told = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / "in" / f"{k:03}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(path / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        told = spark.read.parquet(str(path / "out")).collect()
    return told


def test_m_of_n_on_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, START + dt.timedelta(minutes=5 * k), rng.choice([0, 0, 7, 9])) for s in "ab" for k in range(18)]
    schema = "source string, window_start timestamp, v int"
    steps = [[r for r in rows if a <= (r[1] - START).total_seconds() < b] for a, b in ((0, 1500), (1500, 1800), (1800, 6000))]
    told = streamed(spark, tmp_path, schema, steps, lambda s: alarms.sustained(s, F.col("v") > 5, 3, 4, "source"), "m")
    want = windows.sustained(spark.createDataFrame(rows, schema), F.col("v") > 5, 3, 4, by=["source"]).select("source", "window_start", "breaching", "alarm")
    assert sorted((r.key, r.window_start, r.breaching, r.alarm) for r in told) == sorted(map(tuple, want.collect()))
    assert {r.alarm for r in told} == {True, False}


def test_sources_never_seen_are_told_too(spark, tmp_path):
    at = lambda s, t: (s, START + dt.timedelta(seconds=t))
    known = spark.createDataFrame([("a",), ("b",), ("never",)], "source string")
    steps = [[at("a", 0), at("b", 0), at("a", 30)], [at("a", 3000)], [at("a", 3100), at("b", 3100)], [at("a", 9000)], [at("a", 9010)], [at("b", 20000)]]
    told = streamed(spark, tmp_path, "source string, ts timestamp", steps, lambda s: alarms.silences(s, 600, known, F.lit(START)), "s")
    got = sorted((r.key, (r.last_seen - START).total_seconds()) for r in told)
    # a's next events came with, or before, what moved the watermark past its silence; b and a fell silent before others' events
    assert got == [("a", 9010.0), ("b", 0.0), ("b", 3100.0), ("never", 0.0)]
    assert len(got) == len(set(got))
