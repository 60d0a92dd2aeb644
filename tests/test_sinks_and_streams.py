"""Beat files in every format, a sink that leaves nothing of a failed run, and walks on streams that equal the batch results after a restart."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tactus.operators import scans
from tactus.sources import beat_files as B
from tactus.sources import midi as M
from tactus.streaming import walks as W


def songs(spark):
    schema = "name string, duration double, median_bpm double, stability string, beats_per_bar int, meter_confidence double, beats array<double>, confidence array<double>, downbeats array<int>, candidates array<struct<bpm:double,confidence:double>>"
    rows = [("one", 3.5, 120.0, "Human", 4, 0.75, [0.5, 1.0, 1.5000004], [0.9, 0.8, 0.7], [0], [(120.0, 0.8), (60.0, 0.2)]), ("none", 0.0, 90.0, "Variable", 3, 0.0, None, None, None, None), ("single", 1.0, 1e-3, "Human", 4, 1.0, [0.25], [1.0], [0], [])]
    return spark.createDataFrame(rows, schema)


def contents(df):
    return {r["name"]: bytes(r["content"]) for r in df.collect()}


def test_every_format(spark):
    of = {f: contents(B.render_beats(songs(spark), f)) for f in B.EXTENSIONS}
    assert of["lab"]["one.lab"] == b"0.500000 1.000000 beat\n1.000000 1.500000 beat\n" and of["lab"]["none.lab"] == of["lab"]["single.lab"] == b""
    assert of["audacity"]["one.txt"] == b"0.500000\t1.000000\tbeat\n1.000000\t1.500000\tbeat\n"
    assert of["csv"]["one.csv"] == b"beat_seconds\n0.500000\n1.000000\n1.500000\n" and of["csv"]["none.csv"] == b"beat_seconds\n"
    assert of["table"]["one.txt"].decode() == "duration:   3.500s\ntempo:      120.00 bpm (Human)\nmeter:      4/4 (confidence 0.75)\nbeats:      3\ndownbeats:  1\ncandidates:\n  120.00 bpm  conf=0.800\n  60.00 bpm  conf=0.200\n"
    doc = json.loads(of["jams"]["one.jams"])
    assert doc["file_metadata"] == {"duration": 3.5, "jams_version": "0.3.0"} and doc["annotations"][0]["namespace"] == "beat"
    assert doc["annotations"][0]["data"][1] == {"time": 1.0, "duration": 0.0, "value": 1, "confidence": 0.8}
    assert json.loads(of["json"]["none.json"])["beats"] is None and json.loads(of["json"]["one.json"])["downbeats"] == [0]
    back = M.midi_events(spark.createDataFrame([(k, v) for k, v in of["midi"].items()], "file string, content binary")).where("kind = 'tempo'")
    assert {r["file"]: r["values"][0] for r in back.collect()} == {"one.mid": 500_000, "none.mid": 666_667, "single.mid": (1 << 24) - 1}
    with pytest.raises(ValueError):
        B.render_beats(songs(spark), "wav")
    with pytest.raises(Exception, match="no tempo"):
        B.render_beats(songs(spark).withColumn("median_bpm", F.lit(0.0)), "midi").collect()


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    B.write_beats(songs(spark).repartition(3), path, "csv")
    assert sorted(os.listdir(path)) == ["none.csv", "one.csv", "single.csv"] and (tmp_path / "out" / "one.csv").read_text().startswith("beat_seconds\n0.5")
    for broken in (songs(spark).withColumn("median_bpm", F.when(F.col("name") == "single", -1.0).otherwise(100.0)), songs(spark).unionAll(songs(spark)), songs(spark).withColumn("name", F.when(F.col("name") == "one", "../up").otherwise(F.col("name")))):
        with pytest.raises(Exception):  # noqa: B017  a task, or the driver, ends with an error
            B.write_beats(broken.repartition(4), path, "midi")
        assert sorted(os.listdir(path)) == ["none.csv", "one.csv", "single.csv"] and os.listdir(tmp_path) == ["out"]


def run(df, path, checkpoint):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_walks_on_a_stream_equal_the_batch(spark, tmp_path):
    for k, v in W.STATE_STORE.items():
        spark.conf.set(k, v)
    r = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(k, round(r.uniform(0, 3000), 3), round(r.random(), 2), 7.0 if k else 11.0) for k in (0, 1) for _ in range(150)]
    rows = sorted({(k, t): (k, t, v, p) for k, t, v, p in rows}.values(), key=lambda x: x[1])
    schema = "k int, ts timestamp, v double, p double"
    stamp = lambda x: (x[0], start + dt.timedelta(seconds=x[1]), x[2], x[3])
    batch = spark.createDataFrame([stamp(x) for x in rows], schema).withColumn("t", F.unix_micros("ts") / 1e6)
    source = str(tmp_path / "in")

    def put(part):  # a file of shuffled rows; the watermark is half a minute behind
        part = list(part)
        r.shuffle(part)
        spark.createDataFrame([stamp(x) for x in part], schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    makes = {"c": lambda: W.collapse_gaps_stream(stream(), ["k"], "ts", "v", 12.0, "30 seconds"), "f": lambda: W.follow_tempo_stream(stream(), ["k"], "ts", "v", "p", "30 seconds")}
    cuts = [0, 80, 160, 230, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        put(rows[a:b])
        for name, make in makes.items():  # each time a new query from the checkpoint
            run(make(), str(tmp_path / name), str(tmp_path / f"check-{name}"))
    put([(9, 50_000.0, 0.5, 1.0)])  # far ahead: everything before is settled
    for name, make in makes.items():
        run(make(), str(tmp_path / name), str(tmp_path / f"check-{name}"))
    bucket = F.floor(F.col("_t") / 100)
    want = {"c": scans.collapse_gaps(batch, ["k"], "t", "v", 12.0, bucket), "f": scans.follow_tempo(batch, ["k"], "t", "v", "p")}
    for name, df in want.items():
        got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / name)).where("k < 9").collect())
        assert got == sorted(tuple(x) for x in df.collect()) and len(got) > 100, name
