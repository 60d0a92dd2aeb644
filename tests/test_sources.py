"""Readers and writers round trip; materialised stages; streams against the batch result."""

import json

import pytest
from pyspark.sql import functions as F

from tactus.sources import labels as L
from tactus.sources.materialise import resolve, stage_key
from tactus.streaming import events as E


def test_label_files(spark, tmp_path):
    rows = [(0.0, 1.5, "verse one"), (1.5, 2.25, "chorus"), (2.25, 3.0, "")]
    df = spark.createDataFrame(rows, "start double, end double, label string")
    for i, sep in enumerate((" ", "\t")):
        L.write_labels(df, f"{tmp_path}/l{i}", sep)
        got = L.read_labels(spark, f"{tmp_path}/l{i}").orderBy("start").collect()
        assert [(r["start"], r["end"], r["label"]) for r in got] == rows
    L.write_times(df, f"{tmp_path}/t", "start")
    assert sorted(r["t"] for r in L.read_times(spark, f"{tmp_path}/t").collect()) == [0.0, 1.5, 2.25]
    (tmp_path / "bad.lab").write_text("0 1 a  b\n\nx y\n")
    lenient = L.read_labels(spark, f"{tmp_path}/bad.lab", strict=False).collect()
    assert [(r["start"], r["label"]) for r in lenient] == [(0.0, "a b"), (None, "")]
    with pytest.raises(Exception, match="no label line: x y"):
        L.read_labels(spark, f"{tmp_path}/bad.lab").collect()


def test_pipe_table_and_documents(spark, tmp_path):
    (tmp_path / "log.txt").write_text("name | url | note\n a | u1 | CC-BY-NC | more\nb|u2|free\n")
    got = L.read_pipe_table(spark, f"{tmp_path}/log.txt", ["name", "url", "note"])
    got = got.withColumn("nc", L.non_commercial(got["note"])).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", "u1", "CC-BY-NC | more", True), ("b", "u2", "free", False)]
    df = spark.createDataFrame([(1, 0.0, 1.0, "A"), (1, 1.0, 3.0, "B")], "song int, start double, end double, label string")
    doc = json.loads(L.jams(df, "song").first()["jams"])
    assert [(x["time"], x["duration"], x["value"]) for x in doc["annotations"][0]["data"]] == [(0.0, 1.0, "A"), (1.0, 2.0, "B")]
    L.write_results(df.selectExpr("song", "label"), df.selectExpr("song", "'broken' as error").limit(1), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").where("error is not null").count() == 1


def test_stages_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    key = stage_key("beats", {"hop": 512}, None)
    assert key != stage_key("beats", {"hop": 256}, None) and key != stage_key("beats", {"hop": 512}, key)
    for _ in range(2):
        assert resolve(spark, str(tmp_path), key, compute).count() == 5
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    out = E.run_once(E.block_activity(E.stream_events(spark, sf)), f"{tmp_path}/o", f"{tmp_path}/c")
    batch = E.block_activity(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    got, want = {tuple(r) for r in out.collect()}, {tuple(r) for r in batch.collect()}
    assert got and got <= want  # blocks that the watermark has closed
    sessions = E.run_once(E.event_sessions(E.stream_events(spark, sf)), f"{tmp_path}/so", f"{tmp_path}/sc")
    assert sessions.count() > 0
