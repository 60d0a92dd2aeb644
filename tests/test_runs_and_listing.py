"""Histories and registries of several shapes, and listings of folders."""

import json
import os

import pytest

from tactus.sources import listing as L
from tactus.sources import runs as H


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, content string")


def scores(drums, bass=None, **more):
    return {"si_sdr_improvement": {"drums": drums} | ({} if bass is None else {"bass": bass}), "mean_si_sdr_improvement": drums, **more}


def test_histories_nested_and_flat(spark):
    flat = {"finished": False, "history": [{"epoch": 1, "train_loss": 0.5, **scores(1.0, 2.0, examples={"drums": 0, "bass": 7})}, {"epoch": 2, "train_loss": "high", **scores(3.0)}]}
    nested = {"history": [{"epoch": k, "validation": {"a": scores(float(k), group={"si_sdr_improvement": 10.0 * k}), "b": scores(-1.0, **({} if k == 2 else {"group": {"si_sdr_improvement": 5}}))}} for k in range(1, 6)], "finished": True}
    bad = {"broken": '{"history": [', "none": '{"finished": true}', "list": "[1, 2]", "null": None, "number": '{"history": 3}', "empty": '{"history": []}', "odd": '{"history": [{"validation": 3, "epoch": "x"}, 5, null]}'}
    h = H.run_history(frame(spark, {"flat": json.dumps(flat), "nested": json.dumps(nested), **bad}))
    rows = h.collect()
    got = {(r["file"], r["place"], r["dataset"], r["source"]): (r["epoch"], r["loss"], r["improvement"], r["examples"], r["group"]) for r in rows if r["error"] is None}
    assert got[("flat", 0, "val", "drums")] == (1, 0.5, 1.0, 0.0, None) and got[("flat", 0, "val", "bass")][3] == 7.0
    assert got[("flat", 1, "val", "drums")] == (2, None, 3.0, 1.0, None)
    assert got[("nested", 3, "a", "drums")] == (4, None, 4.0, 1.0, 40.0) and got[("nested", 1, "b", "drums")][4] is None
    assert len(got) == 3 + 10
    assert {(r["file"], r["error"]) for r in rows if r["error"]} == {("broken", "not JSON"), ("null", "not JSON"), ("none", "no history"), ("list", "no history"), ("number", "no history")}
    last = {(r["file"], r["dataset"], r["source"]): (r["epochs"], r["improvement"], r["examples"], r["group"]) for r in H.last_epochs(h).collect()}
    assert last[("nested", "a", "drums")] == (5, 4.0, 1.0, 40.0) and last[("nested", "b", "drums")][3] == 5.0
    assert last[("flat", "val", "drums")] == (2, 2.0, 0.0, None)
    assert {(r["dataset"], r["group"]) for r in H.last_epochs(h, 4).where("file = 'nested'").collect()} == {("a", 35.0), ("b", None)}
    assert H.run_history(frame(spark, {}).limit(0)).count() == 0


def test_registries(spark, tmp_path):
    entry = {"name": "m", "version": "1", "url": "http://x/m", "sha256": "ab", "size_bytes": 5, "license_id": "MIT"}
    good = {"models": [entry, {**entry, "version": "2", "license_note": "so"}, {**entry, "name": "n", "size_bytes": "many"}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "registry.JSON").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.txt").write_text("not read")
    models = H.registry(H.json_files(spark, str(tmp_path)))
    rows = sorted((os.path.basename(r["file"]), r["place"] or 0, r["name"], r["version"], r["license_note"], r["error"]) for r in models.where("file not like '%JSON'").collect())
    assert rows == [("b.json", 0, None, None, None, "not JSON"), ("c.json", 0, None, None, None, "no models")]
    assert [(r["name"], r["version"], r["error"]) for r in models.where("file like '%JSON'").orderBy("place").collect()] == [("m", "1", None), ("m", "2", None), ("n", "1", "no size_bytes")]
    found = H.model_named(models, spark.createDataFrame([("m",), ("n",)], "name string")).collect()
    assert {r["name"]: r["model"]["version"] if r["model"] else None for r in found} == {"m": "1", "n": None}


def test_sound_files_of_folders_and_named_ones(spark, tmp_path):
    for name in ("a.WAV", "b.txt", "deep/er/c.Flac", "deep/.mp3", "deep/noext", "d.tar.ogg", "e.wave"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    base = str(tmp_path)
    names = lambda df: sorted(r["file"].split(base + "/")[1] for r in df.collect())
    df = L.sound_files(spark, [base])
    assert names(df) == ["a.WAV", "d.tar.ogg", "deep/er/c.Flac"] and {r["bytes"] for r in df.collect()} == {5, 9, 14}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    assert names(L.sound_files(spark, [base + "/b.txt", base + "/deep"])) == ["b.txt", "deep/er/c.Flac"]
    assert names(L.sound_files(spark, [base, base + "/a.WAV"])) == ["a.WAV", "d.tar.ogg", "deep/er/c.Flac"]
    assert L.sound_files(spark, []).count() == 0
    with pytest.raises(Exception):  # noqa: B017  a path that isn't there
        L.sound_files(spark, [base + "/none"]).count()


def test_song_stems_with_companions(spark, tmp_path):
    for name in ("T1/mix.flac", "T1/stems/S0.flac", "T1/stems/S1.flac", "T1/MIDI/S0.mid", "T2/stems/S0.flac", "T2/stems/S9.flac", "T2/MIDI/S1.mid", "T3/mix.flac", "T1/other/S2.flac", "stray.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    stems = spark.createDataFrame([("T1", "S0", True), ("T1", "S1", False), ("T1", "S2", True), ("T2", "S0", True), ("T2", "S9", True), ("T3", "S0", True), ("T4", "S0", True), ("T2", "S1", None)], "song string, stem string, rendered boolean")
    got = [(r["song"], r["stem"], r["score"], r["length_file"].split("/", 1)[1].split(str(tmp_path)[1:] + "/")[1]) for r in L.song_stems(L.list_files(spark, str(tmp_path)), stems, str(tmp_path)).orderBy("song", "stem").collect()]
    assert got == [("T1", "S0", True, "T1/mix.flac"), ("T2", "S0", False, "T2/stems/S0.flac"), ("T2", "S9", False, "T2/stems/S0.flac")]
