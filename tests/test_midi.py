"""MIDI files by hand, their times and bars, and rules on names."""

import pytest
from pyspark.sql import functions as F

from tactus.functions import rules
from tactus.sources import midi


def chunk(kind, body):
    return kind + len(body).to_bytes(4, "big") + body


def song(*tracks, division=96, header=b""):
    head = b"\0\1" + len(tracks).to_bytes(2, "big") + division.to_bytes(2, "big") + header
    return chunk(b"MThd", head) + b"".join(chunk(b"MTrk", bytes(t)) for t in tracks)


NOTES = [0, 0x90, 60, 64, 96, 62, 64, 0x81, 0x40, 62, 0, 0, 0xB1, 0x7B, 0, 0, 0xC0, 5, 0, 0xFF, 0x2F, 0]


def test_events():
    layout, division, (track,) = midi.parse(song(NOTES, header=b"more"))
    assert (layout, division) == (1, 96)
    assert [e[:4] for e in track] == [
        (0, "note_on", 0, [60, 64]),
        (96, "note_on", 0, [62, 64]),
        (288, "note_on", 0, [62, 0]),
        (288, "all_notes_off", 1, [0x7B, 0]),
        (288, "program", 0, [5]),
        (288, "end_of_track", None, []),
    ]
    meta = [0, 0xFF, 3, 2, 0x41, 0xFF, 0, 0xFF, 0x59, 2, 0xFD, 1, 0, 0xFF, 0x51, 3, 7, 0xA1, 0x20, 0, 0xFF, 0x7F, 4, 0, 1, 2, 9, 0, 0xFF, 0x60, 1, 8, 0, 0xF0, 2, 1, 0xF7]
    (track,) = midi.parse(song(meta))[2]
    assert [e[1:] for e in track] == [
        ("track_name", None, [], "A�", None),
        ("key_signature", None, [-3, 1], None, None),
        ("tempo", None, [500000], None, None),
        ("sequencer", None, [258], None, b"\t"),
        ("unknown_meta", None, [0x60], None, b"\x08"),
        ("sysex", None, [], None, b"\x01\xf7"),
    ]
    head = chunk(b"MThd", b"\0\0\0\1\0\x60")
    assert len(midi.parse(head + chunk(b"Junk", b"xyz") + chunk(b"MTrk", bytes(NOTES)))[2][0]) == 6


@pytest.mark.parametrize(
    "raw",
    [
        b"",
        b"MThd",
        b"RIFF" + song(NOTES)[4:],
        chunk(b"MThd", b"\0\0\0\1"),
        song(NOTES, division=0),
        song(NOTES, division=0xE900),
        song(NOTES)[:-1],
        song([0, 60, 64]),
        song([0, 0x90, 60, 64, 0, 0xFF, 1, 0, 0, 60, 64]),
        song([0, 0xF1]),
        song([0, 0xFF, 0x51, 2, 1, 1]),
        song([0]),
    ],
)
def test_broken_files(raw):
    with pytest.raises(midi.MidiError):
        midi.parse(raw)


def test_times_and_bars(spark, tmp_path):
    meta = [0, 0xFF, 0x51, 3, 7, 0xA1, 0x20, 96, 0xFF, 0x51, 3, 3, 0xD0, 0x90, 0, 0xFF, 0x58, 4, 3, 2, 24, 8]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MID").write_bytes(song(meta, NOTES))
    (tmp_path / "a" / "y.txt").write_bytes(b"no")
    events = midi.read_midi(spark, str(tmp_path))
    on = midi.with_bars(midi.with_times(events)).where("kind = 'note_on'").orderBy("tick")
    assert [(r["tick"], r["micros"], r["bar"]) for r in on.collect()] == [(0, 0, "1:1:00"), (96, 500_000, "2:1:00"), (288, 1_000_000, "2:3:00")]
    assert sorted(r["micros"] for r in midi.onsets(events).collect()) == [0, 500_000]
    frames = spark.createDataFrame([("f", song(NOTES, division=0xE328)), ("bad", b"x"), ("none", None)], "file string, content binary")
    got = midi.midi_events(frames, strict=False)
    assert {r["file"]: r["error"] for r in got.where("error is not null").collect()} == {"bad": "no MIDI file", "none": "no MIDI file"}
    f = midi.with_bars(midi.with_times(got.where("error is null"))).where("tick = 96").first()
    assert (f["micros"], f["bar"]) == (96 * 1_001_000_000 // (30_000 * 40), None)
    with pytest.raises(Exception, match="bad: no MIDI file"):
        midi.midi_events(frames.where("file = 'bad'")).collect()
    assert midi.onsets(midi.midi_events(frames.limit(0))).count() == 0


def test_name_rules(spark):
    names = ["Bass2.wav", "BigDrum", "eguit1", "piano_l", "organ", "voc2", "keys", "contrabass", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(rules.class_by_name(F.col("n"))).collect()] == ["Bass", "Drums", "Guitar", "Piano", "Organ", "Vocals", None, None, None]
    mixes = spark.createDataFrame([("Mixdown_No_Keyboard",), ("mix no drums",), ("nokeys",), ("mix no x",)], "n string")
    parts = F.array(F.lit("Keyb 1"), F.lit("drums"))
    assert [r[0] for r in mixes.select(rules.missing_by_name(F.col("n"), parts)).collect()] == [["Keyb 1"], ["drums"], None, None]
    bad = spark.createDataFrame([("bass",)], "n string")
    with pytest.raises(Exception, match="unknown label bass"):
        bad.select(rules.checked_label(F.col("n"), ["Bass"])).collect()
    tempos = spark.createDataFrame([(v,) for v in (120.0, 0.0, float("nan"), float("inf"), None, 200.0, 201.0)], "v double")
    assert [r[0] for r in tempos.select(rules.usable_tempo(F.col("v"), 55, 200)).collect()] == [True, False, False, False, False, True, False]


def test_descriptions_and_dumps(spark):
    rows = [("time_signature", None, [6, 3, 24, 8]), ("time_signature", None, [4, 40, 24, 8]), ("key_signature", None, [-2, 0]), ("key_signature", None, [3, 1]), ("key_signature", None, [9, 0]), ("tempo", None, [500_000]), ("tempo", None, [497_925]), ("tempo", None, [0]), ("note_on", 3, [60, 1])]
    df = spark.createDataFrame([("f", 1, 24, 0, i, 24 * i, k, c, v, None, None, None) for i, (k, c, v) in enumerate(rows)], midi.EVENTS)
    said = [r["d"] for r in df.orderBy("place").select(midi.describe().alias("d")).collect()]
    assert said == ["TimeSignature(6/8)", "time_signature(4, 40, 24, 8)", "KeySignature(Bb major)", "KeySignature(F# minor)", "key_signature(9, 0)", "SetTempo(b=120)", "SetTempo(b=120.5)", "tempo(0)", "note_on(3, 60, 1)"]
    assert [r["d"] for r in df.where("kind = 'key_signature'").orderBy("place").select(midi.describe(True).alias("d")).collect()] == ["KeySignature(6B)", "KeySignature(11A)", "key_signature(9, 0)"]
    lines = lambda when: [r["line"].split(" - ")[0] for r in midi.dump_lines(df, when).orderBy("place").collect()]
    assert lines("delta") == ["0"] + ["24"] * 8 and lines("clock")[5] == "0:02:50" and lines("bars")[0] == "1:1:00"
    with pytest.raises(ValueError):
        midi.dump_lines(df, "hours")


def test_subsets_are_nested(spark):
    from pyspark.sql import functions as F

    from tactus.operators.mixing import nested_subsets

    songs = spark.createDataFrame([(f"s{i}",) for i in range(40)] + [("s1",), (None,)], "song string")
    sets = {}
    for r in nested_subsets(songs, "song", [3, 10, 40], F.floor(F.col("_draw") * 8), ["s7", "s3"], 1).collect():
        sets.setdefault(r["size"], set()).add(r["song"])
    assert {k: len(v) for k, v in sets.items()} == {3: 3, 10: 10, 40: 40} and {"s7", "s3"} < sets[3] < sets[10]
    for bad in (dict(sizes=[41]), dict(sizes=[1], first=["none"])):
        with pytest.raises(ValueError):
            nested_subsets(songs, "song", bucket=F.lit(0), **bad)
