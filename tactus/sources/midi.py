"""Standard MIDI files as rows of events, and the times and bars of these.

Python only takes the bytes of a file apart; seconds, bars and onsets are columns. A file is read whole by one task (binaryFile), so
windows over the events of a file hold no more than that task did.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "file string, format int, division int, track int, place int, tick long, kind string, channel int, values array<int>, text string, data binary, error string"
DEFAULT_TEMPO = 500_000
#: Rows of one Arrow batch.
BATCH_ROWS = 65_536

# Fixed values of the format: kinds of events, with the number or layout of their data bytes.
_CHANNEL = {0x8: ("note_off", 2), 0x9: ("note_on", 2), 0xA: ("aftertouch", 2), 0xB: ("controller", 2), 0xC: ("program", 1), 0xD: ("pressure", 1), 0xE: ("pitch_bend", 2)}
_MODE = {0x78: "all_sound_off", 0x79: "reset_controllers", 0x7A: "local_control", 0x7B: "all_notes_off", 0x7C: "omni_off", 0x7D: "omni_on", 0x7E: "mono_on", 0x7F: "poly_on"}
_TEXT = {0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument", 0x05: "lyric", 0x06: "marker", 0x07: "cue"}
_NUMBERS = {0x00: ("sequence_number", ">H"), 0x20: ("channel_prefix", ">B"), 0x2F: ("end_of_track", ">"), 0x51: ("tempo", ">BH"), 0x54: ("smpte_offset", ">5B"), 0x58: ("time_signature", ">4B"), 0x59: ("key_signature", ">bB")}
_FRAME_RATES = (24, 25, 29, 30)
_LAYOUTS = {code: (kind, struct.Struct(layout)) for code, (kind, layout) in _NUMBERS.items()}


class MidiError(ValueError):
    pass


class _Bytes:
    """A cursor that never leaves its bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise MidiError("the chunk ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def quantity(self) -> int:
        """Seven bits a byte, four bytes at most."""
        out = 0
        for _ in range(4):
            b = self.number(1)
            out = out << 7 | b & 0x7F
            if b < 0x80:
                break
        return out


def _meta(c: _Bytes) -> tuple:
    raw, at = c.raw, c.at
    if at + 1 < len(raw) and raw[at + 1] < 0x80 and at + 2 + raw[at + 1] <= len(raw):  # most sizes are a byte
        code, c.at = raw[at], at + 2 + raw[at + 1]
        data = raw[at + 2 : c.at]
    else:
        code = c.number(1)
        data = c.take(c.quantity())
    if code in _TEXT:
        return _TEXT[code], None, [], data.decode("utf-8", "replace"), None
    if code in _LAYOUTS:
        kind, layout = _LAYOUTS[code]
        if layout.size != len(data):
            raise MidiError(f"{kind} of {len(data)} bytes")
        values = list(layout.unpack(data))
        return kind, None, [values[0] << 16 | values[1]] if kind == "tempo" else values, None, None
    if code == 0x7F:  # a maker's number of one byte, or of three where the first is 0
        head = 3 if data[:1] == b"\0" else 1
        if len(data) < head:
            raise MidiError("no maker's number")
        return "sequencer", None, [int.from_bytes(data[:head], "big")], None, data[head:]
    return "unknown_meta", None, [code], None, data


def _events(raw: bytes, kinds: frozenset[str] | None) -> list[tuple]:
    """(place, tick, kind, channel, values, text, data) of a track's events; kinds: of these alone, all are checked."""
    c, end, tick, running, place, out = _Bytes(raw), len(raw), 0, None, -1, []
    at = 0  # the cursor; c takes the rarer shapes
    while at < end:
        place += 1
        if raw[at] < 0x80:  # most distances are a byte
            tick += raw[at]
            at += 1
        else:
            c.at = at
            tick += c.quantity()
            at = c.at
        if at >= end:
            raise MidiError("the chunk ends early")
        status = raw[at]
        if status < 0x80:
            if running is None:
                raise MidiError(f"data byte {status} without a status")
            status = running
        else:
            at += 1
        if status < 0xF0:
            running = status
            kind, size = _CHANNEL[status >> 4]
            if at + size > end:
                raise MidiError("the chunk ends early")
            if kind == "controller" and raw[at] in _MODE:
                kind = _MODE[raw[at]]
            if kinds is None or kind in kinds:
                out.append((place, tick, kind, status & 0xF, list(raw[at : at + size]), None, None))
            at += size
            continue
        running, c.at = None, at
        if status == 0xFF:
            e = _meta(c)
            if kinds is None or e[0] in kinds:
                out.append((place, tick, *e))
        elif status in (0xF0, 0xF7):
            data = c.take(c.quantity())
            if kinds is None or "sysex" in kinds:
                out.append((place, tick, "sysex", None, [], None, data))
        else:
            raise MidiError(f"status {status}")
        at = c.at
    return out


def parse(raw: bytes) -> tuple[int, int, list[list[tuple]]]:
    """(format, division, events of each track as (tick, kind, channel, values, text, data)). More header bytes than six and chunks of other kinds are skipped; a broken file is a MidiError."""
    layout, division, tracks = _parsed(raw, None)
    return layout, division, [[e[1:] for e in track] for track in tracks]


def _parsed(raw: bytes, kinds: frozenset[str] | None) -> tuple[int, int, list[list[tuple]]]:
    c = _Bytes(raw)
    if raw[:4] != b"MThd":
        raise MidiError("no MIDI file")
    c.take(4)
    head = _Bytes(c.take(c.number(4)))
    layout, count, division = (head.number(2) for _ in range(3))
    frames, ticks = -((division >> 8) - 256), division & 0xFF
    if layout > 2 or not (frames in _FRAME_RATES and ticks if division & 0x8000 else division):
        raise MidiError("an invalid header")
    tracks: list[list[tuple]] = []
    while len(tracks) < count:
        try:
            kind = c.take(4)
            body = c.take(c.number(4))
            if kind == b"MTrk":
                tracks.append(_events(body, kinds))
        except MidiError as e:
            raise MidiError(f"track {len(tracks) + 1}: {e}") from e
    return layout, division, tracks


_ARROW = pa.schema(
    [("file", pa.string()), *[(c, pa.int32()) for c in ("format", "division", "track", "place")], ("tick", pa.int64()), ("kind", pa.string()), ("channel", pa.int32())]
    + [("values", pa.list_(pa.int32())), ("text", pa.string()), ("data", pa.binary()), ("error", pa.string())]
)


def _batch(heads: list[tuple], events: list[tuple]) -> pa.RecordBatch:
    """heads: (file, format, division, track, error, number of events) of each track; events: (place, tick, kind, channel, values, text, data) of all."""
    names, *numbers, errors, counts = zip(*heads, strict=True)
    of = pa.array(np.repeat(np.arange(len(heads)), counts))
    place, tick, kind, channel, values, text, data = zip(*events, strict=True)
    lists = pa.ListArray.from_arrays(np.cumsum([0, *[len(v or ()) for v in values]], dtype=np.int32), pa.array([x for v in values for x in v or ()], pa.int32()))
    if None in values:
        lists = pa.array(values, pa.list_(pa.int32()))
    made = {"file": pa.array(names, pa.string()).take(of), "error": pa.array(errors, pa.string()).take(of), "values": lists}
    made |= {c: pa.array(x, pa.int32()).take(of) for c, x in zip(("format", "division", "track"), numbers, strict=True)}
    made |= {c: pa.array(x, _ARROW.field(c).type) for c, x in (("place", place), ("tick", tick), ("kind", kind), ("channel", channel), ("text", text), ("data", data))}
    return pa.RecordBatch.from_arrays([made[c] for c in _ARROW.names], schema=_ARROW)


def _opened(kinds: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        rows: list[tuple] = []
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    layout, division, tracks = _parsed(raw.as_py() or b"", kinds)
                except MidiError as e:
                    heads.append((name, None, None, None, str(e), 1))
                    rows.append((None, None, None, None, None, None, None))
                    continue
                for t, own in enumerate(tracks):
                    for k in range(0, len(own), BATCH_ROWS):
                        part = own[k : k + BATCH_ROWS]
                        heads.append((name, layout, division, t, None, len(part)))
                        rows += part
                        if len(rows) >= BATCH_ROWS:
                            yield _batch(heads, rows)
                            heads, rows = [], []
        if rows:
            yield _batch(heads, rows)

    return opened


def midi_events(files: DataFrame, strict: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """The events of each row of files (file, content), in the order of track and place; kinds: only events of these.

    tick counts from the track's start; values are the event's numbers. A file that can't be read, a null or empty content included, is an error that names the file;
    with strict off it gives one row with `error` and no event. Files without events give no row. Other columns are ignored.
    """
    events = files.select(F.col("file").cast("string"), "content").mapInArrow(_opened(None if kinds is None else frozenset(kinds)), EVENTS)
    if not strict:
        return events
    bad = F.raise_error(F.concat(F.coalesce("file", F.lit("a file")), F.lit(": "), F.col("error"))).cast("string")
    return events.withColumn("error", F.when(F.col("error").isNotNull(), bad)).where("error is null").drop("error")


def read_midi(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """midi_events() of the .mid and .midi files under a folder, or of one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return midi_events(found.select(F.col("path").alias("file"), "content").where(F.lower("file").rlike(r"\.midi?$")), strict)


# --- times and bars --------------------------------------------------------------------------


def _micros(division: Column, scaled: Column, tick: Column) -> Column:
    """Whole microseconds of ticks: by the tempo map, or by frames, where 29 stands for 30000 / 1001 a second."""
    frames, ticks = F.lit(256) - F.shiftright(division, 8), division.bitwiseAND(255)
    top = F.when(frames == 29, 1_001_000_000).otherwise(1_000_000).cast("long")
    bottom = F.when(frames == 29, 30_000).otherwise(frames).cast("long") * ticks
    whole = lambda a, b: ((a - F.pmod(a, b)) / b).cast("long")
    return F.when(division < 0x8000, F.call_function("div", scaled, division.cast("long"))).otherwise(whole(tick * top, F.greatest(bottom, F.lit(1))))


def with_times(events: DataFrame) -> DataFrame:
    """Adds micros, the time of each event from the start of the file.

    A tempo holds from its tick on; of several at one tick the last in the file does, tempos of 0 are ignored, and without one
    a quarter takes 500,000 microseconds. Tempos of all tracks count.
    """
    order = Window.partitionBy("file").orderBy("tick", "track", "place")
    tempo = F.when((F.col("kind") == "tempo") & (F.get("values", F.lit(0)) > 0), F.get("values", F.lit(0)))
    before = F.coalesce(F.last(tempo, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(DEFAULT_TEMPO))
    step = (F.col("tick") - F.lag("tick", 1, 0).over(order)) * before.cast("long")
    scaled = events.withColumn("_step", step).withColumn("_scaled", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.withColumn("micros", _micros(F.col("division"), F.col("_scaled"), F.col("tick"))).drop("_step", "_scaled")


def with_bars(events: DataFrame) -> DataFrame:
    """Adds bar, as bar:beat:hundredths of a beat in the meter in effect, counted from 1; null for ticks of frames.

    First four quarters hold, unless the file starts with another meter. A change inside a bar starts a new bar; of several at one tick the last in the file holds, for all events of
    the tick. Numerators of 0 and powers above 16 are ignored. The events are read once: meters are carried along in windows over the ticks of a file.
    """
    at = lambda k: F.get("values", F.lit(k))
    own = (F.col("kind") == "time_signature") & (F.col("division") < 32768) & (at(0) > 0) & (at(1) <= 16)
    meter = F.when(own, F.struct("tick", "track", "place", at(0).alias("numerator"), at(1).alias("power")))
    common = F.struct(F.lit(0).cast("long").alias("tick"), F.lit(-1).alias("track"), F.lit(-1).alias("place"), F.lit(4).alias("numerator"), F.lit(2).alias("power"))
    ticks = Window.partitionBy("file").orderBy("tick")
    so_far, before = (ticks.rangeBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    # the largest in the order of ticks and places is the last
    held = events.withColumn("_own", meter).withColumns({"_meter": F.coalesce(F.max("_own").over(so_far), common), "_was": F.coalesce(F.max("_own").over(before), common)})
    passed = F.call_function("shiftleft", F.col("tick") - F.col("_was.tick"), F.col("_was.power"))
    bars = F.when(F.col("_own") == F.col("_meter"), F.ceil(passed / (F.col("_was.numerator") * 4 * F.col("division"))).cast("long"))
    held = held.withColumn("_bars", bars).withColumn("_start_bar", F.coalesce(F.sum("_bars").over(so_far), F.lit(0)))
    beat = F.col("division").cast("long") * 4
    since = F.call_function("shiftleft", F.col("tick") - F.col("_meter.tick"), F.col("_meter.power"))
    inside = F.pmod(since, beat * F.col("_meter.numerator"))
    div = lambda a, b: F.call_function("div", a, b)
    bar = F.col("_start_bar") + div(since, beat * F.col("_meter.numerator")) + 1
    part = div(F.pmod(inside, beat) * 100, beat)
    shown = F.concat_ws(":", bar.cast("string"), (div(inside, beat) + 1).cast("string"), F.lpad(part.cast("string"), 2, "0"))
    return held.withColumn("bar", F.when(F.col("division") < 32768, shown)).drop("_own", "_meter", "_was", "_bars", "_start_bar")


def onsets(events: DataFrame) -> DataFrame:
    """file, micros: the distinct times at which notes start; a note on without velocity is a note off."""
    return with_times(events).where("kind = 'note_on' and values[1] > 0").select("file", "micros").distinct()


# --- reference beats ---------------------------------------------------------------------------


def _beat_unit(numerator: Column, power: Column, division: Column) -> tuple[Column, Column]:
    """(beats in a bar, ticks of a beat): meters of eighths in threes beat on dotted quarters, all others on the meter's note."""
    compound = (power == 3) & (numerator > 3) & (numerator % 3 == 0)
    div = lambda a, b: F.call_function("div", a, b)
    plain = F.greatest(F.lit(1).cast("long"), div(division.cast("long") * 4, F.call_function("shiftleft", F.lit(1).cast("long"), power)))
    return F.when(compound, div(numerator, F.lit(3))).otherwise(numerator).cast("long"), F.when(compound, div(division.cast("long") * 3, F.lit(2))).otherwise(plain)


def reference_beats(events: DataFrame) -> DataFrame:
    """The beats of each file up to its last note: file, beat (from 0), tick, bar_beat (1: a downbeat), micros, bpm.

    The first meter (4/4 without one) holds from the start. A meter that changes takes over at the first beat from there on, where a new bar starts; the beats before keep their
    distance up to it. Numerators of 0 are ignored, and so are files whose ticks are frames or that have no note. A file's meters and tempos are arrays; events are read once.
    """
    number = lambda k: F.get("values", F.lit(k))
    per_bar, step = _beat_unit(number(0), number(1), F.col("division"))
    place = ["tick", "track", "place"]
    own = events.where("division < 32768")
    is_note, is_meter, is_tempo = F.expr("kind = 'note_on' and values[1] > 0"), (F.col("kind") == "time_signature") & (number(0) > 0) & (number(1) <= 16), F.expr("kind = 'tempo' and values[0] > 0")
    files = own.groupBy("file").agg(
        F.max("division").alias("division"),
        F.max(F.when(is_note, F.col("tick"))).alias("last"),
        F.array_sort(F.collect_list(F.when(is_meter, F.struct(*place, per_bar.alias("per_bar"), step.alias("step"))))).alias("meters"),
        F.collect_list(F.when(is_tempo, F.struct(*place, "values"))).alias("tempos"),
    ).where("last is not null")
    common = F.array(F.struct(F.lit(0).cast("long").alias("tick"), F.lit(0).alias("track"), F.lit(0).alias("place"), F.lit(4).cast("long").alias("per_bar"), F.col("division").cast("long").alias("step")))
    files = files.withColumn("meters", F.when(F.size("meters") > 0, F.col("meters")).otherwise(common))

    def take_over(made: Column, m: Column) -> Column:
        last = F.element_at(made, -1)
        beats = F.greatest(F.lit(0).cast("long"), F.ceil((m["tick"] - last["start"]) / last["step"]).cast("long"))
        return F.array_append(made, F.struct((last["start"] + beats * last["step"]).alias("start"), m["per_bar"].alias("per_bar"), m["step"].alias("step")))

    first = F.get("meters", F.lit(0))
    made = F.array(F.struct(F.lit(0).cast("long").alias("start"), first["per_bar"].alias("per_bar"), first["step"].alias("step")))
    runs = files.withColumn("runs", F.aggregate(F.slice("meters", 2, F.size("meters")), made, take_over))
    after = F.col("last") + 1
    # a run of beats or one tempo a row, so that files are gathered once
    none, no = F.lit(None).cast("array<int>"), F.lit(0)
    run = F.transform("runs", lambda r, k: F.struct(r["start"].alias("tick"), F.lit((1 << 31) - 1).alias("track"), no.alias("place"), none.alias("values"), r["per_bar"].alias("per_bar"), r["step"].alias("step"), F.least(F.coalesce(F.try_element_at("runs", k + 2)["start"], after), after).alias("end"), k.alias("k")))
    long = lambda x: F.lit(x).cast("long")
    tempo = F.transform("tempos", lambda t: F.struct(t["tick"].alias("tick"), t["track"].alias("track"), t["place"].alias("place"), t["values"].alias("values"), long(None).alias("per_bar"), long(1).alias("step"), (t["tick"] + 1).alias("end"), F.lit(-1).alias("k")))
    rows = runs.select("file", "division", F.inline(F.concat(run, tempo))).where("tick < end")
    n = F.when(F.col("k") >= 0, F.ceil((F.col("end") - F.col("tick")) / F.col("step")).cast("long"))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    each = rows.withColumn("before", before).select("file", "division", "track", "place", "values", "before", "per_bar", F.posexplode(F.sequence("tick", F.col("end") - 1, "step")).alias("i", "tick"))
    both = each.select("file", "division", "track", "place", "tick", "values", F.when(F.col("values").isNull(), "beat").otherwise("tempo").alias("kind"), (F.col("before") + F.col("i")).alias("beat"), (F.col("i") % F.col("per_bar") + 1).alias("bar_beat"))
    both = with_times(both)
    order = Window.partitionBy("file").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    tempo = F.coalesce(F.last(F.get("values", F.lit(0)), ignorenulls=True).over(order), F.lit(DEFAULT_TEMPO))
    return both.withColumn("bpm", 60e6 / tempo).where("kind = 'beat'").select("file", "beat", "tick", "bar_beat", "micros", "bpm")


def marked_sections(events: DataFrame, beats: DataFrame) -> DataFrame:
    """The sections between a file's markers: file, name, start, end (microseconds). What comes before the first marker is the Intro; the last section ends a beat after the last beat.

    beats: file, beat, micros. Sections that hold no beat are left out, and so are files of fewer than two beats.
    """
    kinds = events.where("division < 32768 and (kind = 'marker' or kind = 'tempo' and values[0] > 0)")
    marks = with_times(kinds).where("kind = 'marker'").select("file", "micros", "tick", "track", "place", F.col("text").alias("name"), F.lit(True).alias("mark"))
    # an Intro beside each file's first beat, dropped where a marker stands at the start
    mark = lambda at, is_mark: F.struct(at.alias("micros"), F.lit(-1).cast("long").alias("tick"), F.lit(-1).alias("track"), F.lit(-1).alias("place"), F.when(F.lit(is_mark), "Intro").alias("name"), F.lit(is_mark).alias("mark"))
    beat, intro = mark(F.col("micros"), False), mark(F.lit(0).cast("long"), True)
    grid = beats.select("file", F.inline(F.when(F.col("beat") == 0, F.array(beat, intro)).otherwise(F.array(beat))))
    whole, times = Window.partitionBy("file"), Window.partitionBy("file").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    at_beat = F.when(~F.col("mark"), F.col("micros"))
    # of each row the beats before it and the last of these; a section holds a beat if there are more before its end than before its start
    rows = grid.unionByName(marks).withColumns({"_n": F.count(at_beat).over(times), "_was": F.max(at_beat).over(times)})
    last = F.max(F.when(~F.col("mark"), F.struct("micros", "_n", "_was"))).over(whole)
    rows = rows.withColumns({"_all": F.count(at_beat).over(whole), "_last": last}).where("mark and _all > 1")
    doubled = F.col("_all") - F.col("_last._n") > 1  # two beats at the last time: the last section ends there
    ended = F.when(doubled, F.col("_last.micros")).otherwise(2 * F.col("_last.micros") - F.col("_last._was"))
    held = F.when(doubled, F.col("_last._n")).otherwise(F.col("_all"))
    order = Window.partitionBy("file").orderBy("micros", "tick", "track", "place")
    rows = rows.withColumns({"_next": F.lead("micros").over(order), "_next_n": F.lead("_n").over(order)}).where("not (tick = -1 and _next <=> 0)")
    return rows.where(F.coalesce("_next_n", held) > F.col("_n")).select("file", "name", F.col("micros").alias("start"), F.coalesce("_next", ended).alias("end"))


# --- writing -----------------------------------------------------------------------------------


def _quantity(n: Column) -> Column:
    """Seven bits a byte as hex digits, all but the last with the high bit."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    part = lambda k: F.shiftright(n, 7 * k).bitwiseAND(127)
    more = [F.when(n >= 1 << 7 * k, byte(part(k).bitwiseOR(128))).otherwise("") for k in (3, 2, 1)]
    return F.concat(*more, byte(part(0)))


def tempo_tracks(points: DataFrame, key: str, at: str, bpm: str, quarter: int = 480) -> DataFrame:
    """(key, content): a MIDI file of one track for each key that is its tempo map: `bpm` from `at` seconds on.

    Ticks from point to point follow the tempo of the point before, before the first its own; microseconds of a quarter are rounded and at most 2^24 - 1. Points of one time keep
    the order of their tempos. A tempo that isn't above 0, a null time, or a distance above 2^28 - 1 ticks is an error. A key has a point at least, its points are one array.
    """
    order = Window.partitionBy(key).orderBy(at, bpm)
    t, b = F.col(at).cast("double"), F.col(bpm).cast("double")
    was = F.coalesce(F.lag(b).over(order), b)
    gap = F.greatest(F.lit(0.0), t - F.coalesce(F.lag(t).over(order), F.lit(0.0)))
    ticks = F.round(gap * was * quarter / 60.0).cast("long")
    micros = F.least(F.lit((1 << 24) - 1), F.greatest(F.lit(1), F.round(60_000_000.0 / b))).cast("long")
    bad = t.isNull() | b.isNull() | F.isnan(b) | (b <= 0) | (ticks >= 1 << 28)
    said = F.raise_error(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("a key")), F.lit(": no tempo of "), F.coalesce(b.cast("string"), F.lit("null")), F.lit(" can be written")))
    code = F.when(bad, said.cast("string")).otherwise(F.concat(_quantity(ticks), F.lit("FF5103"), F.lpad(F.hex(micros), 6, "0")))
    coded = points.select(key, t.alias("_t"), b.alias("_b"), code.alias("_code"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_b", "_code"))), lambda x: x["_code"]), "")
    files = coded.groupBy(key).agg(F.concat(body, F.lit("00FF2F00")).alias("_body"))
    size = F.lpad(F.hex(F.expr("length(_body) div 2")), 8, "0")
    return files.select(key, F.unhex(F.concat(F.lit("4D54686400000006" + f"00000001{quarter:04X}" + "4D54726B"), size, F.col("_body"))).alias("content"))


# --- descriptions --------------------------------------------------------------------------------

#: Major keys from seven flats to seven sharps; the minor keys beside them lie three fifths on.
MAJOR_KEYS = ["Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#"]
MINOR_KEYS = ["Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#"]


def describe(camelot: bool = False) -> Column:
    """What an event says: meters as 6/8, keys as names (or codes of the Camelot wheel), tempos in quarters a minute with two decimals at most; other events, and
    values outside the format's range, as kind and numbers or text."""
    number = lambda k: F.get("values", F.lit(k))
    plain = F.concat(F.col("kind"), F.lit("("), F.coalesce(F.concat_ws(", ", F.col("channel").cast("string"), F.transform("values", lambda v: v.cast("string")), F.col("text"), F.hex("data")), F.lit("")), F.lit(")"))
    meter = F.when(number(1) < 32, F.format_string("TimeSignature(%d/%d)", number(0), F.call_function("shiftleft", F.lit(1).cast("long"), number(1))))
    minor, at = number(1) != 0, number(0) + 7
    names = F.when(minor, F.concat(F.get(F.lit(MINOR_KEYS), at), F.lit(" minor"))).otherwise(F.concat(F.get(F.lit(MAJOR_KEYS), at), F.lit(" major")))
    codes = F.concat((F.pmod(at, F.lit(12)) + 1).cast("string"), F.when(minor, "A").otherwise("B"))
    key = F.when(at.between(0, 14), F.concat(F.lit("KeySignature("), codes if camelot else names, F.lit(")")))
    shown = F.regexp_replace(F.format_string("%.2f", 60_000_000.0 / number(0)), r"\.?0+$", "")
    tempo = F.when(number(0) > 0, F.concat(F.lit("SetTempo(b="), shown, F.lit(")")))
    readable = F.when(F.col("kind") == "time_signature", meter).when(F.col("kind") == "key_signature", key).when(F.col("kind") == "tempo", tempo)
    return F.coalesce(readable, plain)


def dump_lines(events: DataFrame, when: str = "delta", camelot: bool = False) -> DataFrame:
    """file, track, place, line of every event as "when - what"; when: `delta` ticks since the track's last event, `bars`, or `clock` (m:ss:hundredths)."""
    if when == "delta":
        order = Window.partitionBy("file", "track").orderBy("place")
        timed = events.withColumn("_when", (F.col("tick") - F.lag("tick", 1, 0).over(order)).cast("string"))
    elif when == "bars":
        timed = with_bars(events).withColumn("_when", F.coalesce("bar", F.lit("")))
    elif when == "clock":
        div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
        us = F.col("micros")
        timed = with_times(events).withColumn("_when", F.format_string("%d:%02d:%02d", div(us, 60_000_000), div(us, 1_000_000) % 60, div(us, 10_000) % 100))
    else:
        raise ValueError(f"no time named {when!r}")
    return timed.select("file", "track", "place", F.concat("_when", F.lit(" - "), describe(camelot)).alias("line"))
