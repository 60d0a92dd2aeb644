"""Scalar functions: scales, levels, names, clocks, text clean-up, vectors and hashes, as Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the twelve pitch classes, and the Camelot numbers of the major and minor keys by tonic.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
CAMELOT_MAJOR = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)
CAMELOT_MINOR = (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)
# The Krumhansl-Kessler key profiles.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


# --- scales and levels ---


def hz_to_mel_htk(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz_htk(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


def hz_to_mel_slaney(hz: Column) -> Column:
    """Linear below 1 kHz (three mels in 200 Hz), then 27 steps for each factor of 6.4."""
    return F.when(hz < 1000, hz * 3 / 200.0).otherwise(15.0 + 27.0 * F.log(F.greatest(hz, F.lit(1000.0)) / 1000.0) / math.log(6.4))


def mel_to_hz_slaney(mel: Column) -> Column:
    return F.when(mel < 15, mel * 200 / 3.0).otherwise(1000.0 * F.exp((mel - 15.0) * math.log(6.4) / 27.0))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def power_db(mean_square: Column, floor: float = 1e-12) -> Column:
    return 10.0 * F.log10(mean_square + floor)


def frame_time(idx: Column, hop: int, rate: int) -> Column:
    return idx * F.lit(float(hop)) / rate


def frame_count(n: Column, hop: int) -> Column:
    return F.ceil(n / hop)


def three_zone(level: Column, present: float, absent: float) -> tuple[Column, Column]:
    """(label, weight): 1 at or above `present`, 0 below `absent`; the zone between has weight 0."""
    label = F.when(level >= present, 1).otherwise(0)
    return label, F.when((level >= present) | (level < absent), 1.0).otherwise(0.0)


# --- names ---


def _pick(values: tuple, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(i, F.lit(len(values))).cast("int") + 1)


def note_name(i: Column) -> Column:
    return _pick(NOTES, i)


def key_name(tonic: Column, minor: Column) -> Column:
    return F.concat(note_name(tonic), F.when(minor, F.lit(" minor")).otherwise(F.lit(" major")))


def harte(tonic: Column, minor: Column) -> Column:
    """Chord label such as C:maj; N without a tonic."""
    return F.when(tonic.isNull(), "N").otherwise(F.concat(note_name(tonic), F.when(minor, F.lit(":min")).otherwise(F.lit(":maj"))))


def camelot(tonic: Column, minor: Column) -> Column:
    return F.concat(F.when(minor, _pick(CAMELOT_MINOR, tonic)).otherwise(_pick(CAMELOT_MAJOR, tonic)).cast("string"), F.when(minor, F.lit("A")).otherwise(F.lit("B")))


def open_key(tonic: Column, minor: Column) -> Column:
    number = F.when(minor, _pick(CAMELOT_MINOR, tonic)).otherwise(_pick(CAMELOT_MAJOR, tonic))
    return F.concat((F.pmod(number - 8, F.lit(12)) + 1).cast("string"), F.when(minor, F.lit("m")).otherwise(F.lit("d")))


def section_letter(i: Column) -> Column:
    return F.char((F.pmod(i, F.lit(26)) + 65).cast("long"))


# --- clocks ---


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def clock(centis: Column) -> Column:
    """m:ss:hh of a number of hundredths of a second."""
    return F.concat_ws(":", F.expr("1").cast("string") if centis is None else F.floor(centis / 6000).cast("long").cast("string"), _two(F.floor(F.pmod(centis, F.lit(6000)) / 100).cast("long")), _two(F.pmod(centis, F.lit(100)).cast("long")))


def clock_short(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat_ws(":", F.floor(s / 60).cast("string"), _two(F.pmod(s, F.lit(60))))


def elapsed(seconds: Column) -> Column:
    """1h 2m 3s without leading zero parts."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    tail = F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))), tail)


def bar_position(tick: Column, ppq: int, beats: int = 4, unit: int = 4) -> Column:
    """bar:beat:hundredths of a tick in a constant meter."""
    beat_ticks = ppq * 4 // unit
    bar = F.floor(tick / (beat_ticks * beats)) + 1
    inside = F.pmod(tick, F.lit(beat_ticks * beats))
    hundredths = F.floor(F.pmod(inside, F.lit(beat_ticks)) * 100 / beat_ticks)
    return F.concat_ws(":", bar.cast("string"), (F.floor(inside / beat_ticks) + 1).cast("string"), _two(hundredths))


def bpm_of_tempo(micros: Column) -> Column:
    """BPM with two decimals at most, trailing zeros cut; the raw number for 0."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(F.try_divide(F.lit(60_000_000.0), micros), 2)), r"0+$", ""), r"\.$", "")
    return F.when(micros == 0, micros.cast("string")).otherwise(shown)


def octave_badge(estimate: Column, reference: Column, tolerance: float = 0.04) -> Column:
    """exact, x0.5, x2, x0.67, x1.5 or none: the first factor that brings the estimate within tolerance of the reference."""
    near = lambda f: F.abs(estimate * f - reference) <= tolerance * reference
    return F.when(near(1.0), "exact").when(near(0.5), "x0.5").when(near(2.0), "x2").when(near(2 / 3), "x0.67").when(near(1.5), "x1.5").otherwise("none")


# --- text ---


def normal_label(s: Column) -> Column:
    """Lower case without (...) and digits, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"\([^)]*\)", ""), r"[0-9]", ""), r"\s+", " "))


def split_tags(s: Column, sep: str = r"\+") -> Column:
    return F.filter(F.transform(F.split(s, sep), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def interruptions(s: Column) -> Column:
    """`3.0-5.5:guitar;10-12:?` as an array of (start, end, family)."""
    parts = F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x, i: F.regexp_extract(x, r"^([0-9.]+)-([0-9.]+)(?::(.*))?$", i)
    return F.transform(parts, lambda x: F.struct(number(x, 1).try_cast("double").alias("start"), number(x, 2).try_cast("double").alias("end"), number(x, 3).alias("family")))


def truncated(s: Column, most: int) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 1), F.lit("…")))


def file_name(url: Column, default: str = "model.bin") -> Column:
    name = F.element_at(F.split(url, "/"), -1)
    return F.when(name == "", default).otherwise(name)


def extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "", "unknown").otherwise(ext)


def stage_id(level: Column, name: Column) -> Column:
    return F.concat_ws(":", F.concat(F.lit("l"), level.cast("string")), name)


# --- vectors ---


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 with a zero vector."""
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den <= 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), den))))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is computed once however often made uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def l1_normal(a: Column, least: float = 1e-9) -> Column:
    scaled = lambda v: bound(total(v), lambda t: F.transform(v, lambda x: x.cast("double") / F.when(t > least, t).otherwise(1.0)))
    return bound(a, scaled)


def l2_normal(a: Column, least: float = 1e-9) -> Column:
    scaled = lambda v: bound(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > least, n).otherwise(1.0)))
    return bound(a, scaled)


def log_softmax(a: Column, temperature: float) -> Column:
    def logs(v: Column) -> Column:
        z = lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp((x.cast("double") - m) / temperature))
        return bound(F.array_max(v).cast("double"), lambda m: bound(F.log(z(m)), lambda logz: F.transform(v, lambda x: (x.cast("double") - m) / temperature - logz)))

    return bound(a, logs)


def less_harmonics(a: Column, fifth: float = 0.6, third: float = 0.3) -> Column:
    """max(0, x[p] - fifth * x[p-7] - third * x[p-4]) around a circle of twelve."""
    at = lambda v, i: F.get(v, F.lit(i % 12)).cast("double")
    return bound(a, lambda v: F.array(*[F.greatest(F.lit(0.0), at(v, p) - fifth * at(v, p - 7) - third * at(v, p - 4)) for p in range(12)]))


def rotated(values: tuple, by: Column) -> Column:
    """values moved up by `by` places around a circle."""
    arr = F.array(*[F.lit(v) for v in values])
    n = len(values)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(arr, (F.pmod(i - by, F.lit(n)) + 1).cast("int")))


def noisy_or(p: Column) -> Column:
    return 1 - F.aggregate(p, F.lit(1.0), lambda s, x: s * (1 - x.cast("double")))


def gated(masks: Column, present: Column, least: float = 1e-8) -> Column:
    """Masks of the present sources, scaled to sum 1; silence if none is present."""
    kept = F.zip_with(masks, present, lambda m, p: m.cast("double") * p.cast("double"))
    return bound(kept, lambda k: bound(F.greatest(total(k), F.lit(least)), lambda t: F.transform(k, lambda m: m / t)))


def hann(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / n))


def multi_hot(vocabulary: list[str], present: Column) -> Column:
    return F.array(*[F.array_contains(present, v).cast("int") for v in vocabulary])


# --- hashes and derived draws ---


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.hex(F.encode(s, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def chained_key(parent: Column, *parts: Column) -> Column:
    """sha256 over a version, whether there is a parent, the parent, and each part with its length, so no two part lists collide."""
    sized = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit("v1"), F.when(parent.isNull(), "0").otherwise("1"), F.coalesce(parent, F.lit("")), *sized), 256)


def uniform(seed: Column, stream: str, k: int = 0) -> Column:
    """A draw in [0, 1) that depends on seed, stream and k only, so switching one stream off moves no other."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.lit(stream), F.lit(str(k)))), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_sizes(total_: Column, weight: Column) -> Column:
    """max(1, total * weight rounded half to even)."""
    return F.greatest(F.lit(1), F.rint(total_ * weight).cast("long"))


def learning_rate(step: Column, top: float, warm: int, steps: int, final: float = 1.0) -> Column:
    """Linear warm-up, then a cosine from top to the share `final` of it at the last step; 1 keeps the rate."""
    done = F.least(F.lit(1.0), (step - warm) / float(max(1, steps - warm)))
    return F.when(step < warm, top * (step + 1) / float(warm)).otherwise(top * (final + (1 - final) * 0.5 * (1 + F.cos(math.pi * done))))


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded half to even: times of labels to four digits, scores to two. What counts as a half is the product with the power of ten, in doubles."""
    return F.rint(x.cast("double") * float(10**digits)) / float(10**digits)
