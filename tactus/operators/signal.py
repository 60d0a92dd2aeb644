"""Sampled signals: frames, spectra, pitch classes, mel bands, onset strength and tempograms.

A signal is a table of keys, idx (0-based, without gaps) and value. It is dealt into blocks of many frames that carry the samples their
frames reach into, so a long signal spreads over tasks and every sample moves about once, whatever the overlap of frames. Numpy sees one block at a time, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import aggregates as A
from tactus.operators import joins as J
from tactus.operators import scans as C
from tactus.operators import series as R
from tactus.sources.materialise import cut

#: Samples of one block, without what its frames reach into beyond it.
BLOCK_SAMPLES = 65_536
#: Frames that numpy sees and hands on together, whatever the number and length of blocks in an Arrow batch.
BATCH_FRAMES = 4096


def mixed_down(samples: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """Mean over the channels of each frame of samples."""
    return samples.groupBy(*keys, idx).agg(F.avg(value).alias(value))


def fitted(samples: Column, n: int) -> Column:
    """An array cut or filled with zeros to n samples."""
    x = F.slice(samples, 1, n)
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size(x))))


def blocks(signal: DataFrame, keys: list[str], value: str, hop: int, win: int, pad: str = "zero", idx: str = "idx") -> DataFrame:
    """Blocks of frames: keys, first (frame), n (frames), x (their samples: frame first + k is x[k * hop : k * hop + win]).

    pad "zero" and "reflect": frame k is centred at sample k * hop, and there are ceil(samples / hop) of them. "none": frame k starts there, and only whole
    frames count. "open": it starts there, and samples beyond the end are NaN. A signal too short to be reflected is filled with zeros.
    """
    lead = win // 2 if pad in ("zero", "reflect") else 0
    per = max(1, BLOCK_SAMPLES // hop)
    span, reach = per * hop, (per - 1) * hop + win
    i = F.col(idx).cast("long")
    held = signal.where(" and ".join(f"`{k}` is not null" for k in keys))
    first = F.greatest(F.lit(0).cast("long"), F.floor((i + lead - reach) / span) + 1)
    held = held.withColumn("_b", F.explode(F.sequence(first, F.floor((i + lead) / span))))
    lists = held.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("_x"))
    last = F.element_at("_x", -1)["i"]
    start = F.col("_b") * per
    room = last + 1 - win if pad == "none" else last
    n = F.greatest(F.lit(0).cast("long"), F.least(F.lit(per).cast("long"), F.floor(room / hop) + 1 - start))
    b = lists.select(*keys, start.alias("first"), n.alias("n"), F.transform("_x", lambda s: s["v"]).alias("_v"), F.greatest(F.lit(0), lead - F.col("_b") * span).cast("int").alias("_before")).where("n > 0")
    behind = F.greatest(F.lit(0).cast("long"), (F.col("n") - 1) * hop + win - F.size("_v") - F.col("_before")).cast("int")
    size = F.size("_v")
    fill = F.lit(float("nan") if pad == "open" else 0.0)
    head, tail = F.array_repeat(fill, F.col("_before")), F.array_repeat(fill, behind)
    if pad == "reflect":
        mirrors = (F.col("_before") < size) & (behind < size)
        head = F.when(mirrors, F.reverse(F.slice("_v", F.lit(2), F.col("_before")))).otherwise(head)
        tail = F.when(mirrors, F.reverse(F.slice("_v", F.greatest(F.lit(1), size - behind), behind))).otherwise(tail)
    return b.select(*keys, "first", "n", F.concat(head, "_v", tail).alias("x"))


def frames(dealt: DataFrame, keys: list[str], hop: int, win: int) -> DataFrame:
    """Single frames of blocks(): keys, frame, x."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return dealt.withColumn("_k", k).select(*keys, (F.col("first") + F.col("_k")).alias("frame"), F.slice("x", (F.col("_k") * hop + 1).cast("int"), win).alias("x"))


def over_frames(dealt: DataFrame, keys: list[str], hop: int, win: int, made: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """keys, frame and the row of made(frames x win) that belongs to it; rows that begin with NaN are left out."""

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def rows(b: pa.RecordBatch, of: list[int], views: list[np.ndarray], at: list[int]) -> pa.RecordBatch:
        out = np.asarray(made(np.concatenate(views)), float)
        sizes = [len(v) for v in views]
        frame = np.concatenate([np.arange(a, a + n) for a, n in zip(at, sizes, strict=True)])
        keep = ~np.isnan(out[:, 0])
        out, place = np.ascontiguousarray(out[keep]), pa.array(np.repeat(of, sizes)[keep])
        vectors = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())
        return pa.RecordBatch.from_arrays([*[b[k].take(place) for k in keys], pa.array(frame[keep], pa.int64()), vectors], names=[*keys, "frame", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, samples = b["x"].offsets.to_numpy(), b["x"].values.to_numpy(zero_copy_only=False)
            of, views, at, held = [], [], [], 0
            for r, (first, n) in enumerate(zip(b["first"].to_pylist(), b["n"].to_pylist(), strict=True)):
                each = np.lib.stride_tricks.sliding_window_view(samples[ends[r] : ends[r + 1]], win)[::hop][:n]
                for k in range(0, len(each), BATCH_FRAMES):
                    part = each[k : k + BATCH_FRAMES]
                    of.append(r), views.append(part), at.append(first + k)
                    held += len(part)
                    if held >= BATCH_FRAMES:
                        yield rows(b, of, views, at)
                        of, views, at, held = [], [], [], 0
            if held:
                yield rows(b, of, views, at)

    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return dealt.select(*keys, "first", "n", "x").mapInArrow(run, f"{named}, frame long, {name} array<double>")


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def magnitudes(win: int) -> Callable[[np.ndarray], np.ndarray]:
    """Magnitudes of the real Fourier transform of Hann-windowed frames: win // 2 + 1 bins."""
    w = hann(win)
    return lambda x: np.abs(np.fft.rfft(x * w, axis=1))


def triangles(edges_hz: np.ndarray, rate: float, win: int) -> np.ndarray:
    """Bins x bands weights of triangular filters between neighbouring edges, 1 at the middle edge."""
    f = np.arange(win // 2 + 1)[:, None] * rate / win
    lo, mid, hi = edges_hz[:-2], edges_hz[1:-1], edges_hz[2:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.maximum(0.0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))))


def htk_edges(bands: int, low: float, high: float) -> np.ndarray:
    mel = np.linspace(*(2595 * np.log10(1 + np.array([low, high]) / 700)), bands + 2)
    return 700 * (10 ** (mel / 2595) - 1)


def slaney_edges(bands: int, low: float, high: float) -> np.ndarray:
    """Linear below 1 kHz, logarithmic above."""
    step = np.log(6.4) / 27
    to = lambda hz: hz * 3 / 200 if hz < 1000 else 15 + np.log(hz / 1000) / step
    mel = np.linspace(to(low), to(high), bands + 2)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(step * (mel - 15)))


def bands(win: int, filters: np.ndarray, shape: str = "log1p", scale: float = 1.0, floor: float = 1e-6) -> Callable[[np.ndarray], np.ndarray]:
    """Band magnitudes of frames: "log1p" gives ln(1 + scale * e), "log" ln(e + floor)."""
    spectrum = magnitudes(win)

    def made(x: np.ndarray) -> np.ndarray:
        e = spectrum(x) @ filters
        return np.log1p(scale * e) if shape == "log1p" else np.log(e + floor)

    return made


def constant_q(rate: float, low: float, octaves: int, per_octave: int = 12) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """The window of the lowest tone, and magnitudes of tones a constant ratio apart, each over a Hann window of as many periods."""
    tones = low * 2.0 ** (np.arange(octaves * per_octave) / per_octave)
    q = 1 / (2 ** (1 / per_octave) - 1)
    sizes = np.maximum(4, np.rint(q * rate / tones).astype(int))
    win = int(sizes.max())
    kernel = np.zeros((win, len(tones)), complex)
    for k, (f, n) in enumerate(zip(tones, sizes)):
        at = win // 2 - n // 2
        kernel[at : at + n, k] = hann(n) * np.exp(-2j * np.pi * f * np.arange(n) / rate) / max(hann(n).sum() / 2, 1e-9)
    return win, lambda x: np.hypot(x @ kernel.real, x @ kernel.imag)


def folded(tones: Column, octaves: int, per_octave: int = 12) -> Column:
    """Sums of the tones of each pitch class."""
    return F.array(*[sum((F.get(tones, F.lit(o * per_octave + p)) for o in range(1, octaves)), F.get(tones, F.lit(p))) for p in range(per_octave)])


def smooth_vectors(df: DataFrame, keys: list[str], vector: str, size: int, radius: int, idx: str) -> DataFrame:
    """Centred moving mean of each element, cut off at the ends."""
    made = {f"_p{k}": (lambda by, frame, k=k: F.avg(F.get(vector, F.lit(k))).over(frame)) for k in range(size)}
    return R.over_rows(df, keys, radius, radius, made, idx).withColumn(vector, F.array(*made)).drop(*made)


def chroma(signal: DataFrame, keys: list[str], value: str, rate: float, hop: int, octaves: int = 7, low: float = 32.7032, radius: int = 0, suppressed: bool = False, pad: str = "reflect") -> DataFrame:
    """Strength of the twelve pitch classes by frame, with sum 1: keys, frame, chroma.

    For keys: a long hop and a smoothing radius; for chords: a short hop and harmonics suppressed.
    """
    win, made = constant_q(rate, low, octaves)
    tones = over_frames(blocks(signal, keys, value, hop, win, pad), keys, hop, win, made, "tones")
    pcs = tones.select(*keys, "frame", folded(F.col("tones"), octaves).alias("chroma"))
    if suppressed:
        pcs = pcs.withColumn("chroma", S.less_harmonics(F.col("chroma")))
    if radius:
        pcs = smooth_vectors(pcs, keys, "chroma", 12, radius, "frame")
    return pcs.withColumn("chroma", S.l1_normal(F.col("chroma")))


def timbre(signal: DataFrame, keys: list[str], value: str, rate: float, hop: int, win: int = 4096, n: int = 24, low: float = 40.0, high: float = 8000.0, radius: int = 4) -> DataFrame:
    """Log energies of mel bands, smoothed in time and brought to mean 0 and deviation 1 in each band of a signal: keys, frame, timbre."""
    filters = triangles(htk_edges(n, low, min(high, rate / 2)), rate, win)
    e = over_frames(blocks(signal, keys, value, hop, win, "reflect"), keys, hop, win, bands(win, filters, "log"), "timbre")
    e = smooth_vectors(e, keys, "timbre", n, radius, "frame") if radius else e
    part = lambda f, c: F.array(*[f(F.get(c, F.lit(k))) for k in range(n)])
    stats = e.groupBy(*keys).agg(part(F.avg, "timbre").alias("_m"), part(F.stddev_pop, "timbre").alias("_s"), F.count("*").alias("_n"))
    z = F.transform("timbre", lambda x, k: F.when(F.col("_n") < 2, x).when(F.get("_s", k) <= 1e-6, 0.0).otherwise(F.try_divide(x - F.get("_m", k), F.get("_s", k))))
    return e.join(stats, keys).select(*keys, "frame", z.alias("timbre"))


def flux(spectra: DataFrame, keys: list[str], vector: str, wide: bool = False, name: str = "flux") -> DataFrame:
    """Sum of the rises of all bins since the frame before, 0 in the first: keys, frame and name. wide: over the largest of three neighbouring bins of that frame."""
    with_last = R.over_rows(spectra, keys, 1, 0, {"_p": lambda by, frame: F.lag(vector).over(by)}, "frame")
    none = F.lit(0.0)
    before = F.transform("_p", lambda x, k: F.greatest(x, F.coalesce(F.get("_p", k - 1), none), F.coalesce(F.get("_p", k + 1), none)) if wide else x)
    rise = F.aggregate(F.zip_with(vector, before, lambda a, b: F.greatest(none, a - b)), none, lambda s, x: s + x)
    return with_last.select(*keys, "frame", F.coalesce(rise, none).alias(name))


def relative_to_top(df: DataFrame, keys: list[str], value: str, least: float = 1e-9) -> DataFrame:
    """value by the largest of its key, where that is not tiny."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).withColumn(value, F.when(F.col("_top") > least, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def tempo_grid(low: float = 40.0, high: float = 240.0, steps: int = 200) -> list[float]:
    return [low + (high - low) * k / max(1, steps - 1) for k in range(steps)]


def tempogram(activation: DataFrame, keys: list[str], value: str, fps: float, win: int = 384, hop: int = 32, tempi: list[float] | None = None, idx: str = "frame") -> DataFrame:
    """Autocorrelation of windows of an activation at the lag of each tempo: keys, frame (window), energy (one for each tempo).

    Windows at the end are shorter; one begins only if the one before did not reach the end, and holds 4 frames at least. Lags are interpolated, 0 outside the window.
    """
    lags = 60.0 * fps / np.array(tempi or tempo_grid())

    def made(x: np.ndarray) -> np.ndarray:
        n = (~np.isnan(x)).sum(axis=1)
        out = np.zeros((len(x), len(lags)))
        y = np.where(np.isnan(x), 0.0, x - np.nansum(x, axis=1, keepdims=True) / np.maximum(1, n)[:, None])
        spectrum = np.fft.rfft(y, 2 * win, axis=1)
        ac = np.fft.irfft(spectrum * spectrum.conj(), axis=1)[:, :win]
        zero = (y * y).sum(axis=1)
        lo = np.floor(lags).astype(int)
        part = lags - lo
        a = ac[:, np.minimum(lo, win - 1)] * (1 - part) + ac[:, np.minimum(lo + 1, win - 1)] * part
        fits = (lo[None, :] + 2 <= n[:, None]) & (zero > 1e-12)[:, None]
        out[fits] = (a / np.maximum(zero, 1e-12)[:, None])[fits]
        out[n < 4] = np.nan
        return out

    rows = over_frames(blocks(activation, keys, value, hop, win, "open", idx), keys, hop, win, made, "energy")
    size = activation.groupBy(*keys).agg(F.max(idx).alias("_last"))
    needed = (F.col("frame") == 0) | ((F.col("frame") - 1) * hop + win <= F.col("_last"))
    return rows.join(size, keys).where(needed).drop("_last")


def tempo_candidates(grams: DataFrame, keys: list[str], tempi: list[float], centre: float = 120.0, spread: float = 0.7) -> DataFrame:
    """Tempi of each key by weight: the best by mean positive energy and a log-normal prior, and the strongest near its double and its half: keys, place, bpm, weight."""
    means = grams.select(*keys, F.posexplode("energy").alias("_k", "_e")).groupBy(*keys, "_k").agg(F.avg(F.greatest(F.col("_e"), F.lit(0.0))).alias("_e"))
    prior = F.array(*[F.exp(-0.5 * F.pow(F.log(F.lit(t) / centre) / spread, 2)) for t in tempi])
    means = means.withColumn("_b", F.get(F.array(*[F.lit(t) for t in tempi]), F.col("_k"))).withColumn("_p", F.get(prior, F.col("_k")))
    # one row of all energies for each key: tempi are a fixed list
    x = F.struct(F.col("_k").alias("k"), F.col("_b").alias("b"), F.col("_e").alias("e"), F.col("_p").alias("p"))
    # on ties the last of the best, and the first near a multiple
    best = means.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("c"), F.max_by(x, F.struct(F.col("_e") * F.col("_p"), "_k")).alias("best"))
    no = F.lit(None).cast("struct<k:int,b:double,e:double,p:double>")

    def near(target: Column) -> Column:
        close = F.filter("c", lambda x: F.abs(x["b"] - target) <= F.greatest(target * 0.08, F.lit(1.0)))
        top = F.aggregate(close, no, lambda s, x: F.when(s.isNull() | (x["e"] > s["e"]), x).otherwise(s))
        return F.when((target >= tempi[0]) & (target <= tempi[-1]), top)

    add = lambda found, x: F.when(x.isNull() | F.exists(found, lambda y: F.abs(y["b"] - x["b"]) < 1), found).otherwise(F.concat(found, F.array(x)))
    best = best.withColumn("found", F.array("best")).withColumn("_d", near(F.col("best.b") * 2)).withColumn("_h", near(F.col("best.b") / 2))
    best = best.withColumn("found", add(F.col("found"), F.col("_d"))).withColumn("found", add(F.col("found"), F.col("_h")))
    weighed = F.transform("found", lambda x: F.struct((-F.greatest(x["e"], F.lit(1e-6)) * x["p"]).alias("w"), x["b"].alias("b")))
    ranked = best.select(*keys, F.array_sort(weighed).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s - x["w"])
    # outer, though no list is empty: else Spark filters by the list's size further down, and each name in its expression is written out there, again and again
    return ranked.withColumn("_t", total).select(*keys, "_t", F.posexplode_outer("f").alias("_p", "_f")).select(*keys, (F.col("_p") + 1).cast("long").alias("place"), F.col("_f.b").alias("bpm"), (-F.col("_f.w") / F.col("_t")).alias("weight"))


def top_keys(pcs: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Best of 24 rotated key profiles for the mean chroma of each key column value: keys, place, tonic, minor, confidence."""
    mean = pcs.groupBy(*keys).agg(F.array(*[F.avg(F.get("chroma", F.lit(k))) for k in range(12)]).alias("v"))
    kinds = F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("minor")) for t in range(12) for m in (False, True)])
    each = mean.select(*keys, "v", F.explode(kinds).alias("_key"))
    shape = F.when(F.col("_key.minor"), S.rotated(S.MINOR_PROFILE, F.col("_key.tonic"))).otherwise(S.rotated(S.MAJOR_PROFILE, F.col("_key.tonic")))
    pairs = each.select(*keys, "_key", F.explode(F.arrays_zip(F.col("v").alias("a"), shape.alias("b"))).alias("z"))
    r = pairs.groupBy(*keys, "_key").agg(A.correlation(F.col("z.a"), F.col("z.b")).alias("r"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("r"), "_key.tonic", "_key.minor"))
    return r.withColumn("place", place.cast("long")).where(F.col("place") <= most).select(*keys, "place", "_key.tonic", "_key.minor", ((F.col("r") + 1) / 2).alias("confidence"))


def chord_templates() -> list[list[float]]:
    """Unit vectors of 24 triads: for each root the major one, then the minor one."""
    out = []
    for root in range(12):
        for third in (4, 3):
            v = np.zeros(12)
            v[[root, (root + third) % 12, (root + 7) % 12]] = 3**-0.5
            out.append(v.tolist())
    return out


def chords(pcs: DataFrame, beats: DataFrame, keys: list[str], at: str, beat_at: str, beat: str, bucket: Column, stay: float, temperature: float = 0.15, nothing: float = 0.35) -> DataFrame:
    """Chord events over beats: keys, first and last beat (place), chord, confidence.

    The mean chroma of a beat is compared with 24 triads and `nothing` (N); Viterbi smooths the states, equal neighbours merge. An event's confidence is the mean probability of its state.
    """
    long = pcs.select(*keys, at, F.posexplode("chroma").alias("pc", "v"))
    found = J.as_of(long, beats, keys, at, beat_at, beat, bucket).where("grid is not null")
    means = found.groupBy(*keys, F.col("grid.id").alias(beat), "pc").agg(F.avg("v").alias("v"))
    vectors = means.groupBy(*keys, beat).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "v"))), lambda s: s["v"]).alias("v"))
    vectors = beats.select(*keys, beat).join(vectors, [*keys, beat], "left").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), 12)))
    # templates are unit vectors of three equal parts, so a cosine is a sum of three elements of the unit vector
    part = lambda t: sum((F.get("_u", F.lit(k)) * x for k, x in enumerate(t) if x), F.lit(0.0))
    vectors = vectors.withColumn("_u", S.l2_normal(F.col("v"), 1e-12))
    near = F.array(*[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), part(t))) for t in chord_templates()], F.lit(nothing))
    states = cut(C.viterbi(vectors.withColumn("logs", S.log_softmax(near, temperature)), keys, beat, "logs", stay), "states")
    runs = R.islands(states, keys, [beat], F.floor(F.col(beat) / 4096), F.col("state"), [F.avg(F.exp("score")).alias("confidence")])
    root, minor = F.floor(F.col("state") / 2).cast("int"), F.col("state") % 2 == 1
    name = F.when(F.col("state") == 24, "N").otherwise(S.harte(root, minor))
    return runs.select(*keys, F.col(f"first.{beat}").alias("first"), F.col(f"last.{beat}").alias("last"), name.alias("chord"), "confidence")


def boundaries(pcs: DataFrame, keys: list[str], vector: str, half: int = 32, rise: float = 0.5, distance: int = 24, also: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """Places where the music changes: keys, frame, novelty. Peaks of checkerboard novelty above mean + rise deviations, at least `distance` frames apart.

    also: frames with a second vector of the same name, whose similarity is blended in by weight.
    """
    band = J.cosine_pairs(pcs, keys, "frame", vector, 2 * half - 1)
    if also is not None:
        second = J.cosine_pairs(also, keys, "frame", vector, 2 * half - 1).withColumnRenamed("similarity", "_s")
        band = band.join(second, [*keys, "i", "j"]).withColumn("similarity", (1 - weight) * F.col("similarity") + weight * F.col("_s")).drop("_s")
    curve = cut(C.novelty(cut(band, "band"), keys, half), "novelty")
    stats = curve.groupBy(*keys).agg(F.avg("novelty").alias("_m"), F.stddev_pop("novelty").alias("_sd"))
    seen = R.over_rows(curve, keys, 1, 1, {"_l": lambda by, frame: F.lag("novelty").over(by), "_r": lambda by, frame: F.lead("novelty").over(by)})
    v = F.col("novelty")
    high = v > F.greatest(F.col("_m") + rise * F.col("_sd"), F.lit(1e-3 * (2 * half) ** 2))
    peak = (F.col("_l").isNull() | (v >= F.col("_l"))) & (F.col("_r").isNull() | (v >= F.col("_r")))
    peaks = seen.join(stats, keys).where(high & peak).select(*keys, F.col("idx").alias("frame"), "novelty")
    peaks = cut(peaks, "peaks")
    return C.suppress(peaks, keys, "frame", "novelty", distance, F.floor(F.col("_t") / 4096)).withColumn("frame", F.col("frame").cast("long"))


def resampled_count(n: Column, rate: int, target: int) -> Column:
    """Samples after resampling: n * target / rate, rounded down."""
    return F.floor(n * target / rate)


def resampled(signal: DataFrame, keys: list[str], value: str, rate: int, target: int, radius: int = 16, idx: str = "idx") -> DataFrame:
    """Windowed-sinc resampling: keys, idx, value. Each output sample weighs the input samples within `radius` periods of the lower rate; the output has n * target / rate samples."""
    ratio = target / rate
    cut = min(1.0, ratio)
    reach = int(np.ceil(radius / cut))
    last = signal.groupBy(*keys).agg(resampled_count(F.max(idx) + 1, rate, target).alias("_n"))
    i = F.col(idx)
    outs = F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((i - reach) * ratio)), F.greatest(F.lit(0).cast("long"), F.floor((i + reach) * ratio)))
    each = signal.select(*keys, i.alias("_i"), F.col(value).cast("double").alias("_v"), F.explode(outs).alias(idx))
    u = F.col(idx) / ratio - F.col("_i")
    x = np.pi * cut * u
    weight = F.when(F.abs(u) < 1e-12, 1.0).otherwise(F.sin(x) / x) * (0.5 + 0.5 * F.cos(np.pi * u / reach))
    each = each.withColumn("_w", F.when(F.abs(u) <= reach, weight).otherwise(0.0))
    out = each.groupBy(*keys, idx).agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"))
    return out.join(last, keys).where(F.col(idx) < F.col("_n")).select(*keys, idx, F.coalesce(F.try_divide("_s", "_t"), F.lit(0.0)).alias(value))
