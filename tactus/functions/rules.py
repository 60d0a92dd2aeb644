"""Predicates and rules on labels, names and tempos, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of stems by their file names; the first rule that fits holds.
STEM_RULES = (("Bass", "start", "bass"), ("Drums", "part", "drum"), ("Guitar", "part", "guit"), ("Piano", "start", "piano"), ("Organ", "start", "organ"), ("Vocals", "start", "voc"))


def half_open(t: Column, lo: Column | float, hi: Column | float) -> Column:
    return (t >= lo) & (t < hi)


def two_channels(frames: Column) -> Column:
    """Frames of one channel get it twice; others stay."""
    return F.transform(frames, lambda x: F.when(F.size(x) == 1, F.concat(x, x)).otherwise(x))


def known_target(label: Column, ambiguous: Column, exact: Sequence[str]) -> Column:
    """Whether a class's target is known: while an ambiguous part sounds, only that of the exact classes is."""
    return F.when(ambiguous, label.isin(*exact)).otherwise(True)


def checked_label(label: Column, allowed: Sequence[str]) -> Column:
    """label, which must be null or one of allowed, in the same spelling."""
    bad = F.raise_error(F.concat(F.lit("unknown label "), label, F.lit("; use one of " + ", ".join(allowed)))).cast("string")
    return F.when(label.isNull() | label.isin(*allowed), label).otherwise(bad)


def candidate(score: Column, least: float = 0.05) -> Column:
    return score >= least


def usable_tempo(bpm: Column, lo: float, hi: float) -> Column:
    """Positive, finite and within [lo, hi]; null is not."""
    return F.coalesce((bpm > 0) & ~F.isnan(bpm) & (bpm < float("inf")) & bpm.between(lo, hi), F.lit(False))


def class_by_name(name: Column, rules: Sequence[tuple[str, str, str]] = STEM_RULES) -> Column:
    """The class of the first rule (class, start or part, text) that the lower-cased name fits, else null."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for label, how, text in reversed(rules):
        out = F.when(low.startswith(text) if how == "start" else low.contains(text), label).otherwise(out)
    return out


def missing_by_name(name: Column, parts: Column) -> Column:
    """The parts that a mix lacks by its name ("mix_no_keys"): those with the first four letters of the word after "no"; null if none."""
    word = F.regexp_extract(F.lower(name), r"(?:^|[_ ])no[_ ]([a-z]+)", 1)
    found = F.filter(parts, lambda p: F.lower(p).contains(F.substring(word, 1, 4)))
    return F.when((word != "") & (F.size(found) > 0), found)


def single_source(states: Column) -> Column:
    """Of an array of (name, state) the one name whose state is present if all others are absent, else null."""
    present = F.filter(states, lambda s: s["state"] == "present")
    clear = F.forall(states, lambda s: s["state"].isin("present", "absent"))
    return F.when((F.size(present) == 1) & clear, F.get(present, F.lit(0))["name"])


def with_settings(df: DataFrame, **settings: Sequence) -> DataFrame:
    """Every row with every combination of settings, a fixed grid of literals that is exploded, not joined."""
    for name, values in settings.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def comparison_line(fields: Sequence[Column], failed: Column, sep: str = "|") -> Column:
    """Fields joined by a separator; of a failed row the first, then ERROR."""
    text = [f.cast("string") for f in fields]
    return F.when(failed, F.concat_ws(sep, text[0], F.lit("ERROR"))).otherwise(F.concat_ws(sep, *[F.coalesce(t, F.lit("")) for t in text]))
