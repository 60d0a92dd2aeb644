"""Beats of songs in seven formats, and a sink that writes a file for each row, all of them or none.

Contents are made by column expressions; the sink only puts bytes where they belong. Tasks write beside the folder's files under names of the run; the driver moves them in place when all tasks have
ended well, and removes them when one has not. A file that is there already is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

EXTENSIONS = {"table": "txt", "jams": "jams", "lab": "lab", "audacity": "txt", "csv": "csv", "midi": "mid", "json": "json"}


def _lines(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("\n"))), "")


def render_beats(songs: DataFrame, form: str, name: str = "name") -> DataFrame:
    """(name with the format's extension, content) of songs: name, duration, median_bpm, stability, beats_per_bar, meter_confidence, beats, confidence, downbeats (places of beats), candidates (bpm, confidence).

    Intervals run from beat to beat, so a song of one beat has none; null lists are empty. A tempo that isn't above 0 can't be written as midi: an error.
    """
    if form not in EXTENSIONS:
        raise ValueError(f"no format named {form!r}")
    empty = F.array().cast("array<double>")
    beats, sure = F.coalesce("beats", empty), F.coalesce("confidence", empty)
    downs = F.coalesce("downbeats", F.array().cast("array<int>"))
    nth = F.sequence(F.lit(0), F.size(beats) - 2)
    intervals = F.when(F.size(beats) > 1, F.transform(nth, lambda i: F.struct(F.get(beats, i).alias("a"), F.get(beats, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    labels = lambda sep: _lines(F.transform(intervals, lambda x: F.format_string(f"%.6f{sep}%.6f{sep}beat", x["a"], x["b"])))
    if form == "table":
        shown = F.coalesce("candidates", F.array().cast("array<struct<bpm:double,confidence:double>>"))
        head = [
            F.format_string("duration:   %.3fs", "duration"), F.format_string("tempo:      %.2f bpm (%s)", "median_bpm", "stability"), F.format_string("meter:      %d/4 (confidence %.2f)", F.col("beats_per_bar").cast("int"), F.col("meter_confidence").cast("double")),
            F.format_string("beats:      %d", F.size(beats)), F.format_string("downbeats:  %d", F.size(downs)), F.lit("candidates:"),
        ]
        text = _lines(F.concat(F.array(*head), F.transform(shown, lambda x: F.format_string("  %.2f bpm  conf=%.3f", x["bpm"], x["confidence"]))))
    elif form == "jams":
        data = F.transform(beats, lambda t, i: F.struct(t.alias("time"), F.lit(0.0).alias("duration"), F.lit(1).alias("value"), F.get(sure, i).alias("confidence")))
        text = F.to_json(F.struct(F.struct(F.col("duration"), F.lit("0.3.0").alias("jams_version")).alias("file_metadata"), F.array(F.struct(F.lit("beat").alias("namespace"), data.alias("data"))).alias("annotations")), {"ignoreNullFields": "false", "pretty": "true"})
    elif form in ("lab", "audacity"):
        text = labels(" " if form == "lab" else "\t")
    elif form == "csv":
        text = _lines(F.concat(F.array(F.lit("beat_seconds")), F.transform(beats, lambda t: F.format_string("%.6f", t))))
    elif form == "json":
        text = F.to_json(F.struct(*[F.col(c) for c in songs.columns if c != name]), {"ignoreNullFields": "false"})
    else:
        bpm = F.col("median_bpm").cast("double")
        micros = F.least(F.lit((1 << 24) - 1), F.greatest(F.lit(1), F.round(60_000_000.0 / bpm))).cast("long")
        bad = F.raise_error(F.concat(F.col(name), F.lit(": no tempo above 0"))).cast("string")
        code = F.concat(F.lit("4D546864000000060000000101E04D54726B0000000B00FF5103"), F.lpad(F.hex(micros), 6, "0"), F.lit("00FF2F00"))
        return songs.select(F.concat(name, F.lit(".mid")).alias("name"), F.unhex(F.when((bpm > 0) & ~F.isnan(bpm), code).otherwise(bad)).alias("content"))
    return songs.select(F.concat(name, F.lit("." + EXTENSIONS[form])).alias("name"), text.cast("binary").alias("content"))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Files(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _beside(self, base: str) -> str:
        return f"{base}/_writing-{self.run}"

    def write(self, batches: Iterator) -> _Written:
        from pyspark import TaskContext

        fs, base = self._fs()
        attempt = TaskContext.get().taskAttemptId()
        folder = f"{self._beside(base)}/{attempt}"
        fs.create_dir(folder, recursive=False)  # an error once abort() has removed the run's folder
        made = []
        for b in batches:
            for name, content in zip(b["name"].to_pylist(), b["content"], strict=True):
                if not name or name.startswith((".", "_")) or "/" in name:
                    raise ValueError(f"no name for a file: {name!r}")
                own = f"{folder}/{len(made)}"
                with fs.open_output_stream(own) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                made.append((own, name))
        return _Written(made)

    def commit(self, messages: list) -> None:
        fs, base = self._fs()
        names = [name for m in messages if m for _, name in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for m in messages:
            for own, name in m.files if m else ():
                fs.move(own, f"{base}/{name}")
        fs.delete_dir(self._beside(base))

    def abort(self, messages: list) -> None:
        from pyarrow import fs as kinds

        fs, base = self._fs()
        if fs.get_file_info(self._beside(base)).type != kinds.FileType.NotFound:
            fs.delete_dir(self._beside(base))


class FilesSink(DataSource):
    """format("named_files"): a row's `content` becomes the file `name` in the folder."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Files:
        out = _Files(self.options["path"])
        fs, base = out._fs()
        fs.create_dir(out._beside(base))
        return out


def write_beats(songs: DataFrame, path: str, form: str, name: str = "name") -> None:
    """A file for each song in a folder that all executors reach, by any file system that Arrow knows; a failed task leaves none."""
    spark: SparkSession = songs.sparkSession
    spark.dataSource.register(FilesSink)
    render_beats(songs, form, name).write.format("named_files").mode("append").save(path)
