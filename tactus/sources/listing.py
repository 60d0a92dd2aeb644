"""Listings of sound files: names and lengths alone, no content.

The binary file source lists folders by its own means; as only paths and lengths are asked for, no file is opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of sound files.
SOUND_FILES = ["wav", "flac", "mp3", "m4a", "aac", "ogg", "opus", "wv", "alac"]


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes) of all files under folders, and of files that are named."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def extension(file: str = "file"):
    """What stands behind the last dot of the name, in lower case; '' without one, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(file, r"[^/.][^/]*\.([^./]+)$", 1))


def sound_files(spark: SparkSession, paths: list[str], extensions: list[str] | None = None) -> DataFrame:
    """(file, bytes): files with one of the extensions, in any case, under the paths that are folders, and every path that is a file, whatever its name."""
    kinds = extensions or SOUND_FILES
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def is_file(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).getFileStatus(p).isFile()

    named = [p for p in paths if is_file(p)]  # one look at each path given, none at what lies below
    folders = [p for p in paths if p not in named]
    parts = [list_files(spark, *folders).where(extension().isin(kinds))] if folders else []
    parts += [list_files(spark, *named)] if named else []
    if not parts:
        return spark.createDataFrame([], "file string, bytes long")
    return reduce(DataFrame.unionAll, parts).distinct()


def song_stems(files: DataFrame, stems: DataFrame, root: str) -> DataFrame:
    """(song, stem, file, score, length_file) of rendered stems whose sound file exists; score: whether the stem's notes exist too.

    files: (file, bytes) below root, as <song>/stems/<stem>.flac, <song>/MIDI/<stem>.mid and <song>/mix.flac. stems: (song, stem, rendered) from the songs' descriptions. length_file: the song's mix, else its first
    stem by name. Companions are looked up by semi joins on names; a song without any stem that can be used gives no row.
    """
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/*", "/")
    path = F.regexp_replace("file", r"^file:/*", "/")
    rel = files.where(F.startswith(path, base)).select("file", F.split(F.substr(path, F.length(base) + 1), "/").alias("at"))
    part = lambda k: F.get("at", F.lit(k))
    name = lambda ext: F.regexp_extract(part(2), rf"^(.*)\.{ext}$", 1)
    sounds = rel.where((F.size("at") == 3) & (part(1) == "stems") & part(2).endswith(".flac")).select(part(0).alias("song"), name("flac").alias("stem"), "file")
    notes = rel.where((F.size("at") == 3) & (part(1) == "MIDI") & part(2).endswith(".mid")).select(part(0).alias("song"), name("mid").alias("stem"), F.lit(True).alias("score"))
    mixes = rel.where((F.size("at") == 2) & (part(1) == "mix.flac")).select(part(0).alias("song"), F.col("file").alias("_mix"))
    usable = stems.where("rendered").select("song", "stem").join(sounds, ["song", "stem"]).join(notes, ["song", "stem"], "left")
    first = usable.groupBy("song").agg(F.min_by("file", "stem").alias("_first"))
    out = usable.join(first, "song").join(mixes, "song", "left")
    return out.select("song", "stem", "file", F.coalesce("score", F.lit(False)).alias("score"), F.coalesce("_mix", "_first").alias("length_file"))
