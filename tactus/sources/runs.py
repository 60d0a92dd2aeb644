"""Training histories and model registries: JSON files of more than one shape, read as VARIANT.

A file is one value; what lies in it is looked up by path, so a field that is missing, of another type, or one level deeper in some files needs no schema of its own. A file that can't be
read gives an error row, not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.sources.materialise import cut

RUN_FIELDS = ["file", "finished", "place", "epoch", "loss", "dataset", "source", "improvement", "examples", "group", "mean", "error"]
#: Name of the only data set of histories that name none.
ONLY = "val"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of JSON files under a folder, or of one file; content is the text."""
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")).where(F.lower("file").endswith(".json"))


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def run_history(files: DataFrame) -> DataFrame:
    """A row for each file, epoch, data set and source (RUN_FIELDS); of files that can't be read one with `error`.

    A history's epochs have their scores under `validation`, by data set, or carry those of a single one, named ONLY. Sources without a number of examples have one. An empty history gives
    no row; a file that is no JSON, or has no history, gives an error row. An epoch without scores of sources gives no row.
    """
    v = files.select("file", "content", F.try_parse_json("content").alias("v"))
    history = _get("v", "$.history", "array<variant>")
    error = F.when(F.col("v").isNull(), "not JSON").when(history.isNull(), "no history")
    v = v.select("file", _get("v", "$.finished", "boolean").alias("finished"), history.alias("history"), error.alias("error"))
    epochs = v.where("error is null").select("file", "finished", F.posexplode("history").alias("place", "h"))
    nested = _get("h", "$.validation", "map<string,variant>")
    epochs = epochs.select("file", "finished", "place", _get("h", "$.epoch", "int").alias("epoch"), _get("h", "$.train_loss", "double").alias("loss"), F.explode(F.coalesce(nested, F.create_map(F.lit(ONLY), F.col("h")))).alias("dataset", "d"))
    scored = epochs.select(
        "file", "finished", "place", "epoch", "loss", "dataset", _get("d", "$.group.si_sdr_improvement", "double").alias("group"), _get("d", "$.mean_si_sdr_improvement", "double").alias("mean"),
        _get("d", "$.examples", "map<string,double>").alias("n"), F.explode(_get("d", "$.si_sdr_improvement", "map<string,double>")).alias("source", "improvement"),
    )
    rows = scored.withColumn("examples", F.coalesce(F.col("n")[F.col("source")], F.lit(1.0))).withColumn("error", F.lit(None).cast("string")).select(*RUN_FIELDS)
    bad = v.where("error is not null").select("file", "finished", "error")
    return rows.unionByName(bad, allowMissingColumns=True).select(*RUN_FIELDS)


def last_epochs(rows: DataFrame, last: int = 3) -> DataFrame:
    """The mean of each run's last epochs: file, epochs, dataset, source, improvement, examples (the least), mean, group (if all of them have it)."""
    good = rows.where("error is null and place is not null")
    n = good.groupBy("file").agg((F.max("place") + 1).alias("epochs"))
    tail = good.join(n, "file").where(F.col("place") >= F.col("epochs") - last)
    group = F.when(F.count("group") == F.count("*"), F.avg("group"))
    return tail.groupBy("file", "epochs", "dataset", "source").agg(F.avg("improvement").alias("improvement"), F.min("examples").alias("examples"), F.avg("mean").alias("mean"), group.alias("group"))


def registry(files: DataFrame) -> DataFrame:
    """The models of registry files, in their order: file, place, name, version, url, sha256, size_bytes, license_id, license_text_url, license_note, error.

    A file that is no JSON or has no list of models, and a model without one of the first six, give an error instead.
    """
    v = files.select("file", F.try_parse_json("content").alias("v"))
    models = _get("v", "$.models", "array<variant>")
    error = F.when(F.col("v").isNull(), "not JSON").when(models.isNull(), "no models")
    v = v.select("file", models.alias("models"), error.alias("error"))
    each = v.select("file", "error", F.posexplode_outer("models").alias("place", "m")).where("m is not null or error is not null")
    need = {"name": "string", "version": "string", "url": "string", "sha256": "string", "size_bytes": "long", "license_id": "string"}
    out = each.select("file", "place", *[_get("m", f"$.{c}", k).alias(c) for c, k in {**need, "license_text_url": "string", "license_note": "string"}.items()], "error")
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in need]))
    return out.withColumn("error", F.coalesce("error", F.when(F.size(lacks) > 0, F.concat(F.lit("no "), F.array_join(lacks, ", ")))))


def model_named(models: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Every row of names with the first model of that name, or nulls."""
    good = models.where("error is null")
    first = good.groupBy("name").agg(F.min_by(F.struct(*[c for c in good.columns if c not in ("name", "error")]), F.struct("file", "place")).alias("model"))
    return names.join(cut(first, "models").withColumnRenamed("name", name), name, "left")
