"""The corpus pipeline: quality, language, near duplicates, benchmark decontamination, tokens.

STAGES are (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Each row stays or goes by its own text: an id may be null or
shared by rows with other texts. Texts are judged whole, however long. No stage fails on an empty table, which gives an empty one;
other columns of documents are kept as they are. Null texts are treated as empty: the quality and language stages remove them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.bpe import encode_documents
from tactus.llm.common import ROW, ids_are_keys, materialise, settled, table, with_rows
from tactus.llm.decontaminate import decontaminate
from tactus.llm.jaccard_join import jaccard_join
from tactus.llm.language_id import UNDETERMINED, fit_languages, identify
from tactus.llm.quality_crf import classify, fit_quality
from tactus.llm.queries import tokenizer_path

#: Near duplicates: word shingles of this length, and percent of Jaccard similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Part of the encoder's working tables that a task of the last stage may fill.
BPE_ROOM = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good. The field is trained on the labelled documents among docs."""
    field = fit_quality(docs, table(spark, sf_dir, "labels"))
    return classify(docs, field, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: texts without any letter go."""
    judged = identify(docs, fit_languages(docs), keep=docs.columns)
    return judged.where(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: doc_id if that is one, else a number."""
    return docs.withColumn(ROW, F.col("doc_id")) if ids_are_keys(docs) else with_rows(docs)


def _surplus(keyed: DataFrame) -> DataFrame:
    """Keys of the rows that near_duplicates() removes."""
    joined = jaccard_join(keyed.select(F.col(ROW).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    ids = keyed.select(ROW, F.col("doc_id").alias("id"))
    joined = joined.select(F.col("doc_id").alias(ROW), "n_shingles", "component_id").join(ids, ROW)
    named = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    groups = materialise(joined.select(ROW, "id", F.when(~named, F.col("component_id")).alias("component"), F.when(named, F.col("id")).alias("wordless")), "groups")
    first = groups.groupBy("component", "wordless").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    return groups.join(first.select(f"first.{ROW}"), ROW, "left_anti").select(ROW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, null after all others, and of equal ids one.

    Texts without words are near duplicates of nothing: one stays of those that share a doc_id, and all without a doc_id.
    """
    keyed = _keyed(docs)
    return keyed.join(settled(lambda: _surplus(keyed), "surplus"), ROW, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Items without words, or without text, have no passage."""
    keyed = _keyed(docs)
    texts = keyed.select(F.col(ROW).alias("doc_id"), "text")
    hit = settled(lambda: decontaminate(texts, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(ROW)), "contaminated")
    return keyed.join(hit, ROW, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document. Workers that the stages before started are still there, so none keeps tables while it is idle."""
    return encode_documents(docs, tokenizer_path(), with_ids=True, keep=["doc_id", "lang", "source"], lasting=False, room=BPE_ROOM).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the trained stages nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
