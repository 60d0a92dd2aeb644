"""What several corpus operators share: the shared folder, materialised tables, Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column | str) -> Column:
    """A-Z in lower case and nothing else, unlike lower()."""
    return F.translate(c if isinstance(c, Column) else F.col(c), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one JVM."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared_"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


#: Shuffle files of a finished write go at once, not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if _made:
        _made[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage, survives lost executors. drop() removes it early."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with _clean_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._path)


#: Paths of the tables that are made within settled().
_made: list[list[str]] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result as a table; all other tables that it made in the shared folder are removed."""
    _made.append([])
    try:
        out = make()
        paths = list(_made[-1])
        _made[-1] = []
        table = materialise(out, name)
        for path in paths:
            _remove(table.sparkSession, path)
    finally:
        _made.pop()
    return table


#: The column that tells rows apart whose ids are null or repeated.
ROW = "_row"


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, `_row`, written once into the shared folder so that a row has the same key whenever it is read."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows", "zstd")


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column, mod: int, rest: int) -> Column:
    """crc32(key as text) mod `mod` = `rest`; a null key is in no fold."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


# --- Arrow text columns -----------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and len+1 offsets into them, without a copy. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free back to the system: Python workers stay for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Bytes from which glibc maps an array of its own, which goes back to the system when it is freed; by itself it raises this up to 32 MB.
MAPPED_BYTES = 4 << 20


def map_large() -> None:
    """Keep glibc's limit for arrays that are mapped on their own at MAPPED_BYTES."""
    try:
        ctypes.CDLL(None).mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(work, schema), whose tasks give free memory back when work has ended and its arrays are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large()
        yield from work(batches)
        release()

    return df.mapInArrow(run, schema)


#: What a Python worker keeps from task to task: one thing, such as a tokenizer's tables.
_held: dict[str, object] = {}


def hold(key: str, make: Callable[[], object]) -> object:
    """make()'s result, kept for the worker's next tasks until another operator's task comes."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    if _held:
        _held.clear()
        gc.collect()
        release()


def row_blocks(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes of text each; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(text)))[1])
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(docs: DataFrame, keep: list[str], block: Callable[[], Callable[[pa.Array], dict]], schema: str, block_bytes: int, holds: bool = False) -> DataFrame:
    """The columns named in keep, and those that block()(texts) makes of each block of at most block_bytes of text.

    block() is called once in each task; holds: it uses hold(). Other columns of docs are dropped, so clashing names do no harm.
    """
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large()
        if not holds:
            forget()
        make = block()
        for whole in batches:
            for b in row_blocks(whole, "_text", block_bytes):
                made = make(b.column(len(names)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *[x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]], names=[*names, *made])
        if not holds:
            make = whole = b = made = None  # block()'s tables, which may refer to one another
            gc.collect()
        release()

    kept = "".join(f"_k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rows.mapInArrow(run, kept + schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
