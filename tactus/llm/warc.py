"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record, chunk, chunks, head, body, ...): concatenating head and body
of an archive's rows in the order of record and chunk gives a WARC/1.1 byte stream. A record's first row carries its WARC head; a
payload above `chunk_bytes` continues in further rows, each with the SHA-1 of its own bytes and of all payload bytes so far, so a
reader checks every chunk as it passes and never holds a whole record. Payloads equal to an earlier one are
`revisit` records, which carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import new_table_path, row_blocks, text_bytes

#: Payload bytes of one row.
CHUNK_BYTES = 1 << 20
#: Payloads below this size are never stored as revisits.
REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows handed to Arrow at once hold at most so many payload bytes, or one row.
BLOCK_BYTES = 4 << 20

DIGEST_SCHEMA = "page_id long, payload_bytes long, sha1 binary, sha256 binary"
ARCHIVE_SCHEMA = "archive int, record long, chunk int, chunks int, head binary, body binary, chunk_sha1 binary, sha1_so_far binary"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_chunks int, sound boolean"


def bare_base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = text_bytes(b.column("html"))
        views = [data[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": b.column("page_id"),
                "payload_bytes": np.diff(at),
                "sha1": pa.array([hashlib.sha1(v).digest() for v in views], pa.binary()),
                "sha256": pa.array([hashlib.sha256(v).digest() for v in views], pa.binary()),
            }
        )


def payload_digests(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_digests, DIGEST_SCHEMA)


def _clean(value: str | None) -> str:
    return "" if value is None else "".join(c for c in value if c >= " " and c != "\x7f")


def _head(kind: str, page: int | None, url: str | None, digest: bytes, size: int, refers: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}" if url is not None else None,
        f"WARC-Payload-Digest: sha1:{bare_base32(digest)}",
        f"WARC-Payload-Length: {size}",
        f"WARC-Profile: {PROFILE}" if kind == "revisit" else None,
        f"WARC-Refers-To: <urn:page:{refers}>" if kind == "revisit" else None,
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {size if kind == 'response' else 0}",
    ]
    return ("\r\n".join(x for x in lines if x is not None) + "\r\n\r\n").encode("utf-8", "replace")


def _writer(chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, name = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in row_blocks(whole, "html", BLOCK_BYTES):
                data, at = text_bytes(b.column("html"))
                ids, urls = b.column("page_id").to_pylist(), b.column("url").to_pylist()
                sha1, refers = b.column("sha1").to_pylist(), b.column("refers_to").to_pylist()
                out: list[tuple] = []
                held = 0
                for i, (page, url, digest, to) in enumerate(zip(ids, urls, sha1, refers, strict=True)):
                    s, e = int(at[i]), int(at[i + 1])
                    kind = "response" if to is None else "revisit"
                    head = _head(kind, page, url, digest, e - s, to)
                    name += 1  # a record's number in its archive
                    if kind == "revisit" or e == s:
                        out.append((archive, name, 0, 1, head, b"\r\n\r\n", None, None))
                        continue
                    starts = range(s, e, chunk_bytes)
                    so_far = hashlib.sha1()
                    for k, c in enumerate(starts):
                        body = data[c : min(c + chunk_bytes, e)]
                        so_far.update(body)
                        last = k == len(starts) - 1
                        own = hashlib.sha1(body).digest() if len(starts) > 1 else so_far.digest()
                        out.append((archive, name, k, len(starts), head if not k else b"", body.tobytes() + b"\r\n\r\n" * last, own, so_far.digest()))
                        held += len(body)
                        if held >= BLOCK_BYTES:  # a long payload leaves in pieces
                            yield _rows(out, _ARCHIVE)
                            out, held = [], 0
                if out:
                    yield _rows(out, _ARCHIVE)

    return write


_ARCHIVE = pa.schema(
    [
        ("archive", pa.int32()),
        ("record", pa.int64()),
        ("chunk", pa.int32()),
        ("chunks", pa.int32()),
        ("head", pa.binary()),
        ("body", pa.binary()),
        ("chunk_sha1", pa.binary()),
        ("sha1_so_far", pa.binary()),
    ]
)
_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("n_chunks", pa.int32()),
        ("sound", pa.bool_()),
    ]
)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write one WARC record per row of pages (page_id, url, html) into the archive table at `path`.

    Of rows with equal payloads of at least revisit_bytes, the one with the largest page_id is the response and the
    others revisit it (rows with null page_id, if any, revisit too). Rows that repeat the response's page_id and payload are
    responses as well. Null html is an empty payload. An empty table writes an empty archive. Extra columns are ignored.
    """
    digests = payload_digests(pages)
    key = ["payload_bytes", "sha1", "sha256"]
    copies = digests.where(F.col("payload_bytes") >= revisit_bytes).groupBy(*key).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = (
        digests.join(copies, key)
        .where("page_id is null or page_id <> first")
        .select(F.col("page_id").alias("rid"), F.col("sha1").alias("rsha1"), F.col("first").alias("refers_to"))
        .distinct()
    )
    full = pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html"), F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).alias("sha1"))
    records = full.join(revisits, F.expr("page_id <=> rid and sha1 = rsha1"), "left").select("page_id", "url", "html", "sha1", "refers_to")
    records.mapInArrow(_writer(chunk_bytes), ARCHIVE_SCHEMA).write.option("compression", "zstd").parquet(path)


def parse_head(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"no WARC record starts with {first[:20]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of record and chunk; keeps one running digest, not the payload."""
    state: dict = {}
    for b in batches:
        out = []
        cols = [b.column(c) for c in ("record", "chunk", "chunks", "head", "body", "chunk_sha1", "sha1_so_far")]
        for i in range(b.num_rows):
            name, k, n, raw, body, own, so_far = (c[i] for c in cols)
            k, n = k.as_py(), n.as_py()
            if not k:
                state = {"head": parse_head(raw.as_py()), "sha1": hashlib.sha1(), "size": 0, "next": 0, "sound": True}
            view = memoryview(body.as_buffer())
            if k == n - 1:
                state["sound"] &= bytes(view[-4:]) == b"\r\n\r\n"
                view = view[:-4]
            state["sha1"].update(view)
            state["size"] += len(view)
            state["sound"] &= k == state["next"] and (so_far.as_py() is None or so_far.as_py() == state["sha1"].digest())
            state["next"] = k + 1
            if k < n - 1:
                continue
            h, digest = state["head"], bare_base32(state["sha1"].digest())
            kind = h["warc-type"]
            named, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["warc-payload-length"])
            sound = state["sound"] and state["size"] == int(h["content-length"]) and (kind == "revisit" or (digest == named and size == state["size"]))
            out.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), size, named, kind, _page(h.get("warc-refers-to")), n, sound))
        if out:
            yield _rows(out, _RECORD)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archive table: its fields, its number of chunks, and whether every digest and length held.

    Records of one chunk are read where they lie. Only the chunks of oversized records are brought together and
    sorted, and pass one by one through a running digest.
    """
    rows = spark.read.schema(ARCHIVE_SCHEMA).parquet(path)
    small = rows.where("chunks = 1").mapInArrow(_reader, RECORD_SCHEMA)
    large = rows.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk").mapInArrow(_reader, RECORD_SCHEMA)
    return small.unionAll(large)


def warc_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the archives of pages into the shared folder and read them back; see write_archives and read_archives."""
    path = new_table_path(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_bytes, revisit_bytes)
    return read_archives(pages.sparkSession, path)
