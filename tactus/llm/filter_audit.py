"""Filter interaction audit: what each of five filters removes, in every order in which they may be applied.

A document fails a filter or passes it whatever the order, so one table of counts answers for all orders: the counts of documents
that pass all filters of a subset. SQL's CUBE over the five failure flags and the part gives a row for each set of columns and their values;
the rows in which every selected flag is false are the survivors of that subset. A step of an order is a pair of subsets, before and
after its filter.

Rows and values:
  * null texts are empty: no words, no characters; they fail A and, if a smaller doc_id has an empty or null text too, E;
  * a doc_id is compared with the ids of equal texts: a null doc_id is neither smaller nor larger than another, so such a row never
    fails E and makes no other row fail; rows that repeat an id and its text don't make each other fail;
  * a label counts if any row of labels says so; null and unknown doc_ids have none;
  * null parts are the part ''; an empty table has no part and gives no rows; other columns are ignored;
  * texts are read whole, however long: a text's words and their distinct ones are an array of that text alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import map_texts, materialise, text_bytes
from tactus.llm.words import find_words, hash_words

#: The filters' letters; the last compares with other rows, the others look at a text alone.
FILTERS = "ABCDE"
#: Texts of a task are looked at in blocks of so many bytes.
BLOCK_BYTES = 4 << 20


def text_failures(least_words: int = 50, distinct_percent: int = 65, capitals_percent: int = 5, symbols: bytes = b"#$%&*|") -> Callable[[pa.Array], dict]:
    """Of a block of texts: failure flags of A to D (few words, few distinct words, many capitals, any of the symbols) and the SHA-256 of each text.

    Distinct words are told by 64-bit hashes within one text.
    """
    marks = np.zeros((3, 256), np.int64)
    marks[0, 0x41:0x5B] = 1  # A-Z
    marks[1, list(symbols)] = 1
    marks[2, :0x80] = marks[2, 0xC0:] = 1  # first bytes of code points

    def block(texts: pa.Array) -> dict:
        data, at = text_bytes(texts)
        n = len(at) - 1
        doc, first, end = find_words(data, at, "space")
        h = hash_words(data, first, end, lower=False)
        order = np.lexsort((h, doc))
        d, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        words, distinct = np.bincount(doc, minlength=n), np.bincount(d[new], minlength=n)
        capitals, found, points = (np.diff(np.concatenate([[0], np.cumsum(m[data])])[at]) for m in marks)
        raw = memoryview(data)
        digests = pa.array([hashlib.sha256(raw[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        return {"A": words < least_words, "B": 100 * distinct < distinct_percent * words, "C": 100 * capitals > capitals_percent * points, "D": found > 0, "digest": digests}

    return block


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic of every document.

    The first document of each text is found by a digest, with a minimum before the shuffle; rows meet it and the labels by their own id, so a text with
    any number of copies is no hot key. Rows without an id are spread by a number of their own, which nothing matches.
    """
    known = F.col("doc_id").isNotNull()
    slim = docs.select(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()).alias("id"), known.alias("known"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = map_texts(slim, ["id", "known", "part"], text_failures, "A boolean, B boolean, C boolean, D boolean, digest binary", BLOCK_BYTES)
    rows = materialise(rows, "flags")
    firsts = rows.where("known").groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(True).alias("known"), F.lit(True).alias("first"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    out = rows.join(firsts, ["id", "known", "digest"], "left").join(marks.withColumn("known", F.lit(True)), ["id", "known"], "left")
    return out.select("part", *FILTERS[:4], (F.col("known") & F.col("first").isNull()).alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(flags: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i applied), n, good, toxic: documents that pass every filter of the subset; subsets without survivors have no row."""
    counts = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")])
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"_{f}") for f in FILTERS])
    passed = " and ".join(f"(_{f} = 1 or not {f})" for f in FILTERS)
    subset = sum(((1 - F.col(f"_{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return cube.where(f"whole = 0 and {passed}").select("part", subset.alias("subset"), "n", "good", "toxic")


def _steps() -> Column:
    """All orders' steps as one array: order, step, filter, the subsets before and after, and the subset of all other filters."""
    every = (1 << len(FILTERS)) - 1
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append({"filter_order": "".join(order), "step": k + 1, "filter": f, "before": before, "after": before | bit, "others": every ^ bit})
            before |= bit
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order string, step int, filter string, before int, after int, others int>>")


def audit(flags: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    flags: part, A to E, good, toxic. All tables after survivors() have 32 or 600 rows for a part.
    """
    found = materialise(survivors(flags), "survivors")
    pairs = found.where("subset = 0").select("part", F.inline(_steps()))
    pairs = pairs.withColumns({"alone": F.col("before").bitwiseXOR(F.col("after")), "none": F.lit(0), "every": F.lit((1 << len(FILTERS)) - 1)})
    for name in ("before", "after", "alone", "none", "others", "every"):
        side = found.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "good", "toxic")])
        pairs = pairs.join(side, ["part", name], "left")
    of = lambda what, name: F.coalesce(F.col(f"{what}_{name}"), F.lit(0).cast("long"))
    removed = of("n", "before") - of("n", "after")
    rows = pairs.select(
        "part", "filter_order", "step", "filter", of("n", "after").alias("kept"), removed.alias("removed"), (of("n", "none") - of("n", "alone") - removed).alias("redundant"),
        (of("n", "others") - of("n", "every")).alias("unique_fails"), *[(of(c, "before") - of(c, "after")).alias(f"{c}_lost") for c in ("good", "toxic")],
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # 120 rows each
