"""The pipeline's stages and run() on rows with null and repeated ids."""

import random

import pytest

import corpus_pipeline
from tactus.llm.bpe import load_codec
from tactus.llm.queries import tokenizer_path
from tests.llm.test_jaccard import brute
from tests.llm.test_operators import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(31)
VOCAB = ["river", "stone", "quiet", "garden", "letter", "window", "morning", "yellow", "bread", "paper", "winter", "music"]


def fine():
    return "\n".join(" ".join(R.choice(VOCAB) for _ in range(9)) + "." for _ in range(6))


def near(text):
    return text[:-1] + " again."


def junk():
    return "\n".join("$$$ ### " * 4 + R.choice(["BUY!!!", "WIN!!!", "NOW!!!"]) for _ in range(4))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS).repartition(3)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of documents, labels and benchmark, the documents as (doc_id, text) and the items."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, fine() if i % 2 else junk()) for i in range(120)]
    a, b, c, d, e = (fine() for _ in range(5))
    passage = fine()
    rows += [(None, a)] * 3 + [(None, near(b)), (200, b)]
    rows += [(201, c), (201, near(b)), (201, junk()), (201, fine() + "\n" + passage), (None, d + "\n" + passage), (None, e), (None, junk())]
    rows += [(202, fine())] * 2 + [(1, fine()), (None, None), (None, "123"), (203, "")]
    items = [("i1", passage), (None, None)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(2, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def is_junk(text):
    return "$$$" in (text or "")


def test_quality_judges_rows(spark, folder):
    path, rows, _ = folder
    got = pairs(corpus_pipeline.quality(spark, frame(spark, rows), path))
    want = [x for x in rows if not is_junk(x[1])]
    letters = lambda xs: sorted((x for x in xs if x[1] and any(c.isalpha() for c in x[1])), key=str)
    assert letters(got) == letters(want)


def test_language_judges_rows(spark, folder):
    path, rows, _ = folder
    assert pairs(corpus_pipeline.language(spark, frame(spark, rows), path)) == sorted((x for x in rows if any(c.isalpha() for c in x[1] or "")), key=str)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d, e, f, g = (fine() for _ in range(7))
    stay = [(5, b), (7, c), (7, d), (8, e), (2, f), (9, g), (None, None), (None, "")]
    go = [(None, near(b)), (8, near(f)), (9, g), (9, near(g))]
    rows = stay + go + [(None, a)] * 3 + [(10, None), (10, " ")]
    got = pairs(corpus_pipeline.near_duplicates(spark, frame(spark, rows), ""))
    blank = [x for x in got if x[0] == 10]
    assert len(blank) == 1 and blank[0][1] in (None, " ")
    assert [x for x in got if x[0] != 10] in (sorted([*stay, (None, a)], key=str), sorted([*stay[:5], (9, near(g)), *stay[6:], (None, a)], key=str))


def test_decontamination_of_null_and_repeated_ids(spark, folder):
    path, _, items = folder
    dirty = items[0][1]
    stay = [(None, fine()), (None, None), (4, fine()), (6, fine()), (6, "")]
    rows = [*stay, (None, dirty), (4, "so " + dirty), (5, dirty), (5, dirty)]
    assert pairs(corpus_pipeline.decontamination(spark, frame(spark, rows), path)) == sorted(stay, key=str)


def test_tokens_of_every_row(spark):
    rows = [(None, "one text"), (None, "other text"), (3, "same id"), (3, "another"), (3, None)]
    codec = load_codec(tokenizer_path())
    got = corpus_pipeline.tokens(spark, frame(spark, rows), "").collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(i), list(codec.encode(t or ""))) for i, t in rows)


def test_run_against_brute_force(spark, folder):
    path, rows, items = folder
    left = [x for x in rows if any(c.isalpha() for c in x[1] or "") and not is_junk(x[1])]
    component = brute([(k, t) for k, (_, t) in enumerate(left)], 5, 80)
    groups = {}
    for k, (i, t) in enumerate(left):
        groups.setdefault(component[k][1], []).append((i is None, i or 0, t))
    grams = lambda t: {tuple(words(t)[p : p + 10]) for p in range(len(words(t)) - 9)}
    want = [(None if none else i, t) for none, i, t in map(min, groups.values()) if not grams(t) & grams(items[0][1])]
    assert len(want) < len(left)
    codec = load_codec(tokenizer_path())
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(i), list(codec.encode(t))) for i, t in want)
