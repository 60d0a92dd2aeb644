"""The Jaccard join against brute force, with families of near copies larger than a direct group."""

import random
import re

from tactus.llm import jaccard_join as join
from tactus.llm.jaccard_join import jaccard_join


def brute(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, i = [], 0

    def add(words):
        nonlocal i
        rows.append((i, " ".join(words)))
        i += 1

    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(110):  # a family of near copies, some within the threshold of each other
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        add(w)
    passage = [r.choice(vocab) for _ in range(30)]
    for _ in range(90):  # texts that share a passage
        add([r.choice(vocab) for _ in range(r.randint(0, 40))] + passage)
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randint(1, 60))]
        add(w)
        add(w)
        add([*w, "more"])
    for t in (None, "", " \n\t", "one", "ONE", "one two", "One  two", "two one", "a a a a a", "a a a"):
        rows.append((i, t))
        i += 1
    r.shuffle(rows)
    return rows


def check(spark, k, percent):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n", "1 as class").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_words_of_three(spark):
    check(spark, 3, 90)


def test_words_of_five(spark):
    check(spark, 5, 80)


def test_empty_table_and_missing_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(none).collect() == []
    rows = [(None, "a b c d"), (4, "a b c d"), (3, "A b c d"), (None, None)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 2, 3), (4, 2, 3), (3, 2, 3), (None, 0, None)}


def test_classes_of_missing_ids_link(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda *other: " ".join("other" if i in other else w for i, w in enumerate(words))
    # 9 and 4 are too far apart; the row without id is near both
    rows = [(9, text(0)), (None, text()), (4, text(59)), (None, "lone words without an id"), (None, "lone words without an id"), (7, "far from all others")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["class_id"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 96).collect()), key=str)
    assert got == sorted([(9, 58, 9, 4), (None, 58, None, 4), (4, 58, 4, 4), (None, 3, None, None), (None, 3, None, None), (7, 2, 7, 7)], key=str)


def family(seed, size, length=60):
    """Near copies of one text with other words at some places, some of them at the same places, and a second version of it."""
    r = random.Random(seed)
    base = [r.choice(WORDS) for _ in range(length)]
    other = base[:20] + [r.choice(WORDS) for _ in range(6)] + base[26:]
    rows = []
    for i in range(size):
        w = list(base if i % 3 else other)
        for _ in range(r.randint(0, 4)):
            w[r.choice((5, 30, 31, r.randrange(length)))] = r.choice(WORDS[:7])
        rows.append((i, " ".join(w)))
    return rows


WORDS = [f"v{i}" for i in range(800)]


def test_groups_of_any_size_go_through_leaders(spark, monkeypatch):
    monkeypatch.setattr(join, "DIFFERENCE_GROUP", 30)  # so that leaders of leaders' groups are needed
    rows = family(1, 140)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, 3, 80).collect()} == brute(rows, 3, 80)


def test_a_large_family(spark):
    rows = family(3, 700) + [(1000 + i, t) for i, t in family(3, 700)]  # each text twice
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, 3, 90).collect()} == brute(rows, 3, 90)


def test_a_very_long_text_and_repeated_ids(spark):
    r = random.Random(9)
    long = [r.choice(WORDS) for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:299_000])), (2, "one two three four"), (5, "one two three four"), (2, "one two three four")]
    got = sorted((x["doc_id"], x["n_shingles"] > 2, x["component_id"]) for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, True, 1), (2, True, 1), (2, False, 2), (5, False, 2), (2, False, 2)])
