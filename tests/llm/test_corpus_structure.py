"""Filter audit, substring dedup and prefix trie against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tactus.llm import prefix_trie as trie
from tactus.llm import substring_dedup as dedup
from tactus.llm.filter_audit import audit, failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---


def audit_by_orders(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        caps = sum("A" <= c <= "Z" for c in t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * caps > 5 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > least[t]}
        rows.append((source or "", frozenset(k for k in bad if bad[k]), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, sums = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(sums[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_fixture():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(90)] + ["Capital", "NASA", "é", "日本"]
    texts = [None, "", " \n\t", "a#b", "A" * 40, "ÀÉ" * 30, "word " * 40_000, " ".join(vocab)]
    for _ in range(50):
        texts.append(" ".join(r.choice(vocab[: r.choice([20, 94])]) for _ in range(r.choice([3, 49, 50, 51, 120]))) + r.choice(["", "", "|", " $"]))
    docs = [(i, t, r.choice(["a", "b", None, ""])) for i, t in enumerate(texts + texts[20:40])]
    docs += [docs[30], docs[31], (None, texts[22], "a"), (None, None, None), (5, "another text of the same id", "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_against_every_order(spark):
    docs, labels = audit_fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' as part", "1 as n", "true as A", "2 as id").repartition(3)
    got = audit(failures(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = audit_by_orders(docs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got.collect()} == want
    assert got.count() == len(want) == 600 * 3 and dict(got.dtypes)["step"] == "int"


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failures(docs, labels)).count() == 0
    one = audit(failures(spark.createDataFrame([(1, "x", None)], docs.schema), labels)).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


# --- substring dedup ---


def removed_by_windows(rows, k):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for p in range(len(w) - k + 1):
                key = tuple(w[p : p + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and least[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def dedup_fixture(seed, k):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "日本", "it's", "#"]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [some(k + d) for d in (-1, 0, 1, 3 * k)]
    rows = []
    for _ in range(120):
        w = some(r.randint(0, 2 * k))
        for p in r.sample(passages, r.randint(0, 3)):
            cut = r.randint(0, 2)
            w += p[cut:] + some(r.randint(0, 3))
        rows.append(r.choice([" ", "\n", " \t "]).join(w))
    rows += [rows[3], rows[3], "a " * (5 * k), "a " * (3 * k), " ".join(["a", "b"] * 2 * k), " ".join(["a", "b"] * 3 * k), None, "", " \n", "solo", " ".join(some(4000)) + " " + rows[5]]
    ids = r.sample(range(1000), len(rows))
    out = list(zip(ids, rows, strict=True))
    return out


@pytest.mark.parametrize(("window", "large"), [(50, 1000), (8, 1000), (7, 3), (50, 2), (2, 1000)])
def test_repeats_against_all_windows(spark, monkeypatch, window, large):
    monkeypatch.setattr(dedup, "LARGE", large)
    rows = dedup_fixture(window, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n", "2 as anchor", "3 as first").repartition(5)
    got = dedup.remove_repeats(df, window)
    assert sorted(map(tuple, got.collect()), key=repr) == removed_by_windows(rows, window)
    assert sum(r[2] for r in removed_by_windows(rows, window)) > 100


def test_repeats_with_shared_and_missing_ids(spark):
    rows = dedup_fixture(3, 9)
    rows = [(None if i % 5 == 0 else i // 4, t) for i, t in rows]
    rows += rows[:6] + [(None, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dedup.remove_repeats(df, 9).collect()), key=repr) == removed_by_windows(rows, 9)
    assert dedup.remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        dedup.remove_repeats(df, 1)


def test_suffix_array_orders_and_shares():
    r = np.random.default_rng(1)
    for window in (2, 5, 16, 50):
        h = r.integers(0, 3, 400).astype(np.uint64)
        starts = np.arange(len(h) - window + 1)
        order, shared = dedup.suffix_array(h, starts, window)
        rows = [tuple(h[s : s + window].tolist()) for s in starts]
        assert [rows[i] for i in order] == sorted(rows)
        for a, b, n in zip(order[:-1], order[1:], shared[1:], strict=True):
            assert n == next((j for j in range(window) if rows[a][j] != rows[b][j]), window)


# --- prefix trie ---


def trie_by_prefixes(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in who if full[c] == p))).encode()).hexdigest()) for p, who in members.items()),
        key=repr,
    )


def trie_rows(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()), key=repr)


def trie_fixture(seed):
    r = random.Random(seed)
    texts = ["hi", "how are you?", "é日本", "", None, "long " * 50_000]
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(205, 230), *range(1600, 1620), *range(3300, 3330), -3, -150, -250, -200]:
        for t in range(r.choice([1, 2, 3, 7, 9])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(texts[: r.choice([1, 2, 6])])))
    same = [(t, "user", f"turn {t}") for t in range(40)]
    for c in (7777, 8888, 9999, 9998):  # deep shared paths; their bases are absent
        rows += [(c, *x) for x in same]
    rows += [(8888, 41, "user", "end"), rows[0], rows[1], rows[1], (None, 1, "user", "nobody's")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_prefixes(spark, seed):
    rows = trie_fixture(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as path", "1 as depth", "2 as base", "3 as digest").repartition(4)
    assert trie_rows(trie.prefix_trie(df)) == trie_by_prefixes(rows)


def test_trie_of_one_family_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(5, 0, "user", "a")], [(1, t, "user", "x") for t in range(9)] + [(2, t, "user", "x") for t in range(9)]):
        assert trie_rows(trie.prefix_trie(spark.createDataFrame(rows, schema))) == trie_by_prefixes(rows)
