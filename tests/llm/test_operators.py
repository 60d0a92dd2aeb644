"""The corpus operators on small fixtures: nulls, empty and long texts, repeats, clashing columns, empty tables, and brute force."""

import base64
import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactus.llm import language_id, quality_crf, quality_rules, queries, url_filter
from tactus.llm.bpe import encode_documents, load_codec
from tactus.llm.common import text_bytes
from tactus.llm.components import connected_components
from tactus.llm.decontaminate import build_index, decontaminate, find_near
from tactus.llm.queries import tokenizer_path
from tactus.llm.sharding import shard_documents
from tactus.llm.url_filter import judge_urls
from tactus.llm.warc import warc_round_trip

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, score string, n string, cell string, lang string"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "en") for i, t in rows], DOCS).repartition(3)


def texts(seed, n=60):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "δέλτα", "e1", "Über", "zz!", "42", "ça", "don't", "日本", "🙂"]
    out = [(i, r.choice([" ", "\n", "  "]).join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "word " * 30_000), (n + 4, out[0][1]), (n, None), (n + 5, "x" * 3000)]
    return out


# --- BPE ---


def test_bpe_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    rows = texts(1) + [(200, "<|endoftext|> A<|startoftext|>b <|endoftext|"), (201, "ΣΑΣ ﬁ Å é   x y"), (202, "I'll've 3x10^5 __init__ ©®")]
    got = {}
    for r in encode_documents(frame(spark, rows), tokenizer_path(), with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        for r in got[i]:
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    small = encode_documents(frame(spark, rows), tokenizer_path(), with_ids=True, lasting=False, room=0.0005)  # tables of a few dozen entries
    assert sorted(map(str, small.collect())) == sorted(str(r) for found in got.values() for r in found)
    codec = load_codec(tokenizer_path())
    assert codec.decode(codec.encode("Hello there")) == lib.decode(lib.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False)
    assert encode_documents(frame(spark, []), tokenizer_path()).collect() == []


# --- decontamination ---


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate((30, 12, 10, 3, 1, 0))] + [("none", None)]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        if i % 3 == 0:
            src = items[i % 2][1].split()
            w[5:5] = src[r.randint(0, 3) :]
        docs.append((i, r.choice([" ", ", "]).join(w).upper() if i % 2 else " ".join(w)))
    docs += [(60, None), (61, ""), (0, docs[0][1])]
    want = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            q = words(text)
            k = min(10, len(q))
            for s in range(len(q) - k + 1) if q else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(name)
        want[i] = (len(w), len(hit), sorted(found), bool(hit))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for table in (bench, bench.repartition(5).union(bench.limit(2))):  # items in one task, or in several and repeated
        got = decontaminate(frame(spark, docs), table).collect()
        assert len(got) == len(docs)
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in got} == want
    assert decontaminate(frame(spark, []), bench).collect() == []
    assert {x["contaminated"] for x in decontaminate(frame(spark, docs), bench.limit(0)).collect()} == {False}
    near = find_near(build_index(frame(spark, [(1, "a b c d e"), (2, "a x x x x x x e"), (3, "e a")])), ["a e"], 4)
    assert sorted(x["doc_id"] for x in near.select("doc_id").distinct().collect()) == [1, 3]


def test_proximity_of_long_spans(spark):
    apart = lambda n: "left " + "x " * (n - 1) + "right"
    rows = [(1, apart(1500)), (2, apart(3000)), (3, "left " + "x " * 10), (4, "x right"), (5, "right left"), (None, apart(1023)), (6, apart(2001))]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))  # one segment
    for span, want in ((1023, {None, 5}), (2000, {None, 1, 5}), (2001, {None, 1, 5, 6}), (1 << 40, {None, 1, 2, 5, 6})):
        assert {r["doc_id"] for r in find_near(index, ["left right"], span).collect()} == want


# --- WARC ---


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c/", "é" * 5000), (6, "http://d/", "é" * 5000), (7, "http://e/", "\r\n\r\n"), (5, "http://c/", "é" * 5000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha1 string, record string").repartition(3)
    got = warc_round_trip(df, chunk_bytes=700).collect()
    assert len(got) == len(rows) and all(r["sound"] for r in got)
    for r in got:
        raw = (next(h for p, _, h in rows if p == r["page_id"]) or "").encode()
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["refers_to"] == {1: 2, 3: 4, 5: 6}.get(r["page_id"])
        assert r["record_type"] == ("revisit" if r["refers_to"] else "response")
    assert max(r["n_chunks"] for r in got) == -(-10_000 // 700)
    assert {r["record_type"] for r in warc_round_trip(df, revisit_bytes=1 << 20).collect()} == {"response"}
    assert warc_round_trip(df.limit(0)).collect() == []


# --- sharding ---


def test_shards(spark):
    rows = texts(5, 300) + [(1000 + i, "copy of one text") for i in range(200)]
    got = shard_documents(frame(spark, rows), shards=7).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    biggest = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * biggest
    for s in size:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = shard_documents(frame(spark, rows).repartition(1), shards=7).collect()
    key = lambda rs: sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)
    assert shard_documents(frame(spark, [])).collect() == []


def test_shards_hold_the_texts(spark):
    rows = texts(6, 200) + [(1000 + i, "one text that many rows have " * 90) for i in range(400)] + [(None, "no id"), (None, None), (2000, "日本" * 400_000)]
    slim = shard_documents(frame(spark, rows), shards=7).collect()
    out = shard_documents(frame(spark, rows), shards=7, keep=["text", "lang"])
    got = out.collect()
    key = lambda rs: sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rs), key=str)
    assert key(got) == key(slim)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["lang"] == "en" for r in got)
    assert len({r["shard"] for r in got if r["text"] == rows[-4][1]}) > 1  # copies of one text are cut where a boundary falls


def test_query_exchanges_texts(spark, tmp_path):
    frame(spark, texts(7, 30)).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op6_sharding(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("RepartitionByExpression")]
    below = plan[plan.index("RepartitionByExpression") :]
    assert "crc32(" in top and "octet_length(" in top and "crc32(" not in below and "_keep_text" in below


# --- components and URL filter ---


def test_components_against_union_find(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(1, 1), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_blocks_spread_to_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://x.net/es/a", ""),
        (2, "http://other.org/p", canonical.format("http://x.net/es/a")),
        (3, "http://far.org/q", canonical.format("http://other.org/p")),
        (4, "http://www.example.com/en/z", canonical.format("http://x.net/es/a")),
        (5, None, "x"),
        (6, "no url", None),
        (7, "HTTP://A.Example.COM/en/?q", ""),
        (7, "HTTP://A.Example.COM/en/?q", ""),
        (8, "http://hop.org/", '<meta http-equiv="refresh" content="0; url=/es/">'),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, node string, own string")
    out = judge_urls(df, redirects=spark.createDataFrame([("http://hop.org/es/", "http://x.net/es/a")], "src string, dst string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("x.net", "/es/a", "net/es/", "block")
    assert got[2][2:] == got[3][2:] == got[8][2:] == (None, "block")
    assert got[4][2:] == ("www.example.com/en/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert judge_urls(df.limit(0)).collect() == []


# --- language, rules, quality ---


def test_languages_on_unseen_texts(spark):
    r = random.Random(9)
    parts = {"aa": ["lo", "mi", "ra", "tu"], "bb": ["schr", "ung", "keit", "zw"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word("aa" if i % 2 else "bb") for _ in range(30)), "aa" if i % 2 else "bb", "x") for i in range(80)]
    rows += [(100, None, None, "x"), (101, "123 !?", "aa", "x"), (102, "", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {x["doc_id"]: x for x in language_id.identify(df, language_id.fit_languages(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i < 80)
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(df.limit(0), language_id.fit_languages(df.limit(0))).collect() == []


def test_every_language_is_learned(spark):
    r = random.Random(21)
    vocab = {f"l{k:02}": ["".join(r.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(8)] for k in range(70)}
    say = lambda lang: " ".join(r.choice(vocab[lang]) for _ in range(20))
    rows = [(20 * k + j, say(lang), lang) for k, lang in enumerate(vocab) for j in range(12 - k // 10)]
    rows += [(None, say("l00"), "l00"), (0, rows[0][1], "l00"), (None, "nur ohne kennung", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    reference = language_id.fit_languages(df)
    assert set(reference) == {*vocab, "zz"}
    got = language_id.identify(df, reference, keep=["doc_id", "text", "lang"]).collect()
    assert len(got) == len(rows) and all(x["lang_pred"] == x["lang"] for x in got)
    whole = {x["text"]: x for x in language_id.identify(df, reference, keep=["doc_id", "text"], block_languages=100).collect()}
    assert all(x["lang_pred"] == whole[x["text"]]["lang_pred"] and abs(x["score"] - whole[x["text"]]["score"]) < 1e-9 for x in got)


def test_reference_is_spread_over_rows(spark):
    def text(i):
        return "x" * 3000 + f" middle{chr(97 + i)} " * 300 + f" ending{chr(97 + i)}" * 300

    rows = [(i, text(i % 26), "aa") for i in range(200)] + [(7, text(7), "aa")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    reference = language_id.fit_languages(df)["aa"]
    assert b"middle" in reference and b"ending" in reference
    assert sum(p.startswith(b"x" * 20) for p in reference.split(b"\0")) == 2 * 60  # two of four places of each row
    assert 0.9 * 24_000 <= len(reference) <= 24_000 + 60


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts_and_rules(spark):
    rows = [x for x in texts(11) if len(x[1] or "") < 5000] + [(300, "a b c d e\n" * 4), (301, "# $$ <b>|x|\nsame\nsame\n\n\nsame ")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, quality int, text string")
    df = frame(spark, rows)
    got = quality_rules.apply_rules(df, quality_rules.fit_rules(df, labels)).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        counts = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert counts == base(want[r["doc_id"]]), r
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(df.limit(0), quality_rules.fit_rules(df, labels.limit(0))).collect() == []


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    field = quality_crf.LineField(r.normal(size=3), r.normal(size=(2, 2)))
    doc = np.array([0] * 5 + [1] + [2] * 3)
    x = r.normal(size=(9, 3))
    good, _ = field.marginals(doc, x, 3)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        score = x[at] @ field.weights
        total, on = 0.0, np.zeros(len(at))
        for states in itertools.product((0, 1), repeat=len(at)):
            s = np.exp(sum(score[i] for i, q in enumerate(states) if q) + sum(field.trans[a, b] for a, b in itertools.pairwise(states)))
            total += s
            on += s * np.array(states)
        assert np.allclose(good[at], on / total)


def test_quality_tells_lines_apart(spark):
    r = random.Random(13)
    fine = lambda: "\n".join(" ".join(r.choice(["river", "stone", "quiet", "garden", "letter"]) for _ in range(9)) + "." for _ in range(4))
    junk = lambda: "\n".join("$$$ ### " * 4 + "BUY!!!" for _ in range(4))
    rows = [(i, fine() if i % 2 else junk()) for i in range(120)] + [(500, None), (501, ""), (502, "one\n" * 4000)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)], "doc_id long, quality int, text string")
    df = frame(spark, rows)
    out = quality_crf.classify(df, quality_crf.fit_quality(df, labels))
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] < 120]
    assert held and all(x["predicted"] == x["doc_id"] % 2 for x in held)
    assert all(x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert quality_crf.classify(df.limit(0), quality_crf.fit_quality(df, labels.limit(0))).collect() == []
    assert out.where(F.col("n_lines") < 1).count() == 0


def test_many_rules_are_joined(spark):
    r = random.Random(5)
    hosts = ["a.com", "b.com", "x.a.com", "y.x.a.com", "com", "net", "c.net", ""]
    path = lambda: "/" + "/".join(r.choice(["en", "fr", "e", "long-part"]) for _ in range(r.randint(0, 4)))
    rules = list({(r.choice(["allow", "block"]), r.choice(hosts[:-1]) + path() + str(r.choice(["", "/", i]))) for i in range(5000)})
    urls = [None, "no scheme", "http://"] + [f"http://{r.choice(['', 'www.'])}{r.choice(hosts)}{path()}{r.choice(['', '/', '?q', '/en/12'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")

    def brute(host, path):
        fits = [(-len(rule), v != "allow", rule, v) for v, rule in rules for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return min(fits)[2:] if fits else (None, "allow")

    got = url_filter.judge_urls(df, rules).collect()
    assert len(rules) > 2000 and len(got) == len(urls)
    for x in got:
        assert (x["rule"], x["verdict"]) == brute(x["host"], x["path"]), x


def test_phrases_against_a_naive_parse():
    r = random.Random(7)
    voc = ["".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(60)]
    ref = {x: " ".join(r.choice(voc[i : i + 40]) for _ in range(300)).replace(" ", "\0").encode() for i, x in ((0, "p"), (20, "q"))}
    # a text of one phrase after another is the same from any start; one long phrase is not
    texts = ["", "a", "zz", ref["p"].decode().replace("\0", " ") * 2, " ".join(r.choice(voc) for _ in range(4000)), "ab" * 700, "abz" * 300 + "q", "é" + voc[0]]
    parser = language_id.train(ref).opened()

    def naive(letters, reference):
        at = count = 0
        while at < len(letters):
            n = 1
            while at + n <= len(letters) and letters[at : at + n] in reference:
                n += 1
            at += max(1, n - 1)
            count += 1
        return count

    data, at = text_bytes(pa.array(texts))
    letters, offsets = language_id._letters(data, at)
    got = parser.phrases(letters, offsets)
    for i in range(len(texts)):
        own = letters[offsets[i] : offsets[i + 1]].tobytes()
        assert got[i].tolist() == [naive(own, ref[x]) for x in ref], i


def test_rules_score_against_plain_python(spark):
    rows = texts(11, 20)
    size = 1 << quality_rules.HASH_BITS
    rng = np.random.default_rng(3)
    model = quality_rules.NgramModel(rng.normal(0, 3, (3, size)).astype(np.float32), 0.1, 1.3, -0.2)

    def slots(text, kind):
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.array([0, len(data)])
        doc, first, end = quality_rules.find_words(data, at, "space")
        return quality_rules.feature_slots(data, at, doc, quality_rules.hash_words(data, first, end, False))[kind][1].tolist()

    def p(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        z = model.bias
        for kind, features in enumerate((w, [" ".join(x) for x in zip(w, w[1:])], [text[i : i + 3] for i in range(len(text) - 2)])):
            # a feature has the same slot wherever it stands: ask for it alone
            found = [slots(f, kind)[0] for f in dict.fromkeys(features)]
            known = dict(zip(dict.fromkeys(features), found, strict=True))
            z += sum(float(model.weights[kind][known[f]]) for f in features) / max(1, len(features))
        return 1 / (1 + np.exp(-(model.slope * z + model.offset)))

    got = quality_rules.apply_rules(frame(spark, rows), model).collect()
    want = {i: p(t or "") for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["p_good"] - want[r["doc_id"]]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= quality_rules.KEEP_AT)
