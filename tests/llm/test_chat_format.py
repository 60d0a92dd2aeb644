"""Role repair against an exhaustive search over all ways."""

import random
from functools import cache

from tactus.llm.chat_format import INSERT, MERGE, NAME_UNKNOWN, RELABEL, repair_chats

FOLLOW = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def least_cost(roles):
    """Cheapest repair by plain recursion: at each point insert, or use up a turn."""

    @cache
    def go(i, state, inserted):
        best = 1 << 30
        if i == len(roles):
            best = 0 if state in ("assistant", "") else best
        else:
            r = roles[i]
            price = lambda q: 0 if q == r else RELABEL if r in FOLLOW else NAME_UNKNOWN
            for q in FOLLOW[state]:
                best = min(best, price(q) + go(i + 1, q, 0))
            if state:
                best = min(best, MERGE + price(state) + go(i + 1, state, 0))
        if inserted < 2:
            for q in FOLLOW[state]:
                if q != "system":
                    best = min(best, INSERT + go(i, q, inserted + 1))
        return best

    return go(0, "", 0)


def rendered(rows):
    return "".join(r["piece"] for r in sorted(rows, key=lambda r: r["turn"]))


def check(rows, convs):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == set(convs)
    for c, turns in convs.items():
        got = sorted(by[c], key=lambda r: r["turn"])
        roles = [t[0] for t in turns]
        assert {r["conv_cost"] for r in got} == {least_cost(tuple(roles))}, (c, roles)
        # the rendered chat is legal and has every text in order
        messages = [m.split("|>\n", 1) for m in "".join(r["piece"] for r in got).removesuffix("<|end|>\n").split("<|end|>\n")]
        state = ""
        for head, _ in messages:
            assert head.removeprefix("<|") in FOLLOW[state], (roles, messages)
            state = head.removeprefix("<|")
        assert state == "assistant"
        assert "\n".join(x for x in (m[1] for m in messages) if x).split("\n") == [t[1] for t in turns]
        paid = sum(({"keep": 0, "merge": MERGE}.get(r["action"], 0)) + (MERGE if r["action"] == "merge+relabel" else 0) + ((RELABEL if r["role"] in FOLLOW else NAME_UNKNOWN) if "relabel" in r["action"] else 0) + (INSERT if r["inserted"] else 0) for r in got)
        tail = {"system": 2, "user": 1, "assistant": 0}[got[-1]["new_role"]]
        assert paid + INSERT * tail == got[0]["conv_cost"]
        assert got[-1]["message"] + 1 + tail == len(messages)


def convs(seed, n=120):
    r = random.Random(seed)
    out = {}
    for c in range(n):
        roles = [r.choice(["user", "assistant", "user", "assistant", "system", "tool"]) for _ in range(r.randint(1, 9))]
        out[c] = [(q, f"t{c}x{i}") for i, q in enumerate(roles)]
    out[n] = [(r.choice(["user", "assistant", "user", "tool", "system"]), f"long{i}") for i in range(400)]  # spans partitions
    return out


def test_against_search(spark):
    want = convs(1)
    rows = [(c, i, q, t, "x") for c, turns in want.items() for i, (q, t) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string").repartition(3)
    for part_rows in (40, 100_000):
        check(repair_chats(df, part_rows).collect(), want)


def test_nulls_ties_repeats_and_aliases(spark):
    rows = [
        (None, 0, "user", "a"),
        (1, None, None, None),
        (2, 0, "Human ", "q"),
        (2, 1, "GPT", "a"),
        (3, 0, "user", "same"),
        (3, 0, "user", "same"),
        (3, 1, "assistant", ""),
        (4, 0, "user", "p"),
        (4, 0, "user", "q"),
    ]
    got = repair_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(got) == len(rows)
    by = lambda c: [r for r in got if r["conv_id"] == c]
    assert by(None)[0]["piece"] == "<|user|>\na<|end|>\n<|assistant|>\n<|end|>\n"
    assert by(1)[0]["action"] == "relabel" and by(1)[0]["conv_cost"] == NAME_UNKNOWN + INSERT - (INSERT - 0) * (by(1)[0]["new_role"] == "assistant") + (INSERT if by(1)[0]["inserted"] else 0)
    assert rendered(by(2)) == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"
    assert by(3)[0]["conv_cost"] == 0 and [r["action"] for r in by(3)] == ["keep"] * 3
    assert sorted(r["action"] for r in by(4)) == ["keep", "merge"]


def test_empty_table(spark):
    assert repair_chats(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).collect() == []
