"""Chat formatting with minimum-cost role repair.

A legal chat is an optional system message, then user and assistant messages in turn, the last one of the assistant. Its automaton
has four states, named after the message before: start, system, user, assistant. Each turn of a conversation is kept, relabelled, or merged
into the message before, and empty messages may be inserted; dynamic programming over (turn, state) finds the cheapest way.

The cost of a run of turns is a 4 x 4 table (state before, state after), and tables of neighbouring runs combine by (min, +). So a
conversation of any length is cut where range partitions of the sorted turns end: every partition gives the tables of its first
and last conversation, the driver links those (two for each partition at most), and each partition then decides its own turns. Only
(conversation, turn, role, digest) rows are sorted; texts move once, to meet their decisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.llm.common import materialise

ROLES = ("unknown", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs of the repairs. An unknown role has to be relabelled, at a lower cost.
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 1, 3, 4, 1
#: Rendering: a message is HEADER with its role, its text, FOOTER; merged texts are joined by JOINT.
HEADER, FOOTER, JOINT = "<|{}|>\n", "<|end|>\n", "\n"
#: Turns that are decided side by side.
BLOCK_TURNS = 200_000
#: Slim rows of one range partition, about.
PART_ROWS = 500_000
_FAR = 1 << 40
#: State -> states that may follow at once.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def insertions(before: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty messages after state `before` that let `role` follow; None if nothing does."""
    if role in _NEXT[before]:
        return ()
    for mid in (USER, ASSISTANT):
        if mid in _NEXT[before] and role in _NEXT[mid]:
            return (mid,)
    return None


#: After the last turn: the empty messages that end a chat legally.
TAIL = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By (role, state before, state after): cost, whether the turn merges, the role inserted before it (0: none)."""
    cost = np.full((4, 4, 4), _FAR, np.int64)
    merged, inserted = np.zeros((4, 4, 4), bool), np.zeros((4, 4, 4), np.int8)
    for role in range(4):
        for s in range(4):
            for q in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == q else RELABEL if role else NAME_UNKNOWN
                put = insertions(s, q)
                if put is not None:
                    cost[role, s, q] = label + INSERT * len(put)
                    inserted[role, s, q] = put[0] if put else 0
                if s == q and label + MERGE <= cost[role, s, q]:
                    cost[role, s, q], merged[role, s, q], inserted[role, s, q] = label + MERGE, True, 0
    return cost, merged, inserted


COST, MERGED, INSERTED = _tables()
#: Among equally cheap ways the turn keeps its role, else takes the first of system, user, assistant.
_PREFER = np.array([[0 if q == r else q + 1 for q in range(4)] for r in range(4)], np.int64)
END_COST = np.array([INSERT * len(TAIL[s]) for s in range(4)], np.int64)


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of runs by falling length, their first turns, their lengths, number of runs longer than k for each k)."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    steps = int(length[0]) if len(length) else 0
    return order, first, length, np.searchsorted(-length, -np.arange(steps), "left")


def run_tables(roles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The (state before, state after) cost table of each run of turns."""
    order, first, length, alive = _lanes(lengths)
    out = np.full((len(lengths), 4, 4), _FAR, np.int64)
    out[:, range(4), range(4)] = 0
    made = out[order]
    for k, m in enumerate(alive.tolist()):
        step = COST[roles[first[:m] + k]]
        made[:m] = np.minimum((made[:m, :, :, None] + step[:, None, :, :]).min(axis=2), _FAR)
    out[order] = made
    return out


def to_go(roles: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 0, 4): least cost from the state after each turn to the end of its conversation; end: cost after each run."""
    order, first, length, alive = _lanes(lengths)
    out = np.zeros((len(roles), 4), np.int64)
    last = first + length - 1
    now = end[order].copy()
    for k, m in enumerate(alive.tolist()):
        at = last[:m] - k
        out[at] = now[:m]
        now[:m] = (COST[roles[at]] + now[:m, None, :]).min(axis=2)
    return out


def decide(roles: np.ndarray, lengths: np.ndarray, after: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before, state after) each turn on the preferred cheapest way from the given entry states; after: see to_go."""
    order, first, _, alive = _lanes(lengths)
    before, behind = np.zeros(len(roles), np.int8), np.zeros(len(roles), np.int8)
    now = entry[order].astype(np.int64)
    for k, m in enumerate(alive.tolist()):
        at = first[:m] + k
        r = roles[at]
        total = (COST[r, now[:m]] + after[at]) * 8 + _PREFER[r]
        pick = total.argmin(axis=1)
        before[at], behind[at] = now[:m], pick
        now[:m] = pick
    return before, behind


_PACKED = [T.StructField("part", T.IntegerType()), T.StructField("edge", T.ByteType()), T.StructField("turns", T.BinaryType()), T.StructField("no_turn", T.BinaryType()), T.StructField("digests", T.BinaryType()), T.StructField("roles", T.BinaryType()), T.StructField("costs", T.BinaryType())]


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = (at * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _changes(conv: pa.Array) -> np.ndarray:
    """First places of runs of equal values; nulls equal each other."""
    if len(conv) < 2:
        return np.arange(len(conv))
    a, b = conv[1:], conv[:-1]
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    differ = pc.if_else(both, False, pc.fill_null(pc.not_equal(a, b), True))
    return np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a sorted partition; the first and last ones, which may go on elsewhere, are edges with their cost table."""
    from pyspark import TaskContext

    part, held, lead = TaskContext.get().partitionId(), [], True

    def rows(t: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        nonlocal lead
        start = _changes(t.column("conv"))
        at = np.append(start, t.num_rows)
        edge = np.zeros(len(start), np.int8)
        edge[0] |= lead
        edge[-1] |= 2 * last
        lead = False
        turn, roles = t.column("turn"), t.column("role").to_numpy(zero_copy_only=False).astype(np.uint8)
        costs: list[bytes | None] = [None] * len(start)
        for i in np.flatnonzero(edge).tolist():
            s, e = int(at[i]), int(at[i + 1])
            costs[i] = run_tables(roles[s:e], np.array([e - s]))[0].tobytes()
        return pa.RecordBatch.from_arrays(
            [
                t.column("conv").take(pa.array(start)),
                pa.array(np.full(len(start), part, np.int32)),
                pa.array(edge),
                _binaries(turn.fill_null(0).to_numpy(zero_copy_only=False), at),
                _binaries(turn.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), at),
                _binaries(t.column("digest").to_numpy(zero_copy_only=False), at),
                _binaries(roles, at),
                pa.array(costs, pa.binary()),
            ],
            names=["conv", *[f.name for f in _PACKED]],
        )

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        last = int(_changes(b.column("conv"))[-1])
        goes_on = not held or len(_changes(pa.concat_arrays([held[-1].column("conv")[-1:], b.column("conv")[:1]]))) == 1
        if not last and goes_on:  # one conversation only
            held.append(b)
            continue
        held.append(b.slice(0, last))
        yield rows(whole(), False)
        held = [b.slice(last)]
    if held:
        yield rows(whole(), True)


_DECIDED = [
    T.StructField("turn", T.LongType()),
    T.StructField("digest", T.LongType()),
    T.StructField("new_role", T.ByteType()),
    T.StructField("merged", T.BooleanType()),
    T.StructField("put", T.ByteType()),
    T.StructField("message", T.LongType()),
    T.StructField("first", T.BooleanType()),
    T.StructField("last", T.BooleanType()),
    T.StructField("cost", T.LongType()),
]


def _opened(before: np.ndarray, behind: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """Messages that each turn opens, inserted ones included."""
    r = roles.astype(np.int64)
    return np.where(MERGED[r, before, behind], 0, 1 + (INSERTED[r, before, behind] > 0)).astype(np.int64)


def _exits(packed):
    """For the parts of conversations that span partitions: state after and messages opened, by state before."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = packed.value
        for b in batches:
            for part, edge, raw in zip(b.column("part").to_pylist(), b.column("edge").to_pylist(), b.column("roles"), strict=True):
                if (part, edge) not in ends:
                    continue
                roles = np.frombuffer(raw.as_buffer(), np.uint8)
                n = np.array([len(roles)] * 4)
                four = np.tile(roles, 4)
                before, behind = decide(four, n, np.tile(to_go(roles, n[:1], ends[part, edge][None]), (4, 1)), np.arange(4))
                opened = _opened(before, behind, four).reshape(4, -1).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "edge": pa.array([edge], pa.int8()), "after": [behind.reshape(4, -1)[:, -1].astype(np.int64).tolist()], "opened": [opened.tolist()]})

    return exits


def _decider(packed):
    """Rows of decisions for every turn of packed conversations."""

    def block(rows: list[tuple], conv: pa.Array) -> pa.RecordBatch:
        known = packed.value
        raws = [np.frombuffer(r[5], np.uint8) for r in rows]
        roles, n = np.concatenate(raws), np.array([len(x) for x in raws])
        # (entry state, messages before, cost after, cost of the whole conversation, whether it starts and ends here)
        links = [known.get((r[0], r[1])) for r in rows]
        entry = np.array([0 if x is None else x[0] for x in links])
        opened_before = np.array([0 if x is None else x[1] for x in links], np.int64)
        end = np.stack([END_COST if x is None else x[2] for x in links])
        starts, stops = (np.array([x is None or x[i] for x in links]) for i in (4, 5))
        after = to_go(roles, n, end)
        at = np.cumsum(n) - n
        before, behind = decide(roles, n, after, entry)
        cost = np.array([-1 if x is None else x[3] for x in links])
        own = COST[roles[at], START] + after[at]
        cost = np.where(cost < 0, own.min(axis=1), cost)
        opened = _opened(before, behind, roles)
        total = np.cumsum(opened)
        message = total - np.repeat(total[at] - opened[at], n) + np.repeat(opened_before, n) - 1
        first, last = np.zeros(len(roles), bool), np.zeros(len(roles), bool)
        first[at[starts]] = True
        last[(at + n - 1)[stops]] = True
        turn = pa.array(np.frombuffer(b"".join(r[2] for r in rows), np.int64), mask=np.frombuffer(b"".join(r[3] for r in rows), bool))
        return pa.RecordBatch.from_arrays(
            [
                conv.take(pa.array(np.repeat(np.arange(len(n)), n))),
                turn,
                pa.array(np.frombuffer(b"".join(r[4] for r in rows), np.int64)),
                pa.array(behind),
                pa.array(MERGED[roles, before, behind]),
                pa.array(INSERTED[roles, before, behind]),
                pa.array(message),
                pa.array(first),
                pa.array(last),
                pa.array(np.repeat(cost, n)),
            ],
            names=["conv", *[f.name for f in _DECIDED]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*[b.column(c).to_pylist() for c in ("part", "edge", "turns", "no_turn", "digests", "roles")], strict=True))
            at, size = 0, 0
            for i, r in enumerate(rows):
                size += len(r[5])
                if size >= BLOCK_TURNS or i == len(rows) - 1:
                    yield block(rows[at : i + 1], b.column("conv").slice(at, i + 1 - at))
                    at, size = i + 1, 0

    return run


def _link(packed: DataFrame) -> dict[tuple[int, int], tuple]:
    """Entry and end of the pieces of conversations that span partitions; two pieces for each partition at most."""
    spark = packed.sparkSession
    edges = packed.where("edge > 0")
    found = sorted(((r["part"], r["edge"], r["conv"], np.frombuffer(r["costs"], np.int64).reshape(4, 4)) for r in edges.select("part", "edge", "conv", "costs").toLocalIterator()), key=lambda r: (r[0], r[1] & 2))
    chains = [run for run in (list(g) for _, g in groupby(found, key=lambda r: r[2])) if len(run) > 1]
    if not chains:
        return {}
    ends: dict[tuple[int, int], np.ndarray] = {}
    start_cost: dict[tuple[int, int], int] = {}
    for run in chains:
        end = END_COST
        for part, edge, _, table in reversed(run):
            ends[part, edge] = end
            end = (table + end[None, :]).min(axis=1)
        start_cost[run[0][:2]] = int(end[START])
    shared = spark.sparkContext.broadcast(ends)  # one vector for each end of a partition
    got = edges.select("part", "edge", "roles").mapInArrow(_exits(shared), "part int, edge byte, after array<long>, opened array<long>")
    exits = {(r["part"], r["edge"]): (r["after"], r["opened"]) for r in got.toLocalIterator()}
    out: dict[tuple[int, int], tuple] = {}
    for run in chains:
        state, messages = START, 0
        for i, (part, edge, *_) in enumerate(run):
            out[part, edge] = (state, messages, ends[part, edge], start_cost[run[0][:2]], i == 0, i == len(run) - 1)
            after, opened = exits[part, edge]
            state, messages = after[state], messages + opened[state]
    return out


def role_code(role: Column) -> Column:
    """0 to 3 (see ROLES) for a role name or one of its aliases, in any case; null and other names are unknown."""
    name = F.lower(F.trim(role))
    code = F.when(name == "system", SYSTEM).when(name == "user", USER).when(name == "assistant", ASSISTANT)
    for alias, real in ALIASES.items():
        code = code.when(name == alias, ROLES.index(real))
    return code.otherwise(0).cast("byte")


def _digest() -> Column:
    return F.xxhash64(F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")))


def repair_chats(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of conversations (conv_id, turn, role, text).

    Returns conv_id, turn, role, new_role, action (keep, relabel, merge, merge+relabel), inserted (role of the empty message put before
    the turn, or null), message (0-based, of the repaired chat), conv_cost, and piece: what the turn adds to the rendered chat. The pieces
    of a conversation, in the order of turn, role and text digest, joined, are the chat; the last one closes it.

    Turns are ordered by turn (null first); of equal ones by role, then a 64-bit digest of role and text. Rows that repeat another
    row in full are one turn and all carry its decision. Null and unknown roles are relabelled. Null text is
    empty. A null conv_id is a conversation of its own. An empty table gives an empty result. Other columns are ignored.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("_d", _digest())
    slim = rows.select(F.col("conv_id").alias("conv"), "turn", F.col("_d").alias("digest"), role_code(F.col("role")).alias("role")).distinct()
    slim = materialise(slim, "turns")
    parts = max(spark.sparkContext.defaultParallelism, slim.count() // part_rows)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    kind = slim.schema["conv"]
    packed = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack, T.StructType([kind, *_PACKED]))
    packed = materialise(packed, "packed_turns")
    links = spark.sparkContext.broadcast(_link(packed))
    decided = packed.mapInArrow(_decider(links), T.StructType([kind, *_DECIDED])).withColumnsRenamed({"turn": "_turn"})
    both = rows.join(decided.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("_d") == F.col("digest")))
    named = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("new_role") + 1)
    put = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("put") + 1)
    head = lambda role: F.concat(F.lit(HEADER.split("{}")[0]), role, F.lit(HEADER.split("{}")[1]))
    foot = F.lit(FOOTER)
    opening = F.concat(F.when(F.col("first"), F.lit("")).otherwise(foot), F.when(F.col("put") > 0, F.concat(head(put), foot)).otherwise(F.lit("")), head(named))
    tail = F.lit("")
    for s, more in TAIL.items():
        if more:
            tail = F.when(F.col("new_role") == s, F.lit("".join(HEADER.format(ROLES[q]) + FOOTER for q in more))).otherwise(tail)
    closing = F.when(F.col("last"), F.concat(foot, tail)).otherwise(F.lit(""))
    piece = F.concat(F.when(F.col("merged"), F.lit(JOINT)).otherwise(opening), F.coalesce("text", F.lit("")), closing)
    relabelled = F.col("new_role") != role_code(F.col("role"))
    action = F.when(F.col("merged"), F.when(relabelled, "merge+relabel").otherwise("merge")).when(relabelled, "relabel").otherwise("keep")
    return both.select(
        "conv_id", "turn", "role", named.alias("new_role"), action.alias("action"), F.when(F.col("put") > 0, put).alias("inserted"), F.col("message"), F.col("cost").alias("conv_cost"), piece.alias("piece")
    )
