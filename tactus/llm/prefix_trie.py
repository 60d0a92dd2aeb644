"""Prefix trie of conversations, built family by family.

The conversations of a family share a base id; each is rebuilt as the first turns of its family's base, followed by its own. A node of the
trie is a distinct sequence of first turns (role, text) that rebuilt conversations start with. Families are cogrouped with their base's turns, each builds
its own small trie, and only the combined nodes of families are shuffled to be merged. Of nodes that lie in one family alone the whole subtree does, so what the family
summed up over it is final; sums over the others double the distance they reach in each round, so a deep trie takes few rounds.

Rows and values:
  * null roles and texts are empty; turns are ordered by turn, null first, equal ones by a digest of role and text, so rows repeated in full stay repeated turns;
  * rows without a conv_id belong to no conversation and are left out; an empty table has no trie, not even a root; other columns are ignored;
  * turns move as digests (32 bytes) and lengths: texts of any length cost a family nothing. A family's turns are one group: at most 199 conversations (ids of one
    hundred; the hundreds below and above 0 share base 0), about 100 bytes a turn;
  * a node's key is a 128-bit digest of its turns. Ids that end in a node are joined to texts for parts of 16 families, which one task then digests in order as they stream by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import drop, materialise

#: Conversations c and c - c % FAMILY are one family; a conversation takes fewer than HEADS turns of its base.
FAMILY, HEADS = 100, 6
#: Ids of so many families are joined to one text.
PART_FAMILIES = 16

NODES = "path long, path2 long, parent long, parent2 long, depth long, points long, conv_id long, n_convs long, weighted long, n_leaves long, distinct long, ends string"


def turns_of_base(conv_id: int) -> int:
    """How many turns a conversation takes from its base at most."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def slim_turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, digest and points (code points of the text) of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null")
    return rows.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id", F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("points"))


def _in_order(turns: pa.Table) -> pa.Table:
    return turns.take(pc.sort_indices(turns, [("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start"))


def _key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def family_trie(own: pa.Table, base: pa.Table) -> pa.Table:
    """The combined nodes of one family: NODES, parents before children.

    weighted: over the subtree, members times code points of the last turn; distinct: the code points alone, each node once. ends: the ids of the
    conversations that end in the node, by number.
    """
    own = _in_order(own)
    head = list(zip(*(c.to_pylist() for c in _in_order(base).select(["digest", "points"]).slice(0, HEADS - 1).columns), strict=True))
    ids = own["conv_id"].to_numpy()
    digests, points = own["digest"].to_pylist(), own["points"].to_pylist()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []
    nodes: dict[bytes, int] = {}
    keys, parents, depths, sizes, least, members, ends = [], [], [], [], [], [], []

    def node(key: bytes, parent: int, size: int, conv: int) -> int:
        at = nodes.get(key)
        if at is None:
            at = nodes[key] = len(keys)
            keys.append(key), parents.append(parent), depths.append(depths[parent] + 1 if parent >= 0 else 0), sizes.append(size), least.append(conv), members.append(0), ends.append([])
        members[at] += 1
        return at

    for i, j in zip(starts, [*starts[1:], len(ids)], strict=True):  # ids ascend, so the first member is the smallest
        conv = int(ids[i])
        shared = turns_of_base(conv)
        at = node(b"", -1, 0, conv)
        for digest, size in (*head[:shared], *zip(digests[i + shared : j], points[i + shared : j], strict=True)):
            at = node(_key(keys[at], digest), at, size, conv)
        ends[at].append(conv)
    leaves, weighted, distinct = [0] * len(keys), [m * s for m, s in zip(members, sizes, strict=True)], list(sizes)
    for at in range(len(keys) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        if (up := parents[at]) >= 0:
            leaves[up] += leaves[at]
            weighted[up] += weighted[at]
            distinct[up] += distinct[at]
    halves = np.frombuffer(b"".join(k or bytes(16) for k in keys), np.int64).reshape(-1, 2)
    above = np.array(parents, np.int64)
    up = np.where((above >= 0)[:, None], halves[above], 0)
    nulls = above < 0
    columns = [halves[:, 0], halves[:, 1], pa.array(up[:, 0], mask=nulls), pa.array(up[:, 1], mask=nulls), depths, sizes, least, members, weighted, leaves, distinct, [",".join(map(str, e)) for e in ends]]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.string() if k == len(columns) - 1 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in NODES.split(", ")])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie, with its base."""
    turns = slim_turns(conversations)
    base = turns.where("conv_id = base")

    def build(key: tuple, own: pa.Table, heads: pa.Table) -> pa.Table:
        out = family_trie(own, heads)
        return out.append_column("base", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    return turns.groupBy("base").cogroup(base.groupBy("base")).applyInArrow(build, NODES + ", base long")


def _ends(families: DataFrame) -> DataFrame:
    """path, path2, ends_sha256 of the nodes in which conversations end. A part's ids are one text; the parts of a node stream by in order."""
    parts = families.where("ends <> ''").groupBy("path", "path2", F.floor(F.col("base") / (FAMILY * PART_FAMILIES)).alias("part"))
    parts = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",").alias("ends"))
    parts = parts.repartition("path", "path2").sortWithinPartitions("path", "path2", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for b in batches:
            for key in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key[:2] != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key[:2], hashlib.sha256()
                    state.update(key[2].encode())
                else:
                    state.update(b"," + key[2].encode())
            yield _digests(done)
            done = []
        if now:
            yield _digests([(*now, state.hexdigest())])

    return parts.mapInArrow(digest, "path long, path2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["path", "path2", "ends_sha256"])


KEY, UP = ["path", "path2"], ["parent", "parent2"]


def _subtrees(shared: DataFrame) -> DataFrame:
    """path, path2, n_leaves, distinct: own values of shared nodes, summed over their subtrees among them.

    Every node knows an ancestor and the sum of what lies nearer than that; each round adds the sums of those that point at it, and
    both reach twice as far. The root is above all, so its sum is that of all rows and nothing points at it.
    """
    at_root = lambda c: F.max(F.when(F.col("depth") == 0, F.col(c))).alias(c)
    root = shared.agg(*[at_root(c) for c in KEY], F.sum("n_leaves").alias("n_leaves"), F.sum("distinct").alias("distinct")).where("path is not null")
    below = F.col("depth") > 1
    state = materialise(shared.where("depth > 0").select(*KEY, *[F.when(below, F.col(c)).alias(c) for c in UP], "n_leaves", "distinct"), "sums")
    while not state.where("parent is not null").isEmpty():
        got = state.where("parent is not null").groupBy(*UP).agg(F.sum("n_leaves").alias("l"), F.sum("distinct").alias("d")).withColumnsRenamed(dict(zip(UP, KEY, strict=True)))
        further = state.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], *[F.col(u).alias(f"_{u}") for u in UP])
        new = state.join(got, KEY, "left").join(further, UP, "left")
        new = new.select(*KEY, *[F.col(f"_{u}").alias(u) for u in UP], *[(F.col(c) + F.coalesce(s, F.lit(0))).alias(c) for c, s in (("n_leaves", "l"), ("distinct", "d"))])
        old, state = state, materialise(new, "sums")
        drop(old)
    return state.select(*KEY, "n_leaves", "distinct").unionAll(root)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: path, path2 (its key), parent, parent2, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    families = materialise(family_nodes(conversations), "families")
    least = lambda *names: [F.min(c).alias(c) for c in names]
    nodes = families.groupBy(*KEY).agg(
        *least("parent", "parent2", "depth", "points", "conv_id", "n_leaves", "distinct"), F.sum("n_convs").alias("n_convs"), F.sum("weighted").alias("weighted"), (F.min("base") != F.max("base")).alias("shared")
    )
    nodes = materialise(nodes, "nodes")
    ups = nodes.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("shared").alias("parent_shared"))
    linked = materialise(nodes.where("parent is not null").join(ups, UP), "linked")
    own = F.col("parent_shared") & ~F.col("shared")  # the top of a subtree that lies in one family
    children = linked.groupBy(*UP).agg(F.count("*").alias("n_children"), *[F.sum(F.when(own, F.col(c))).alias(f"own_{c}") for c in ("n_leaves", "distinct")]).withColumnsRenamed(dict(zip(UP, KEY, strict=True)))
    nodes = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(linked.drop("parent_shared")).join(children, KEY, "left")
    nodes = materialise(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.where("shared").withColumns({"n_leaves": F.coalesce("own_n_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "distinct": F.coalesce("own_distinct", F.lit(0)) + F.col("points")})
    sums = _subtrees(values).withColumnsRenamed({"n_leaves": "all_leaves", "distinct": "all_distinct"})
    out = nodes.join(sums, KEY, "left").join(_ends(families), KEY, "left")
    leaves, distinct = F.coalesce("all_leaves", "n_leaves"), F.coalesce("all_distinct", "distinct")
    return out.select(
        *KEY, *UP, "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), (F.col("weighted") - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
