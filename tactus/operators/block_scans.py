"""Scans whose steps compose: a series is cut into blocks, each block is summed up on its own, and the summaries are carried along.

A step of a moving average with memory is an affine map, one of a best path a table of (max, +) sums: both compose, so a block has one map or table whatever
state comes in. Blocks are worked on in parallel; only their summaries, one row for thousands of steps, pass through one task in the order of the
series, a row at a time. Results are the same for every block size: scores of paths are whole numbers, whose sums don't depend on where they are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tactus.operators.series import index_rows
from tactus.sources.materialise import cut

#: Log probabilities are counted in steps of 2^-28, and as at least -1000 below the step's best.
LOG_STEPS, LEAST_LOG = 1 << 28, -1000.0


def stream_sorted(df: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], Callable[[dict | None, bool], list[dict]]], schema: str) -> DataFrame:
    """Walks the rows of each key in order, a row at a time: step(row, first of its key) gives rows of `schema`, and so does step(None, False) after a key's last row.

    Keys lie together in a sorted partition and nothing but step's state is held, so a series of any length takes no more memory than a short one.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, now = start(), None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now and now is not None:
                    out += step(None, False)
                out += step(row, key != now)
                now = key
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(step(None, False), schema=out_schema)

    return dealt.mapInArrow(run, schema)


# --- moving averages with memory ---


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, bucket: Column | None = None, block: int = 65_536) -> DataFrame:
    """Moving average with memory, whose decay grows as (1 + u) / (10 + u) up to `decay`: one row per key with the last average.

    The first row's value starts the average: a map with factor 0. bucket: an expression that follows the order, for numbering; a block's rows become one map.
    """
    placed = index_rows(df, keys, order, F.lit(0) if bucket is None else bucket, "_u")
    d = F.when(F.col("_u") == 0, F.lit(0.0)).otherwise(F.least(F.lit(decay), (1 + F.col("_u")) / (10 + F.col("_u"))))
    maps = placed.select(*keys, "_u", F.floor(F.col("_u") / block).alias("_b"), F.struct(d.alias("a"), ((1 - d) * F.col(value).cast("double")).alias("b")).alias("_m"))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def after(s: Column, x: Column) -> Column:
        return F.struct((s["a"] * x["_m"]["a"]).alias("a"), (x["_m"]["a"] * s["b"] + x["_m"]["b"]).alias("b"))

    def composed(rows: DataFrame, by: list[str], place: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(F.struct(place, "_m"))), same, after).alias("_m"))

    return composed(composed(maps, [*keys, "_b"], "_u"), keys, "_b").select(*keys, F.col("_m.b").alias("ema"))


# --- best paths ---


def _counted(logs: list | np.ndarray) -> np.ndarray:
    """Rows of log probabilities as whole steps below each row's best."""
    x = np.array(logs, float)
    x = np.nan_to_num(x - x.max(axis=1, keepdims=True), nan=LEAST_LOG)
    return np.rint(np.maximum(x, LEAST_LOG) * LOG_STEPS).astype(np.int64)


def _costs(stay: float, k: int) -> tuple[int, int]:
    with np.errstate(divide="ignore"):
        logs = np.log([stay, (1 - stay) / max(1, k - 1)])
    hold, move = np.rint(np.maximum(logs, LEAST_LOG) * LOG_STEPS).astype(np.int64).tolist()
    return hold, move


def _advance(score: np.ndarray, hold: int, move: int) -> tuple[np.ndarray, np.ndarray]:
    """(best score with which each state is reached, the state it comes from: the lowest of equally good ones). Rows of score are separate cases."""
    n, k = score.shape
    rows = np.arange(n)
    best = score.argmax(axis=1)
    rest = score.copy()
    rest[rows, best] = np.iinfo(np.int64).min // 2
    second = rest.argmax(axis=1) if k > 1 else best
    other = np.broadcast_to(best[:, None], (n, k)).copy()
    other[rows, best] = second
    moved, own, states = np.take_along_axis(score, other, 1) + move, score + hold, np.arange(k)
    if k == 1:
        return own, np.zeros((n, 1), np.int64)
    from_self = (own > moved) | ((own == moved) & (states < other))
    return np.where(from_self, own, moved), np.where(from_self, states, other)


def _forward(score: np.ndarray, x: np.ndarray, hold: int, move: int, back: list | None = None) -> np.ndarray:
    for t in range(len(x)):
        score, came = _advance(score, hold, move)
        score = score + x[t]
        if back is not None:
            back.append(came)
    return score


#: Steps of the blocks that are worked on together.
GROUP_STEPS = 65_536


def _groups(items: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StructArray]]:
    """Blocks of a batch by groups of one number of states and about GROUP_STEPS: their places, sizes (longest first) and items laid end to end."""
    offsets = items.offsets.to_numpy()
    sizes, states = np.diff(offsets), np.diff(items.values.field("x").offsets.to_numpy())[offsets[:-1]]
    order = np.lexsort((-sizes, states))
    for _, same in _runs(states[order]):
        ends = np.cumsum(sizes[order[same]])
        for _, at in _runs(ends // GROUP_STEPS):
            places = order[same][at]
            yield places, sizes[places], items.take(pa.array(places)).flatten()


def _runs(label: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(label[a]), slice(a, b)


def _steps(flat: pa.StructArray) -> np.ndarray:
    """Log probabilities of the items, steps x states."""
    return flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _together(score: np.ndarray, x: np.ndarray, sizes: np.ndarray, of: int, hold: int, move: int, back: np.ndarray | None = None, skip: np.ndarray | None = None) -> np.ndarray:
    """Scores at the ends of blocks that are worked on side by side, `of` rows of scores each; sizes fall, x has the blocks' steps end to end.

    back: filled with the state that each state comes from, by step. skip: blocks whose first step is only added, as nothing comes before it.
    """
    starts = np.cumsum(sizes) - sizes
    score = score.copy()
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # the blocks with a step t
        at = starts[:n] + t
        made, came = _advance(score[: n * of], hold, move)
        if t == 0 and skip is not None:
            made = np.where(np.repeat(skip[:n], of)[:, None], score[: n * of], made)
        score[: n * of] = made + np.repeat(x[at], of, axis=0)
        if back is not None:
            back[at] = came.reshape(n, of, -1)[:, 0]
    return score


def viterbi(steps: DataFrame, keys: list[str], idx: str, logs: str, stay: float, block: int = 4096) -> DataFrame:
    """Most likely state of every step: keys, idx, state, score (log probability of the state at the step).

    logs: log probabilities by state. A state stays with probability `stay` and moves to each other state with
    an equal share of the rest; equally good predecessors: the lowest state; equally good ends: the last one.
    A block's table has the best score from each state before it to each state at its end. With the tables carried along, each block learns the scores that
    come in, then which state before it leads to each state at its end; carried back, these give each block its last state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    item = F.struct(F.col(idx).alias("i"), F.col(logs).cast("array<double>").alias("x"))
    blocks = steps.groupBy(*keys, F.floor(F.col(idx) / block).cast("long").alias("_b")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    blocks = cut(blocks, "blocks")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables, firsts = [None] * len(b), [None] * len(b)
            for places, sizes, flat in _groups(b["_items"]):
                x = _counted(_steps(flat))
                k = x.shape[1]
                hold, move = _costs(stay, k)
                least = np.iinfo(np.int64).min // 4
                first = _together(np.zeros((len(places), k), np.int64), x, sizes, 1, hold, move, skip=np.ones(len(places), bool))
                for p, f in zip(places, first.tolist(), strict=True):
                    firsts[p] = f
                later = np.array([b["_b"][int(p)].as_py() > 0 for p in places])  # a series' first block has no table
                if later.any():
                    held = x[np.repeat(later, sizes)]
                    start = np.tile(np.where(np.eye(k, dtype=bool), 0, least), (int(later.sum()), 1))
                    made = np.maximum(_together(start, held, sizes[later], k, hold, move), least)
                    for p, m in zip(places[later], made.reshape(-1, k * k).tolist(), strict=True):
                        tables[p] = m
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], b["_b"], pa.array(tables, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], names=[*keys, "_b", "_table", "_first"])

    def carried() -> Callable[[dict, bool], list[dict]]:
        score = None

        def step(row: dict | None, new: bool) -> list[dict]:
            nonlocal score
            if row is None:
                return []
            came = None if new else score.tolist()
            if new:
                score = np.array(row["_first"], np.int64)
            else:
                k = len(score)
                score = (score[:, None] + np.array(row["_table"], np.int64).reshape(k, k)).max(axis=0)
            score -= score.max()  # the same for all paths, so that no sum grows with the series
            return [{**{k: row[k] for k in keys}, "_b": row["_b"], "_in": came}]

        return step

    tables = blocks.mapInArrow(table, f"{named}, _b long, _table array<long>, _first array<long>")
    ins = stream_sorted(tables, keys, [F.col("_b")], carried, f"{named}, _b long, _in array<long>")
    ready = cut(blocks.join(ins, [*keys, "_b"]), "blocks")

    def traced(x: np.ndarray, sizes: np.ndarray, came: list) -> tuple[np.ndarray, np.ndarray]:
        """(scores at the ends of blocks, the state each state comes from by step); came: the scores that come in, or None."""
        k = x.shape[1]
        hold, move = _costs(stay, k)
        back = np.empty(x.shape, np.int64)
        score = np.array([c or [0] * k for c in came], np.int64)
        return _together(score, x, sizes, 1, hold, move, back, np.array([c is None for c in came])), back

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ends = [None] * len(b), [None] * len(b)
            came_in = b["_in"].to_pylist()
            for places, sizes, flat in _groups(b["_items"]):
                came = [came_in[p] for p in places]
                score, back = traced(_counted(_steps(flat)), sizes, came)
                k, starts = back.shape[1], np.cumsum(sizes) - sizes
                at = np.tile(np.arange(k), (len(places), 1))
                for t in range(int(sizes[0]) - 1, -1, -1):
                    n = int(np.searchsorted(-sizes, -t, side="left"))
                    at[:n] = np.take_along_axis(back[starts[:n] + t], at[:n], 1)
                last = k - 1 - score[:, ::-1].argmax(axis=1)
                for p, c, a, e in zip(places, came, at.tolist(), last.tolist(), strict=True):
                    out[p], ends[p] = a if c is not None else [-1] * k, e
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], b["_b"], pa.array(out, pa.list_(pa.int64())), pa.array(ends, pa.int64())], names=[*keys, "_b", "_from", "_end"])

    def carried_back() -> Callable[[dict, bool], list[dict]]:
        state = 0

        def step(row: dict | None, new: bool) -> list[dict]:
            nonlocal state
            if row is None:
                return []
            last = row["_end"] if new else state
            state = row["_from"][last]
            return [{**{k: row[k] for k in keys}, "_b": row["_b"], "_last": last}]

        return step

    ways = ready.mapInArrow(sources, f"{named}, _b long, _from array<long>, _end long")
    lasts = stream_sorted(ways, keys, [F.col("_b").desc()], carried_back, f"{named}, _b long, _last long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            came_in, last_in = b["_in"].to_pylist(), b["_last"].to_numpy()
            for places, sizes, flat in _groups(b["_items"]):
                logs = _steps(flat)
                back = traced(_counted(logs), sizes, [came_in[p] for p in places])[1]
                starts, at = np.cumsum(sizes) - sizes, last_in[places].astype(np.int64)
                states = np.empty(len(logs), np.int64)
                for t in range(int(sizes[0]) - 1, -1, -1):
                    n = int(np.searchsorted(-sizes, -t, side="left"))
                    states[starts[:n] + t] = at[:n]
                    at[:n] = back[starts[:n] + t, at[:n]]
                rows = pa.array(np.repeat(places, sizes))
                yield pa.RecordBatch.from_arrays([*[b[k].take(rows) for k in keys], flat.field("i"), pa.array(states, pa.int32()), pa.array(logs[np.arange(len(logs)), states])], names=[*keys, idx, "state", "score"])

    return ready.join(lasts, [*keys, "_b"]).mapInArrow(fill, f"{named}, {idx} {kinds[idx]}, state int, score double")
