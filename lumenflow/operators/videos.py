"""Whole videos against queries: a task gets a video's frames and a part of the queries, and only what it chooses leaves it, no pairs.

Frames are shuffled and sorted by Spark, GROUPS times at most; scores never are. A task holds the vectors of one video
and CELLS of their scores, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .arrow import Vectors, blocks, dots, matrix

#: Tasks that a search has at least, where there are queries enough: few videos are repeated, each copy meeting a part of the queries.
GROUPS = 24
#: Scores that a task holds at once, and rows of a batch that it hands back.
CELLS, ROWS = 1 << 21, 1 << 17
#: Ranks of a missing score, and of what can't be chosen.
NULL, OUT = -np.finfo(float).max, -np.inf


class Frames:
    """A video's rows in order."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __len__(self) -> int:
        return self.table.num_rows

    def take(self, name: str, at: np.ndarray) -> pa.Array:
        return self.table.column(name).combine_chunks().take(pa.array(at))

    def numbers(self, name: str) -> np.ndarray:
        """In double, nulls as NaN."""
        return self.table.column(name).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


#: (frames, sim [queries, frames], which frames have a score, [queries, frames] that may be chosen or None for all) -> query of each row of the result, its columns.
Choice = Callable[[Frames, np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, list[pa.Array]]]


def per_video(frames: DataFrame, queries: DataFrame, choose: Choice, columns: str | StructType, order: tuple[str, ...] = ("frame_idx",), lists: Callable[[Vectors], np.ndarray] | None = None) -> DataFrame:
    """query_id, video and `columns`, as `choose` makes them of each video's frames(video, emb, ...) in that order and queries(query_id, q).

    With `lists`, a function of the queries that gives [queries, lists probed], a query meets only the frames whose list_id it probes.
    """
    names = [c for c in frames.columns if c != "emb"]
    schema = StructType([queries.select("query_id").schema[0], frames.select("video").schema[0], *(_parse_datatype_string(columns) if isinstance(columns, str) else columns)])
    asked = list(blocks(queries))
    found = [r[0] for r in frames.select("video").distinct().limit(GROUPS + 1).collect()]
    parts = max(1, -(-GROUPS // (max(1, len(found)) * len(asked))))
    rows = frames.select(*[F.col(f"`{c}`") for c in names], "emb", F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("__part"))
    if len(found) <= GROUPS:  # a task each; by hash two would meet in one
        at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in found if v is not None]), F.col("video")), F.lit(0)) if any(v is not None for v in found) else F.lit(0)
        rows = rows.repartitionById((len(found) + 1) * parts, (at * parts + F.col("__part")).cast("int"))
    else:
        rows = rows.repartition("video", "__part")
    rows = rows.sortWithinPartitions("video", "__part", *order)
    context, kinds = frames.sparkSession.sparkContext, to_arrow_schema(schema)

    def one(vectors: Vectors) -> DataFrame:
        held = context.broadcast((vectors, lists(vectors) if lists is not None else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, near = held.value
            for (video, part), table in _videos(batches):
                for own, sim, ok, there in _scored(vectors, near, table, part, parts):
                    of, made = choose(Frames(table), sim, ok, there)
                    made = [vectors.keys.take(pa.array(own[of])), pa.repeat(pa.scalar(video, kinds.field(1).type), len(of)), *made]
                    whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, kinds)], schema=kinds)
                    for start in range(0, len(of), ROWS):
                        yield whole.slice(start, ROWS)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [one(v) for v in asked])


def _videos(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    owner, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        video, part = np.array(b.column("video").to_pylist(), object), b.column("__part").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((video[1:] != video[:-1]) | (part[1:] != part[:-1])) + 1
        for start, end in pairwise([0, *cuts.tolist(), b.num_rows]):
            of = video[start], int(part[start])
            if of != owner and held:
                yield owner, pa.Table.from_batches(held)
                held = []
            owner = of
            held.append(b.slice(start, end - start))
    if held:
        yield owner, pa.Table.from_batches(held)


def _scored(vectors: Vectors, near: np.ndarray | None, table: pa.Table, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(queries of the part, their sim, which frames have one, which may be chosen), some queries at a time."""
    n, emb = table.num_rows, table.column("emb").combine_chunks()
    step = max(1, CELLS // n)
    none = np.setdiff1d(np.arange(len(vectors.keys)), np.concatenate([np.empty(0, int), *(at for _, at, _ in vectors.parts)]))
    for dim, at, x in [*vectors.parts, (None, none, None)]:
        mine = np.flatnonzero(at % parts == part)
        if not len(mine):
            continue
        left, ok = (None, np.zeros(n, bool)) if dim is None else matrix(emb, dim)
        left = left if left is None else np.ascontiguousarray(left.T)  # [dim, frames]
        for start in range(0, len(mine), step):
            own = at[mine[start : start + step]]
            there = None if near is None else _there(near[own], table)
            if left is None:
                yield own, np.zeros((len(own), n)), ok, there
            else:
                yield own, _products(x[mine[start : start + step]], left, table, there), ok, there


def _there(near: np.ndarray, table: pa.Table) -> np.ndarray:
    """[queries, frames]: does the query probe the frame's list?"""
    of = table.column("list_id").combine_chunks().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    known, place = np.unique(of, return_inverse=True)
    return np.stack([np.isin(known, row) for row in near])[:, place]


def _products(q: np.ndarray, left: np.ndarray, table: pa.Table, there: np.ndarray | None) -> np.ndarray:
    """[queries, frames] inner products; with `there`, of those pairs only."""
    if there is None:
        return dots(q, left.T)
    out = np.zeros((len(q), left.shape[1]))
    of = table.column("list_id").combine_chunks().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        who = np.flatnonzero(there[:, at[0]])
        if len(who):
            out[np.ix_(who, at)] = dots(q[who], left[:, at].T)
    return out


# choices


def ranks(sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """A copy of sim whose larger values go first: missing scores behind all others, OUT where nothing may be chosen. NaN is the largest, as in Spark."""
    key = np.maximum(sim, NULL)
    key[:, ~ok] = NULL
    if there is not None:
        key[~there] = OUT
    return key


def first(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place from 0) of the k largest of each row; of equals the one that comes first."""
    n = key.shape[1]
    if k < n:
        edge = np.partition(key, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(~(key < edge[:, None]))
    else:
        row, column = np.divmod(np.arange(key.size), max(n, 1))
    value = key[row, column]
    order = np.lexsort((column, -value, ~np.isnan(value), row))
    row, column, value = row[order], column[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < k) & (value != OUT)
    return row[keep], column[keep], place[keep]


def _rows(rows: Frames, columns: tuple[str, ...], sim: np.ndarray, ok: np.ndarray, row: np.ndarray, column: np.ndarray) -> list[pa.Array]:
    return [*(rows.take(c, column) for c in columns), pa.array(sim[row, column], mask=~ok[column])]


def best(k: int, *columns: str) -> Choice:
    """The k best: columns, sim, place from 1."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        row, column, place = first(ranks(sim, ok, there), k)
        return row, [*_rows(rows, columns, sim, ok, row, column), pa.array(place + 1)]

    return choose


def spaced(k: int | None, gap: Callable[[np.ndarray], float], inclusive: bool, *columns: str) -> Choice:
    """Best first, those within gap(ts) of a chosen one left out: columns, sim, place from 1."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        key, ts = ranks(sim, ok, there), rows.numbers("ts")
        most, within, rising = len(rows) if k is None else k, gap(ts), bool(np.all(ts[1:] >= ts[:-1]))
        row, column, place = [], [], []
        for q, left in enumerate(key):
            for n in range(most):
                at = int(left.argmax())
                if left[at] == OUT:
                    break
                row.append(q), column.append(at), place.append(n + 1)
                t = ts[at]
                near = slice(None)
                if rising:  # somewhat more, as t - within is rounded
                    slack = 1e-9 * (abs(t) + within) + 1e-12
                    near = slice(np.searchsorted(ts, t - within - slack), np.searchsorted(ts, t + within + slack, "right"))
                far = np.abs(ts[near] - t)
                left[near][far <= within if inclusive else far < within] = OUT
                left[at] = OUT
        of, at = np.array(row, int), np.array(column, int)
        return of, [*_rows(rows, columns, sim, ok, of, at), pa.array(place, pa.int32())]

    return choose


def by_segment(budget: int, *columns: str) -> Choice:
    """Frames sorted by seg_id: every segment's best, best segments first, then every second best, and so on: columns, sim, place from 1."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        key, segment = ranks(sim, ok), np.array(rows.table.column("seg_id").to_pylist(), object)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[starts, len(segment)])
        top = np.maximum.reduceat(key, starts, axis=1)
        found, taken, depth, largest = [], 0, 0, top
        while taken < budget and (sizes > depth).any():
            if depth:
                largest = np.maximum.reduceat(key, starts, axis=1)
            # NaN equals nothing; a segment without a frame left isn't asked
            same = np.repeat(largest, sizes, axis=1)
            where = np.minimum.reduceat(np.where((key == same) | (np.isnan(key) & np.isnan(same)), np.arange(len(segment)), len(segment)), starts, axis=1)
            row, seg, place = first(np.where(sizes > depth, top, OUT), min(budget - taken, int((sizes > depth).sum())))
            found.append((row, where[row, seg], place + taken + 1))
            np.put_along_axis(key, where, OUT, axis=1)
            taken, depth = taken + int((sizes > depth).sum()), depth + 1
        row, column, place = (np.concatenate(x) for x in zip(*found))
        return row, [*_rows(rows, columns, sim, ok, row, column), pa.array(place)]

    return choose
