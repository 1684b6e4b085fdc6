"""Arrow-batched kernels: vectors against broadcast vectors, and ordered folds that hold one row's state, not a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Query vectors are broadcast up to so many; more of them go in blocks of so many.
BROADCAST_QUERIES = 10_000
#: Products are made for so many (row, query) pairs at once.
BLOCK = 1 << 17
#: Vectors that are multiplied by one at once.
TILE = 1 << 12


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dim) in double, and which rows are vectors of that length without nulls."""
    ok = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim
    values = column.filter(pa.array(ok)).flatten()
    out = np.zeros((len(column), dim))
    out[ok] = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if values.null_count:
        ok[ok] = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
    return out, ok


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, each product summed from the first dimension on: as `vectors.dot`, and alike for equal vectors wherever they stand."""
    if len(a) > len(b):
        return np.ascontiguousarray(dots(b, a).T)
    out, right = np.empty((len(a), len(b))), b.T
    for start in range(0, len(b), TILE):
        tile = np.ascontiguousarray(right[:, start : start + TILE])
        if tile.shape[1] == 1:  # alone it would be summed in another order
            tile = np.repeat(tile, 2, axis=1)
            out[:, start] = [np.einsum("ji,j->i", tile, x)[0] for x in a]
            continue
        for k, x in enumerate(a):
            np.einsum("ji,j->i", tile, x, out=out[k, start : start + TILE])
    return out


class Vectors:
    """Keyed vectors that fit a broadcast, by their lengths."""

    def __init__(self, keys: pa.Array, vectors: pa.Array):
        self.keys = keys
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        self.parts = []
        for dim in np.unique(lengths[lengths >= 0]).tolist():
            x, ok = matrix(vectors, dim)
            self.parts.append((dim, np.flatnonzero(ok), np.asfortranarray(x[ok])))

    def products(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """[rows, vectors] inner products, and where both sides are vectors of one length."""
        out, good = np.zeros((len(column), len(self.keys))), np.zeros((len(column), len(self.keys)), bool)
        for dim, at, x in self.parts:
            rows, ok = matrix(column, dim)
            out[:, at], good[np.ix_(ok, at)] = dots(rows, x), True
        return out, good


def blocks(queries: DataFrame, key: str = "query_id", vector: str = "q") -> Iterator[Vectors]:
    """The queries, BROADCAST_QUERIES at most at a time. They are made once, and the driver holds them."""
    found = queries.select(key, vector).toArrow()
    for start in range(0, max(1, found.num_rows), BROADCAST_QUERIES):
        part = found.slice(start, BROADCAST_QUERIES)
        yield Vectors(*(pa.concat_arrays(c.chunks) if (c := part.column(k)).num_chunks else pa.array([], c.type) for k in (key, vector)))


def products(rows: DataFrame, queries: DataFrame, lists: Callable[[Vectors], np.ndarray] | None = None) -> DataFrame:
    """rows(emb, ...) against every query(query_id, q): query_id, the columns of rows without emb, sim (null if either side is or lengths differ).

    The queries are broadcast as a matrix, rows stream by in Arrow batches: no shuffle. With `lists`, a function of the queries
    that gives [queries, lists probed], a row meets only the queries that probe its list_id.
    """
    rest = [c for c in rows.columns if c != "emb"]
    schema = StructType([queries.select("query_id").schema[0], *rows.select(*rest).schema, StructField("sim", DoubleType())])
    context = rows.sparkSession.sparkContext

    def one(held_vectors: Vectors) -> DataFrame:
        probed = lists(held_vectors) if lists is not None else None
        held = context.broadcast((held_vectors, probed))
        source = rows if probed is None else rows.where(F.col("list_id").isin(np.unique(probed).tolist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, near = held.value
            n = len(vectors.keys)
            step = max(1, BLOCK // max(n, 1))
            for whole in batches:
                for start in range(0, whole.num_rows if n else 0, step):
                    b = whole.slice(start, step)
                    sim, good = vectors.products(b.column(len(rest)))
                    if near is None:
                        row, query = np.divmod(np.arange(sim.size), n)
                    else:
                        own = b.column(rest.index("list_id")).to_numpy(zero_copy_only=False)
                        row, query = np.nonzero(_probes(near, own))
                    picked = pa.array(row)
                    out = [vectors.keys.take(pa.array(query)), *(b.column(k).take(picked) for k in range(len(rest))), pa.array(sim[row, query], mask=~good[row, query])]
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

        return source.select(*[F.col(f"`{c}`") for c in rest], "emb").mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [one(v) for v in blocks(queries)])


def _probes(near: np.ndarray, own: np.ndarray) -> np.ndarray:
    """[rows, queries]: does the query probe the row's list?"""
    return (near[None, :, :] == own[:, None, None]).any(axis=2)


def nearest(rows: DataFrame, centres: DataFrame, name: str = "list_id") -> DataFrame:
    """rows with the number of the centre(list_id, c) of the largest inner product, the least of equals; null without a vector."""
    found = centres.select("list_id", "c").orderBy("list_id").toArrow()
    held = rows.sparkSession.sparkContext.broadcast(Vectors(found.column(0).combine_chunks(), found.column(1).combine_chunks()))
    names = rows.columns
    at = names.index("emb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = held.value
        step = max(1, BLOCK // len(centre.keys))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                sim, good = centre.products(b.column(at))
                best = np.where(good, sim, -np.inf).argmax(axis=1)
                ids = centre.keys.take(pa.array(best, mask=~good.any(axis=1))).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*names, name])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(name, IntegerType())]))


def folded(rows: DataFrame, keys: tuple[str, ...], order: list[Column | str], run: Callable[[Iterator[tuple[tuple, dict[str, list]]]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`run` over the rows by key and order. It gets (key, columns as lists) for each stretch of a batch that has one key; a long key comes in several.

    Rows are shuffled by key and sorted by Spark (spilling as it must); a key's rows are never held together.
    """
    names = rows.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretches() -> Iterator[tuple[tuple, dict[str, list]]]:
            for b in batches:
                columns = {c: b.column(k).to_pylist() for k, c in enumerate(names)}
                of = list(zip(*(columns[k] for k in keys)))
                start = 0
                for k in range(1, len(of) + 1):
                    if k == len(of) or of[k] != of[start]:
                        yield of[start], {c: v[start:k] for c, v in columns.items()}
                        start = k

        yield from run(stretches())

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(whole, schema)


def emitted(schema: pa.Schema, rows: Iterator[tuple[Any, ...]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of row tuples."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
