"""N-gram Jaccard join by MinHash banding.

1. Every document becomes its set of word 3-grams; sets that are equal (128-bit
   fingerprints) are one *class of copies* with one representative, so copies
   cost nothing beyond this point, however many there are.
2. MinHash sketches of the representatives are cut into bands; band and row counts
   follow from the target recall at the threshold. Representatives that share a band
   hash and whose set sizes allow the threshold are candidates. No bucket is capped, and none is
   gathered whole: buckets are held in parts of about PART_DOCS representatives, and parts meet by pairs of parts.
3. Candidates are verified on the full sets. Pairs go to the block of the least
   label (least neighbour) of their two documents, so near copies of one document meet
   in one block and a text travels once for each block, not for each pair. Blocks of
   many documents are cut into tiles by a hash of each side.

`deduplicate` needs only what is connected. It first verifies stars (each member of a bucket with the bucket's
least one), and then only the candidates whose documents are not yet connected: thousands of near copies of one
text cost a few stars, not all their pairs, and no candidate is left unverified that could still join two groups.

Defined results
---------------
* Null or blank text: no n-grams, hence no pair, and the document is kept by `deduplicate`.
* Null doc_id: never paired; kept by `deduplicate`.
* Texts of fewer than 3 words have one n-gram of all their words.
* Repeated rows of a doc_id are one document, near to whatever one of them is near to; its links are those of the text that
  has most. If it stays in `deduplicate`, so does its row of the least text (ties: the least of the other columns, maps aside).
* Empty tables give empty results. Columns besides doc_id and text are ignored, and pass through `deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, checked, cut, lean, with_ids, without_ids

N = 3
THRESHOLD = 0.5
RECALL = 0.95
MAX_HASHES = 96
SEED = 8
#: Representatives in a part of a band's bucket, about.
PART_DOCS = 512
#: A block with more documents than so many on either side of its pairs is cut into tiles.
TILE_DOCS = 512
#: Classes of more documents meet their rows by broadcast, so that no task gets all rows of one.
HOT_DOCS = 50_000
#: Rows and bytes of text that a worker gathers before it verifies.
BUFFER_BYTES = 8 << 20
#: Edges that a task gathers before it contracts them, 100 to 140 bytes each; what contracts to so few settles in one task.
TASK_EDGES = 2_000_000

SKETCH = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("set_b", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose band count for `recall` at `threshold` stays within `max_hashes`."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        if hit == 0:
            break
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _marks(grams: np.ndarray) -> np.ndarray:
    """What a set's fingerprint sums over its n-grams."""
    return K.mix(grams + K._C[3])


def _sketcher(n: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for at, texts in K.slices(b.column(1)):
                grams, first = K.gram_sets(texts, n)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                marks = _marks(grams)
                set_a, set_b = np.add.reduceat(marks, first[some]), np.add.reduceat(K.mix(marks ^ K._C[4]), first[some])
                sketch = K.minhash(grams, first, bands * rows, SEED)[some].reshape(len(some), bands, rows)
                band = np.zeros((len(some), bands), K.U)
                for r in range(rows):
                    band = K.mix(band * K._C[1] + sketch[:, :, r])
                band = K.mix(band + np.arange(bands, dtype=K.U) * K._C[2])  # the band's number is part of its hash
                yield batch(SKETCH, ids.slice(at, len(texts)).take(pa.array(some)), set_a.view(np.int64), set_b.view(np.int64), np.diff(first)[some].astype(np.int32), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel())))

    return run


def sketches(docs: DataFrame, n: int = N, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """One checkpointed row for each document with n-grams: id, node and set_b (its set's fingerprint), size of the set, band hashes."""
    if bands is None or rows is None:
        bands, rows = choose_bands(THRESHOLD, RECALL)
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).where("id is not null and text is not null")
    return cut(narrow.mapInArrow(lean(_sketcher(n, bands, rows)), "id long, node long, set_b long, size int, bands array<long>"))


def equal_sets(sketch: DataFrame) -> DataFrame:
    """Of each distinct set: node (half of its fingerprint), rep (least id), docs (rows), size, band hashes. All are partial aggregates."""
    return sketch.groupBy("node", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("docs"), F.first("size").alias("size"), F.first("bands").alias("bands")).drop("set_b")


def with_hot(rows: DataFrame, side: DataFrame, key: str, count: str = "docs", hot: int = HOT_DOCS) -> DataFrame:
    """rows joined with `side` (checkpointed; one row for each key, with the count of the key's rows): keys of more than `hot` rows by broadcast."""
    many = side.where(F.col(count) > hot)
    if many.isEmpty():
        return rows.join(side, key)
    return rows.join(side.where(F.col(count) <= hot), key).unionByName(rows.join(checked(many), key))


def buckets(reps: DataFrame) -> DataFrame:
    """band, n (its nodes), node, size, group of each node of a band that two nodes or more share. `group`: what is connected already, else the node."""
    group = F.col("group") if "group" in reps.columns else F.col("node")
    rows = reps.select("node", "size", group.alias("group"), F.explode("bands").alias("band"))
    shared = cut(rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), (F.min("group") == F.max("group")).alias("joined")).where("n > 1 and not joined").drop("joined"))
    return with_hot(rows, shared, "band", "n")


def _possible(a: str, b: str, threshold: float) -> Column:
    """Sizes of two sets that can reach the threshold."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-9)


def stars(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs a < b of the least node of a band and another of it."""
    size = reps.select(F.col("node").alias("a"), F.col("size").alias("size_a"))
    pairs = buckets(reps).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"), "size").distinct()
    return pairs.join(size, "a").where(_possible("size", "size_a", threshold)).select("a", "b")


def candidates(reps: DataFrame, threshold: float = THRESHOLD, part_docs: int = PART_DOCS) -> DataFrame:
    """Distinct pairs a < b of nodes that share a band hash, of different groups, whose sizes can reach the threshold."""
    member = buckets(reps).withColumn("parts", F.ceil(F.col("n") / part_docs).cast("int"))
    member = member.select("band", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.struct("node", "size", "group").alias("m"))
    held = cut(member.groupBy("band", "part", "parts").agg(F.sort_array(F.collect_list("m")).alias("ms")))  # a part is about part_docs, by hash
    fits = lambda x: (x["group"] != F.col("m.group")) & (F.least(x["size"], F.col("m.size")) >= F.greatest(x["size"], F.col("m.size")) * (threshold - 1e-9))
    # the pairs of a part come one document at a time: no array of all of them is built
    own = held.where("size(ms) > 1").select("ms", F.posexplode("ms").alias("at", "m")).where("at < size(ms) - 1")
    own = own.select(F.col("m.node").alias("a"), F.explode(F.filter(F.expr("slice(ms, at + 2, size(ms))"), fits)).alias("o"))
    if held.where("parts > 1").isEmpty():
        return own.select("a", F.col("o.node").alias("b")).distinct()
    one, two = (held.where("parts > 1").select("band", F.col("part").alias(f"part{k}"), F.col("ms").alias(f"ms{k}")) for k in (1, 2))
    across = one.join(two, "band").where("part1 < part2").select(F.explode("ms1").alias("m"), "ms2").select(F.col("m.node").alias("a"), F.explode(F.filter("ms2", fits)).alias("o"))
    return own.union(across).select(F.least("a", "o.node").alias("a"), F.greatest("a", "o.node").alias("b")).distinct()


def blocks(cand: DataFrame, tile_docs: int = TILE_DOCS) -> DataFrame:
    """a, b, block: pairs by the least label of their two documents; blocks of many documents tiled by a hash of each side."""
    label = cand.select("a", "b").union(cand.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label"))
    pairs = cand.join(label.withColumnRenamed("label", "la"), "a").join(label.select(F.col("a").alias("b"), F.col("label").alias("lb")), "b").select("a", "b", F.least("la", "lb").alias("root"))
    cuts = lambda c: F.ceil(F.approx_count_distinct(c) / tile_docs).cast("int")
    sizes = cut(pairs.groupBy("root").agg(F.count("*").alias("n"), cuts("a").alias("cuts_a"), cuts("b").alias("cuts_b")))
    side = lambda c: F.pmod(F.xxhash64(c), F.col(f"cuts_{c}")).cast("int")
    tiled = with_hot(pairs, sizes, "root", "n", 20 * HOT_DOCS).select("a", "b", "root", side("a").alias("x"), side("b").alias("y"))
    return tiled.select("a", "b", F.xxhash64("root", "x", "y").alias("block"))


def _verify_buffer(doc_block: np.ndarray, texts: pa.Array, pair_block: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard of each pair; documents and pairs meet by block and fingerprint."""
    grams, lengths, nodes = [], [], []
    for _, part in K.slices(texts):
        g, first = K.gram_sets(part, n)
        some = np.flatnonzero(np.diff(first))
        node = np.zeros(len(part), K.U)
        if len(some):
            node[some] = np.add.reduceat(_marks(g), first[some])
        grams.append(g)
        lengths.append(np.diff(first))
        nodes.append(node)
    dense = np.unique(np.concatenate(grams), return_inverse=True)[1]
    length = np.concatenate(lengths)
    start = np.concatenate([[0], np.cumsum(length)])
    docs = pd.DataFrame({"block": doc_block, "node": np.concatenate(nodes).view(np.int64), "at": np.arange(len(length))}).drop_duplicates(["block", "node"])
    place = pd.Series(docs["at"].to_numpy(), pd.MultiIndex.from_frame(docs[["block", "node"]]))
    at_a, at_b = (place.reindex(pd.MultiIndex.from_arrays([pair_block, x])).to_numpy().astype(np.int64) for x in (a, b))
    order = np.argsort(at_a, kind="stable")
    shared = np.zeros(len(order), np.int64)
    mark = np.zeros(int(dense.max()) + 1 if len(dense) else 1, bool)
    cuts = np.flatnonzero(np.diff(at_a[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        own = dense[start[at_a[group[0]]] : start[at_a[group[0]] + 1]]
        mark[own] = True
        for k in group:
            j = at_b[k]
            shared[k] = np.count_nonzero(mark[dense[start[j] : start[j + 1]]])
        mark[own] = False
    return shared / np.maximum(length[at_a] + length[at_b] - shared, 1)


def _verifier(n: int, threshold: float, forest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block: (block, a, b, text); b is null for a document, a and b are a pair else."""

    def emit(buffer: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(buffer)
        is_doc = pc.is_null(t.column(2))
        docs, pairs = t.filter(is_doc), t.filter(pc.invert(is_doc))
        if not pairs.num_rows:
            return
        ints = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
        block, a, b = (ints(pairs.column(i)) for i in range(3))
        jaccard = _verify_buffer(ints(docs.column(0)), docs.column(3).combine_chunks(), block, a, b, n)
        good = np.flatnonzero(jaccard >= threshold)
        if forest:
            good = good[_spanning(a[good], b[good])]
        if len(good):
            yield batch(PAIRS, a[good], b[good], jaccard[good])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            block = b.column(0).to_numpy(zero_copy_only=False)
            held.append(b)
            size += b.nbytes
            if size > BUFFER_BYTES and len(block) and block[0] != block[-1]:
                last = int(np.searchsorted(block, block[-1]))  # the last block may go on
                done = [*held[:-1], b.slice(0, last)]
                if any(x.num_rows for x in done):
                    yield from emit([x for x in done if x.num_rows])
                held = [b.slice(last)]
                size = held[0].nbytes
        if held:
            yield from emit(held)

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges that keep what is connected connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    return np.array(kept, np.int64)


def verified(docs: DataFrame, reps: DataFrame, cand: DataFrame, n: int = N, threshold: float = THRESHOLD, forest: bool = False) -> DataFrame:
    """a, b, jaccard of the candidates at or above the threshold; with `forest`, in each buffer only a spanning forest."""
    tiles = blocks(cand)
    needed = tiles.select("block", F.col("a").alias("node")).union(tiles.select("block", F.col("b"))).distinct().join(reps.select("node", F.col("rep").alias("id")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    shipped = texts.join(needed, "id").select("block", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = shipped.unionByName(tiles.select("block", "a", "b", F.lit(None).cast("string").alias("text")))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_verifier(n, threshold, forest)), "a long, b long, jaccard double")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, classes of copies, pairs): all pairs a, b, jaccard of nodes of different sets at or above the threshold, found with at least `recall` at it."""
    sketch = sketches(docs, n, *choose_bands(threshold, recall))
    reps = cut(equal_sets(sketch))
    return sketch, reps, cut(verified(docs, reps, cut(candidates(reps, threshold)), n, threshold))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of, copies, links BIGINT: one row for each document that another one is near to or equal to.

    class_id: least doc_id of all documents that are connected with it; copy_of: least doc_id of those with the same
    n-gram set, of which there are `copies`; links: documents, other than itself, whose n-gram Jaccard with it is at least
    `threshold`, copies included. Found with at least `recall` at the threshold, all of the copies.
    """
    sketch, reps, pairs = jaccard_pairs(docs, n, threshold, recall)
    again = repeated(sketch)
    sets = sketch.select("id", "node") if again.isEmpty() else cut(sketch.select("id", "node").distinct())
    info = sets.groupBy("node").agg(F.count("*").alias("docs"), F.min("id").alias("rep"))
    near = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).join(info.select(F.col("node").alias("b"), F.col("docs").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.sum("near").alias("near"))
    roots = components(pairs.select("a", "b").union(_same_id(sketch, again)))
    of = info.join(near, "node", "left").join(roots, "node", "left").select("node", "docs", "rep", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "node").alias("root"))
    of = cut(of.where((F.col("docs") > 1) | (F.col("near") > 0)))
    least = of.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("docs"))
    of = cut(with_hot(of.withColumnRenamed("docs", "copies"), cut(least), "root").drop("docs").withColumnRenamed("copies", "docs"))
    rows = with_hot(sets, of, "node").select(F.col("id").alias("doc_id"), "class_id", F.col("rep").alias("copy_of"), F.col("docs").alias("copies"), (F.col("docs") - 1 + F.col("near")).alias("links"))
    return rows if again.isEmpty() else rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.max("copies").alias("copies"), F.max("links").alias("links"))


def repeated(sketch: DataFrame) -> DataFrame:
    """id, a (its least node), n (rows) of the ids of several rows; checkpointed."""
    return cut(sketch.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))


def _same_id(sketch: DataFrame, again: DataFrame) -> DataFrame:
    """a, b: edges between the texts of one id."""
    return with_hot(sketch.select("id", "node"), again, "id", "n").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _rooted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, ascending, and the least node of all that are connected with each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((further := root[root]) != root).any():
            root = further
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def _contractor(most: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges as (node, least node connected with it), as far as `most` edges at once show; with `whole` least nodes have rows too."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def contracted() -> tuple[np.ndarray, np.ndarray]:
            node, root = _rooted(*(np.concatenate(x) for x in zip(*held)))
            return node[node != root], root[node != root]

        for b in batches:
            held.append(tuple(b.column(k).to_numpy() for k in (0, 1)))
            size += b.num_rows
            if size > most:
                held = [contracted()]
                size = len(held[0][0])
                if size > most // 2:
                    yield batch(schema, *held[0])
                    held, size = [], 0
        if held:
            yield batch(schema, *(_rooted(*(np.concatenate(x) for x in zip(*held))) if whole else contracted()))

    return run


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root (least node) of every connected node of edges(a, b); checkpointed. Tasks contract the edges they see; of what is left,
    up to `task_edges` edges settle in one task, more of them by large-star and small-star rounds."""
    contract = lambda df, whole: cut(df.mapInArrow(lean(_contractor(task_edges, whole)), "u long, v long"))
    edges = contract(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), False)
    if edges.count() <= task_edges:
        return contract(edges.coalesce(1), True).toDF("node", "root")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct()))
        state = now


def duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(ids to drop, ids of several rows). Groups are the connected components of the pairs; the least id of a group stays."""
    sketch = sketches(docs, n, *choose_bands(threshold, recall))
    reps = cut(equal_sets(sketch))
    again = repeated(sketch)
    first = verified(docs, reps, cut(stars(reps, threshold)), n, threshold, forest=True).select("a", "b")
    roots = components(first.union(_same_id(sketch, again)))
    grouped = cut(reps.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"))
    rest = cut(candidates(grouped, threshold))
    if not rest.isEmpty():
        more = verified(docs, reps, rest, n, threshold, forest=True).select("a", "b")
        roots = components(more.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    of = reps.join(roots, "node", "left").select("node", "rep", "docs", F.coalesce("root", "node").alias("root"))
    kept = of.groupBy("root").agg(F.min("rep").alias("kept"), F.count("*").alias("n"), F.max("docs").alias("most"))
    of = cut(with_hot(of, cut(kept), "root", "n").where("n > 1 or most > 1").select("node", "kept", "docs"))
    return cut(with_hot(sketch.select("id", "node"), of, "node").where("id <> kept").select("id").distinct()), again.select("id")


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs without all but one document of each group of near copies; see the module for nulls and repeated rows."""
    drop, again = duplicates(docs, n, threshold, recall)
    kept = without_ids(docs, drop)
    if again.isEmpty():
        return kept
    order = [F.col(f"`{c}`") for c in ["text", *[c for c, k in docs.dtypes if c not in ("doc_id", "text") and "map<" not in k]]]
    # a partial aggregate: the rows of an id don't meet in a task
    one = with_ids(kept, again).groupBy(F.col("doc_id").alias("of id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)).alias("row"))
    return without_ids(kept, again).unionByName(one.select("row.*"))
