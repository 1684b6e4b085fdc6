"""Sharding by extendible hashing.

A document's hash is the first 60 bits of the MD5 of its doc_id. The directory starts with
one bucket; a bucket whose documents exceed the byte limit splits on the next bit of the hash,
and only such a bucket does, until every shard fits. A shard is thus a hash prefix, and a new
document's shard follows from the directory alone.

The bytes of all prefixes down to the directory's depth come from one aggregation by the
longest prefix; the depth follows from the total, and prefixes that still exceed the limit there
(skew within the hash) are split deeper in further rounds of their own.

Defined results
---------------
* Bytes are those of the UTF-8 text; null and blank texts have 0. Null doc_ids share the hash of ''.
* Rows of one doc_id stay together. A document (or the rows of one id, or ids with equal hashes) larger than the limit can't be
  split: it is alone in a shard of MAX_BITS bits, the only kind of shard that may exceed the limit.
* An empty table has no shards. `assign` replaces columns named shard_id and shard_bytes; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, fresh

LIMIT_BYTES = 32 << 20
MAX_BITS = 60
#: Bits beyond those that the total needs, in the first round; bits of each further round.
SLACK_BITS, ROUND_BITS = 4, 10


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 as a BIGINT."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, MAX_BITS - bits)


def _leaves(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """Of rows(h, bytes), below prefixes of `start` bits that exceed the limit: each prefix of `depth` bits (as `p`) with its shard's bits (null: still too large) and bytes."""
    base = rows.groupBy(_prefix(F.col("h"), depth).alias("p")).agg(F.sum("bytes").alias("bytes"))
    levels = base.select("p", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("bits"), "bytes")
    up = F.expr(f"shiftright(p, {depth} - bits)")
    sums = levels.groupBy("bits", up.alias("q")).agg(F.sum("bytes").alias("total"))
    at = levels.select("p", "bits", up.alias("q")).join(sums, ["bits", "q"])
    fits = at.where((F.col("total") <= limit) | (F.col("bits") == MAX_BITS))
    leaf = fits.groupBy("p").agg(F.min(F.struct("bits", "total")).alias("leaf"))
    return base.select("p").join(leaf, "p", "left").select("p", F.col("leaf.bits").alias("bits"), F.col("leaf.total").alias("shard_bytes"))


def directory(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> list[tuple[int, DataFrame]]:
    """Rounds of (depth, table of p, bits, shard_bytes): prefixes of `depth` bits and their shards."""
    rows = cut(docs.select(hash_bits(F.col("doc_id").cast("long")).alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, start, rounds = min(MAX_BITS, max(0, (total // max(limit_bytes, 1)).bit_length()) + SLACK_BITS), 0, []
    while True:
        leaves = cut(_leaves(rows, start, depth, limit_bytes))
        rounds.append((depth, leaves.where("bits is not null")))
        over = leaves.where("bits is null").select("p")
        if depth == MAX_BITS or over.isEmpty():
            return rounds
        rows = rows.join(checked(over), _prefix(F.col("h"), depth) == F.col("p"), "left_semi")
        start, depth = depth + 1, min(MAX_BITS, depth + ROUND_BITS)


def shard_name(h: Column, bits: Column) -> Column:
    """The prefix in binary, '' for the only shard."""
    return F.when(bits == 0, F.lit("")).otherwise(F.substr(F.lpad(F.bin(h), MAX_BITS, "0"), F.lit(1), bits))


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """docs with shard_id (the hash prefix in binary) and shard_bytes. No row moves: `write` brings shards together."""
    out = docs.drop("shard_id", "shard_bytes")
    own = fresh(out, "__shard")
    h, bits, size = f"{own}h", f"{own}bits", f"{own}bytes"
    out = out.withColumn(h, hash_bits(F.col("doc_id").cast("long"))).withColumns({bits: F.lit(None).cast("int"), size: F.lit(None).cast("long")})
    for k, (depth, leaves) in enumerate(directory(docs, limit_bytes)):
        p, b, s = (f"{c}{k}" for c in (f"{own}p", bits, size))
        out = out.join(checked(leaves.toDF(p, b, s)), _prefix(F.col(h), depth) == F.col(p), "left").withColumns({bits: F.coalesce(bits, b), size: F.coalesce(size, s)}).drop(p, b, s)
    return out.withColumns({"shard_id": shard_name(F.col(h), F.col(bits)), "shard_bytes": F.col(size)}).drop(h, bits, size)


def write(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Each shard as a folder of one file: the documents move once, to their shard's task."""
    assign(docs, limit_bytes).repartition("shard_id").write.partitionBy("shard_id").mode("overwrite").parquet(path)
