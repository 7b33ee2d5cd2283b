"""Exact top-k search over binary codes by incremental multi-index hashing (operator 4).

A vector's code has a bit for each dimension, set where the value is positive. Codes are cut into segments;
a code within distance m (r + 1) - 1 of the query, for m segments, is within r of it in some segment. So
the search radius of the segments grows, the codes found are verified by their Hamming distance, and a
query ends as soon as its k-th verified distance is provably covered by the radius searched. The last segment has
the bits that are left; no bit is made up.

Equal codes are one entry with their k + 1 smallest ids, which is all that a top-k with ties by id can use;
the entries are dealt to shards by hash. Queries, a stated set, pass each shard, and the shards' exact lists are
merged. There are only as many shards, or blocks of queries where the shards are few, as tasks can run at a time
(shards grow up to SHARD_MOST codes); so what is sent grows with the rows and not with their square up to that many
shards of that size. Beyond, every query still goes to every shard: visits grow as queries times codes / SHARD_MOST.

Defined results: vectors without values have no code, are not found and find nothing; nulls and values that are not
numbers give a 0 bit. Only vectors of equal length are compared. Rows without an id are left out. A vector does not
find itself. Ties go to the smaller id. Repeated rows count once; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, scratch, ship, table

SHARD_CODES, SHARD_MOST, QUERY_BLOCK, SEGMENT = 1 << 16, 1 << 22, 1024, 8


def codes_of(vectors: list) -> list[bytes | None]:
    """Packed sign bits of each vector, whole bytes."""
    return [np.packbits(np.array([x is not None and x > 0 for x in v]), bitorder="little").tobytes() if v else None for v in vectors]


class MultiIndex:
    """Tables of byte segments over codes of ``bits`` bits; ids[i] are the smallest ids that have code i."""

    def __init__(self, codes: list[bytes], ids: list[list[int]], bits: int):
        self.codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -(-bits // SEGMENT))
        self.ids = ids
        self.order = [np.argsort(self.codes[:, s], kind="stable") for s in range(self.codes.shape[1])]
        self.edges = [np.searchsorted(self.codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]
        self.words = _words(self.codes)
        sizes = [min(SEGMENT, bits - SEGMENT * s) for s in range(self.codes.shape[1])]
        self.flips = [[np.array([sum(1 << b for b in c) for c in combinations(range(n), r)], np.int64) for n in sizes] for r in range(SEGMENT + 1)]

    def top(self, code: bytes, own: int, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id), ties by id, without ``own``."""
        q = np.frombuffer(code, np.uint8)
        word, m = _words(q[None]), len(q)
        seen = np.zeros(len(self.codes), bool)
        found: list[tuple[int, int]] = []
        for r in range(SEGMENT + 1):
            parts = []
            for s in range(m):
                edge, order = self.edges[s], self.order[s]
                for v in (int(q[s]) ^ self.flips[r][s]).tolist():
                    parts.append(order[edge[v] : edge[v + 1]])
            if not parts:  # the radius covers whole segments: every code has been seen
                break
            new = np.concatenate(parts)
            fresh = np.zeros(len(seen), bool)
            fresh[new] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            if len(at):
                distance = np.bitwise_count(self.words[at] ^ word).sum(1, dtype=np.int64)
                limit = np.partition(distance, k)[k] if len(at) > k + 1 else distance.max()
                if len(found) >= k:
                    limit = min(limit, found[k - 1][0])
                for i, d in zip(at[distance <= limit].tolist(), distance[distance <= limit].tolist()):
                    found += [(d, x) for x in self.ids[i] if x != own]
                found = sorted(found)[: k + 1]
            if len(found) >= k and found[k - 1][0] <= m * (r + 1) - 1:
                break
        return found[:k]


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view("<u8")


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance). Both frames have vec_id and embedding."""
    spark = index.sparkSession
    ship(spark)
    code_schema = pa.schema([("vec_id", pa.int64()), ("bits", pa.int32()), ("code", pa.binary())])

    def encode(batches):
        for b in batches:
            vectors = b.column(1).to_pylist()
            yield batch({"vec_id": b.column(0), "bits": [len(v or ()) for v in vectors], "code": codes_of(vectors)}, code_schema)

    coded = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(encode, "vec_id long, bits int, code binary").dropna().distinct()
    least = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    # A code's ids meet in a few lists of k + 1 at most, however many rows have it.
    salted = coded(index).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", F.row_number().over(Window.partitionBy("bits", "code", "salt").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = scratch(salted.groupBy("bits", "code").agg(least(F.collect_list("vec_id")).alias("ids")), "codes")
    asked = scratch(coded(queries), "queries")
    tasks, codes, wanted = 2 * spark.sparkContext.defaultParallelism, entries.count(), asked.count()
    shards = max(1, min(-(-codes // SHARD_CODES), tasks), -(-codes // SHARD_MOST))
    blocks = max(1, min(-(-wanted // QUERY_BLOCK), tasks // shards))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = entries.select("bits", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), "code", "ids").withColumn("block", every(blocks))
    put = asked.select("bits", "vec_id", "code", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("ids")).withColumn("shard", every(shards))
    out_schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int32())])

    def search(batches):
        key, codes, ids, tables = None, [], [], None
        for b in batches:
            rows = []
            for bits, shard, block, kind, vec, code, own in zip(*(b.column(c).to_pylist() for c in ("bits", "shard", "block", "kind", "vec_id", "code", "ids"))):
                if (bits, shard, block) != key:
                    key, codes, ids, tables = (bits, shard, block), [], [], None
                if not kind:
                    codes.append(code)
                    ids.append(own)
                elif codes:
                    tables = tables or MultiIndex(codes, ids, bits)
                    rows += [(vec, i, d) for d, i in tables.top(code, vec, k)]
            yield batch({n: [r[c] for r in rows] for c, n in enumerate(out_schema.names)}, out_schema)

    at = ["bits", "shard", "block"]
    found = dealt.unionByName(put).repartition(*at).sortWithinPartitions(*at, "kind").mapInArrow(search, "query_id long, neighbor_id long, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op4_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 20 = 0"), 10)


OP4_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE len(embedding) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, n.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM codes q JOIN codes n ON q.vec_id % 20 = 0 AND q.vec_id <> n.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
  FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""
