"""Exact deduplication by composable polynomial fingerprints (operator 11).

A text's fingerprint is its length in bytes and the polynomial of its bytes at four points, modulo the prime
2^31 - 1. Fingerprints compose: that of two strings end to end is the first one's plus the second one's shifted by
the first one's length, h(xy) = h(x) + B^|x| h(y). So any cutting gives the same number: a worker cuts what it reads
wherever that is handy, and a text of over ``huge`` bytes is dealt in chunks to many tasks, whose shifted hashes are
summed.

Equal fingerprints only propose. Within a task a row is compared with the row of the same fingerprint that the task has
held, which thins out large groups before anything is shuffled; the rows that are left are compared with one of
their group chunk by chunk, in a join on fingerprint and chunk number that streams and never holds a whole group.
Rows whose chunks differ (a collision) form groups of their own in another round, until no row differs.

Defined results: null counts as empty, and so the two are equal. Of equal texts the row with the largest id stays; a null
id is smaller than any other, and of rows with equal texts and ids exactly one stays. Repeated rows count each. Other
columns are carried along, but for those named as a result column, which are replaced. An empty table gives no row.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _forget, batch, discard, key_bitmap, maybe_in, scratch, slices, table, tidied, tidy

PRIME = (1 << 31) - 1
POINTS = (1_103_515_245, 1_812_433_253, 214_748_357, 69_069_069)
WINDOW = 1 << 16  # bytes that are multiplied at once; sums of WINDOW bytes times PRIME fit 64 bits
CHUNK = 1 << 18  # bytes of a row in the comparison
HUGE = 1 << 24
HELD = 32 << 20  # bytes of texts that a task holds for comparison

KEY = ["n_bytes", "fa", "fb"]


class Polynomial:
    """Polynomial hashes of byte strings at the fixed points, modulo ``prime``."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.points = [2 + x % (prime - 2) if prime > 2 else 1 for x in POINTS]
        self.up = [self._table(b) for b in self.points]
        self.down = [self._table(pow(b, -1, prime)) for b in self.points]

    def _table(self, base: int):
        import numpy as np

        out = np.ones(WINDOW, np.uint64)
        have = 1
        while have < WINDOW:
            out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, self.prime)) % np.uint64(self.prime)
            have *= 2
        return out

    def shifted(self, which: int, by):
        """B^by modulo the prime for an array of lengths."""
        import numpy as np

        high, at = np.unique(by >> 16, return_inverse=True)
        far = np.array([pow(self.points[which], int(h) << 16, self.prime) for h in high], np.uint64)
        return far[at] * self.up[which][by & (WINDOW - 1)] % np.uint64(self.prime)

    def many(self, data, edge, offset=None):
        """Hashes (strings x points) of the strings data[edge[i]:edge[i+1]], each shifted by ``offset``."""
        import numpy as np

        p, n = np.uint64(self.prime), len(edge) - 1
        out = np.zeros((n, len(self.points)), np.uint64)
        if not n or edge[-1] == edge[0]:
            return out
        full = np.flatnonzero(edge[1:] > edge[:-1])
        start = np.union1d(edge[full], np.arange(edge[0], edge[-1], WINDOW))
        owner = np.searchsorted(edge, start, "right") - 1
        within = start - edge[owner] + (0 if offset is None else offset[owner])
        place = (start - edge[0]) % WINDOW
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        cut = np.searchsorted(start, np.arange(edge[0], edge[-1], WINDOW))
        for k in range(len(self.points)):
            sums = np.empty(len(start), np.uint64)
            for w, (a, b) in enumerate(zip(cut, [*cut[1:], len(start)])):
                low = edge[0] + w * WINDOW
                part = data[low : min(low + WINDOW, edge[-1])].astype(np.uint64)
                part *= self.up[k][: len(part)]
                sums[a:b] = np.add.reduceat(part, place[a:b])
            sums = sums % p * self.down[k][place] % p * self.shifted(k, within) % p
            out[owner[first], k] = np.add.reduceat(sums, first) % p
        return out


def _edges(column: pa.Array):
    """The bytes of a binary column without nulls, and where each value begins."""
    import numpy as np

    edge = np.frombuffer(column.buffers()[1] or bytes(4), np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) and edge[-1] else np.zeros(0, np.uint8)
    return data, edge


def _halves(h):
    """Two longs of the four hashes."""
    import numpy as np

    return [((h[:, i] << np.uint64(31)) | h[:, i + 1]).astype(np.int64) for i in (0, 2)]


def _leaders(prime: int, schema: pa.Schema):
    """Fingerprint rows (rid, row, text, n_bytes), and name for each the row of this task that it equals."""

    def run(batches):
        _forget()
        poly, held, size = Polynomial(prime), OrderedDict(), 0
        for b in slices(batches, 512, 4_000_000):
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            data, edge = _edges(at["text"])
            fa, fb = _halves(poly.many(data, edge))
            view, same = memoryview(data), []
            for i, (rid, a, c) in enumerate(zip(at["rid"].to_pylist(), fa.tolist(), fb.tolist())):
                text = view[edge[i] : edge[i + 1]]
                key = (len(text), a, c)
                got = held.get(key)
                if got and got[1] == text:  # bytes against bytes
                    held.move_to_end(key)
                    same.append(got[0])
                    continue
                same.append(rid)
                if not got and len(text) <= HELD // 16:
                    held[key] = (rid, bytes(text))
                    size += len(text) + 200
                    while size > HELD:
                        size -= len(held.popitem(last=False)[1][1]) + 200
            yield batch({**at, "fa": fa, "fb": fb, "same_as": same}, schema)
        held.clear()
        tidy()

    return run


def _chunk_hashes(prime: int):
    schema = pa.schema([("rid", pa.int64()), *[(f"h{k}", pa.int64()) for k in range(4)]])

    def run(batches):
        import numpy as np

        poly = Polynomial(prime)
        for b in slices(batches, 512, 4_000_000):
            data, edge = _edges(b.column(2))
            h = poly.many(data, edge, b.column(1).to_numpy()).astype(np.int64)
            yield batch({"rid": b.column(0), **{f"h{k}": h[:, k] for k in range(4)}}, schema)

    return run


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each CHUNK bytes of a text; one for an empty text."""
    count = F.greatest(F.ceil(F.col("n_bytes") / CHUNK), F.lit(1))
    parts = rows.select(*keep, "text", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"))
    return parts.select(*keep, "part", F.expr(f"substring(text, CAST(part * {CHUNK} + 1 AS INT), {CHUNK})").alias("bytes"))


def _fingerprinted(rows: DataFrame, prime: int, huge: int) -> list[DataFrame]:
    """Stored tables (rid, row, text, n_bytes, fa, fb, same_as) that hold all rows together."""
    kinds = {f.name: f for f in rows.schema.fields}
    usual = rows.filter(F.col("n_bytes") <= huge).withColumn("rid", F.monotonically_increasing_id())
    usual = usual.select("rid", "row", "text", "n_bytes")
    more = "fa long, fb long, same_as long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType([*usual.schema.fields, *StructType.fromDDL(more).fields])
    out = [scratch(usual.mapInArrow(tidied(_leaders(prime, to_arrow_schema(made))), made), "prints")]
    long = scratch(rows.filter(F.col("n_bytes") > huge).withColumn("rid", -1 - F.monotonically_increasing_id()).select("rid", *kinds), "long")
    if long.isEmpty():
        discard(long)
        return out
    dealt = _chunks(long, "rid").select("rid", (F.col("part") * CHUNK).alias("offset"), "bytes").repartition("rid", "offset")
    sums = dealt.mapInArrow(tidied(_chunk_hashes(prime)), "rid long, h0 long, h1 long, h2 long, h3 long").groupBy("rid").agg(*[F.pmod(F.sum(f"h{k}"), F.lit(prime)).alias(f"h{k}") for k in range(4)])
    two = lambda i: F.shiftleft(F.col(f"h{i}"), 31).bitwiseOR(F.col(f"h{i + 1}"))
    prints = sums.select("rid", two(0).alias("fa"), two(2).alias("fb"))
    out.append(scratch(long.join(prints, "rid").select("rid", "row", "text", "n_bytes", "fa", "fb", F.col("rid").alias("same_as")), "prints"))
    discard(long)
    return out


def _same_text(leaders: DataFrame) -> list[DataFrame]:
    """Stored tables (rid, rep): the rows that are equal, chunk by chunk, to the row ``rep`` of their fingerprint."""
    groups = scratch(leaders.groupBy(*KEY).agg(F.count("*").alias("k"), F.min("rid").alias("rep")).filter("k > 1"), "groups")
    pending = scratch(maybe_in(leaders.select("rid", *KEY, "text"), key_bitmap(groups, *KEY), *KEY), "pending")
    found = []
    while True:
        own = pending.join(groups.select(F.col("rep").alias("rid")), "rid")
        right = _chunks(own, "rid", *KEY).withColumnsRenamed({"rid": "rep", "bytes": "other"})
        pairs = _chunks(pending, "rid", *KEY).join(right, [*KEY, "part"])
        seen = scratch(pairs.groupBy("rid", "rep").agg(F.bool_and(F.col("bytes") == F.col("other")).alias("equal")), "compared")
        found.append(seen.filter("equal").select("rid", "rep"))
        rest = seen.filter("NOT equal").select("rid")
        if rest.isEmpty():
            discard(pending, groups)
            return found
        later = scratch(pending.join(rest, "rid", "left_semi"), "pending")
        discard(pending, groups)
        pending = later
        groups = scratch(pending.groupBy(*KEY).agg(F.min("rid").alias("rep")), "groups")


RESULT = ["keep_id", "group_size", "kept"]


def classes(docs: DataFrame, prime: int = PRIME, huge: int = HUGE, with_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (their text only if asked for) with keep_id, group_size and kept.

    ``prime`` sets the field of the fingerprints; a small one makes collisions, which cost rounds and no result.
    """
    others = [c for c in docs.columns if c not in RESULT and c != "text"]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.struct("doc_id", *[F.col(f"`{c}`") for c in others if c != "doc_id"]).alias("row"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = _fingerprinted(rows, prime, huge)
    every = stored[0] if len(stored) == 1 else stored[0].unionByName(stored[1])
    best = F.max(F.struct(F.col("row.doc_id").alias("id"), F.col("rid").alias("rid")))
    heads = every.groupBy("same_as").agg(F.count("*").alias("rows"), best.alias("best"))
    equal = None
    for found in _same_text(every.filter("same_as = rid")):
        equal = found if equal is None else equal.unionByName(found)
    heads = scratch(heads.join(equal.withColumnRenamed("rid", "same_as"), "same_as", "left").select("same_as", F.coalesce("rep", "same_as").alias("class"), "rows", "best"), "heads")
    groups = heads.groupBy("class").agg(F.sum("rows").alias("group_size"), F.max("best").alias("stays"))
    told = heads.select("same_as", "class").join(groups, "class").drop("class")
    out = every.join(told, "same_as")
    text = [F.col("text").cast("string").alias("text")] if with_text else []
    return out.select("row.*", *text, F.col("stays.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("stays.rid")).alias("kept"))


def keep_last(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest id, with the columns of ``docs``; a null text comes back as empty."""
    return classes(docs, with_text=True).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])


def op11_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return classes(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
