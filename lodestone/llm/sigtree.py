"""Jaccard join of word shingles by signature trees (operator 10).

A document's set holds the hashes of its five-word shingles. Two sets link when their similarity reaches
the threshold; documents with equal sets are one class and components are formed over classes.

1. Prefixes. Shingles are ordered by how common they are (a counting sketch of fixed size over all
   documents) and then by hash. Two sets that link share a shingle in their first n - ceil(t n) + 1.
   A task gives each class once, however many copies of it it has read.
2. Leaders. Rows (shingle, class) are sorted by shingle on their shuffle partition and read as a stream: each
   class is paired with the first class of each of its prefix shingles. The rows of a common shingle are
   dealt into slots by class, with a leader each, and the slots' leaders are paired in turn. Each class is
   checked with the leader with which it shares most, and with others only if it is still apart from them. That
   joins large groups of near copies by about as many checks as they have members.
3. Trees. Only shingles whose classes lie in different components are left. The classes of such a shingle
   form a signature tree: leaves hold bitmaps of the prefix shingles, inner nodes the OR of their children
   with the range of sizes. A dual traversal drops node pairs whose largest possible overlap is too small, and
   single pairs by the places of their shingle and bitmaps of the whole sets besides.
   Large groups are dealt out as pairs of blocks, so that no task holds more than two blocks. A class that
   leads a shingle's only slot has met all others there and is left out.
   Each class is checked with its best partners of every tree first; what is possible after that, across the
   components that then remain, is checked whole.
4. Checks. Bitmaps of the whole sets, of two to four bits a shingle, bound the overlap of a pair: each bit that
   differs is a shingle that one set lacks. The pairs that pass are checked exactly: the compressed text of one
   document of each class travels to its pair's more frequent class, in blocks of at most HUB pairs, and the
   sets are made anew there, one of the hub and one of a pair at a time.

Nothing is dropped for being frequent. No link between different sets is lost: a pair of classes that is
never compared is already connected, or shares no prefix shingle, or cannot reach the threshold. A class is
known by 64 bits of its set's 128-bit hash; classes that these bits would join are known by the other half.

Defined results: texts without words and null texts have an empty set, link with nothing and are their own
component; fewer than five words are one shingle of the whole sequence. Repeated rows have equal sets and
so one component. component_id is the smallest doc_id of the component, nulls left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, batch, discard, fresh, key_bitmap, restrict, scratch, ship, slices, table, tidied, without, word_hashes
from .components import components

WIDTH = 5
SKETCH = 1 << 20  # counters
SKETCH_BLOCK = 1 << 12
BITS = 512  # of a prefix bitmap
BLOCK = 2048  # classes of a group in a task, twice
HUB = 256  # pairs that one task checks against a copy of a class's text
WHOLE_BITS = 1 << 18  # of a whole set's bitmap, at most
LEAF, FAN = 16, 8
PARTNERS = 2  # of a class in a tree, in the round before all that is possible is checked
SMALL = 48  # classes of a group that are compared without a tree
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. texts: strings, or an Arrow column of them."""
    flat, sizes = word_hashes(texts, lower=True)
    grams = np.zeros(0, np.uint64)
    if len(flat) >= WIDTH:
        grams = _mix(sum(flat[i : len(flat) - WIDTH + 1 + i] * _ODD[i] for i in range(WIDTH)))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WIDTH:
            own = np.sort(grams[at : at + n - WIDTH + 1])
            new = own[1:] != own[:-1]
            out.append(own if new.all() else own[np.concatenate([[True], new])])
        elif n:
            out.append(_mix((flat[at : at + n] * _ODD[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlap_needed(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class Order:
    """The global order of shingles: level of commonness, then hash."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def prefix(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        level = self.level(shingles)
        chosen = shingles if not level.any() else shingles[np.argsort(level, kind="stable")]
        return chosen[: prefix_size(len(shingles), percent)]

    def level(self, shingles: np.ndarray) -> np.ndarray:
        return self.levels[(shingles >> np.uint64(44)).astype(np.int64)]


def _text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key finds the text again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two longs."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)


def _names(sets: list[np.ndarray], clashes: frozenset) -> np.ndarray:
    """The name of each set's class: half of its signature, or the other half where the first has clashed."""
    both = _signatures(sets)
    out = both[:, 0].copy()
    for i in np.flatnonzero(np.isin(out, list(clashes))) if clashes else ():
        out[i] = both[i, 1]
    return out


def _describe(batches):
    """Rows of documents, and at the end of a partition the blocks of its counters (block is not null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
    total = np.zeros(SKETCH, np.uint32)
    for b in slices(batches):
        sets = shingle_sets(b.column(1))
        both, empty = _signatures(sets), np.array([not len(s) for s in sets])
        h = np.concatenate([*sets, np.zeros(0, np.uint64)])
        total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(both[:, 0], mask=empty), pa.array(both[:, 1], mask=empty), pa.array([len(s) for s in sets], pa.int32()), *none], schema=schema)
    blocks = total.reshape(-1, SKETCH_BLOCK)
    some = np.flatnonzero(blocks.any(1))
    if len(some):
        none = {c: pa.nulls(len(some), schema.field(c).type) for c in ("doc_id", "key", "hi", "lo", "n")}
        yield batch(none | {"block": some.astype(np.int32), "counts": [blocks[i].tobytes() for i in some]}, schema)


def _add_counts(batches):
    """Sums of the blocks, which come sorted by block."""
    schema, at, total = pa.schema([("block", pa.int32()), ("counts", pa.binary())]), None, None
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1)):
            if k != at:
                if at is not None:
                    yield batch({"block": [at], "counts": [total.tobytes()]}, schema)
                at, total = k, np.zeros(SKETCH_BLOCK, np.uint64)
            total += np.frombuffer(c.as_buffer(), "<u4")
    if at is not None:
        yield batch({"block": [at], "counts": [total.tobytes()]}, schema)


def common_levels(described: DataFrame) -> np.ndarray:
    """A level for each counter of a sketch of all shingles of all documents: 0, or more the commoner it is.

    A shingle of level n > 0 has less than 2**n times the rows of one that is just not common.
    """
    rows = _streamed(described.filter("block IS NOT NULL").select("block", "counts"), ["block"], _add_counts, "block int, counts binary").collect()
    counts = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint64)
    for r in rows:  # as many blocks as the sketch has: 8 MB
        counts[r["block"]] = np.frombuffer(r["counts"], "<u8")
    floor = 4 * counts.mean() + 32
    return np.maximum(0, np.floor(np.log2(np.maximum(counts.ravel(), 1) / floor)) + 1).astype(np.uint8)


def _first_of_task(texts: pa.Array, clashes: frozenset, seen: set):
    """(class, set) of the sets that are not empty and that this task has not had yet."""
    sets = [s for s in shingle_sets(texts) if len(s)]
    out = []
    for name, s in zip(_names(sets, clashes).tolist(), sets):
        if name not in seen:
            seen.add(name)
            out.append((name, s))
    return out


def _streamed(rows: DataFrame, keys: list[str], run, schema: str, order: list[str] | None = None) -> DataFrame:
    """Rows of a key follow each other, sorted, on one partition and pass through ``run`` as a stream."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(tidied(run), schema)


def _shared(batches):
    """From rows (token, slot, sig, n, q) sorted by token, slot and sig: the classes that follow the first one of a
    slot, with it; and the first ones of common shingles' slots (slot > 0), without a leader."""
    schema = pa.schema([("token", pa.int64()), ("slot", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("q", pa.int32()), ("leader", pa.int64()), ("leader_n", pa.int32())])
    last = None  # token, slot, last sig, leader, its size
    for b in batches:
        if not b.num_rows:
            continue
        token, slot, sig, n, q = (b.column(i).to_numpy() for i in range(5))
        new = np.empty(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (slot[1:] != slot[:-1])
        new[0] = last is None or token[0] != last[0] or slot[0] != last[1]
        same = np.zeros(len(token), bool)
        same[1:] = ~new[1:] & (sig[1:] == sig[:-1])
        same[0] = not new[0] and sig[0] == last[2]
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        leader = np.where(start >= 0, sig[start], last[3] if last else 0)
        leader_n = np.where(start >= 0, n[start], last[4] if last else 0)
        keep = (~new & ~same & (sig != leader)) | (new & (slot > 0))
        last = (token[-1], slot[-1], sig[-1], leader[-1], leader_n[-1])
        if keep.any():
            first = new[keep]
            yield batch({"token": token[keep], "slot": slot[keep], "sig": sig[keep], "n": n[keep], "q": q[keep], "leader": pa.array(leader[keep], mask=first), "leader_n": pa.array(leader_n[keep].astype(np.int32), mask=first)}, schema)


def _bitmap(prefix: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(prefix & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def whole_bitmap(shingles: np.ndarray, bits_each: int = 2) -> bytes:
    """A bitmap of the whole set, of up to twice ``bits_each`` bits a shingle (fewer for sets beyond WHOLE_BITS)."""
    bits = np.zeros(min(WHOLE_BITS, max(64, 1 << (bits_each * len(shingles) - 1).bit_length())), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(a: bytes, na: int, b: bytes, nb: int) -> int:
    """The largest intersection that two sets' bitmaps allow; the longer one is folded to the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while size > 8 * len(a):
        size >>= 1
        y = (y >> size) | (y & ((1 << size) - 1))
    return (na + nb - (x ^ y).bit_count()) // 2


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets' bitmaps leave a link possible."""
    left, right = (maps.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("whole").alias(f"m{x}")) for x in "ab")

    def run(batches):
        for t in batches:
            na, nb = (t.column(f"n{x}").to_pylist() for x in "ab")
            most = [most_overlap(x.as_py(), i, y.as_py(), j) for x, i, y, j in zip(t.column("ma"), na, t.column("mb"), nb)]
            ok = [m >= overlap_needed(i, j, percent) for m, i, j in zip(most, na, nb)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(tidied(run), "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes in different components."""
    one, two = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _shared_values(x, y) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _check(pairs: DataFrame, src: DataFrame, classes: DataFrame, clashes: frozenset, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by the whole texts of one document of each class."""
    spark = pairs.sparkSession
    degree = scratch(pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("pairs")), "degrees")
    held = spark.sparkContext.broadcast(key_bitmap(classes.join(degree, "sig", "left_semi"), "key"))  # 8 MB
    text_schema = pa.schema([("sig", pa.int64()), ("data", pa.binary())])

    def gather(batches):
        import zstandard

        bits, seen, pack = np.frombuffer(held.value, np.uint8), set(), zstandard.ZstdCompressor(3)
        for b in batches:
            at = b.column(1).to_numpy()
            wanted = b.select(["text"]).filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for t in slices([wanted]):
                sets = shingle_sets(t.column(0))
                made = {name: i for i, (name, s) in enumerate(zip(_names(sets, clashes).tolist(), sets)) if len(s) and name not in seen}
                seen |= made.keys()
                if made:
                    yield batch({"sig": list(made), "data": [pack.compress(t.column(0)[i].as_buffer()) for i in made.values()]}, text_schema)

    found = src.select("text", F.pmod(F.xxhash64("key"), F.lit(BITMAP_BITS)).alias("at")).mapInArrow(gather, "sig long, data binary")
    texts = scratch(found.join(degree.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "pair-texts")
    # The class with more pairs is a pair's hub; the pairs of a hub are dealt into slots.
    one, two = (degree.select(F.col("sig").alias(x), F.col("pairs").alias(f"{x}_pairs")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    is_hub = F.col("a_pairs") >= F.col("b_pairs")
    hubbed = both.select(F.when(is_hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(is_hub, F.col("b")).otherwise(F.col("a")).alias("sig"), F.ceil(F.greatest("a_pairs", "b_pairs") / HUB).alias("slots"))
    dealt = scratch(hubbed.select("hub", F.pmod(F.xxhash64("sig"), F.col("slots")).cast("int").alias("slot"), "sig"), "dealt-pairs")
    hubs = dealt.select("hub", "slot").distinct().join(texts.withColumnRenamed("sig", "hub"), "hub").select("hub", "slot", F.lit(0).alias("kind"), F.col("hub").alias("sig"), "data")
    rows = hubs.unionByName(dealt.join(texts, "sig").select("hub", "slot", F.lit(1).alias("kind"), "sig", "data"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        import zstandard

        unpack, hub, own = zstandard.ZstdDecompressor(), None, None
        for t in slices(batches, 64):
            sets = shingle_sets([unpack.decompress(x.as_buffer()).decode() for x in t.column("data")])
            links = []
            for h, kind, sig, s in zip(t.column("hub").to_pylist(), t.column("kind").to_pylist(), t.column("sig").to_pylist(), sets):
                if not kind:
                    hub, own = h, s
                    continue
                assert h == hub
                if 100 * (same := _shared_values(own, s)) >= percent * (len(own) + len(s) - same):
                    links.append((min(h, sig), max(h, sig)))
            if links:
                yield batch({"a": [p[0] for p in links], "b": [p[1] for p in links]}, schema)

    links = scratch(_streamed(rows, ["hub", "slot"], run, "a long, b long", ["kind"]), "links")
    discard(degree, texts, dealt)
    held.destroy()
    return links


class Level:
    """Nodes of one height of a signature tree, as arrays.

    bits: bitmaps; low, high: sizes; rest: most shingles outside the prefix; spare: most prefix shingles that
    set no bit of their own; part: the component, if ``mixed`` is not set.
    """

    def __init__(self, bits, low, high, rest, spare, part, mixed):
        self.bits, self.low, self.high, self.rest, self.spare, self.part, self.mixed = bits, low, high, rest, spare, part, mixed

    def __len__(self):
        return len(self.low)

    def up(self, fan: int) -> "Level":
        at = np.arange(0, len(self), fan)
        mixed = (np.minimum.reduceat(self.part, at) != np.maximum.reduceat(self.part, at)) | np.logical_or.reduceat(self.mixed, at)
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.rest, at), np.maximum.reduceat(self.spare, at), self.part[at], mixed)

    def possible(self, other: "Level", i, j, percent: int) -> np.ndarray:
        """Of node pairs, those that span components and whose largest possible overlap reaches what their sizes need."""
        ok = (self.part[i] != other.part[j]) | self.mixed[i] | other.mixed[j]
        ok &= (100 * other.high[j] >= percent * self.low[i]) & (100 * self.high[i] >= percent * other.low[j])
        i, j, at = i[ok], j[ok], np.flatnonzero(ok)
        common = np.bitwise_count(self.bits[i] & other.bits[j]).sum(1, dtype=np.int64)
        # Shared prefix shingles set shared bits; beyond the prefixes at most ``rest`` can be shared.
        most = common + np.minimum(self.spare[i], other.spare[j]) + np.maximum(self.rest[i], other.rest[j])
        return at[most >= overlap_needed(self.low[i], other.low[j], percent)]


def _level(n, bitmaps: list[bytes], part, percent: int) -> Level:
    """Single sets as nodes."""
    n = n.astype(np.int64)
    bits = np.frombuffer(b"".join(bitmaps), "<u8").reshape(len(n), -1)
    p = n - -(-percent * n // 100) + 1
    return Level(bits, n, n, n - p, p - np.bitwise_count(bits).sum(1, dtype=np.int64), part, np.zeros(len(n), bool))


def _tree(leaves: Level) -> list[Level]:
    """Levels from the members up to a few roots."""
    levels, fan = [leaves], LEAF
    while len(levels[-1]) > 2 * FAN:
        levels.append(levels[-1].up(fan))
        fan = FAN
    return levels


def tree_pairs(left: Level, right: Level | None, percent: int):
    """Dual traversal: members (i, j) that may link, between two trees or within one (right is None, i < j)."""
    a_tree = _tree(left)
    b_tree = a_tree if right is None else _tree(right)
    height = min(len(a_tree), len(b_tree)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a_tree[height])), np.arange(len(b_tree[height])), indexing="ij"))
    while True:
        a, b = a_tree[height], b_tree[height]
        if right is None:
            once = i < j if height == 0 else i <= j
            i, j = i[once], j[once]
        ok = [a.possible(b, i[k : k + 65536], j[k : k + 65536], percent) + k for k in range(0, len(i), 65536)]
        ok = np.concatenate(ok) if ok else np.zeros(0, int)
        i, j = i[ok], j[ok]
        if height == 0:
            return i, j
        fan = LEAF if height == 1 else FAN
        height -= 1
        i, j = (i[:, None] * fan + np.repeat(np.arange(fan), fan)).ravel(), (j[:, None] * fan + np.tile(np.arange(fan), fan)).ravel()
        inside = (i < len(a_tree[height])) & (j < len(b_tree[height]))
        i, j = i[inside], j[inside]


@lru_cache(SMALL + 1)
def triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are among the PARTNERS best scored ones of i, or of j."""
    keep = np.zeros(len(i), bool)
    for own in (i, j):
        order = np.lexsort((-score, own))
        new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        keep[order[place < PARTNERS]] = True
    return keep


def _tree_run(percent: int, best_only: bool = False):
    """From rows (token, x, y, side, sig, n, q, part, bitmap, half) sorted by their block pair: pairs that may link.

    A pair that links does so at the first shingle that both have, and there at most the shingles from its places q
    on are shared; pairs that cannot link by that, or by their whole sets' bitmaps, are left out.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names, blobs = ["token", "x", "y", "side", "sig", "n", "q", "part"], ["bitmap", "half"]

    def level(t):
        return _level(t["n"], t["bitmap"], t["part"], percent)

    def take(t, at):
        return {k: [v[i] for i in at] if isinstance(v, list) else v[at] for k, v in t.items()}

    def chosen(one, two, i, j, out):
        need = overlap_needed(one["n"][i].astype(np.int64), two["n"][j], percent)
        ok = np.minimum(one["n"][i] - one["q"][i], two["n"][j] - two["q"][j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        left, right, na, nb = one["half"], two["half"], one["n"].tolist(), two["n"].tolist()
        most = np.array([most_overlap(left[x], na[x], right[y], nb[y]) for x, y in zip(i.tolist(), j.tolist())], np.int64)
        ok = most >= need
        if ok.any():
            i, j = i[ok], j[ok]
            if best_only:
                some = _best(i, j if one is two else j + len(one["n"]), (most / need)[ok])
                i, j = i[some], j[some]
            a, b = one["sig"][i], two["sig"][j]
            out.append((np.minimum(a, b), np.maximum(a, b)))

    def group(t, out):
        t = take(t, np.lexsort((t["sig"], t["n"])))
        if t["x"][0] == t["y"][0]:
            chosen(t, t, *tree_pairs(level(t), None, percent), out)
            return
        one, two = (take(t, np.flatnonzero(t["side"] == s)) for s in (0, 1))
        if len(one["n"]) and len(two["n"]):
            chosen(one, two, *tree_pairs(level(one), level(two), percent), out)

    def small(t, spans, out):
        """All pairs within groups of few classes, bounded together."""
        whole, i, j, made = level(t), [], [], 0

        def bound():
            x, y = np.concatenate(i), np.concatenate(j)
            ok = whole.possible(whole, x, y, percent)
            chosen(t, t, x[ok], y[ok], out)

        for s, e in spans:
            x, y = triangle(e - s)
            i.append(x + s)
            j.append(y + s)
            made += len(x)
            if made > 500_000:
                bound()
                i, j, made = [], [], 0
        if made:
            bound()

    def run(batches):
        held = []

        def flush(out):
            group({k: np.concatenate([p[k] for p in held]) for k in names} | {k: [x for p in held for x in p[k]] for k in blobs}, out)

        for b in batches:
            if not b.num_rows:
                continue
            t = {k: b.column(k).to_numpy() for k in names} | {k: b.column(k).to_pylist() for k in blobs}
            out, spans = [], []
            cut = np.flatnonzero((np.diff(t["token"]) != 0) | (np.diff(t["x"]) != 0) | (np.diff(t["y"]) != 0)) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for k, (s, e) in enumerate(zip(edges, edges[1:])):
                if 0 < k < len(edges) - 2 and e - s <= SMALL and t["x"][s] == t["y"][s]:
                    spans.append((s, e))
                    continue
                part = {k: v[s:e] for k, v in t.items()}
                if held and any(held[0][k][0] != part[k][0] for k in ("token", "x", "y")):
                    flush(out)
                    held = []
                held.append(part)
            if spans:
                small(t, spans, out)
            if out:
                yield batch({k: np.concatenate([o[i] for o in out]) for i, k in enumerate("ab")}, schema)
        out = []
        if held:
            flush(out)
        if out:
            yield batch({k: np.concatenate([o[i] for o in out]) for i, k in enumerate("ab")}, schema)

    return run


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    src = _text(docs)
    described = scratch(src.mapInArrow(_describe, "doc_id long, key long, hi long, lo long, n int, block int, counts binary"), "sets")
    held = spark.sparkContext.broadcast(common_levels(described))  # one byte a counter: 1 MB
    rows = described.filter("block IS NULL").drop("block", "counts")
    # Halves of signatures that stand for several sets: n^2 / 2^65 of n sets are to be expected.
    twice = rows.filter("hi IS NOT NULL").groupBy("hi").agg(F.min("lo").alias("p"), F.max("lo").alias("q")).filter("p <> q")
    clashes = frozenset(r["hi"] for r in twice.select("hi").collect())
    slim = rows.select("doc_id", "key", (F.when(F.col("hi").isin(list(clashes)), F.col("lo")).otherwise(F.col("hi")) if clashes else F.col("hi")).alias("sig"), "n")
    # Of each class the smallest id, and the key of one of its texts.
    classes = scratch(slim.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first"), F.min("key").alias("key")), "classes")

    token_schema = pa.schema([("token", pa.int64()), ("slot", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("q", pa.int32())])

    def tokens(batches):
        own, seen = Order(held.value), set()
        for b in slices(batches):
            made = [(name, len(s), own.prefix(s, percent)) for name, s in _first_of_task(b.column(0), clashes, seen)]
            if made:
                size = [len(p) for _, _, p in made]
                token, sig = np.concatenate([p for _, _, p in made]), np.repeat(np.array([m[0] for m in made], np.int64), size)
                level = own.level(token).astype(np.uint64)
                slot = np.where(level > 0, 1 + ((sig.view(np.uint64) >> np.uint64(8)) & ((np.uint64(1) << level) - np.uint64(1))), 0)
                yield batch({"token": token.view(np.int64), "slot": slot.astype(np.int32), "sig": sig, "n": np.repeat(np.array([m[1] for m in made], np.int32), size), "q": np.concatenate([np.arange(k, dtype=np.int32) for k in size])}, token_schema)

    map_schema = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("bitmap", pa.binary()), ("half", pa.binary()), ("whole", pa.binary())])

    def bitmaps(batches):
        own, seen = Order(held.value), set()
        for b in slices(batches):
            made = _first_of_task(b.column(0), clashes, seen)
            if made:
                yield batch({"sig": [m[0] for m in made], "n": [len(m[1]) for m in made], "bitmap": [_bitmap(own.prefix(m[1], percent)) for m in made], "half": [whole_bitmap(m[1], 1) for m in made], "whole": [whole_bitmap(m[1]) for m in made]}, map_schema)

    maps = scratch(src.select("text").mapInArrow(bitmaps, "sig long, n int, bitmap binary, half binary, whole binary").dropDuplicates(["sig"]), "maps")
    shared_columns = "token long, slot int, sig long, n int, q int, leader long, leader_n int"
    in_slots = src.select("text").mapInArrow(tokens, "token long, slot int, sig long, n int, q int")
    shared = scratch(_streamed(in_slots, ["token", "slot"], _shared, shared_columns, ["sig"]), "shared")
    heads = shared.filter("slot > 0 AND leader IS NULL").select("token", F.lit(0).alias("slot"), "sig", "n", "q")
    led = shared.filter("leader IS NOT NULL").unionByName(_streamed(heads, ["token", "slot"], _shared, shared_columns, ["sig"]))
    fits = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    led = scratch(led.filter(fits("n", "leader_n")).groupBy(F.col("leader").alias("a"), F.col("sig").alias("b")).agg(F.count("*").alias("c")), "led")
    # First each class and the leader with which it shares most prefix shingles; the others if that leaves them apart.
    best = scratch(led.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b"), "best-leaders")
    first = scratch(_possible(best, maps, percent), "leader-pairs")
    found = _check(first, src, classes, clashes, percent)
    labels = components(found)

    def trees(labels: DataFrame, best_only: bool) -> DataFrame:
        """Pairs of classes in different components that their shingles' signature trees leave possible."""
        parted = shared.select("token", "sig", "n", "q").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("token", "sig", "n", "q", F.coalesce("label", "sig").alias("part"))
        open_tokens = parted.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).filter("p <> q").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        left = parted.join(open_tokens, "token").select("token", "sig", "n", "q", "part", "blocks")
        own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
        dealt = left.join(maps.select("sig", "bitmap", "half"), "sig").withColumn("own", own)
        dealt = dealt.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("token", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y"), (F.col("own") > F.col("z")).cast("int").alias("side"), "sig", "n", "q", "part", "bitmap", "half")
        return _streamed(dealt, ["token", "x", "y"], _tree_run(percent, best_only), "a long, b long").distinct()

    # Then the other leaders, and in each tree each class's best partners; all that is possible if that leaves them apart.
    others = _apart(led.join(best, ["a", "b"], "left_anti").select("a", "b"), labels)
    second = scratch(_possible(others.unionByName(trees(labels, True).join(best, ["a", "b"], "left_anti")).distinct(), maps, percent), "second-pairs")
    also = _check(second, src, classes, clashes, percent)
    tested, links = first.unionByName(second), found.unionByName(also)
    third = scratch(_possible(trees(components(links), False).join(tested, ["a", "b"], "left_anti"), maps, percent), "third-pairs")
    more = _check(third, src, classes, clashes, percent)

    whole = components(links.unionByName(more))
    named = classes.join(whole.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = scratch(named.join(smallest, "label").select("sig", "component_id"), "component-of")
    discard(classes, maps, shared, led, best, first, second, third, found, also, more)
    return slim.join(of, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the one with the smallest id.

    Documents with an empty set and rows without an id stay. Of rows with one id all stay if any does, but equal
    texts stay once.
    """
    found = scratch(jaccard_components(docs, percent), "components")
    stays = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    own = fresh(docs, "_id")
    gone, again = (by_id.filter(which).select(F.col("doc_id").alias(own)) for which in ("NOT stays", "n > 1"))
    kept = without(docs.withColumn(own, F.col("doc_id").cast("long")), gone, own)
    if again.isEmpty():
        return kept.drop(own)
    once = without(kept, again, own)
    return once.unionByName(restrict(kept, again, own).dropDuplicates([own, "text"])).drop(own)


def op10_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
