"""Substring deduplication with repeated-phrase automata (operator 8).

A word goes when a window of 50 words over it also starts in a document with a smaller id.

1. Anchors. Of the 26 runs of 25 words in a window the one with the smallest hash is chosen, so windows that
   repeat have equal anchors, about one for every 13 words. Anchors of two documents or more recur.
2. Windows. Only windows over recurring anchors are hashed; sorted by hash and id they pass as a stream that
   leads each document to an earlier one that has the window, the first of its slot. The windows over a common
   anchor are dealt into slots by document, and the slots' first documents are led on in turn.
3. Passages. The words around recurring anchors of those earlier documents, the confirmed passages, are
   dealt to shards by document.
4. Automata. For each shard an Aho-Corasick automaton is compiled over words as symbols. It holds seeds of
   eight words, the rarest of every 21 starts, so that every window over a passage has a whole seed. The
   documents that share windows with the shard stream through it; the windows over the hits are looked up
   among the passages' windows, each once whether one passage or thousands have the seed, and those whose words
   are equal are the occurrences. Shards with many documents are dealt to several tasks, each with its own copy
   of the automaton: a passage that a third of all documents share is as cheap as any other.

Defined results: null texts have no words; texts of fewer than 50 words lose none. A null id counts as larger
than all others. Rows with equal ids never take words from each other. Rows with equal ids and texts are one text to
the search, and each of them loses the same words. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, batch, bitmap_of, discard, fresh, key_bitmap, maybe_in, restrict, scratch, ship, slices, table, tidied, word_hashes

WINDOW, GRAM, SEED = 50, 25, 8
BLOCK = (WINDOW - SEED + 2) // 2  # starts of which one is a seed
SHARD_WORDS, TASK_DOCS = 1_000_000, 4000
SLOT_ROWS = 256  # rows of a recurring anchor for one slot
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * _powers(_BASE, len(hashes)))])
    h = (total[size:] - total[:-size]) * _powers(_INVERSE, n)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_anchors(grams: np.ndarray) -> np.ndarray:
    """For every window the place of its anchor among the runs of 25 words."""
    span = WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << 20) - 1)
    own = (grams & ~mask) | (np.arange(len(grams), dtype=np.uint64) & mask)
    rows = np.full(-(-len(own) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(own)] = own
    rows = rows.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    at = np.arange(n, dtype=np.int64)
    return at + (((least & mask).astype(np.int64) - at) & ((1 << 20) - 1))


def _flat(texts):
    """Word hashes of texts end to end, each word's text and each text's first word."""
    h, size = word_hashes(texts)
    return h, np.repeat(np.arange(len(size)), size), np.cumsum(size) - size


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The different rows of some columns."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows])
    return [c[new] for c in rows]


def _windows(texts):
    """(word hashes, runs of 25, windows' starts, their anchors, texts, first words)."""
    h, owner, first = _flat(texts)
    grams = runs(h, GRAM)
    anchor = window_anchors(grams)
    whole = np.flatnonzero(owner[: len(anchor)] == owner[WINDOW - 1 :]) if len(anchor) else np.zeros(0, np.int64)
    return h, grams, whole, anchor[whole], owner, first


def _anchor_rows(bitmap=None):
    """Anchors of each text; with a broadcast bitmap only those whose hash may be in it, and where they stand."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), *([("tid", pa.int64()), ("pos", pa.int32())] if bitmap else [])])

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        for b in slices(batches):
            ids, tids = (b.column(c).to_numpy() for c in ("doc_id", "tid"))
            _, grams, _, anchor, owner, first = _windows(b.column("text"))
            at = np.unique(anchor)
            if bitmap:
                bit = grams[at] & np.uint64(BITMAP_BITS - 1)
                at = at[(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if len(at):
                of = owner[at]
                yield batch({"hash": grams[at].view(np.int64), "doc_id": ids[of], **({"tid": tids[of], "pos": (at - first[of]).astype(np.int32)} if bitmap else {})}, schema)

    return run


def _window_rows(batches):
    """(hash, slot, doc_id) of the windows over marked anchors; a mark is 64 times its place, and the anchor's level."""
    schema = pa.schema([("hash", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64())])
    for b in slices(batches):
        ids, marks = b.column("doc_id").to_numpy(), b.column("marks")
        h, _, start, anchor, owner, first = _windows(b.column("text"))
        if not len(start):
            continue
        level = np.full(len(h), -1, np.int64)
        for f, m, n in zip(first, marks, np.bincount(owner, minlength=len(first))):
            m = m.values.to_numpy()
            m = m[m >> 6 < n]
            level[f + (m >> 6)] = m & 63
        start, level = start[level[anchor] >= 0], level[anchor][level[anchor] >= 0]
        if len(start):
            doc = ids[owner[start]]
            mixed = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            slot = np.where(level > 0, 1 + (mixed & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))).astype(np.int64), 0)
            # A text's equal windows count once.
            own, found, slot = _distinct(doc, runs(h, WINDOW)[start].view(np.int64), slot)
            yield batch({"hash": found, "slot": slot, "doc_id": own}, schema)


def _led(batches):
    """From rows (hash, slot, doc_id), sorted: each later document with the first one of its slot, as its owner; and
    the first ones of slots above 0, without an owner, for the next turn."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.int64())])
    last = None  # hash, slot, first document
    for b in batches:
        if not b.num_rows:
            continue
        h, slot, doc = (b.column(c).to_numpy() for c in ("hash", "slot", "doc_id"))
        new = np.empty(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (slot[1:] != slot[:-1])
        new[0] = last is None or h[0] != last[0] or slot[0] != last[1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        owner = np.where(start >= 0, doc[start], last[2] if last else 0)
        last = (h[-1], slot[-1], owner[-1])
        later, first = doc > owner, new & (slot > 0)
        if later.any():
            of, by = _distinct(doc[later], owner[later])
            yield batch({"hash": pa.nulls(len(of), pa.int64()), "doc_id": of, "owner": by}, schema)
        if first.any():
            yield batch({"hash": h[first], "doc_id": doc[first], "owner": pa.nulls(int(first.sum()), pa.int64())}, schema)


class Shard:
    """Passages of earlier documents, the automaton over their seeds, and their windows by hash."""

    def __init__(self):
        self.owners, self.words, self.automaton = [], [], None

    def add(self, owner: int, words: np.ndarray):
        self.owners.append(owner)
        self.words.append(words)

    @staticmethod
    def symbols(hashes: np.ndarray) -> str:
        """One character a word; words that fall together give hits whose windows are not found."""
        return (hashes % np.uint64(0xF0000) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")

    def compile(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        seeds = [runs(w, SEED) for w in self.words]
        kinds, at, count = np.unique(np.concatenate([*seeds, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        common, edge = count[at], 0
        for w, s in zip(self.words, seeds):
            own = common[edge : edge + len(s)]
            edge += len(s)
            text = self.symbols(w)
            for a in range(0, len(s) - BLOCK + 1, BLOCK):
                i = a + int(own[a : a + BLOCK].argmin())
                self.automaton.add_word(text[i : i + SEED])
        self.automaton.make_automaton()
        # Of equal windows the one with the smallest owner: where it begins in the passages end to end.
        size = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        found = np.concatenate([*(runs(w, WINDOW) for w in self.words), np.zeros(0, np.uint64)])
        n = np.maximum(size - WINDOW + 1, 0)
        place = np.arange(len(found)) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)
        owner = np.repeat(np.array(self.owners, np.int64), n)
        order = np.lexsort((owner, found))
        first = np.ones(len(order), bool)
        first[1:] = found[order][1:] != found[order][:-1]
        order = order[first]
        self.windows, self.places, self.firsts = found[order], place[order], owner[order]
        self.owners, self.words = [], []

    def occurrences(self, doc: int, hashes: np.ndarray) -> np.ndarray:
        """Which words lie in a run of 50 or more that also lies in a passage of an earlier document.

        The windows over the automaton's hits are looked up, each once, however many passages have its seeds.
        """
        covered = np.zeros(len(hashes), bool)
        if self.automaton is None:
            self.compile()
        if len(hashes) < WINDOW or not len(self.automaton) or not len(self.windows):
            return covered
        seed = np.fromiter((end for end, _ in self.automaton.iter(self.symbols(hashes))), np.int64) - (SEED - 1)
        start = np.flatnonzero(_spread(np.maximum(seed + SEED - WINDOW, 0), seed + 1, len(hashes) - WINDOW + 1))
        wanted = runs(hashes, WINDOW)[start]
        at = np.minimum(np.searchsorted(self.windows, wanted), len(self.windows) - 1)
        ok = (self.windows[at] == wanted) & (self.firsts[at] < doc)
        start, place = start[ok], self.places[at[ok]]
        # Equal hashes are no proof yet: the words are compared.
        same = np.ones(len(start), bool)
        for i in range(WINDOW):
            same &= hashes[start + i] == self.flat[place + i]
        return _spread(start[same], start[same] + WINDOW, len(hashes))


def _spread(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie between some begin and its end."""
    step = np.bincount(np.minimum(begins, n), minlength=n + 1) - np.bincount(np.minimum(ends, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _passages(batches):
    """Words around recurring anchors, joined where they meet."""
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int64()))])
    for b in slices(batches):
        ids, words = [], []
        flat, size = word_hashes(b.column("text"))
        for d, h, marks in zip(b.column("doc_id").to_pylist(), np.split(flat, np.cumsum(size)[:-1]), b.column("marks").to_pylist()):
            near = np.zeros(len(h) + 1, np.int64)
            m = np.array(marks, np.int64) >> 6
            m = m[m < len(h)]
            np.add.at(near, np.maximum(m - (WINDOW - GRAM), 0), 1)
            np.add.at(near, np.minimum(m + WINDOW, len(h)), -1)
            inside = np.concatenate([[False], np.cumsum(near)[:-1] > 0, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            for x, y in zip(edge[::2], edge[1::2]):
                if y - x >= WINDOW:
                    ids.append(d)
                    words.append(h[x:y].view(np.int64))
        if ids:
            yield batch({"doc_id": ids, "words": words}, schema)


def _locate(batches):
    """From a shard's passages (kind 0) and then documents (kind 1): spans of words to remove."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    key, shard = None, None
    for b in slices(batches):
        rows = {n: [] for n in schema.names}
        flat, size = word_hashes(b.column("text"))
        plain = (b.column(n).to_pylist() for n in ("shard", "salt", "kind", "doc_id", "tid"))
        for s, salt, kind, d, tid, words, h in zip(*plain, b.column("words"), np.split(flat, np.cumsum(size)[:-1])):
            own = (s, salt)
            if own != key:
                key, shard = own, Shard()
            if not kind:
                shard.add(d, words.values.to_numpy().view(np.uint64))
                continue
            covered = np.concatenate([[False], shard.occurrences(d, h), [False]])
            edge = np.flatnonzero(covered[1:] != covered[:-1]).astype(np.int32)
            if len(edge):
                for n, v in zip(schema.names, (d, tid, edge[::2], edge[1::2])):
                    rows[n].append(v)
        if rows["tid"]:
            yield batch(rows, schema)


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, begins, ends): spans of words to remove, from the columns doc_id, tid and text.

    tid tells apart texts that share an id. A document may have several rows; its spans may overlap.
    """
    spark = docs.sparkSession
    ship(spark)
    anchors = docs.mapInArrow(_anchor_rows(), "hash long, doc_id long")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / SLOT_ROWS))).cast("int")
    recurring = anchors.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), level.alias("level"))
    recurring = scratch(recurring.filter("first <> last").select("hash", "level"), "recurring")
    held = spark.sparkContext.broadcast(bitmap_of(recurring, F.pmod("hash", F.lit(BITMAP_BITS))))  # 8 MB
    marks = docs.mapInArrow(_anchor_rows(held), "hash long, doc_id long, tid long, pos int").join(recurring, "hash")
    by_doc = scratch(marks.groupBy("doc_id", "tid").agg(F.collect_set(F.col("pos") * F.lit(64) + F.col("level")).alias("marks")), "marks-by-doc")
    discard(recurring)
    held.destroy()
    marked = scratch(restrict(docs, by_doc, "doc_id", "tid", once=True).join(by_doc, ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"]), "marked")

    led = lambda rows: rows.repartition("hash", "slot").sortWithinPartitions("hash", "slot", "doc_id").mapInArrow(tidied(_led), "hash long, doc_id long, owner long")
    turn = scratch(led(marked.select("doc_id", "text", "marks").mapInArrow(_window_rows, "hash long, slot long, doc_id long")).distinct(), "turns")
    heads = turn.filter("owner IS NULL").select("hash", F.lit(0).cast("long").alias("slot"), "doc_id")
    routes = scratch(turn.filter("owner IS NOT NULL").unionByName(led(heads)).select("doc_id", "owner").distinct(), "routes")

    shards = max(1, (by_doc.agg(F.sum(F.size("marks"))).first()[0] or 0) * 14 // SHARD_WORDS)
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    to = scratch(routes.select("doc_id", shard("owner").alias("shard")).distinct(), "routes-by-shard")
    tasks = to.groupBy("shard").agg(F.ceil(F.count("*") / TASK_DOCS).cast("int").alias("salts"))
    owners = routes.select(F.col("owner").alias("doc_id")).distinct()
    passages = marked.join(owners, "doc_id", "left_semi").mapInArrow(_passages, "doc_id long, words array<long>").withColumn("shard", shard("doc_id"))
    texts = marked.select("doc_id", "tid", "text").join(to, "doc_id")
    both = (
        passages.join(tasks, "shard")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("shard", "salt", F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("long").alias("tid"), "words", F.lit(None).cast("string").alias("text"))
        .unionByName(texts.join(tasks, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "tid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "tid", F.lit(None).cast("array<long>").alias("words"), "text"))
    )
    found = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_locate, "doc_id long, tid long, begins array<int>, ends array<int>")
    spans = scratch(found, "spans")
    discard(by_doc, marked, turn, routes, to)
    return spans


def _with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that keep all words, and the others; after their columns the spans' begins and ends."""
    key, tid, begins, ends = (fresh(docs, c) for c in ("_key", "_tid", "_begins", "_ends"))
    text = F.col("text").cast("string")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST).cast("long")), tid: F.xxhash64(text)})
    found = find_repeats(keyed.select(F.col(key).alias("doc_id"), F.col(tid).alias("tid"), text.alias("text")))
    spans = scratch(found.groupBy(F.col("doc_id").alias(key), F.col("tid").alias(tid)).agg(F.flatten(F.collect_list("begins")).alias(begins), F.flatten(F.collect_list("ends")).alias(ends)), "spans-by-doc")
    discard(found)
    bitmap = key_bitmap(spans, key, tid)
    # Not by broadcast: what cuts the texts would share its stage with the filter, and each core would need two Python
    # workers. Spark uses all workers it has in turn, so each of them would go on to hold the later stages' caches.
    whole = maybe_in(keyed, bitmap, key, tid, keep=False).select(*docs.columns)
    return whole, maybe_in(keyed, bitmap, key, tid).join(spans.hint("merge"), [key, tid], "left").select(*docs.columns, begins, ends)


def _kept(text: str | None, begins, ends) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by blanks."""
    words = words_of(text)
    if not begins:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words), bool)
    for a, z in zip(begins, ends):
        gone[a:z] = True
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def digest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in slices(batches):
            spans = [c.to_pylist() for c in b.columns[2:]] or [[None] * b.num_rows] * 2
            rows = [_kept(t, x, y) for t, x, y in zip(b.column(1).to_pylist(), *spans)]
            yield batch({"doc_id": b.column(0), "n_words": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "kept_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows]}, schema)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole, cut = _with_spans(src)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return whole.select("doc_id", "text").mapInArrow(run, out).unionByName(cut.mapInArrow(run, out))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of documents that lose words made of the kept words joined by blanks.

    All columns stay; n_chars, if there, follows the new text. Other documents are left as they are.
    """
    whole, cut = _with_spans(docs)
    at, columns = docs.columns.index("text"), docs.columns
    place = {c: i for i, c in enumerate(columns)}

    def run(batches):
        for b in slices(batches):
            texts, fields = pc.cast(b.column(at), pa.string()).to_pylist(), list(b.columns[: len(columns)])
            made = [t if not x else _kept(t, x, y)[2].decode() for t, x, y in zip(texts, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            fields[at] = pa.array(made, b.schema.field(at).type)
            if "n_chars" in place:
                old = fields[place["n_chars"]]
                fields[place["n_chars"]] = pa.array([o if m is t else len(m) for o, t, m in zip(old.to_pylist(), texts, made)], old.type)
            yield pa.RecordBatch.from_arrays(fields, names=columns)

    return whole.unionByName(cut.mapInArrow(run, docs.schema))


def op8_substring(spark, sf_dir):
    return digest_documents(table(spark, sf_dir, "documents"))
