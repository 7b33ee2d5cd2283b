"""Harmonic packing of token sequences (operator 7).

Lengths fall into reciprocal-capacity classes: class k holds documents of more than capacity / (k + 1) and up to
capacity / k tokens, for k = 1, 2, 3, ..., and each of its bins takes exactly k of them; the last class takes all that
are shorter. A document is cut in two cases only: what exceeds the capacity gives whole sequences first, and
the rest that a bin has left once it holds its k documents is filled with the head of those that come next. So
a full bin has no padding, and there is about one cut for each sequence. Every worker fills its own bins: no
shuffle, no shared state. At the end of a partition the documents that are left, fewer than k in class k, are
put end to end into whole sequences; what remains is cut to powers of two, at most eleven sequences that are
shorter than the capacity and need no padding either.

Defined results: a null text is an empty one; an empty document is its end id alone. Repeated rows are
packed each. An empty table gives no pieces. sequence_id is the partition's number times 2**33 plus a
counter, the same again when a lost partition is computed anew from the same input.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cached, gather, ship, slices, table, tidied

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64  # twice: words seen again, and new ones; about 100 MB a worker
#: Texts with characters from here on keep their case: only below it are lower-casing and composing sure to commute.
BEYOND = re.compile("[^\x00-\u024f]")
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordTokenizer:
    """Ids of texts from a cache of their words.

    The tokenizer's normaliser composes, lower-cases and collapses white space, and its pre-tokenizer drops
    white space: nothing reaches across an ASCII blank, so words between blanks are encoded on their own. A
    word of Latin letters is one pre-token, with the ids of its lower-case form, and a run of ASCII marks
    other than apostrophes after it is another; such words are encoded many at a time and cut where a token
    ends a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The model without normaliser and patterns, for words of lower-case composed Latin letters.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Words seen again, and words seen once so far; the latter make room first.
        self.held: dict[str, bytes] = {"": b""}
        self.young: dict[str, bytes] = {}

    def _batch(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        tokenizer = self.bare if bare else self.tokenizer
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(e.ids, "<u4") for e in run(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, ids in zip(groups, self._batch([" ".join(g) for g in groups], bare=True)):
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            if len(cuts) != len(group) + 1 or cuts[-1] != len(data):
                raise ValueError("the tokenizer does not end each word with one token")
            out.update(zip(group, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks."""
        held, young, plain, cores, others = self.held, self.young, [], set(), set()
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                cores.add(w)
                continue
            m = PLAIN.match(w)
            core = m[1].lower() if m else ""
            if m and len(core) == len(m[1]):
                plain.append((w, core, m[2]))
                cores.add(core)
                others.add(m[2])
            else:
                others.add(w)
        get = lambda w: held.get(w, young.get(w))
        made = {w: x for w in (*cores, *others) if (x := get(w)) is not None}
        made.update(self._plain([c for c in cores if c not in made]))
        others = [x for x in others if x not in made]
        made.update(zip(others, [i.tobytes() for i in self._batch(others)]))
        made.update([(w, made[core] + made[tail]) for w, core, tail in plain])
        if len(young) + len(made) > CACHE_ENTRIES:
            young = self.young = {}
        young.update((w, x) for w, x in made.items() if len(w) <= CACHE_CHARS)
        return made

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        folded = [self._fold(t).replace("\n", " ").replace("\t", " ").replace("\r", " ") if t else "" for t in texts]
        lists = pc.split_pattern(pa.array(folded, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.held) > CACHE_ENTRIES:
            self.held = {"": b""}
        held, young = self.held, self.young
        found, new = [*map(held.get, words)], []
        for i, x in enumerate(found):
            if x is None:
                if (x := young.get(words[i])) is None:
                    new.append(i)
                else:
                    found[i] = held[words[i]] = x
        if new:
            made = self._learn([words[i] for i in new])
            for i in new:
                found[i] = made[words[i]]
        ids, edge = gather(found, coded.indices.to_numpy())
        rows = edge[lists.offsets.to_numpy()]
        return [ids[i:j].tobytes() for i, j in zip(rows, rows[1:])]

    @staticmethod
    def _fold(text: str) -> str:
        """Lower case, as the normaliser would make it; a text that may hold a special token's string stays."""
        return text if "<|" in text or (not text.isascii() and BEYOND.search(text)) else text.lower()


class HarmonicPacker:
    """Fills the bins of one worker. ``capacity`` is a power of two, and the tokens are 4 bytes each.

    A part is (doc, start, ids, tokens of the document); at most classes + 1 bins are open.
    """

    def __init__(self, capacity: int, base: int, classes: int = 64):
        if capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.classes, self.next = capacity, min(classes, capacity), base
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple] = []  # a bin that holds its number of documents, and what it lacks
        self.gap = 0

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Place a document. Rows of the bins that are now full."""
        out, at, total = [], 0, len(ids) // 4

        def cut(n: int) -> tuple:
            nonlocal at
            at += n
            return doc, at - n, ids[4 * (at - n) : 4 * at], total

        if self.gap:
            n = min(self.gap, total)
            self.short.append(cut(n))
            self.gap -= n
            if not self.gap:
                out += self._close(self.short)
                self.short = []
        while total - at >= self.capacity:
            out += self._close([cut(self.capacity)])
        if rest := total - at:
            k = min(self.classes, self.capacity // rest)
            bin = self.open.setdefault(k, [])
            bin.append(cut(rest))
            if len(bin) == k:
                del self.open[k]
                # Only a document that left no gap open comes here.
                self.short, self.gap = bin, self.capacity - sum(len(p[2]) // 4 for p in bin)
                if not self.gap:
                    out += self._close(bin)
                    self.short = []
        return out

    def _close(self, parts: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for doc, start, ids, total in parts:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def finish(self) -> list[tuple]:
        left = [*self.short, *(p for k in sorted(self.open) for p in self.open[k])]
        self.short, self.gap, self.open = [], 0, {}
        tokens, out, held = sum(len(p[2]) // 4 for p in left), [], []
        room = size = min(self.capacity, 1 << tokens.bit_length() >> 1)
        for doc, start, ids, total in left:
            while ids:
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                start, ids, room = start + n, ids[4 * n :], room - n
                if not room:
                    out += self._close(held)
                    held, tokens = [], tokens - size
                    room = size = min(self.capacity, 1 << tokens.bit_length() >> 1)
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there, its length, its sequence and place."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        for b in slices(batches):
            tokens = cached(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
            for doc, ids in zip(b.column(0).to_pylist(), tokens(b.column(1).to_pylist())):
                rows += packer.add(doc, ids + end)
            if len(rows) >= 8192:
                yield batch(dict(zip(names, zip(*rows))), schema)
                rows = []
        rows += packer.finish()
        if rows:
            yield batch(dict(zip(names, zip(*rows))), schema)

    return src.mapInArrow(tidied(run), SCHEMA)


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
