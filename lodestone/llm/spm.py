"""SentencePiece encoding with source offsets, and decoding (operator 1).

A text is normalised by the longest-prefix rule of the model's compiled character map, and every
normalised byte keeps the source byte it came from; pieces are then projected to source byte spans.
White space becomes U+2581 and no piece of such a model holds that mark after another character, so a
text falls apart before each run of marks into segments that encode on their own; where no piece joins a Latin
letter to another character, segments are cut there as well. A bounded cache per worker keeps the segments'
pieces, and new segments are merged many at a time; spans are projected for each text. The digests are made of these
pieces; the library's own encoder is what the tests compare with, and not on the way.

Defined results: null and empty texts have no pieces and decode to ''. Repeated rows are encoded each.
Rows of any length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cached, gather, ship, slices, table

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Segments cut where Latin letters begin or end as well.
RUNS = re.compile(f"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}]+)|{MARK}+")
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
UNKNOWN = 1 << 20  # numbers of characters that are no piece begin here


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; value is bytes for length-delimited ones."""

    def varint(at):
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Normalizer:
    """Longest-prefix normalisation with source alignment.

    ``charsmap`` is a model's precompiled map: a 32-bit size, a double-array trie of that many bytes, and
    the zero-ended replacement strings that the trie's values point into. Empty: the identity.
    """

    def __init__(self, charsmap: bytes = b"", dummy_prefix=True, remove_extra=False, escape=True):
        self.units, self.strings = (), b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.strings = charsmap[4 + size :]
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        self.space = MARK.encode() if escape else b" "

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, value) of the longest key of the trie at ``at``; (0, -1) if there is none."""
        units, node, found = self.units, 0, (0, -1)
        if not units:
            return found
        base = units[0]
        node ^= (base >> 10) << ((base & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def chunk(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes taken at ``at`` and what stands for them: the longest key, or one character."""
        taken, value = self.longest(data, at)
        if taken:
            return taken, self.strings[value : self.strings.index(b"\0", value)]
        first = data[at]
        size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, data[at : at + size]

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them (and the end) its source byte offset."""
        data, out, align = text.encode(), bytearray(), []
        if not data:
            return b"", [0]
        at, end, space = 0, len(data), self.space
        if self.remove_extra:
            while at < end and self.chunk(data, at)[1] in (b" ", b""):
                at += self.chunk(data, at)[0]
        if self.dummy_prefix and at < end:
            out += space
            align += [at] * len(space)
        gap = self.remove_extra
        while at < end:
            taken, new = self.chunk(data, at)
            if self.remove_extra and gap:
                new = new.lstrip(b" ")
            new = new.replace(b" ", space)
            out += new
            align += [at] * len(new)
            at += taken
            if new:
                gap = self.remove_extra and new.endswith(space)
        if self.remove_extra:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), [*align, at]

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a call gives for each of the texts, one after the other, and where each one's part begins.

        For an empty map, by which every character is its own longest prefix, with arrays.
        """
        assert not self.units and not self.remove_extra
        data = [t.encode() for t in texts]
        # Each text with the blank of the dummy prefix before it and a byte after it for its end.
        lead = b" " if self.dummy_prefix else b""
        source = np.frombuffer(b"".join([x for d in data for x in (lead if d else b"", d, b"\0")]), np.uint8)
        blank = source == 32
        at = np.arange(len(source), dtype=np.int32)
        at[(source & 0xC0) == 0x80] = 0
        at = np.maximum.accumulate(at)  # a character's first byte
        wide = np.where(blank, len(self.space), 1)
        size = np.array([len(d) + bool(d) * len(lead) + 1 for d in data])
        start = np.cumsum(size) - size
        origin = np.repeat(start + np.array([bool(d) * len(lead) for d in data]), size)
        align = np.repeat(np.maximum(at - origin, 0).astype(np.int32), wide)
        place = np.concatenate([[0], np.cumsum(wide)])
        normal = np.repeat(source, wide)
        marks = place[:-1][blank]
        for k, byte in enumerate(self.space):
            normal[marks + k] = byte
        return normal, align, place[np.append(start, len(source))]


class PieceEncoder:
    """Normalises, merges the characters into pieces, and projects each piece to its source bytes.

    The merges are those of byte-pair encoding: of all neighbours that are a piece together the best scored,
    leftmost pair is joined, until none is left; a character that is no piece becomes its bytes. Models of
    another kind, or with pieces that ask for more, take their ids from the library.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = list(_fields(self.sp.serialized_model_proto()))
        spec = dict(_fields(next((v for k, v in proto if k == 3), b"")))
        self.normalizer = n = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        kinds = [dict(_fields(v)).get(3, 1) for k, v in proto if k == 1]  # 1 is a normal piece
        self.is_byte = [self.sp.is_byte(i) for i in range(len(pieces))]
        self.widths = [1 if b else len(p.encode()) for p, b in zip(pieces, self.is_byte)]
        self.widths_of = np.array(self.widths, np.int32)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.costs = {p: -self.sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        trainer = dict(_fields(next((v for k, v in proto if k == 2), b"")))
        #: Byte pairs with bytes for unknown characters, and neither pieces of the user's nor unused ones.
        self.own_merges = trainer.get(3) == 2 and any(self.is_byte) and not {4, 5} & set(kinds)
        #: Segments may be encoded on their own only if nothing but white space is rewritten and no piece joins two.
        self.by_segment = self.own_merges and not n.units and n.dummy_prefix and not n.remove_extra and n.space == MARK.encode() and not any(MARK in p.lstrip(MARK) for p in pieces)
        latin = re.compile(f"[{LATIN}]").match
        alone = self.by_segment and all(x == MARK or bool(latin(x)) == bool(latin(y)) for p in self.ids for x, y in zip(p, p[1:]))
        self.segment = RUNS if alone else SEGMENT
        # Of all two pieces that make a third: both, and the third one's place in the order of merging.
        by_cost = sorted(self.ids, key=self.costs.get)
        ranks: dict[float, int] = {}  # equal costs have equal places
        made = [(self.ids[p[:i]] * UNKNOWN * 2 + self.ids[p[i:]], ranks.setdefault(self.costs[p], len(ranks)), self.ids[p]) for p in by_cost for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        made = np.array(sorted(made), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_ids = made[:, 0].copy(), made[:, 1].copy(), made[:, 2].copy()
        # A segment's ids; the older half of the cache.
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, normal: str) -> list[int]:
        """Ids of a normalised text."""
        ids, out = self.ids, []
        for p in self._many(normal):
            if p in ids:
                out.append(ids[p])
            elif p:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each two neighbours the row of their merge in the table of pairs, or -1."""
        if not len(self.pair_keys):
            return np.full(left.shape, -1)
        key = left * (2 * UNKNOWN) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, at, -1)

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """Ids of each of many short normalised segments, as 32-bit integers: those of one length side by side."""
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by_size.setdefault(len(s), []).append(i)
        out: list[bytes] = [b""] * len(segments)
        number, other = dict(self.ids), []
        none = np.iinfo(np.int64).max

        def rank(at):
            return np.where(at >= 0, self.pair_ranks[at] if len(self.pair_ranks) else 0, none)

        for size, where in by_size.items():
            chars = "".join([segments[i] for i in where])
            for c in set(chars):
                if c not in number:
                    number[c] = UNKNOWN + len(other)
                    other.append(c)
            parts = np.array([number[c] for c in chars], np.int64).reshape(-1, size)
            rows, merges = np.array(where), self._pairs(parts[:, :-1], parts[:, 1:])
            ranks = rank(merges)
            while len(rows):
                width = parts.shape[1]
                best = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
                at = np.arange(len(rows))
                done = ranks[at, best] == none if width > 1 else np.ones(len(rows), bool)
                for i, own in zip(rows[done].tolist(), parts[done]):
                    if other and own.max() >= UNKNOWN:
                        own = [x for p in own.tolist() for x in ([p] if p < UNKNOWN else [self.byte_ids[b] for b in other[p - UNKNOWN].encode()])]
                    out[i] = np.array(own, np.int32).tobytes()
                go = ~done
                rows, parts, merges, ranks, best = rows[go], parts[go], merges[go], ranks[go], best[go]
                if not len(rows):
                    break
                # The best pair becomes one part, and the pairs with its neighbours are looked up anew.
                at = np.arange(len(rows))
                parts[at, best] = self.pair_ids[merges[at, best]]
                drop = np.arange(width - 1)
                parts = np.take_along_axis(parts, drop + (drop > best[:, None]), 1)
                drop = drop[:-1]
                keep = drop + (drop >= best[:, None])
                merges, ranks = np.take_along_axis(merges, keep, 1), np.take_along_axis(ranks, keep, 1)
                for side, some in ((best - 1, best > 0), (best, best < width - 2)):
                    x, y = at[some], side[some]
                    merges[x, y] = new = self._pairs(parts[x, y], parts[x, y + 1])
                    ranks[x, y] = rank(new)
        return out

    def _many(self, normal: str) -> list[str]:
        """Merged parts of a text of any length, by a queue; a part that went into the one before it is ''."""
        costs, parts, n = self.costs, list(normal), len(normal)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(costs[p], i, i + 1, p) for i, p in enumerate(x + y for x, y in zip(parts, parts[1:])) if p in costs]
        heapify(queue)
        while queue:
            _, i, j, p = heappop(queue)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := p + parts[k]) in costs:
                    heappush(queue, (costs[q], i, k, q))
            h = before[i]
            if h >= 0 and (q := parts[h] + p) in costs:
                heappush(queue, (costs[q], h, i, q))
        return parts

    def project(self, ids: list[int], normal: bytes, align: list[int]) -> tuple[list[int], list[int]]:
        """Begins and ends of the pieces of a normalised text in its source.

        Of the byte pieces that stand for one character the last carries its span; those before are empty.
        """
        at, start, begins, ends, widths, is_byte = 0, None, [], [], self.widths, self.is_byte
        for i in ids:
            end = at + widths[i]
            if is_byte[i]:
                start = at if start is None else start
                whole = end >= len(normal) or normal[end] & 0xC0 != 0x80
                begins.append(align[start])
                ends.append(align[end] if whole else align[start])
                start = None if whole else start
            else:
                begins.append(align[at])
                ends.append(align[end])
            at = end
        return begins, ends

    def encode_spans(self, texts: list[str | None]) -> "Spans":
        """Pieces of each text with their source byte spans."""
        texts = [t or "" for t in texts]
        return self._by_segment(texts) if self.by_segment else self._one_by_one(texts)

    def _one_by_one(self, texts: list[str]) -> "Spans":
        ids, begins, ends = [], [], []
        for t in texts:
            normal, align = self.normalizer(t)
            ids.append(self.merge(normal.decode()) if self.own_merges else self.sp.encode(t))
            for out, own in zip((begins, ends), self.project(ids[-1], normal, align)):
                out += own
        rows = np.cumsum([0, *map(len, ids)])
        return Spans(rows, *(np.array(x, np.int32) for x in ([i for own in ids for i in own], begins, ends)))

    def _learn(self, segments: list[str]) -> list[bytes]:
        """Ids of different segments; those that the cache lacks are merged. What was not asked for lately goes."""
        if len(self.held) + len(segments) > CACHE_ENTRIES // 2:
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        found = [held.get(s) or older.get(s) for s in segments]
        new = [s for s, x in zip(segments, found) if x is None]
        short = [s for s in new if len(s) <= CACHE_CHARS]
        made = dict(zip(short, self.merge_all(short)))
        made.update((s, np.array(self.merge(s), np.int32).tobytes()) for s in new if len(s) > CACHE_CHARS)
        found = [made[s] if x is None else x for s, x in zip(segments, found)]
        held.update((s, x) for s, x in zip(segments, found) if len(s) <= CACHE_CHARS)
        return found

    def _by_segment(self, texts: list[str]) -> "Spans":
        normal, align, place = self.normalizer.many(texts)
        parts = [self.segment.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        coded = pa.array([s for own in parts for s in own], pa.string()).dictionary_encode()
        ids, edge = gather(self._learn(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        ids, rows = ids.view(np.int32), edge[np.cumsum([0, *map(len, parts)])]
        # The pieces' places in the normalised bytes; a byte more lies between texts. All bytes of a character
        # have its source, so that the byte pieces before its last one are empty.
        width = self.widths_of[ids].astype(np.int64)
        stop = np.cumsum(width) + np.repeat(np.arange(len(texts)), np.diff(rows))
        total = np.concatenate([[0], np.cumsum(width)])[rows]
        if (np.diff(total) != np.diff(place) - 1).any():
            raise ValueError("the pieces do not cover their text")
        return Spans(rows, ids, align[stop - width], align[stop])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_spans([text]).ids.tolist()

    def encode_with_offsets(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, begin, end) for each piece, in source bytes."""
        made = self.encode_spans([text])
        return list(zip(made.ids.tolist(), made.begins.tolist(), made.ends.tolist()))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


class Spans(NamedTuple):
    """Pieces of some texts, one after the other; those of text k lie from rows[k] to rows[k + 1]."""

    rows: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def joined(self) -> list[str]:
        """Each text's ids, joined by commas."""
        lists = pa.ListArray.from_arrays(pa.array(self.rows, pa.int32()), pa.array(self.ids).cast(pa.string()))
        return pc.binary_join(lists, ",").to_pylist()


def encoder(model_path: str) -> PieceEncoder:
    return cached(("spm", model_path), lambda: PieceEncoder(model_path))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends): pieces of each whole text with their source byte spans."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("ids", "begins", "ends"))])

    def run(batches):
        for b in slices(batches):
            enc = encoder(model_path)
            made = enc.encode_spans(b.column(1).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(made.rows, pa.int32()), pa.array(x)) for x in (made.ids, made.begins, made.ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], schema=schema)

    return src.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the decoded text."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        sha = hashlib.sha256
        for b in slices(batches, 1024):
            enc = encoder(model_path)
            made = enc.encode_spans(b.column(1).to_pylist())
            ids = [sha(j.encode()).hexdigest() for j in made.joined()]
            texts = [sha(enc.decode(made.ids[i:j].tolist()).encode()).hexdigest() for i, j in zip(made.rows, made.rows[1:])]
            yield batch({"doc_id": b.column(0), "n_tokens": np.diff(made.rows), "ids_sha256": ids, "decoded_sha256": texts}, schema)

    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
