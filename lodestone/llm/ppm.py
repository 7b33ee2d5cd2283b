"""Language identification by prediction by partial matching (operator 5).

For each language a context tree over bytes up to three bytes deep holds frozen counts. A context's
distribution gives a symbol seen there c / (n + d), with n symbols and d different ones, and passes the
escape mass d / (n + d) to the next shorter context over the symbols not seen (with exclusion, so that it
sums to 1); the last resort is uniform over 256 bytes. The code length of a text in a language is the
exact sum of -log2 of these, over every byte of the whole text; the shortest wins.

As the statistics are frozen, each (context, byte) has one cost for each language: workers build a table
from the counts once and sum looked-up costs, many texts at a time.

The trees are fitted on a bounded sample: for each language pieces of its texts, drawn by a hash, of about
``target_bytes`` in all. Every string of one to four bytes of that sample counts.

``keep_identified`` compares the best language's code with one by the text's own byte counts (order 0, learned on
the way, so that short texts get the benefit of the doubt), as it stands or in small letters. A text whose best language needs over a bit a
byte more goes: random letters, and texts of a language that was not learned.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if
no language was learned. Ties go to the name that sorts first. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cached, remainder, scratch, ship, slices, table, tidied

LETTER = re.compile(r"[^\W\d_]")
DEPTH = 3
PIECE = 16_384  # bytes of a text that are drawn together
FOLD_BELOW = 1.0  # bits saved a byte
STATES = 2048  # contexts whose distributions are made together
UND = "und"


def own_bits(data: bytes) -> float:
    """Code length of bytes by their own counts, each byte's from those before it (and a half for each of 256)."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = counts[counts > 0].tolist()
    nats = math.lgamma(len(data) + 128) - math.lgamma(128) - sum(map(math.lgamma, [c + 0.5 for c in counts])) + len(counts) * math.lgamma(0.5)
    return nats / math.log(2)


class ContextTrees:
    """Counts of byte strings of one to four bytes for each language, and the costs that follow from them.

    counts: for each language {length: (keys, counts)}; a key holds the bytes, first byte highest.
    """

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], min_context: int = 1):
        self.languages = sorted(counts)
        self.key = uuid.uuid4().hex
        self.counts, self.min_context = counts, min_context

    def _build(self):
        seen = np.unique(np.concatenate([c[1][0] for c in self.counts.values()] or [np.zeros(0, np.int64)])).astype(int)
        other, width = len(seen), len(seen) + 1  # one symbol for all bytes never seen
        code = np.full(256, other, np.uint8)
        code[seen] = np.arange(other)
        uniform = np.full(width, 1 / 256)
        uniform[other] = max(256 - other, 0) / 256
        split = max(256 - other, 1)
        # States: the contexts that any language has often enough, by depth; state 0 is the empty one.
        contexts = [np.zeros((1, 0), int)]
        for depth in range(1, DEPTH + 1):
            often = []
            for c in self.counts.values():
                keys, n = c[depth + 1]
                ctx, at = np.unique(keys >> 8, return_inverse=True)
                often.append(ctx[np.bincount(at, n, minlength=len(ctx)) >= self.min_context])
            ctx = np.unique(np.concatenate(often or [np.zeros(0, np.int64)]))
            contexts.append(np.stack([code[(ctx >> (8 * (depth - 1 - i))) & 255] for i in range(depth)], 1).astype(int))
        place = [width ** np.arange(d - 1, -1, -1) for d in range(DEPTH + 1)]
        lookup = [np.zeros(1, np.int32)]  # by depth: dense context number -> state of its longest known suffix
        first = np.cumsum([0, *(len(c) for c in contexts)])
        for depth in range(1, DEPTH + 1):
            whole = np.tile(lookup[-1], width)  # drop the first symbol
            if len(contexts[depth]):
                whole[contexts[depth] @ place[depth]] = first[depth] + np.arange(len(contexts[depth]))
            lookup.append(whole.astype(np.int32))
        costs = np.empty((first[-1], width, len(self.languages)), np.float32)
        for k, language in enumerate(self.languages):
            p = np.empty((first[-1], width))
            for depth in range(DEPTH + 1):
                keys, n = self.counts[language][depth + 1]
                symbols = np.stack([code[(keys >> (8 * (depth - i))) & 255] for i in range(depth + 1)], 1).astype(int)
                number = symbols[:, :depth] @ place[depth] if depth else np.zeros(len(keys), int)
                state = lookup[depth][number]
                for at in range(first[depth], first[depth + 1], STATES):
                    end = min(at + STATES, first[depth + 1])
                    own = (state >= at) & (state < end)  # a context below this depth's states is not a state
                    c = np.zeros((end - at, width))
                    np.add.at(c, (state[own] - at, symbols[own, depth]), n[own])
                    part = contexts[depth][at - first[depth] : end - first[depth]]
                    lower = np.tile(uniform, (1, 1)) if not depth else p[lookup[depth - 1][part[:, 1:] @ place[depth - 1]]]
                    total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                    rest = np.where(c > 0, 0, lower)
                    mass = rest.sum(1, keepdims=True)
                    escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0)
                    mixed = np.where(c > 0, c / np.maximum(total + np.where(mass > 0, kinds, 0), 1), escape * rest / np.maximum(mass, 1e-300))
                    p[at:end] = np.where(total > 0, mixed, lower)
            p[:, other] /= split
            for at in range(0, len(p), STATES):
                costs[at : at + STATES, :, k] = -np.log2(np.maximum(p[at : at + STATES], 1e-30))
        return code, width, lookup[DEPTH], costs.reshape(-1, len(self.languages))

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language."""
        code, width, lookup, costs = cached(("ppm", self.key), self._build)
        pad = b"\0" * DEPTH
        data = [t.encode() for t in texts]
        size = np.array([len(d) for d in data])
        flat = code[np.frombuffer(pad.join([b"", *data]), np.uint8)].astype(np.int32)
        start = np.cumsum(size + DEPTH) - size
        for s in range(1, DEPTH + 1):
            flat[start - s] = width - 1
        context = (flat[:-3] * width + flat[1:-2]) * width + flat[2:-1]
        cost = costs[lookup[context] * width + flat[3:]]
        out = np.zeros((len(texts), len(self.languages)))
        # Position i of cost is byte i + 3 of flat; sums run from a text's first byte to its last.
        edges = np.stack([start - DEPTH, start - DEPTH + size], 1)
        some = size > 0
        if some.any():
            cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
            out[some] = np.add.reduceat(cost, edges[some].ravel(), axis=0, dtype=np.float64)[::2]
        return out

    def savings(self, texts: list[str | None]) -> list[float]:
        """Bits a byte that the best language's code saves against the text's own byte counts; minus infinity without a letter."""
        out = [-np.inf] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        # Text in capitals is as much of a language: where a text saves little, it is read in small letters as well.
        for fold in (False, True):
            some = [i for i in known if not fold or out[i] < FOLD_BELOW]
            if some:
                read = [texts[i].lower() if fold else texts[i] for i in some]
                for i, t, bits in zip(some, read, self.code_lengths(read).min(1).tolist()):
                    data = t.encode()
                    out[i] = max(out[i], (own_bits(data) - bits) / len(data))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if known:
            bits = self.code_lengths([texts[i] for i in known])
            size = np.array([len(texts[i].encode()) for i in known])
            best = bits.argmin(1)
            gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / size)[:, None]
            score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
            for i, b, s in zip(known, best.tolist(), score.tolist()):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def train(docs: DataFrame, target_bytes: int = 3_000_000, min_context: int = 1) -> ContextTrees:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang)."""
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r["n"]}
    if not sizes:
        return ContextTrees({})
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, target_bytes / n))).otherwise(share)
    # Pieces are drawn, not documents: a language of one huge text is learned as well, and rows without an id are told apart.
    cut = known.select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("own"), share.alias("share"))
    drawn = cut.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / PIECE).cast("int"))).alias("piece")).filter(F.pmod(F.xxhash64("own", "piece", F.lit(17)), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    sample = drawn.select("lang", F.expr(f"substring(text, piece * {PIECE} + 1, {PIECE})").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for b in slices(batches, chars=8_000_000):
            lang, text = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for name in dict.fromkeys(lang):
                parts = [np.frombuffer(t, np.uint8).astype(np.int64) for t, x in zip(text, lang) if x == name]
                for length in range(1, DEPTH + 2):
                    keys = [sum(p[i : len(p) - length + 1 + i] << (8 * (length - 1 - i)) for i in range(length)) for p in parts if len(p) >= length]
                    if keys:
                        k, n = np.unique(np.concatenate(keys), return_counts=True)
                        yield batch({"lang": [name] * len(k), "length": np.full(len(k), length, np.int32), "key": k, "n": n.astype(np.int64)}, schema)

    counted = sample.mapInArrow(count, "lang string, length int, key long, n long").groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))
    # At most the different strings of four bytes of a sample of bounded size.
    names = sorted(sizes)
    rows = counted.select(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int").alias("lang"), "length", "key", "n").toPandas()
    counts = {}
    for i, lang in enumerate(names):
        own = rows[rows["lang"] == i + 1]
        counts[lang] = {}
        for length in range(1, DEPTH + 2):
            x = own[own["length"] == length].sort_values("key")
            counts[lang][length] = (x["key"].to_numpy(np.int64), x["n"].to_numpy(np.int64))
    return ContextTrees({k: c for k, c in counts.items() if len(c[1][0])}, min_context)


def identify(docs: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches, chars=250_000):
            names, scores = model.predict(b.column(1).to_pylist())
            yield batch({"doc_id": b.column(0), "lang_pred": names, "score": scores}, schema)

    return src.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ContextTrees, min_saving: float = -1.0) -> DataFrame:
    """The rows of ``docs``, all columns, of which a learned language's code saves ``min_saving`` bits a byte or more (below 0: loses)."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches, chars=250_000):
            saved = model.savings(pc.cast(b.column(at), pa.string()).to_pylist())
            yield b.filter(pa.array([s >= min_saving for s in saved], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
