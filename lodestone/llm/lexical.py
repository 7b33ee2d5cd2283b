"""Ranked lexical search over a clustered index of reordered documents (operator 13).

Documents are dealt to shards in the order of a random projection of their term vectors, so that like ones meet. In each
shard recursive graph bisection reorders them: a range of documents is halved, documents whose move lowers the estimated
cost of the shard's posting lists change sides, and the halves are bisected in turn, down to clusters of at most
CLUSTER documents. A shard is one row of the index: sorted terms, their postings by place in the new order, and for
each term and cluster the largest contribution that a document of the cluster gets from it.

A query's bound for a cluster is the sum of these maxima times the terms' weights. First every shard tells each query
its best cluster's bound; then the queries visit their two most promising shards, whose clusters are scored by
falling bound until the next bound is below the k-th score; the k-th score over both is a threshold for the other
shards, which are visited only if their bound reaches it. A bound equal to it is visited as well, since ties go to the
smaller doc_id: places are mapped back to ids before anything is cut. So the result is exact, whatever the order.

Queries travel to the shards as rows of a shuffle and are streamed past one shard's row at a time; neither they nor the
index pass through the driver. Scores are sums of whole numbers below 2^53.

Defined results: terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z
lowered; a null or empty text has none. Repeated rows are documents of their own. Documents without an id take part and
come after all others of the same score. Rows with one item_id (null is one, too) are one item with the terms
of all. Items without a term that a document has give no row, nor do empty tables. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, discard, scratch, ship, slices, table, tidied

#: Bytes of terms: 0-9, a-z and all of characters beyond ASCII; A-Z are lowered, any other ends a term.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SHARD_DOCS, SHARD_POSTINGS, CLUSTER = 4096, 1 << 20, 64
ROUNDS = 5  # of exchanges at each level of the bisection
FIRST_SHARDS = 2
NO_ID = np.iinfo(np.int64).max

BAG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sign", pa.int32()), ("terms", pa.list_(pa.binary())), ("tf", pa.list_(pa.int32()))])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _sign(terms: list[bytes], counts: list[int]) -> int:
    """Sixteen signs of a random projection of the term vector; documents of one language or topic share most."""
    hashes = np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms))
    bits = ((hashes[:, None] >> np.arange(16, dtype=np.uint32)) & 1).astype(np.float64) * 2 - 1
    return int(((np.array(counts, np.float64) @ bits) > 0) @ (1 << np.arange(15, -1, -1)))


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sign, terms, tf) of every document that has a term."""

    def run(batches):
        for b in slices(batches, 512, 2_000_000):
            out: dict[str, list] = {n: [] for n in BAG.names}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = terms_of(t) if t else []
                if not words:
                    continue
                count = Counter(words)
                terms, tf = list(count), list(count.values())
                for name, v in zip(BAG.names, (i, len(words), _sign(terms, tf), terms, tf)):
                    out[name].append(v)
            yield batch(out, BAG)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidied(run), "doc_id long, n long, sign int, terms array<binary>, tf array<int>")


def bisect(doc: np.ndarray, term: np.ndarray, n: int, rounds: int = ROUNDS, leaf: int = CLUSTER) -> tuple[np.ndarray, np.ndarray]:
    """Recursive graph bisection of documents 0..n-1 with postings (doc, term).

    Returns the documents in their new order and the bounds of the leaves there. All ranges of a level are treated
    together. The cost of a term with d of a range's m documents is d log2(m / (d + 1)), the logarithmic gaps' estimate.
    """
    order, bounds = np.arange(n), np.array([0, n])
    log = np.log2(np.arange(n + 3, dtype=np.float64) + 1)  # log[d] = log2(d + 1)
    while (sizes := np.diff(bounds)).max(initial=0) > leaf:
        split = sizes > leaf
        low, high = bounds[:-1], bounds[1:]
        middle = np.where(split, (low + high) // 2, high)
        node = np.repeat(np.arange(len(low)), sizes)  # by place
        right = np.arange(n) >= middle[node]
        left = np.flatnonzero(~right & split[node])
        partner = left - low[node[left]] + middle[node[left]]
        home, side = np.empty(n, np.int64), np.empty(n, np.int64)
        home[order] = node  # documents do not leave their range
        doc, term, cell, own, held = _cells(doc, term, home)
        m_left, m_right = (np.log2(np.maximum(m, 1))[own] for m in (middle - low, high - middle))
        cost = lambda d, m: d * (m - log[d])
        for _ in range(rounds):
            side[order] = right
            to = side[doc]
            b = np.bincount(cell, weights=to, minlength=len(held)).astype(np.int64)
            a = held - b
            out = cost(a, m_left) - cost(np.maximum(a - 1, 0), m_left) + cost(b, m_right) - cost(b + 1, m_right)
            back = cost(b, m_right) - cost(np.maximum(b - 1, 0), m_right) + cost(a, m_left) - cost(a + 1, m_left)
            gain = np.bincount(doc, weights=np.concatenate([out, back])[cell + to * len(held)], minlength=n)
            ranked = order[np.lexsort((-gain[order], right, node))]
            moves = gain[ranked[left]] + gain[ranked[partner]] > 0
            x, y = left[moves], partner[moves]
            ranked[x], ranked[y] = ranked[y].copy(), ranked[x].copy()
            order = ranked
            if len(x) <= len(left) // 100:
                break
        bounds = np.unique(np.concatenate([bounds, middle]))
    return order, bounds


def _cells(doc: np.ndarray, term: np.ndarray, home: np.ndarray):
    """Number the pairs of range and term that postings have; a term of one document in its range moves no cost and goes.

    Returns the postings that stay, their cells, and each cell's range and number of documents.
    """
    width = int(term.max(initial=0)) + 1
    key = home[doc] * width + term
    count = np.bincount(key)
    stays = count[key] > 1
    number = np.cumsum(count > 1) - 1
    cells = np.flatnonzero(count > 1)
    return doc[stays], term[stays], number[key[stays]], cells // width, count[cells]


SHARD = pa.schema(
    [("shard", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), ("entry_edge", pa.binary()), ("entry_cluster", pa.binary()), ("entry_most", pa.binary()), ("entry_start", pa.binary()), ("place", pa.binary()), ("part", pa.binary()), ("ids", pa.binary()), ("clusters", pa.int32())]
)
SHARD_DDL = "shard long, terms array<binary>, df array<int>, entry_edge binary, entry_cluster binary, entry_most binary, entry_start binary, place binary, part binary, ids binary, clusters int"


def contribution(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n docs) div length."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // length))


def shard_row(number: int, ids: list, n: list[int], terms: list[list[bytes]], tf: list[list[int]], docs: int, length: int) -> dict:
    """One shard's row of the index from its documents' bags."""
    sizes = np.array([len(t) for t in terms])
    flat = [t for own in terms for t in own]
    names = sorted(set(flat))
    code = {t: i for i, t in enumerate(names)}
    term = np.fromiter((code[t] for t in flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(ids)), sizes)
    order, bounds = bisect(doc, term, len(ids))
    at = np.empty(len(ids), np.int64)
    at[order] = np.arange(len(ids))
    part = contribution(np.fromiter((v for own in tf for v in own), np.int64, len(flat)), np.repeat(np.array(n, np.int64), sizes), docs, length)
    place = at[doc]
    sort = np.lexsort((place, term))
    term, place, part = term[sort], place[sort], part[sort]
    cluster = np.searchsorted(bounds, place, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])]))
    pack = lambda v, kind: v.astype(kind).tobytes()
    return {
        "shard": number, "terms": names, "df": np.bincount(term, minlength=len(names)).tolist(), "entry_edge": pack(np.searchsorted(term[first], np.arange(len(names) + 1)), "<i4"), "entry_cluster": pack(cluster[first], "<u2"),
        "entry_most": pack(np.maximum.reduceat(part, first), "<u4"), "entry_start": pack(np.append(first, len(term)), "<i4"), "place": pack(place, "<u2"), "part": pack(part, "<u4"),
        "ids": pack(np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64), "<i8"), "clusters": len(bounds) - 1,
    }


def build_index(held: DataFrame, docs: int, length: int, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The stored index of bags: like documents side by side, a row for each shard."""

    def run(batches):
        task, made, size = TaskContext.get().partitionId(), 0, 0
        held: list[list] = [[], [], [], []]

        def flush():
            return batch({k: [v] for k, v in shard_row((task << 32) | made, *held, docs, length).items()}, SHARD)

        for b in slices(batches, 512, 4_000_000):
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held[0] and (len(held[0]) >= shard_docs or size + len(row[2]) > SHARD_POSTINGS):
                    yield flush()
                    made, size, held = made + 1, 0, [[], [], [], []]
                for own, v in zip(held, row):
                    own.append(v)
                size += len(row[2])
        if held[0]:
            yield flush()

    dealt = held.withColumn("tie", F.xxhash64("doc_id", "n")).repartitionByRange("sign", "tie").sortWithinPartitions("sign", "tie")
    return scratch(dealt.select("doc_id", "n", "terms", "tf").mapInArrow(tidied(run), SHARD_DDL), "index")


class Shard:
    """One shard's row, ready for queries."""

    def __init__(self, row: dict, whole: bool):
        of = lambda n, kind: np.frombuffer(row[n], kind)
        self.code = {t: i for i, t in enumerate(row["terms"])}
        self.edge, self.cluster, self.most, self.clusters = of("entry_edge", "<i4"), of("entry_cluster", "<u2"), of("entry_most", "<u4").astype(np.float64), row["clusters"]
        if whole:
            self.start, self.place, self.part, self.ids = of("entry_start", "<i4").astype(np.int64), of("place", "<u2"), of("part", "<u4").astype(np.float64), of("ids", "<i8")

    def entries(self, terms: list[bytes], weights: list[int]):
        """Entries of the query's terms, each with its term's weight, and the bounds of all clusters."""
        found = [(i, w) for t, w in zip(terms, weights) if (i := self.code.get(t)) is not None]
        if not found:
            return None, None, np.zeros(self.clusters)
        codes = np.array([i for i, _ in found])
        sizes = self.edge[codes + 1] - self.edge[codes]
        entry = np.arange(sizes.sum()) + np.repeat(self.edge[codes] - (np.cumsum(sizes) - sizes), sizes)
        weight = np.repeat(np.array([w for _, w in found], np.float64), sizes)
        return entry, weight, np.bincount(self.cluster[entry], weights=weight * self.most[entry], minlength=self.clusters)

    def top(self, terms: list[bytes], weights: list[int], k: int, least: int) -> tuple[list[tuple[int, int]], int]:
        """The (score, id) that may be among the k best with a score of ``least`` or more, and the clusters scored."""
        entry, weight, bound = self.entries(terms, weights)
        order = np.argsort(-bound, kind="stable")
        best_score, best_id, limit = np.zeros(0), np.zeros(0, np.int64), max(least, 1)
        at, step = 0, 1
        while at < len(order) and bound[order[at]] >= limit:
            chosen = np.zeros(self.clusters, bool)
            group = order[at : at + step]
            chosen[group[bound[group] >= limit]] = True
            use = chosen[self.cluster[entry]]
            begin, size = self.start[entry[use]], self.start[entry[use] + 1] - self.start[entry[use]]
            posting = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            score = np.bincount(self.place[posting], weights=np.repeat(weight[use], size) * self.part[posting], minlength=1)
            hit = np.flatnonzero(score >= limit)
            best_score, best_id = np.concatenate([best_score, score[hit]]), np.concatenate([best_id, self.ids[hit]])
            if len(best_score) > k:
                keep = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[keep], best_id[keep]
            if len(best_score) >= k:
                limit = max(limit, int(best_score.min()))
            at, step = at + len(group), step * 2
        return list(zip(best_score.astype(np.int64).tolist(), best_id.tolist())), at


FOUND = {False: pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("bound", pa.int64())]), True: pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])}


def _visit(index: DataFrame, visits: DataFrame, k: int | None, buckets: int | None = None) -> DataFrame:
    """Stream the visits (deal, item, terms, w, least) past the shards: bounds where k is None, else the best documents.

    A visit goes to the shard whose number is ``deal``, or with ``buckets`` to every shard that hashes there.
    """
    whole = k is not None
    columns = [c for c in index.columns if c != "df" and (whole or c not in ("entry_start", "place", "part", "ids"))]
    deal = F.pmod(F.xxhash64("shard"), F.lit(buckets)) if buckets else F.col("shard")
    asked = {"item": "long", "w": "array<long>", "least": "long"}
    own = index.select(*columns, deal.alias("deal"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in asked.items()])
    put = visits.select("deal", "terms", F.lit(1).alias("kind"), *asked, *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in columns if c != "terms"])
    schema = FOUND[whole]

    def run(batches):
        held, at = [], None  # about one shard for each number dealt
        for b in slices(batches, 256, 16_000_000):
            out: list[tuple] = []
            for row in b.to_pylist():
                if row["deal"] != at:
                    held, at = [], row["deal"]
                if row["kind"] == 0:
                    held.append((row["shard"], Shard(row, whole)))
                    continue
                for number, shard in held:
                    if whole:
                        out += [(row["item"], None if i == NO_ID else i, s) for s, i in shard.top(row["terms"], row["w"], k, row["least"])[0]]
                    elif (most := int(shard.entries(row["terms"], row["w"])[2].max(initial=0))) > 0:
                        out.append((row["item"], number, most))
            yield batch({n: [r[c] for r in out] for c, n in enumerate(schema.names)}, schema)

    dealt = own.unionByName(put).repartition("deal").sortWithinPartitions("deal", "kind")
    return dealt.mapInArrow(tidied(run), ", ".join(f"{f.name} long" for f in schema))


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])

    def run(batches):
        for b in slices(batches):
            pairs = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for t in set(terms_of(text))]
            yield batch({n: [p[c] for p in pairs] for c, n in enumerate(schema.names)}, schema)

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidied(run), "item_id long, term binary").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item by score, then doc_id."""
    ship(docs.sparkSession)
    held = scratch(bags(docs), "bags")
    whole = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n, length = whole["docs"], max(1, whole["length"])
    index = build_index(held, n, length, shard_docs)
    discard(held)
    # A term's documents are counted from one number for each shard.
    counts = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = query_terms(items).join(counts, "term").select("item_id", "term", weight.alias("weight")).filter("weight > 0")
    asked = scratch(weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t")).select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("w")), "items")
    queries = asked.select("item", "terms", "w")
    # Each query goes to as many buckets as there are shards, which are dealt to them by hash.
    shards = max(1, index.count())
    to_all = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("deal"), F.lit(0).cast("long").alias("least"))
    bounds = scratch(_visit(index, to_all, None, shards), "bounds")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    ranked = bounds.withColumn("place", F.row_number().over(by_bound))
    first = ranked.filter(F.col("place") <= FIRST_SHARDS).join(queries, "item").withColumns({"least": F.lit(0).cast("long"), "deal": F.col("shard")})
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    early = scratch(best(_visit(index, first, k)), "early")
    least = early.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
    others = ranked.filter(F.col("place") > FIRST_SHARDS).join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).filter(F.col("bound") >= F.col("least")).join(queries, "item").withColumn("deal", F.col("shard"))
    late = scratch(_visit(index, others, k), "late")
    discard(bounds)
    return best(early.drop("rank").unionByName(late)).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), bags AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), sizes AS (SELECT doc_id, sum(tf) :: BIGINT AS n FROM bags GROUP BY ALL
), total AS (SELECT count(*) AS docs, sum(n) :: BIGINT AS length FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) :: DOUBLE / (2 * df + 1) :: DOUBLE)) :: BIGINT AS w FROM (SELECT term, count(*) AS df FROM bags GROUP BY ALL), total
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)))) :: BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN bags USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
"""
