"""SimHash document fingerprints, in DataFrame functions only (operator 3).

A text's terms are its words with their successors. Each occurrence hashes to 128 bits and votes for or
against each of them, so that a term weighs as often as it occurs; the sign of a bit's votes is the bit.
Votes are counted in packed lanes: one 64-bit addition counts four bits, for parts of 2**15 terms, so that no
lane can overflow; parts are then added up, however long the text. Terms never leave their partition.

``near_fingerprints`` finds all such fingerprints within a Hamming radius by permuted block tables, and
``with_near`` says of each document how many there are. A pair counts in the first table that joins it, so pairs
are never sent on; groups of a table beyond HOT fingerprints form no pairs at all, see ``_crowded``.

Defined results: a null text is an empty one; an empty text has one empty term. Equal texts have equal
fingerprints. Documents are ordered by id descending, then text; a null id comes last. The only document
of a table is its own next document.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, scratch, table

HOT = 4096  # fingerprints of a block table's group up to which they are compared in pairs
SALTS = 8
PART_BITS, LANES = 15, 0x0001000100010001
CUTS, BUCKET_BYTES = 1000, 1 << 27


def term_hashes(text: Column) -> Column:
    """Hashes of the words with their successors; the last word stands alone."""
    words = F.split(F.lower(text), r"\s+")
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def fingerprint_texts(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """128-bit fingerprints of the text columns: ``keys``, and two longs <text>_hi and <text>_lo for each.

    ``keys`` must tell rows apart. There is no shuffle if ``rows`` is partitioned by some of them.
    """
    held = rows.select(*keys, *[term_hashes(F.col(t)).alias(f"_t{i}") for i, t in enumerate(texts)])
    sized = held.select(*keys, *[F.size(f"_t{i}").alias(f"_n{i}") for i in range(len(texts))], F.concat(*[F.col(f"_t{i}") for i in range(len(texts))]).alias("_all"))
    at = sized.select(*keys, *[f"_n{i}" for i in range(len(texts))], F.posexplode("_all").alias("_pos", "_h"))
    before = [reduce(lambda a, b: a + b, [F.col(f"_n{j}") for j in range(i)], F.lit(0)) for i in range(len(texts))]
    which = reduce(lambda a, i: a + (F.col("_pos") >= before[i]).cast("int"), range(1, len(texts)), F.lit(0))
    offset = reduce(lambda a, i: F.when(F.col("_pos") >= before[i], before[i]).otherwise(a), range(1, len(texts)), F.lit(0))
    votes = at.select(*keys, which.alias("_which"), F.shiftright(F.col("_pos") - offset, PART_BITS).alias("_part"), F.col("_h").alias("_a"), F.xxhash64("_h").alias("_b"))
    lanes = [F.sum(F.shiftrightunsigned(F.col(c), j).bitwiseAND(F.lit(LANES))).alias(f"_{c}{j}") for c in ("_a", "_b") for j in range(16)]
    parts = votes.groupBy(*keys, "_which", "_part").agg(F.count("*").alias("_n"), *lanes)
    total = parts.groupBy(*keys, "_which").agg(
        F.sum("_n").alias("_n"),
        *[F.sum(F.shiftrightunsigned(F.col(f"_{c}{j}"), 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"_{c}{j}_{k}") for c in ("_a", "_b") for j in range(16) for k in range(4)],
    )

    def signs(c: str) -> Column:
        bits = [F.when(2 * F.col(f"_{c}{j}_{k}") > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), j + 16 * k)).otherwise(F.lit(0).cast("long")) for j in range(16) for k in range(4)]
        while len(bits) > 1:
            bits = [bits[i].bitwiseOR(bits[i + 1]) for i in range(0, len(bits), 2)]
        return bits[0]

    signed = total.select(*keys, "_which", signs("_a").alias("_hi"), signs("_b").alias("_lo"))
    return signed.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == i, F.col(f"_{p}"))).alias(f"{t}_{p}") for i, t in enumerate(texts) for p in ("hi", "lo")])


def hex_of(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """1 - Hamming distance / 128."""
    distance = F.bit_count(F.col(f"{a}_hi").bitwiseXOR(F.col(f"{b}_hi"))) + F.bit_count(F.col(f"{a}_lo").bitwiseXOR(F.col(f"{b}_lo")))
    return (1 - distance / F.lit(128.0)).cast("double")


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents dealt by id into ``buckets`` ranges, each with a copy of the row that follows its last one.

    Columns _bucket, _copy, _key, doc_id, text. A window over _bucket then sees every row's successor; the
    lowest range is followed by the first document of all.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_key"))
    coarse = min(buckets, CUTS)
    cuts = src.agg(F.percentile_approx("_key", [i / coarse for i in range(1, coarse)], 10000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    placed = src.withColumn("_bucket", F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("_key"))) if cuts else F.lit(0))
    if (fine := -(-buckets // coarse)) > 1 and cuts:
        # Between two cuts ids are dealt by their distance from the lower one.
        low = F.array(*[F.lit(c).cast("double") for c in [cuts[0], *cuts]])
        width = F.array(*[F.lit(float(max(1, y - x))) for x, y in zip([cuts[0], *cuts], [*cuts, cuts[-1] + max(1, cuts[-1] - cuts[0]) // len(cuts)])])
        step = F.floor((F.col("_key") - F.element_at(low, F.col("_bucket") + 1)) / F.element_at(width, F.col("_bucket") + 1) * fine)
        placed = placed.withColumn("_bucket", (F.col("_bucket") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), step))).cast("int"))
    # One row for each range: at most ``buckets`` on the driver and in the broadcast.
    tops = sorted((r["_bucket"], r["top"]) for r in placed.groupBy("_bucket").agg(F.max("_key").alias("top")).collect())
    if not tops:
        return placed.select("_bucket", F.lit(0).alias("_copy"), "_key", "doc_id", "text")
    follows = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    after = docs.sparkSession.createDataFrame(follows, "_key long, _to int")
    both = placed.join(F.broadcast(after), "_key", "left").withColumn("_at", F.array(F.struct(F.col("_bucket"), F.lit(0).alias("_copy")), F.struct(F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))))
    return both.select(F.explode("_at").alias("_at"), "_key", "doc_id", "text").select("_at._bucket", "_at._copy", "_key", "doc_id", "text").filter("_bucket IS NOT NULL")


def fingerprint_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like the edited and the next one are."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc("_key"), "text")
    rows = in_order(docs, buckets).select("_bucket", "_copy", "doc_id", "text", F.lead("text").over(order).alias("_next"), F.row_number().over(order).alias("_row"))
    sized = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = sized.select("_bucket", "_row", "_copy", "doc_id", "n_chars", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)).alias("edited"))
    keyed = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = fingerprint_texts(keyed, ["_bucket", "_row", "_copy", "doc_id", "n_chars", "edited_sha256"], ["text", "edited"])
    by_row = Window.partitionBy("_bucket").orderBy("_row")
    after = prints.withColumn("next_hi", F.lead("text_hi").over(by_row)).withColumn("next_lo", F.lead("text_lo").over(by_row)).filter("_copy = 0")
    return after.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_of("text_hi", "text_lo").alias("fingerprint"),
        hex_of("edited_hi", "edited_lo").alias("edited_fingerprint"),
        likeness("text", "edited").alias("near_edited"),
        likeness("text", "next").alias("near_next"),
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """The bits of each choice of ``blocks - radius`` blocks, as signed 64-bit parts, the highest first."""
    if not 0 <= radius < blocks <= bits:
        raise ValueError("the radius must be smaller than the number of blocks")
    edge = [bits * i // blocks for i in range(blocks + 1)]
    whole = [reduce(lambda a, b: a | b, [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in c], 0) for c in combinations(range(blocks), blocks - radius)]
    return [[_signed(m >> 64 * k & (1 << 64) - 1) for k in reversed(range(bits // 64))] for m in whole]


def _tables(df: DataFrame, name: str, side: str, masks: list[list[int]]) -> DataFrame:
    """<side>_0 (and <side>_1), table, key: a row for each fingerprint and choice of blocks, the key a hash of their bits."""
    if name == "fp":
        halves = [F.col(name).cast("long")]
    else:
        digits = [F.conv(F.substring(F.col(name).cast("string"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
        halves = [F.shiftleft(digits[i], 32).bitwiseOR(digits[i + 1]) for i in (0, 2)]
    parts = [f"{side}_{k}" for k in range(len(halves))]
    own = df.select(*[h.alias(p) for h, p in zip(halves, parts)]).dropna().distinct()
    keys = [F.xxhash64(F.lit(i), *[F.col(p).bitwiseAND(F.lit(m)) for p, m in zip(parts, mask)]) for i, mask in enumerate(masks)]
    return own.select(*parts, F.posexplode(F.array(*keys)).alias("table", "key"))


def _apart(one: str, two: str, longs: int) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{one}_{k}").bitwiseXOR(F.col(f"{two}_{k}"))) for k in range(longs)])


def _first_table(one: str, two: str, masks: list[list[int]]) -> Column:
    """The first table in which the two sides agree, so that a pair counts once."""
    agree = [reduce(lambda a, b: a & b, [F.col(f"{one}_{k}").bitwiseXOR(F.col(f"{two}_{k}")).bitwiseAND(F.lit(m)) == 0 for k, m in enumerate(mask)]) for mask in masks]
    return F.coalesce(*[F.when(same, F.lit(i)) for i, same in enumerate(agree)])


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query, found, distance) of different-or-equal fingerprints within ``radius``.

    Both frames have a column ``fingerprint`` with 128 bits as 32 hex digits, as ``fingerprint_documents`` gives
    it, or a long column ``fp`` with 64 bits; duplicates count once. The bits are cut into ``blocks`` blocks; of
    two fingerprints within the radius at least blocks - radius blocks agree, so for each choice of that
    many a table keyed by their bits joins all such pairs, and the distance confirms them.
    """
    name = "fingerprint" if "fingerprint" in queries.columns else "fp"
    longs = 2 if name == "fingerprint" else 1
    masks = _masks(64 * longs, radius, blocks)
    pairs = _tables(queries, name, "query", masks).join(_tables(index, name, "found", masks), ["table", "key"])
    found = pairs.withColumn("distance", _apart("query", "found", longs)).filter((F.col("distance") <= radius) & (F.col("table") == _first_table("query", "found", masks)))
    return found.select(*[(hex_of(f"{c}_0", f"{c}_1") if longs == 2 else F.col(f"{c}_0")).alias(c) for c in ("query", "found")], "distance")


def _flips(masks: tuple[str, str]) -> Column:
    """The single bits of a 128-bit mask, each as a struct of two longs."""
    bits = [F.struct(F.lit(_signed(1 << p) if k == 0 else 0).cast("long").alias("hi"), F.lit(_signed(1 << p) if k == 1 else 0).cast("long").alias("lo")) for k in (0, 1) for p in range(64)]
    return F.filter(F.array(*bits), lambda f: (f["hi"].bitwiseAND(F.col(masks[0])) != 0) | (f["lo"].bitwiseAND(F.col(masks[1])) != 0))


def _crowded(own: DataFrame, hot: DataFrame, reach: DataFrame, radius: int) -> DataFrame:
    """(own_0, own_1, n_near) of the fingerprints ``hot``, in work that grows with their number, not with their pairs.

    Each fingerprint tells all points one bit off that it is there; let a(z) be how many told z. Of a fingerprint x
    let N1, N2, N3 be the numbers of others at these distances, and v the number of bits that may differ between it and
    those that share a group with it. Then a(x) = N1; the sum of a over the v points one bit off x is v + 2 N2, for x
    itself told each of them and a fingerprint two bits off told two; over the v (v - 1) / 2 points two bits off it is
    (v - 1) N1 + 3 N3. So a point needs v + v (v - 1) / 2 look-ups whatever the size of its group. ``reach`` names the v bits.
    """
    fp, group = ["own_0", "own_1"], ["table", "key"]
    free = [F.bit_or(f"free_{k}").alias(f"free_{k}") for k in (0, 1)]
    mine = own.join(hot, fp)
    # Whoever shares a group with x tells all points that x may ask, so that the sums hold to the bit.
    asked = mine.join(reach, fp).groupBy(*group).agg(*free)
    teller = own.join(asked, group).groupBy(*fp).agg(*free)
    off = lambda f: (F.col("own_0").bitwiseXOR(f["hi"]).alias("z_0"), F.col("own_1").bitwiseXOR(f["lo"]).alias("z_1"))
    told = teller.select(*fp, F.explode(_flips(("free_0", "free_1"))).alias("f")).select(*off(F.col("f"))).groupBy("z_0", "z_1").agg(F.count("*").alias("a"))
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")))
    one = F.col("one")
    two = F.flatten(F.transform(one, lambda f, i: F.transform(F.slice(one, i + 2, F.size(one)), lambda g: F.struct(f["hi"].bitwiseOR(g["hi"]).alias("hi"), f["lo"].bitwiseOR(g["lo"]).alias("lo")))))
    steps = [nothing, one, two][:radius]
    rows = reach.select(*fp, _flips(("free_0", "free_1")).alias("one"))
    asks = rows.select(*fp, F.size("one").alias("v"), F.explode(F.concat(*steps)).alias("f")).select(*fp, "v", (F.bit_count("f.hi") + F.bit_count("f.lo")).alias("step"), *off(F.col("f")))
    sums = asks.join(told, ["z_0", "z_1"]).groupBy(*fp, "v").agg(*[F.coalesce(F.sum(F.when(F.col("step") == i, F.col("a"))), F.lit(0)).alias(f"s{i}") for i in range(3)])
    n1, v = F.col("s0"), F.col("v")
    near = [n1, (F.col("s1") - v) / 2, (F.col("s2") - (v - 1) * n1) / 3][:radius]
    return sums.select(*fp, F.round(reduce(lambda a, b: a + b, near)).cast("long").alias("n_near"))


def near_counts(prints: DataFrame, radius: int = 3, blocks: int = 5, hot: int | None = None) -> DataFrame:
    """(fingerprint, n_near) of all fingerprints that have others within ``radius`` (1 to 3); null ones are left out.

    Fingerprints in a group of a table with more than ``hot`` (HOT if not given) are counted by ``_crowded``, the
    others, with at most that many to meet in each table, by pairs.
    """
    if not 1 <= radius <= 3:
        raise ValueError("near fingerprints are counted for a radius of 1, 2 or 3")
    hot = HOT if hot is None else hot
    masks, fp, group = _masks(128, radius, blocks), ["own_0", "own_1"], ["table", "key"]
    own = scratch(_tables(prints, "fingerprint", "own", masks), "near-blocks")
    held = own.groupBy(*group).agg(F.count("*").alias("size"), *[F.bit_or(f"own_{k}").bitwiseXOR(F.bit_and(f"own_{k}")).alias(f"free_{k}") for k in (0, 1)])
    groups = scratch(held.filter("size > 1"), "near-groups")
    meet = own.join(groups.filter(F.col("size") <= hot).select(*group), group, "left_semi")
    asking, parts, crowd = meet, [], scratch(own.join(groups.filter(F.col("size") > hot).select(*group), group, "left_semi").select(*fp).distinct(), "near-crowd")
    done = [own, groups, crowd]
    if not crowd.isEmpty():
        asking = meet.join(crowd, fp, "left_anti")
        free = [F.bit_or(f"free_{k}").alias(f"free_{k}") for k in (0, 1)]
        reach = scratch(own.join(crowd, fp).join(groups.drop("size"), group).groupBy(*fp).agg(*free), "near-reach")
        done.append(reach)
        parts = [_crowded(own, crowd, reach, radius)]
    sides = [df.select(*[F.col(f"own_{k}").alias(f"{side}_{k}") for k in (0, 1)], *group) for side, df in (("query", asking), ("found", meet))]
    apart = _apart("query", "found", 2)
    pairs = sides[0].join(sides[1], group).filter(apart.between(1, radius) & (F.col("table") == _first_table("query", "found", masks)))
    counts = pairs.groupBy(F.col("query_0").alias("own_0"), F.col("query_1").alias("own_1")).agg(F.count("*").alias("n_near"))
    out = scratch(reduce(DataFrame.unionByName, parts, counts).filter("n_near > 0").select(hex_of("own_0", "own_1").alias("fingerprint"), "n_near"), "near-counts")
    discard(*done)
    return out


def with_near(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``prints``, all columns, and n_near: how many other fingerprints of the table lie within the radius of a row's own.

    Rows of one fingerprint are dealt over SALTS keys; a null fingerprint has none.
    """
    near, salt = near_counts(prints, radius, blocks), fresh(prints, "_salt")
    near = near.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = prints.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(near, ["fingerprint", salt], "left").select(*prints.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op3_simhash(spark, sf_dir):
    return with_near(scratch(fingerprint_documents(table(spark, sf_dir, "documents")), "fingerprints"))
