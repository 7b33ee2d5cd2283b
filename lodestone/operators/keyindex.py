"""Keys of a table in fixed buckets, so that an append looks at few of them and moves none.

Each append leaves a segment: its keys, hashed to a fixed number of buckets by Spark's own bucketing and sorted in each,
and a Bloom filter for each bucket, in pages of 4 KB (a key's bits all lie in one page). The next append hashes its
keys the same way and asks the filters: only bucket files whose filter may hold one of its keys are opened, and since
they are bucketed, the join shuffles the new keys alone. Segments of like size are merged once there are many,
bucket by bucket, again without moving keys between tasks; so an append meets a few segments however many came before.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import pk_key
from ..sources import commits, files

KEY = "_pk_hash"
BUCKETS = 64
PAGE_BITS = 4096 * 8
BITS_A_KEY, PROBES = 16, 6  # one key in a thousand is taken for a known one
SEGMENTS = 8  # beyond so many the smaller half is merged


def bucket_of(buckets: int) -> Column:
    """The bucket that Spark writes a key to."""
    return F.pmod(F.hash(KEY), F.lit(buckets))


def _page(pages: Column) -> Column:
    return F.pmod(F.xxhash64(KEY, F.lit(-1)), pages).cast("int")


def _bits() -> list[Column]:
    return [F.pmod(F.xxhash64(KEY, F.lit(i)), F.lit(PAGE_BITS)) for i in range(PROBES)]


def write_segment(keys: DataFrame, root: str, buckets: int) -> dict:
    """Store keys, each once, as a segment with its filters; an exchange of these keys only."""
    spark, name = keys.sparkSession, uuid.uuid4().hex
    path, table = f"{root}/keys_index/data/segment={name}", f"lodestone_segment_{name}"
    dealt = keys.select(KEY).repartition(buckets, KEY)
    dealt.write.bucketBy(buckets, KEY).sortBy(KEY).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")
    rows = spark.read.parquet(path)
    n = rows.count()
    pages = max(1, -(-n * BITS_A_KEY // (buckets * PAGE_BITS)))
    marked = rows.select(bucket_of(buckets).alias("bucket"), _page(F.lit(pages)).alias("page"), F.explode(F.array(*_bits())).alias("bit"))
    marked.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{root}/keys_index/filters/segment={name}")
    return {"segment": name, "keys": n, "pages": pages}


def may_hold(keys: DataFrame, root: str, segments: list[dict], buckets: int) -> list[tuple[str, int]]:
    """The (segment, bucket) pairs whose filter may hold one of the keys; as many rows as there are bucket files at most."""
    if not segments:
        return []
    spark = keys.sparkSession
    filters = spark.read.option("basePath", f"{root}/keys_index/filters").parquet(*[f"{root}/keys_index/filters/segment={s['segment']}" for s in segments])
    each = F.explode(F.array(*[F.struct(F.lit(s["segment"]).alias("segment"), F.lit(s["pages"]).alias("pages")) for s in segments]))
    asked = keys.select(KEY, bucket_of(buckets).alias("bucket"), each.alias("s")).select(KEY, "bucket", "s.segment", _page(F.col("s.pages")).alias("page"))
    found = F.lit(True)
    for bit in _bits():
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    hits = asked.join(filters.withColumn("segment", F.col("segment").cast("string")), ["segment", "bucket", "page"]).filter(found)
    return [(r["segment"], r["bucket"]) for r in hits.select("segment", "bucket").distinct().collect()]


@contextmanager
def opened(spark: SparkSession, root: str, segments: list[str], buckets: int, only: list[tuple[str, int]] | None = None) -> Iterator[DataFrame]:
    """The keys of segments as a bucketed table, of the chosen bucket files only; for use within the block."""
    name, place = f"lodestone_keys_{uuid.uuid4().hex}", f"{root}/keys_index/data".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({KEY} STRING, segment STRING) USING parquet PARTITIONED BY (segment) CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(f'PARTITION (segment={s!r})' for s in segments)}")
        rows = spark.table(name)
        if only is not None:
            wanted = set(only)
            chosen = [f for s in segments for f in files.children(spark, f"{root}/keys_index/data/segment={s}") if (b := re.search(r"_(\d{5})\.c", f)) and (s, int(b[1])) in wanted]
            rows = rows.filter(F.col("_metadata.file_name").isin(chosen))
        yield rows.select(KEY)
    finally:
        spark.sql(f"DROP TABLE {name}")


@contextmanager
def unknown(rows: DataFrame, root: str, segments: list[dict], buckets: int) -> Iterator[DataFrame]:
    """Those of ``rows``, whose keys differ, that no segment holds; for use within the block."""
    pairs = may_hold(rows, root, segments, buckets)
    if not pairs:
        yield rows
        return
    with opened(rows.sparkSession, root, sorted({s for s, _ in pairs}), buckets, pairs) as known:
        # Bucketed files are joined as they lie: only the new rows are exchanged.
        yield rows.join(known.hint("merge"), KEY, "left_anti")


def merge(spark: SparkSession, root: str) -> bool:
    """Merge the smaller half of the segments, if there are many, and commit that."""
    state = commits.replay(spark, root)
    if len(state.segments) <= SEGMENTS:
        return False
    buckets = state.meta["buckets"]
    small = sorted(state.segments, key=lambda s: s["keys"])[: -(-len(state.segments) // 2)]
    with opened(spark, root, [s["segment"] for s in small], buckets) as keys:
        made = write_segment(keys, root, buckets)
    own = {s["segment"] for s in small}

    def settle(entry, others):
        if any(own & set(o.get("replaces") or []) for o in others):
            raise commits.Conflict("another writer has merged these segments")
        return entry

    try:
        commits.commit(spark, root, {"segments": [made], "replaces": sorted(own)}, state.version, settle)
    except commits.Conflict:
        return False
    return True


def _rebuilt(spark: SparkSession, root: str, keys: list[str], state: commits.State) -> commits.State:
    """The state with an index of all its rows: made anew where segments are lost, or the table had none before."""
    there = set(files.children(spark, f"{root}/keys_index/data")) & set(files.children(spark, f"{root}/keys_index/filters"))
    if all(f"segment={s['segment']}" in there for s in state.segments) and sum(s["keys"] for s in state.segments) == sum(s["rows"] for s in state.snapshots):
        return state
    every = commits.scan(spark, root, state.version).select(pk_key(keys).alias(KEY)).distinct()
    made = write_segment(every, root, state.meta["buckets"])
    gone = {s["segment"] for s in state.segments}

    def settle(entry, others):
        if any(o.get("replaces") for o in others):
            raise commits.Conflict("another writer has changed the index")
        return entry

    commits.commit(spark, root, {"segments": [made], "replaces": sorted(gone)}, state.version, settle)
    return commits.replay(spark, root)


def append_new(rows: DataFrame, root: str, keys: list[str], snapshot: str, buckets: int = BUCKETS) -> int:
    """Append those of ``rows`` (KEY, each once, and the table's columns) whose key the table has not; their number.

    Nothing is committed where there are none. Where other appends are committed meanwhile, this one's keys are compared
    with theirs alone, and its rows are written again without those that they have brought.
    """
    spark = rows.sparkSession
    commits.begin(spark, root, buckets=buckets)
    state = commits.replay(spark, root)
    if "buckets" not in state.meta:
        state.version = commits.commit(spark, root, {"meta": {"buckets": buckets}}, state.version)
        state = commits.replay(spark, root)
    state = _rebuilt(spark, root, keys, state)
    buckets = state.meta["buckets"]

    def write(fresh: DataFrame, name: str) -> dict:
        listing, n = commits.write_snapshot(fresh.drop(KEY), root, name)
        if not n:
            files.remove(spark, f"{root}/data/snapshot={name}")
            return {}
        segment = write_segment(spark.read.parquet(f"{root}/data/snapshot={name}").select(pk_key(keys).alias(KEY)), root, buckets)
        return {"snapshot": name, "files": listing, "rows": n, "scope": None, "schema": fresh.drop(KEY).schema.jsonValue(), "segments": [segment]}

    with unknown(rows, root, state.segments, buckets) as fresh:
        entry = write(fresh, snapshot)

    def settle(entry: dict, others: list[dict]) -> dict:
        theirs = [s for o in others if o.get("snapshot") for s in o.get("segments") or []]
        own = spark.read.parquet(f"{root}/data/snapshot={entry['snapshot']}").withColumn(KEY, pk_key(keys))
        with unknown(own, root, theirs, buckets) as left:
            if left is own:
                return entry
            again = write(left, f"{entry['snapshot']}x")
        if again.get("rows") == entry["rows"]:
            files.remove(spark, f"{root}/data/snapshot={again['snapshot']}")
            return entry
        files.remove(spark, f"{root}/data/snapshot={entry['snapshot']}")
        if not again:
            raise commits.Conflict("other writers have brought all of these keys")
        return again

    if not entry:
        return 0
    committed: list[dict] = [entry]

    def settled(entry: dict, others: list[dict]) -> dict:
        committed[0] = settle(entry, others)
        return committed[0]

    try:
        commits.commit(spark, root, entry, state.version, settled)
    except commits.Conflict:
        return 0
    merge(spark, root)
    return committed[0]["rows"]
