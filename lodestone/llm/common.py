"""Shared plumbing of the training-data operators: table access, scratch tables, worker caches."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    # Rows are whole documents: few of them make a batch large enough.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset a temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'lodestone-checkpoints')}"
    return root.rstrip("/")


TIDY_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's own shuffle files go when it ends. The table goes with ``discard``, or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY_SHUFFLES, "false")
    spark.conf.set(TIDY_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY_SHUFFLES, before)
    target, files = _file(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        target, files = _file(t.sparkSession, t._scratch_path)
        files.delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def cached(key, build):
    """The last object that was asked for in this Python process and stage; workers are reused from task to task."""
    held = sys.__dict__.setdefault("_lodestone_held", {})
    if key not in held:
        held.clear()
        tidy()
        held[key] = build()
    sys.__dict__["_lodestone_stage"] = _stage()
    return held[key]


def _forget() -> None:
    """Let go of what an earlier stage has cached in this process."""
    held = sys.__dict__.get("_lodestone_held")
    if held and sys.__dict__.get("_lodestone_stage") != _stage():
        held.clear()
        tidy()


def tidied(run):
    """``run``, a function of record batches, before which earlier stages' caches go and after which freed memory is given back."""

    def made(batches):
        _forget()
        yield from run(batches)
        tidy()

    return made


def tidy() -> None:
    """Give freed memory back: workers live on from task to task and from stage to stage."""
    sys.__dict__.pop("_lodestone_powers", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def remainder(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches, rows: int = 512, chars: int = 1_000_000):
    """Cut record batches so that a piece holds few rows and, but for single long texts, few bytes."""
    _forget()
    for b in batches:
        size = max(1, min(rows, b.num_rows, int(rows if not b.nbytes else max(1, chars * b.num_rows // b.nbytes))))
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
    tidy()


BITMAP_BITS = 1 << 26  # 8 MB, whatever the number of keys


def key_bitmap(keys: DataFrame, *columns: str) -> bytes:
    """A bitmap of fixed size with the hashed keys' bits set; the driver gets 8 MB at most."""
    return bitmap_of(keys, F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)))


def bitmap_of(keys: DataFrame, bit) -> bytes:
    """A bitmap of fixed size with the bits that the column ``bit`` names."""
    at = keys.select((bit + 1).alias("p"))  # buckets and bits count from 1
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()
    size = len(parts[0]["b"]) if parts else 4096
    out = bytearray(BITMAP_BITS // 8)
    for r in parts:
        out[(r["k"] - 1) * size : r["k"] * size] = r["b"]
    return bytes(out)


def maybe_in(df: DataFrame, bitmap: bytes, *columns: str, keep: bool = True, once: bool = False) -> DataFrame:
    """Rows whose key may be in the bitmap (``keep``), or those whose key certainly is not.

    ``once``: a task gives one row only of those with equal keys, which must be numbers.
    """
    held = df.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB
    src = df.withColumn(fresh(df, "_bit"), F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)))
    places = [df.columns.index(c) for c in columns]

    def run(batches):
        import numpy as np

        bits, seen = np.frombuffer(held.value, np.uint8), set()
        for b in batches:
            p = b.column(b.num_columns - 1).to_numpy()
            out = b.select(b.schema.names[:-1]).filter(pa.array(((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1) == keep))
            if once:
                keys = list(zip(*(out.column(i).to_pylist() for i in places)))
                new = [k not in seen and not seen.add(k) for k in keys]
                out = out.filter(pa.array(new, pa.bool_()))
            yield out

    return src.mapInArrow(tidied(run), df.schema)


def restrict(df: DataFrame, keys: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """``df`` semi-joined with ``keys`` (distinct or not); a bitmap keeps most other rows out of the shuffle."""
    return maybe_in(df, key_bitmap(keys, *columns), *columns, once=once).join(keys.select(*columns), list(columns), "left_semi").select(df.columns)


def without(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``df`` anti-joined with ``keys``; rows that the bitmap rules out skip the shuffle."""
    bitmap = key_bitmap(keys, *columns)
    rest = maybe_in(df, bitmap, *columns).join(keys.select(*columns), list(columns), "left_anti").select(df.columns)
    return maybe_in(df, bitmap, *columns, keep=False).unionByName(rest)


_SPACE = [9, 10, 11, 12, 13, 32]
_STEP = 0x9E3779B97F4A7C1B  # 3 modulo 8: neither it less 1 nor it plus 1 has many factors of 2


def _powers(n: int, base: int):
    import numpy as np

    held = sys.__dict__.setdefault("_lodestone_powers", {})
    if len(held.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        held[base] = np.multiply.accumulate(out)
    out = held[base]
    if n < 1 << 23 < len(out):  # made for a very long text
        held[base] = out[: 1 << 23].copy()
    return out


def word_hashes(texts, lower: bool = False):
    """64-bit hashes of the words of all texts, end to end, and how many each text has.

    texts: strings, or an Arrow column of them; null is empty. Words are what ASCII white space leaves; ``lower`` lowers
    A-Z. A word's hash is a polynomial in its bytes' random numbers, taken from sums over the whole batch.
    """
    import numpy as np

    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    column = column.fill_null("") if column.null_count else column
    edge = np.frombuffer(column.buffers()[1] or bytes(4), np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    if not len(column) or edge[-1] == edge[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    data, edge = np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]], edge - edge[0]
    number, inside = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64), np.ones(256, bool)
    inside[_SPACE] = False
    if lower:
        number[65:91] = number[97:123]
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = edge[:-1][edge[:-1] < edge[1:]]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[begins[1:] - 1] = word[begins[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    total = number[data]
    total *= _powers(len(data), _STEP)[: len(data)]
    np.add.accumulate(total, out=total)
    h = total[end] - np.where(start > 0, total[start - 1], np.uint64(0))
    h *= _powers(len(data), pow(_STEP, -1, 1 << 64))[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h, np.diff(np.searchsorted(start, edge))


def gather(values: list[bytes], codes, width: int = 4):
    """Integers of ``width`` bytes: those of each code's value, one after the other; and where each code's begin."""
    import numpy as np

    size = np.array([len(v) for v in values], np.int64) // width
    edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[codes])])
    flat = np.frombuffer(b"".join(values), f"<u{width}")
    return flat[np.repeat((np.cumsum(size) - size)[codes] - edge[:-1], size[codes]) + np.arange(edge[-1])], edge
