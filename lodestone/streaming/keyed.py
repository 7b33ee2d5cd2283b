"""First rows of keys in a stream, by keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.keys import pk_key
from ..sources import files

BUCKETS = 4096


def _places(rows: pa.Table, keys: list[str], order: list[str]) -> np.ndarray:
    """Where the first row of every key stands, nulls first, in the order of the rows."""
    sorted_ = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()
    rank = np.empty(len(sorted_), np.int64)
    rank[sorted_] = np.arange(len(sorted_))
    ranked = pa.table([*(rows.column(k) for k in keys), pa.array(rank)], names=[*map(str, range(len(keys))), "rank"])
    best = ranked.group_by(ranked.column_names[:-1], use_threads=False).aggregate([("rank", "min")]).column("rank_min").to_numpy()
    return np.sort(sorted_[best]).astype(np.int64)


def _firsts(keys: list[str], order: list[str]):
    """Of each Arrow batch the first row of every key: a hot key sends a row a batch to the shuffle, not all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(_places(pa.Table.from_batches([b]), keys, order)))

    return run


def _pack(known: dict[str, int]) -> bytes:
    table = pa.table({"key": pa.array(known.keys(), pa.string()), "until": pa.array(known.values(), pa.int64())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(held: bytes) -> dict[str, int]:
    table = pa.ipc.open_stream(held).read_all()
    return dict(zip(table.column("key").to_pylist(), table.column("until").to_pylist()))


def first_of_keys(rows: DataFrame, keys: list[str], order: list[str], time: str, ttl_seconds: int = 7 * 86400, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The first row of each key that the stream ``rows`` brings, all columns; write it in append mode.

    Of the rows of a key in one micro-batch the first by ``order`` goes on (nulls first); in later batches the key
    is known and its rows go. A key is forgotten ``ttl_seconds`` after its first row, when the watermark of ``time``, which
    runs ``late`` behind, has passed that point; from then on it counts as new. Rows behind the watermark, rows without
    a complete key and rows without a time are left out. The state, in Spark's checkpointed state store, holds the keys
    of a bucket together, by their hash, with the time until which each is known: Python is called for each bucket
    that a batch touches, not for each key. A batch costs what it brings and the keys of the buckets it touches, and a
    stream that begins again from its checkpoint repeats nothing; it has to keep the number of buckets.
    """
    files.ship(rows.sparkSession)
    # Whole numbers travel as text: pandas would turn nullable ones into floats.
    whole = {f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)}
    plain = [F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in rows.columns]
    complete = rows.dropna(subset=[*keys, time])
    # The time as a number is the same whatever the session's time zone.
    longest = max(rows.columns, key=len)
    millis, own, bucket = f"{longest}_millis", f"{longest}_key", f"{longest}_bucket"
    few = complete.mapInArrow(_firsts(keys, order), rows.schema).withWatermark(time, late)
    dealt = few.select(*plain, F.unix_millis(F.col(f"`{time}`").cast("timestamp")).alias(millis), pk_key(keys).alias(own))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int"))

    def places(frame: pd.DataFrame) -> np.ndarray:
        columns = {own: pa.array(frame[own], pa.string())}
        for i, c in enumerate(order):
            values = pa.array(frame[c], pa.string() if c in whole else None, from_pandas=True)
            columns[str(i)] = values.cast(pa.int64()) if c in whole else values
        return _places(pa.table(list(columns.values()), names=["key", *map(str, range(len(order)))]), ["key"], [str(i) for i in range(len(order))])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, mark = _unpack(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            best = None
            for frame in frames:
                pool = frame if best is None else pd.concat([best, frame], ignore_index=True)
                best = pool.iloc[places(pool)]
            new = best[[k not in known for k in best[own]]]
            for k, since in zip(new[own], new[millis]):
                known[k] = max(int(since) + 1000 * ttl_seconds, mark + 1)
            if len(new):
                yield new.drop(columns=[millis, own, bucket])
        known = {k: until for k, until in known.items() if until >= mark}
        if known:
            state.update((_pack(known),))
            state.setTimeoutTimestamp(max(min(known.values()), mark + 1))
        else:
            state.remove()

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in rows.schema])
    made = dealt.groupBy(F.col(f"`{bucket}`")).applyInPandasWithState(run, schema, "known binary", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in rows.schema])
