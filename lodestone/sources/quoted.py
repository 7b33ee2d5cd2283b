"""Delimited text with line breaks inside quotes, read by many tasks.

Where a record begins depends on everything before it: a line belongs to the one before while a quoted field is
open. But a line turns only one of two states (a quoted field is open at its start, or not) into one of the two, and
such functions compose. So each split of a file is scanned once for both states: in which state it ends and how many
records begin in it, from either. A prefix scan over the splits, a few numbers each, tells in which state every split
really begins and how many records come before it. A second scan then puts the records together: whole ones within
their split, and the pieces of a record that crosses splits, at most two for each split, in a small grouping of their
own. Text is neither shuffled nor held: a task streams its lines and keeps the record that it is in.

Quotes follow the reader's rules: one opens a field only as its first character, two in a row stand for one, and after
the closing one the rest up to the delimiter is taken as it is.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: The split table is broadcast up to so many splits (60 bytes each, so 30 MB); beyond, it is joined.
BROADCAST_SPLITS = 500_000


def patterns(delimiter: str) -> tuple[str, str]:
    """Two regular expressions: a line that starts outside quotes ends outside; one that starts inside ends outside."""
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*+"(?!")[^{d}]*+|(?!")[^{d}]*+)'
    rest = rf"(?:{d}{field})*+"
    return rf"(?s)\A{field}{rest}\z", rf'(?s)\A(?:[^"]|"")*+"(?!")[^{d}]*+{rest}\z'


def _compiled(delimiter: str):
    return [re.compile(p.replace(r"\z", r"\Z").encode()) for p in patterns(delimiter)]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _start, value) of every line, ended by a line feed; a split's lines follow each other in one task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), "value")


def has_open_lines(spark: SparkSession, path: str, delimiter: str = ",") -> bool:
    """Whether a line read by itself leaves a quoted field open. Stops at the first such line of each task."""
    closed = patterns(delimiter)[0]
    return not lines_of(spark, path).filter(F.col("value").contains('"') & ~F.col("value").rlike(closed)).select(F.lit(1)).limit(1).isEmpty()


class States:
    """The state after each line, from the state before the first."""

    def __init__(self, delimiter: str):
        self.closes = _compiled(delimiter)

    def opens(self, values: pa.Array, inside: bool):
        """A flag for each line: a quoted field is open at its start; and the state after the last line."""
        import numpy as np

        out = np.empty(len(values), bool)
        marked = np.flatnonzero(pc.greater_equal(pc.find_substring(values, b'"'), 0).to_numpy(zero_copy_only=False))
        at = 0
        for i, line in zip(marked.tolist(), values.take(pa.array(marked)).to_pylist()):
            out[at : i + 1] = inside
            at, inside = i + 1, not self.closes[inside].match(line)
        out[at:] = inside
        return out, inside


def _runs(batch: pa.RecordBatch):
    """Pieces of a batch that come from one split."""
    import numpy as np

    paths, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    edge = [0, *(np.flatnonzero((paths[1:] != paths[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(edge, edge[1:]):
        if b > a:
            yield batch.column(0)[a].as_py(), int(starts[a]), batch.column(2).slice(a, b - a)


def _blank(values: pa.Array):
    return pc.is_in(values, pa.array([b"", b"\r"])).to_numpy(zero_copy_only=False)


SCAN = pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("after_0", pa.bool_()), ("after_1", pa.bool_()), ("begun_0", pa.int64()), ("begun_1", pa.int64())])


def _scan(delimiter: str):
    def run(batches):
        states, key, now = States(delimiter), None, None
        for b in batches:
            for path, start, values in _runs(b):
                if (path, start) != key:
                    if key:
                        yield _row(key, now)
                    key, now = (path, start), [False, True, 0, 0]
                blank = _blank(values)
                for s in (0, 1):
                    open_, now[s] = states.opens(values, now[s])
                    now[2 + s] += int((~open_ & ~blank).sum())
        if key:
            yield _row(key, now)

    def _row(key, now):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *now), SCAN)], schema=SCAN)

    return run


def split_table(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(_path, _start, inside, crosses, index, base): the state in which a split begins, whether a record crosses one of
    its ends, the records of its file that begin before it, and the rows of all files before, which are read in order
    of their paths and each have a header.
    """
    files.ship(spark)
    lines = lines_of(spark, path).withColumn("value", F.col("value").cast("binary"))
    scanned = files.materialize(lines.mapInArrow(_scan(delimiter), "_path string, _start long, after_0 boolean, after_1 boolean, begun_0 long, begun_1 long"), "splits")
    # A split keeps the state, turns it round, or ends in the same one however it began.
    in_file = Window.partitionBy("_path").orderBy("_start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("after_0") == F.col("after_1"), F.col("after_0").cast("int"))
    told = scanned.withColumn("fixed", fixed).withColumn("turns", F.sum(F.when(F.col("fixed").isNull() & F.col("after_0"), 1).otherwise(0)).over(in_file))
    # The last split that fixed the state, and the turns since then.
    told = told.withColumns({"anchor": F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), True).over(earlier), "all": F.coalesce(F.max("turns").over(earlier), F.lit(0))})
    inside = (F.coalesce("anchor.fixed", F.lit(0)) + F.col("all") - F.coalesce("anchor.turns", F.lit(0))) % 2 == 1
    crosses = F.col("inside") | F.when(F.col("inside"), F.col("after_1")).otherwise(F.col("after_0"))
    begun = told.withColumn("inside", inside).withColumn("crosses", crosses).withColumn("begun", F.when(F.col("inside"), F.col("begun_1")).otherwise(F.col("begun_0")))
    placed = begun.withColumn("index", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    rows = placed.groupBy("_path").agg(F.greatest(F.sum("begun") - 1, F.lit(0)).alias("rows"))
    base = rows.select("_path", F.coalesce(F.sum("rows").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.materialize(placed.join(base, "_path").select("_path", "_start", "inside", "crosses", "index", "base"), "split-table")


PIECE = pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("place", pa.int64()), ("kind", pa.int8()), ("record", pa.binary())])
WHOLE, TAIL, HEAD = 0, 1, 2


def _assemble(delimiter: str, crossing: bool = False):
    """Each split's records with their places: whole ones, the last one's beginning (TAIL), the end of one before (HEAD).

    ``crossing``: only those that cross the ends of splits. The records of several lines of an input batch go on together.
    """

    def run(batches):
        import numpy as np

        states, key, inside, count, held, kind = States(delimiter), None, False, 0, [], WHOLE
        made = [[] for _ in PIECE]

        def piece(place):
            if kind != WHOLE or not crossing:
                for column, v in zip(made, (*key, place, kind, b"\n".join(held))):
                    column.append(v)

        def flush():
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, PIECE)], schema=PIECE)
                for column in made:
                    column.clear()

        for b in batches:
            at = 0
            for path, start, values in _runs(b):
                if (path, start) != key:
                    if held:
                        kind = TAIL if kind == WHOLE else HEAD
                        piece(count - 1)
                    key, count, held = (path, start), 0, []
                    inside = b.column(3)[at].as_py()
                    kind = HEAD if inside else WHOLE
                at += len(values)
                open_, after = states.opens(values, inside)
                goes_on = np.append(open_[1:], after)
                begins = ~open_ & ~_blank(values)
                number = count - 1 + np.cumsum(begins)
                single = np.flatnonzero(begins & ~goes_on)
                n = len(single)
                if n and not crossing:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(number[single]), pa.array([WHOLE] * n, pa.int8()), values.take(pa.array(single))], schema=PIECE)
                several = np.flatnonzero(open_ | (begins & goes_on))
                for line, of, more in zip(values.take(pa.array(several)).to_pylist(), number[several].tolist(), goes_on[several].tolist()):
                    held.append(line)
                    if not more:
                        piece(of)
                        held, kind = [], WHOLE
                count, inside = int(number[-1]) + 1, after
            yield from flush()
        if held:
            kind = TAIL if kind == WHOLE else HEAD
            piece(count - 1)
        yield from flush()

    return run


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(row_number, record): the text of each record but the files' headers, numbered from 1 in file order."""
    table = split_table(spark, path, delimiter)
    few = table.count() <= BROADCAST_SPLITS
    beside = F.broadcast if few else lambda splits: splits  # a broadcast join keeps the order of the lines
    lines = lines_of(spark, path)
    if not few:
        lines = lines.withColumn("_at", F.monotonically_increasing_id())

    def pieces(splits: DataFrame, crossing: bool = False) -> DataFrame:
        begun = lines.join(beside(splits.select("_path", "_start", "inside")), ["_path", "_start"])
        begun = begun if few else begun.repartition("_path", "_start").sortWithinPartitions("_path", "_start", "_at")
        values = begun.select("_path", "_start", F.col("value").cast("binary").alias("value"), "inside")
        return values.mapInArrow(_assemble(delimiter, crossing), "_path string, _start long, place long, kind byte, record binary")

    # Two pieces a split at most cross its ends, and only some splits have any. A record is a tail with the heads up to
    # the next one.
    crossing = files.materialize(pieces(table.filter("crosses"), True), "crossing")
    tails = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("_path").orderBy("_start", "kind_order"))
    marked = crossing.withColumn("kind_order", F.when(F.col("kind") == HEAD, 0).otherwise(1)).withColumn("of", tails)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_start", F.col("record").cast("string").alias("text")))), lambda x: x["text"]), "\n").cast("binary")
    joined = marked.groupBy("_path", "of").agg(F.min(F.struct("_start", "place")).alias("first"), whole.alias("record")).select("_path", F.col("first._start").alias("_start"), F.col("first.place").alias("place"), "record")
    every = pieces(table).filter(F.col("kind") == WHOLE).select("_path", "_start", "place", "record").unionByName(joined)
    numbered = every.join(beside(table.select("_path", "_start", "index", "base")), ["_path", "_start"]).withColumn("_of_file", F.col("index") + F.col("place")).filter("_of_file > 0")
    return numbered.select((F.col("base") + F.col("_of_file")).alias("row_number"), F.regexp_replace(F.col("record").cast("string"), r"\r\z", "").alias("record"))


def read(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", name: str = "row_number") -> DataFrame:
    """The records' fields as text columns, and their numbers."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    fields = F.from_csv("record", schema, {"sep": delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return records(spark, path, delimiter).select(fields.alias("_fields"), "row_number").select("_fields.*", F.col("row_number").alias(name))
