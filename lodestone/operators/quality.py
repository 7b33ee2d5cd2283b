"""Quality counts and samples over a frame with __accept and __v_<i> columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _counts(rules: int, keys: list[str]) -> list[Column]:
    complete = F.col("__accept")
    for k in keys:
        complete = complete & F.col(f"`{k}`").isNotNull()
    return [F.count("*").alias("rows"), F.count_if("__accept").alias("accepted"), F.count_if(complete).alias("complete"), *[F.count_if(F.col(f"__v_{i}")).alias(f"v{i}") for i in range(rules)]]


def _totals(row: dict, rules: int) -> dict:
    return {"rows": row["rows"], "accepted": row["accepted"], "complete": row["complete"], "violations": [row[f"v{i}"] for i in range(rules)]}


def totals(frame: DataFrame, rules: int, keys: list[str] = ()) -> dict:
    """Rows, accepted rows, accepted rows with complete keys and violations of each rule, in one pass."""
    return _totals(frame.agg(*_counts(rules, keys)).first().asDict(), rules)


class Observed:
    """The same totals, counted while the frame is written for another purpose.

    ``frame`` has to be written by a job without a shuffle: then each task's counts enter once, whatever is run again.
    """

    def __init__(self, frame: DataFrame, rules: int, keys: list[str] = ()):
        self.observation, self.rules = Observation(), rules
        self.frame = frame.observe(self.observation, *_counts(rules, keys))

    def totals(self) -> dict:
        return _totals(self.observation.get, self.rules)


def summary(frame: DataFrame, codes: list[str]) -> DataFrame:
    """(rule_code, violations, checked_rows) of every rule, from one aggregate."""
    counted = frame.agg(*_counts(len(codes), []))
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule_code"), F.col(f"v{i}").alias("violations"), F.col("rows").alias("checked_rows")) for i, c in enumerate(codes)])))


def invalid(rules: int) -> Column:
    bad = ~F.col("__accept")
    for i in range(rules):
        bad = bad | F.coalesce(F.col(f"__v_{i}"), F.lit(False))
    return bad


def sample_text(rules: int, sources: list[str]) -> Column:
    """The source columns of a row that is refused or breaks a rule, as JSON; NULL for any other."""
    return F.when(invalid(rules), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sources]), {"ignoreNullFields": "false"}))


def first_samples(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """(row_no, source_values) of the first rows by __row that have a __sample.

    No sort: every task keeps ``limit`` rows at most, and so does what merges them.
    """
    first = rows.filter("__sample IS NOT NULL").select("__row", "__sample").orderBy("__row").limit(limit)
    return first.select((F.row_number().over(Window.orderBy("__row")) - 1).alias("row_no"), F.col("__sample").alias("source_values"))


def invalid_samples(rows: DataFrame, limit: int = 1000) -> list[dict]:
    """The first rows that are refused or break a rule, as JSON documents; ``limit`` of them at most come to the driver."""
    return [{"reason_code": "INVALID", "message": "filters failed or DQ violation", "row_no": r["row_no"], "source_values": json.loads(r["source_values"])} for r in first_samples(rows, limit).orderBy("row_no").collect()]
