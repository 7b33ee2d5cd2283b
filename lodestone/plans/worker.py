"""Metadata-driven runs: request, mapping, quality, incremental append, response."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mapping as M
from ..functions.keys import pk_key
from ..operators import keyindex, quality
from ..operators.dedup import keep_first
from ..sources import commits, files, tables
from ..sources.delimited import read_typed, with_row_numbers
from .local import sanitize

SAMPLES = 1000


class RequestError(ValueError):
    """What a caller has to mend."""


@dataclass
class Dataset:
    layer: str
    name: str
    primary_key: list[str]
    fields: list[dict]
    uri: str | None = None
    source: dict | None = None  # {"kind": "Csv", "delimiter", "has_header", "encoding"} or {"kind": "Parquet"}


@dataclass
class RunRequest:
    namespace: str
    warehouse: str
    origin: Dataset
    target: Dataset
    columns: list[dict]
    filters: list[dict] = field(default_factory=list)
    dq_rules: list[dict] = field(default_factory=list)


@dataclass
class RunResponse:
    snapshot: str
    ori_rows: int
    dest_rows: int
    rejected_rows: int
    error_samples: list[dict] = field(default_factory=list)
    dq_summary: list[dict] = field(default_factory=list)
    logs: list[str] = field(default_factory=list)
    breakdown: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


def parse_source(value: Any) -> dict:
    """A source description; a doubled Csv wrapper is unwrapped."""
    if value == "Parquet" or isinstance(value, dict) and "Parquet" in value:
        return {"kind": "Parquet"}
    if not isinstance(value, dict) or "Csv" not in value:
        raise RequestError(f"unknown source: {value!r}")
    own = value["Csv"] or {}
    while isinstance(own.get("Csv"), dict):
        own = own["Csv"]
    return {"kind": "Csv", "delimiter": own.get("delimiter", ","), "has_header": own.get("has_header", True), "encoding": own.get("encoding", "utf-8")}


def parse_dataset(value: dict) -> Dataset:
    (layer, body), = value.items()
    if layer not in ("Bronze", "Silver", "Gold"):
        raise RequestError(f"unknown layer: {layer}")
    inner = body["inner"] if layer == "Bronze" else body
    schema = inner.get("schema") or []
    fields = schema["fields"] if isinstance(schema, dict) else schema
    return Dataset(layer, inner["name"], list(inner.get("primary_key") or []), [dict(f) for f in fields], body.get("uri") if layer == "Bronze" else None, parse_source(body["source"]) if layer == "Bronze" else None)


def parse_request(value: dict | str) -> RunRequest:
    value = json.loads(value) if isinstance(value, str) else value
    try:
        project, (origin, target), mapping = value["project"], value["datasets"], value["mapping"]
        transforms = mapping["transforms"]
        return RunRequest(project["namespace"], project["warehouse_uri"], parse_dataset(origin), parse_dataset(target), list(transforms["columns"]), list(transforms.get("filters") or []), list(mapping.get("dq_rules") or []))
    except (KeyError, TypeError) as e:
        raise RequestError(f"malformed request: {e}") from e


def infer_schema(spark: SparkSession, uri: str, source_config: Any, limit: int = 200) -> dict:
    """{"fields": [...]} of the first rows of a delimited file."""
    source = parse_source(source_config)
    if source["kind"] != "Csv":
        raise RequestError("schema inference of Parquet sources is not supported")
    df = read_typed(spark, files.resolve_uri(uri), source["delimiter"], source["has_header"], source["encoding"], infer_rows=max(1, min(limit, 1000)))
    kinds = {"int": "i64", "bigint": "i64", "double": "f64", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "boolean": "bool"}
    return {"fields": [{"name": f.name, "type": kinds.get(f.dataType.simpleString(), "f64" if isinstance(f.dataType, T.DecimalType) else "str"), "nullable": True} for f in df.schema.fields]}


def table_root(req: RunRequest, name: str) -> str:
    return f"{files.resolve_uri(req.warehouse).rstrip('/')}/{req.namespace}/{name}"


def _origin(spark: SparkSession, req: RunRequest) -> DataFrame:
    """The origin's rows; a Bronze file is first appended, typed, to its own table."""
    d = req.origin
    if d.layer == "Gold":
        raise RequestError("Gold cannot be a source")
    root = table_root(req, d.name)
    if d.layer == "Silver":
        return tables.scan_snapshots(spark, root)
    if d.source["kind"] == "Parquet":
        raise RequestError("Bronze from Parquet is not supported")
    raw = with_row_numbers(read_typed(spark, files.resolve_uri(d.uri), d.source["delimiter"], d.source["has_header"], d.source["encoding"]), "__row")
    typed = M.enforce_schema(raw, d.fields) if d.fields else raw.drop("__row")
    staged = raw.select("__row", *[c.alias(n) for n, c in _enforced(raw, d.fields)]) if d.fields else raw
    made = tables.append_snapshot(staged, root)
    return spark.read.parquet(f"{root}/data/snapshot={made}").select("__row", *typed.columns)


def _enforced(df: DataFrame, fields: list[dict]) -> list[tuple[str, Column]]:
    out = []
    for f in fields:
        kind = M.spark_type(f["type"])
        c = F.col(f"`{f['name']}`") if f["name"] in df.columns else F.lit(None)
        out.append((f["name"], c.cast("string") if isinstance(kind, T.StringType) else M.coerce(M.empty_to_null(c), kind) if f["name"] in df.columns else c.cast(kind)))
    return out


@dataclass
class Plan:
    """A frame with the source columns, targets as __t_<name>, acceptance and violations, and their names."""

    frame: DataFrame
    sources: list[str]
    targets: list[str]
    codes: list[str]
    parse_codes: list[str]


def build_plan(rows: DataFrame, req: RunRequest, legacy_nulls: bool = False) -> Plan:
    """Everything is judged on the source columns, whatever the targets are called.

    ``legacy_nulls`` reproduces three-valued acceptance: a NULL input of a non-text target drops its row.
    """
    M.check_coverage(req.target.fields, req.columns)
    compile_, kinds = M.Compiler(rows), {f["name"]: M.spark_type(f["type"]) for f in req.target.fields}
    exprs = {c["target"]: M.empty_to_null(compile_(c["expr"])) for c in req.columns}
    order = [f["name"] for f in req.target.fields]
    sources = [c for c in rows.columns if c != "__row"]
    frame = rows.select("*", *[(exprs[n].cast("string") if isinstance(kinds[n], T.StringType) else M.coerce(exprs[n], kinds[n])).alias(f"__t_{n}") for n in order])
    accept = F.lit(True)
    for f in req.filters:
        accept = accept & compile_(f)
    violations: list[tuple[str, Column]] = [(M.rule_code(r["column"], r["op"]), M.violation(r, {n: F.col(f"`__t_{n}`") for n in order}, kinds)) for r in req.dq_rules]
    parse: list[tuple[str, Column]] = []
    for n in order:
        if isinstance(kinds[n], T.StringType):
            continue
        had = F.length(exprs[n].cast("string")) > 0
        failed = (had if legacy_nulls else F.coalesce(had, F.lit(False))) & F.col(f"`__t_{n}`").isNull()
        parse.append((f"PARSE_FAIL_{n}", failed))
        accept = accept & ~failed
    every = violations + parse
    frame = frame.select("*", F.coalesce(accept, F.lit(False)).alias("__accept"), *[v.alias(f"__v_{i}") for i, (_, v) in enumerate(every)])
    return Plan(frame, sources, order, [c for c, _ in every], [c for c, _ in parse])


def run(spark: SparkSession, request: dict | str | RunRequest, legacy_nulls: bool = False) -> RunResponse:
    """One run from the origin to the target table."""
    req = request if isinstance(request, RunRequest) else parse_request(request)
    M.check_coverage(req.target.fields, req.columns)
    rows = _origin(spark, req)
    if "__row" not in rows.columns:
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
    plan = build_plan(rows, req, legacy_nulls)
    root, pk = table_root(req, req.target.name), req.target.primary_key
    rules = len(plan.codes)
    # The source is read, mapped and judged once; what follows reads the few columns it needs of this.
    watched = quality.Observed(plan.frame, rules, [f"__t_{k}" for k in pk])
    judged = files.materialize(watched.frame.select("__row", "__accept", quality.sample_text(rules, plan.sources).alias("__sample"), *[F.col(f"`__t_{n}`") for n in plan.targets]), "judged")
    totals = watched.totals()
    summary = [{"rule_code": c, "violations": v, "checked_rows": totals["rows"]} for c, v in zip(plan.codes, totals["violations"])]
    samples = quality.invalid_samples(judged, SAMPLES)
    logs = ["stage: read source", "stage: apply mapping", "stage: apply dedup"]
    chosen = judged.filter("__accept").select(*[F.col(f"`__t_{n}`").alias(n) for n in plan.targets], "__row")
    made = tables.snapshot_id()
    if pk:
        complete = chosen.dropna(subset=pk).withColumn(keyindex.KEY, pk_key(pk))
        dest = keyindex.append_new(keep_first(complete, [keyindex.KEY], ["__row"]).drop("__row"), root, pk, made)
    else:
        dest = _append_all(chosen.drop("__row"), root, made)
    breakdown = {"filtered_or_unparsed": totals["rows"] - totals["accepted"], "null_key": totals["accepted"] - totals["complete"], "duplicate_or_known": totals["complete"] - dest}
    if not dest:
        return RunResponse("", totals["rows"], 0, totals["rows"], samples, summary, [*logs, "stage: append unique (no new rows)", "stage: compute DQ summary"], breakdown)
    if req.target.layer == "Gold":
        tables.scan_snapshots(spark, root).createOrReplaceTempView(f"{sanitize(req.namespace)}_{sanitize(req.target.name)}")
    return RunResponse(made, totals["rows"], dest, totals["rows"] - dest, samples, summary, [*logs, "stage: append unique", "stage: write dest", "stage: write keys index", "stage: compute DQ summary"], breakdown)


def _append_all(rows: DataFrame, root: str, snapshot: str) -> int:
    """Append every row; nothing is committed where there is none."""
    spark = rows.sparkSession
    commits.begin(spark, root)
    read = commits.replay(spark, root).version
    listing, n = commits.write_snapshot(rows, root, snapshot)
    if n:
        commits.commit(spark, root, {"snapshot": snapshot, "files": listing, "rows": n, "scope": None, "schema": rows.schema.jsonValue()}, read)
    else:
        files.remove(spark, f"{root}/data/snapshot={snapshot}")
    return n
