"""Projects: sources, datasets, mappings, pipelines and runs, kept as one JSON document each."""

from __future__ import annotations

import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..sources import files
from . import worker

#: Type names that other tools use and the declared names they stand for; others are text.
ALIASES = {
    "f64": "f64", "double": "f64", "float": "f64", "float64": "f64", "f32": "f64", "float32": "f64", "decimal": "f64",
    "i64": "i64", "int": "i64", "integer": "i64", "int64": "i64", "i32": "i64", "int32": "i64", "bigint": "i64", "long": "i64",
    "bool": "bool", "boolean": "bool", "date": "date", "date32": "date",
    "datetime": "datetime", "timestamp": "datetime", "str": "str", "string": "str", "utf8": "str", "text": "str",
}
LAYERS = {("bronze", "silver"), ("silver", "gold")}


class ProjectError(ValueError):
    pass


def canonical_type(name: str) -> str:
    return ALIASES.get(name.lower(), "str")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Project:
    """One project's metadata under <store>/<id>.json."""

    def __init__(self, spark: SparkSession, store: str, name: str, warehouse: str, data: dict | None = None):
        self.spark, self.store = spark, store.rstrip("/")
        self.data = data or {"id": uuid.uuid4().hex, "name": name, "namespace": name.lower().replace(" ", "_"), "warehouse_uri": warehouse, "created_at": _now(), "sources": {}, "datasets": {}, "mappings": {}, "pipelines": {}, "runs": {}}

    # -- storage

    def save(self) -> "Project":
        files.write_json(self.spark, f"{self.store}/{self.data['id']}.json", self.data)
        return self

    @classmethod
    def load(cls, spark: SparkSession, store: str, project_id: str) -> "Project":
        data = files.read_json(spark, f"{store.rstrip('/')}/{project_id}.json")
        return cls(spark, store, data["name"], data["warehouse_uri"], data)

    @classmethod
    def list(cls, spark: SparkSession, store: str) -> list["Project"]:
        """Newest first."""
        found = [cls.load(spark, store, n[: -len(".json")]) for n in files.children(spark, store) if n.endswith(".json")]
        return sorted(found, key=lambda p: p.data["created_at"], reverse=True)

    def _put(self, kind: str, value: dict, key: str | None = None) -> dict:
        key = key or uuid.uuid4().hex
        self.data[kind][key] = {**value, "id": key}
        self.save()
        return self.data[kind][key]

    def get(self, kind: str, key: str) -> dict:
        if key not in self.data[kind]:
            raise ProjectError(f"no such entry in {kind}: {key}")
        return self.data[kind][key]

    def delete(self, kind: str, key: str) -> None:
        self.get(kind, key)
        used = {"datasets": [(m["from"], m["to"]) for m in self.data["mappings"].values()], "mappings": [(p["bronze_silver"], p.get("silver_gold")) for p in self.data["pipelines"].values()]}.get(kind, [])
        if any(key in pair for pair in used):
            raise ProjectError(f"{kind[:-1]} {key} is in use")
        del self.data[kind][key]
        self.save()

    # -- datasets

    def add_source(self, name: str, uri: str, source_config: dict, limit: int = 200) -> dict:
        """Register a file and, from its inferred schema, a Bronze dataset of the same name."""
        schema = worker.infer_schema(self.spark, uri, source_config, max(1, min(1000, limit)))
        source = self._put("sources", {"name": name, "uri": uri, "config": source_config})
        known = next((k for k, d in self.data["datasets"].items() if d["layer"] == "bronze" and d["name"] == name), None)
        self.add_dataset("bronze", name, schema["fields"], source=source["id"], key=known)
        return source

    def add_dataset(self, layer: str, name: str, fields: list[dict], primary_key: list[str] = (), source: str | None = None, key: str | None = None) -> dict:
        if layer not in ("bronze", "silver", "gold"):
            raise ProjectError(f"unknown layer: {layer}")
        missing = [k for k in primary_key if k not in {f["name"] for f in fields}]
        if missing:
            raise ProjectError(f"primary key is not in the schema: {', '.join(missing)}")
        return self._put("datasets", {"layer": layer, "name": name, "schema": {"fields": [dict(f) for f in fields]}, "primary_key": list(primary_key), "source": source}, key)

    def seed_silver(self, bronze_id: str) -> dict:
        """The project's Silver dataset with the Bronze fields in canonical types; its key stays if it has one."""
        bronze = self.get("datasets", bronze_id)
        if bronze["layer"] != "bronze":
            raise ProjectError("silver is seeded from a bronze dataset")
        old = next((d for d in self.data["datasets"].values() if d["layer"] == "silver"), None)
        fields = [{"name": f["name"], "type": canonical_type(f["type"]), "nullable": True} for f in bronze["schema"]["fields"]]
        key = [k for k in (old or {}).get("primary_key", []) if k in {f["name"] for f in fields}]
        return self.add_dataset("silver", "silver", fields, key, key=old["id"] if old else None)

    # -- mappings and pipelines

    def put_mapping(self, from_id: str, to_id: str, columns: list[dict], filters: list[dict] = (), dq_rules: list[dict] = ()) -> dict:
        """One mapping for each pair of datasets, bronze to silver or silver to gold."""
        layers = self.get("datasets", from_id)["layer"], self.get("datasets", to_id)["layer"]
        if layers not in LAYERS:
            raise ProjectError(f"a mapping cannot lead from {layers[0]} to {layers[1]}")
        old = next((k for k, m in self.data["mappings"].items() if (m["from"], m["to"]) == (from_id, to_id)), None)
        return self._put("mappings", {"from": from_id, "to": to_id, "transforms": {"columns": list(columns), "filters": list(filters)}, "dq_rules": list(dq_rules)}, old)

    def put_pipeline(self, name: str, bronze_silver: str, silver_gold: str | None = None) -> dict:
        for slot, want in ((bronze_silver, ("bronze", "silver")), (silver_gold, ("silver", "gold"))):
            if slot is not None:
                m = self.get("mappings", slot)
                have = tuple(self.get("datasets", m[k])["layer"] for k in ("from", "to"))
                if have != want:
                    raise ProjectError(f"the mapping of this slot has to lead from {want[0]} to {want[1]}")
        if silver_gold is not None and self.get("mappings", bronze_silver)["to"] != self.get("mappings", silver_gold)["from"]:
            raise ProjectError("the second mapping does not start where the first one ends")
        old = next((k for k, p in self.data["pipelines"].items() if p["name"] == name), None)
        return self._put("pipelines", {"name": name, "bronze_silver": bronze_silver, "silver_gold": silver_gold}, old)

    # -- runs

    def _dataset_json(self, key: str) -> dict:
        d = self.get("datasets", key)
        inner = {"name": d["name"], "primary_key": d["primary_key"], "schema": d["schema"]}
        if d["layer"] == "bronze":
            source = self.get("sources", d["source"])
            return {"Bronze": {"uri": source["uri"], "source": source["config"], "inner": inner}}
        return {d["layer"].capitalize(): inner}

    def request(self, mapping_id: str) -> dict:
        m = self.get("mappings", mapping_id)
        return {"project": {"namespace": self.data["namespace"], "warehouse_uri": self.data["warehouse_uri"]}, "datasets": [self._dataset_json(m["from"]), self._dataset_json(m["to"])], "mapping": {"transforms": m["transforms"], "dq_rules": m["dq_rules"]}}

    def run_pipeline(self, pipeline_id: str) -> dict:
        """Both steps in order; the record says how far it came."""
        p = self.get("pipelines", pipeline_id)
        record = self._put("runs", {"pipeline": pipeline_id, "state": "running", "started_at": _now(), "steps": [], "logs": [], "dq_summary": [], "error_samples": []})
        try:
            for mapping in (p["bronze_silver"], p["silver_gold"]):
                if mapping is None:
                    continue
                made = worker.run(self.spark, self.request(mapping))
                record["steps"].append({k: v for k, v in asdict(made).items() if k in ("snapshot", "ori_rows", "dest_rows", "rejected_rows", "breakdown")})
                record["logs"] += made.logs
                record["dq_summary"] += made.dq_summary
                record["error_samples"] += made.error_samples[:1000]
            record["state"] = "succeeded"
        except Exception as e:
            record |= {"state": "failed", "reason": str(e).splitlines()[0] if str(e) else type(e).__name__}
            raise
        finally:
            record["finished_at"] = _now()
            self.save()
        return record
