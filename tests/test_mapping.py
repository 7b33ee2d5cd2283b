"""The mapping language, quality rules, keys and worker runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import mapping as M
from lodestone.functions.keys import pk_key
from lodestone.plans import worker
from lodestone.plans.project import Project, ProjectError, canonical_type


def call(name, *args, **more):
    return {"fn_": name, "args": list(args), **more}


def col(name):
    return {"col": name}


def lit(v):
    return {"lit": v}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([("12", 3, 1.5, "03/02/2023"), ("x", 0, None, "bad"), ("", None, 2.0, "31/02/2023"), (None, -4, float("nan"), None)], "s string, i long, f double, d string")


def values(frame, e):
    return [r[0] for r in frame.select(M.Compiler(frame)(e)).collect()]


def test_functions(frame):
    assert values(frame, call("+", col("i"), lit(2))) == [5, 2, None, -2]
    assert values(frame, call("+", col("s"), lit("z"))) == ["12z", "xz", "z", None]
    assert values(frame, call("/", lit(6), col("i"))) == [2.0, None, None, -1.5]
    assert values(frame, call("==", col("s"), lit(12))) == [True, None, None, None]
    assert values(frame, call("cast", col("s"), to="i64")) == [12, None, None, None]
    assert values(frame, call("cast", lit("1d"), to="f64")) == [None] * 4
    assert values(frame, call("to_date", col("d"), fmt="%d/%m/%Y")) == [dt.date(2023, 2, 3), None, None, None]
    assert values(frame, call("zfill", col("i"), len=3)) == ["003", "000", None, "-04"]
    assert values(frame, call("zfill", lit("123456"), len=5)) == ["123456"] * 4
    assert values(frame, {"fn_": "when", "pred": call(">", col("i"), lit(0)), "then": lit(1)}) == [1, None, None, None]
    assert values(frame, {"fn_": "when", "pred": call(">", col("i"), lit(0)), "then": lit("a"), "else": lit("b")}) == ["a", "b", "b", "b"]
    assert values(frame, call("is_null", col("s"))) == [False, False, False, True]
    assert values(frame, lit([1, {"a": 2}])) == ['[1,{"a":2}]'] * 4


@pytest.mark.parametrize("e", [call("nope", lit(1)), call("cast", col("i")), call("cast", col("i"), to="money"), call("+", col("i")), {"fn_": "when", "pred": lit(True)}, col("none"), {}])
def test_errors(frame, e):
    with pytest.raises(M.MappingError):
        M.Compiler(frame)(e)


def test_layouts():
    assert M.java_layout("%Y-%m-%d") == "yyyy-MM-dd" and M.java_layout("%d %B %y") == "dd MMMM yy" and M.java_layout("%H:%M'T'%S%%") == "HH:mm'''T'''ss%"
    for bad in ("%Q", "%"):
        with pytest.raises(M.MappingError):
            M.java_layout(bad)


def test_schema_enforcement(spark):
    df = spark.createDataFrame([("1", "", "q"), ("z", "2023-01-02", "r")], "a string, b string, extra string")
    out = M.enforce_schema(df, [{"name": "b", "type": "date"}, {"name": "a", "type": "i64"}, {"name": "c", "type": "f64"}])
    assert out.columns == ["b", "a", "c"] and [tuple(r) for r in out.collect()] == [(None, 1, None), (dt.date(2023, 1, 2), None, None)]
    with pytest.raises(M.MappingError, match="unsupported dtype"):
        M.enforce_schema(df, [{"name": "a", "type": "money"}])
    assert M.type_name(T.LongType()) == "i64"


def test_rules(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (None,)], "v long")
    count = lambda op, value=None: df.filter(M.violation({"column": "v", "op": op, "value": value}, {"v": F.col("v")}, {"v": T.LongType()})).count()
    assert count(">", 0) == 2 and count("is_null") == 3 and count("is_not_null") == 1 and count("==") == 0 and count(">=") == 1
    for bad in ({"column": "w", "op": ">"}, {"column": "v", "op": "~"}):
        with pytest.raises(M.MappingError):
            M.violation(bad, {"v": F.col("v")}, {})


def test_keys_differ(spark):
    rows = spark.createDataFrame([("a|", "b"), ("a", "|b"), (None, "b"), ("<NULL", ">b")], "x string, y string")
    assert rows.select(pk_key(["x", "y"])).distinct().count() == 4


FIELDS = [{"name": "id", "type": "i64", "nullable": True}, {"name": "n", "type": "i64", "nullable": True}, {"name": "t", "type": "str", "nullable": True}]


def request(root, path, pk=("id",), target="Silver", columns=None, doubled=False, **mapping):
    csv = {"Csv": {"Csv": {"delimiter": ";"}}} if doubled else {"Csv": {"delimiter": ";"}}
    raw = [{"name": c, "type": "str"} for c in ("id", "n", "t")]
    return {
        "project": {"namespace": "ns", "warehouse_uri": f"file://{root}"},
        "datasets": [{"Bronze": {"uri": f"file://{path}", "source": csv, "inner": {"name": "b", "primary_key": [], "schema": raw if doubled else {"fields": raw}}}}, {target: {"name": "s", "primary_key": list(pk), "schema": {"fields": FIELDS}}}],
        "mapping": {"transforms": {"columns": columns or M.identity_mapping(raw, FIELDS), "filters": mapping.get("filters", [])}, "dq_rules": mapping.get("rules", [])},
    }


@pytest.fixture()
def source(tmp_path):
    path = tmp_path / "in put.csv"
    path.write_text("id;n;t\n1;10;a\n2;x;b\n3;;c\n3;5;again\n;7;d\n")
    return tmp_path, str(path).replace(" ", "%20")


def test_run_twice(spark, source):
    root, path = source
    req = request(root, path, rules=[{"column": "n", "op": ">", "value": 6}])
    first, second = worker.run(spark, req), worker.run(spark, req)
    assert (first.ori_rows, first.dest_rows, first.rejected_rows) == (5, 2, 3)
    assert first.breakdown == {"filtered_or_unparsed": 1, "null_key": 1, "duplicate_or_known": 1}
    assert first.dq_summary == [{"rule_code": "DQ_n_>", "violations": 1, "checked_rows": 5}, {"rule_code": "PARSE_FAIL_id", "violations": 0, "checked_rows": 5}, {"rule_code": "PARSE_FAIL_n", "violations": 1, "checked_rows": 5}]
    assert [s["source_values"]["id"] for s in first.error_samples] == ["2", "3"] and first.snapshot
    assert second.dest_rows == 0 and second.snapshot == "" and "no new rows" in second.logs[-2]
    kept = worker.tables.scan_snapshots(spark, f"{root}/ns/s").orderBy("id").collect()
    assert [tuple(r) for r in kept] == [(1, 10, "a"), (3, None, "c")]


def test_index_is_not_trusted_alone(spark, source):
    import shutil

    root, path = source
    worker.run(spark, request(root, path))
    shutil.rmtree(f"{root}/ns/s/keys_index")
    assert worker.run(spark, request(root, path)).dest_rows == 0


def test_no_key_appends(spark, source):
    root, path = source
    assert [worker.run(spark, request(root, path, pk=(), doubled=True)).dest_rows for _ in range(2)] == [4, 4]


def test_legacy_nulls_and_filters(spark, source):
    root, path = source
    renamed = [{"target": "id", "expr": col("id")}, {"target": "n", "expr": col("n")}, {"target": "t", "expr": call("+", col("t"), lit("!"))}]
    out = worker.run(spark, request(root, path, pk=(), columns=renamed, filters=[call("!=", col("t"), lit("a"))]))
    assert out.dest_rows == 3
    assert worker.run(spark, request(root, path, pk=(), columns=renamed), legacy_nulls=True).dest_rows == 2


def test_request_errors(spark, source):
    root, path = source
    bad = request(root, path)
    bad["mapping"]["transforms"]["columns"].pop()
    with pytest.raises(M.MappingError, match="missing target"):
        worker.run(spark, bad)
    extra = request(root, path)
    extra["mapping"]["transforms"]["columns"].append({"target": "zz", "expr": lit(1)})
    with pytest.raises(M.MappingError, match="extra target"):
        worker.run(spark, extra)
    gold = request(root, path)
    gold["datasets"][0] = {"Gold": gold["datasets"][1]["Silver"]}
    with pytest.raises(worker.RequestError):
        worker.run(spark, gold)
    parquet = request(root, path)
    parquet["datasets"][0]["Bronze"]["source"] = "Parquet"
    with pytest.raises(worker.RequestError):
        worker.run(spark, parquet)
    with pytest.raises(worker.RequestError):
        worker.infer_schema(spark, path, "Parquet")
    with pytest.raises(worker.RequestError):
        worker.parse_request({"project": {}})


def test_infer(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c,d\n1,2.5,"x, y",2024-01-02\n2,3,z,2024-01-03\n')
    fields = worker.infer_schema(spark, str(path), {"Csv": {}}, 10)["fields"]
    assert [(f["name"], f["type"], f["nullable"]) for f in fields] == [("a", "i64", True), ("b", "f64", True), ("c", "str", True), ("d", "date", True)]


def test_project(spark, source):
    root, path = source
    p = Project(spark, f"{root}/store", "My Project", f"file://{root}/wh").save()
    p.add_source("raw", f"file://{path}", {"Csv": {"delimiter": ";"}})
    bronze = next(d for d in p.data["datasets"].values() if d["layer"] == "bronze")
    silver = p.seed_silver(bronze["id"])
    assert [f["type"] for f in silver["schema"]["fields"]] == ["i64", "str", "str"]
    p.add_dataset("silver", "silver", silver["schema"]["fields"], ["id"], key=silver["id"])
    gold = p.add_dataset("gold", "g", [{"name": "id", "type": "i64"}], ["id"])
    one = p.put_mapping(bronze["id"], silver["id"], M.identity_mapping(bronze["schema"]["fields"], silver["schema"]["fields"]))
    two = p.put_mapping(silver["id"], gold["id"], [{"target": "id", "expr": col("id")}])
    assert p.put_mapping(silver["id"], gold["id"], [{"target": "id", "expr": col("id")}])["id"] == two["id"]
    with pytest.raises(ProjectError):
        p.put_mapping(bronze["id"], gold["id"], [])
    with pytest.raises(ProjectError):
        p.put_pipeline("bad", two["id"])
    with pytest.raises(ProjectError):
        p.delete("datasets", gold["id"])
    line = p.put_pipeline("all", one["id"], two["id"])
    record = p.run_pipeline(line["id"])
    assert record["state"] == "succeeded" and [s["dest_rows"] for s in record["steps"]] == [3, 3]
    again = Project.load(spark, f"{root}/store", p.data["id"])
    assert again.data["runs"] == p.data["runs"] and [x.data["name"] for x in Project.list(spark, f"{root}/store")] == ["My Project"]
    p.data["sources"][bronze["source"]]["uri"] = f"{root}/gone.csv"
    with pytest.raises(Exception):
        p.run_pipeline(line["id"])
    assert sorted(r["state"] for r in p.data["runs"].values()) == ["failed", "succeeded"]
    assert canonical_type("Timestamp") == "datetime" and canonical_type("blob") == "str"
