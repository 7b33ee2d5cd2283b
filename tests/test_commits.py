"""The commit log, the bucketed key index and runs on top of them."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions.keys import pk_key
from lodestone.operators import keyindex
from lodestone.sources import commits, files, tables


def rows(spark, ids, tag="x"):
    return spark.createDataFrame([(i, f"{tag}{i}") for i in ids], "id long, v string")


def keyed(df):
    return df.withColumn(keyindex.KEY, pk_key(["id"]))


def ids_of(df):
    return sorted(r["id"] for r in df.collect())


def metric(spark, name):
    """The values of a metric in the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, it, out = store.executionMetrics(last.executionId()), last.metrics().iterator(), []
    while it.hasNext():
        m = it.next()
        if m.name() == name and values.get(m.accumulatorId()).isDefined():
            out.append(int(values.get(m.accumulatorId()).get().replace(",", "")))
    return out


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.replay(spark, root)
    made = [commits.append(rows(spark, [i]), root, f"s{i}") for i in range(23)]
    assert made == list(range(1, 24))
    assert ids_of(tables.scan(spark, root)) == list(range(23)) and ids_of(tables.scan(spark, root, 7)) == list(range(7))
    assert {n for n in files.children(spark, f"{root}/_log") if n.startswith("checkpoint")} == {"checkpoint-00000000000000000010.json", "checkpoint-00000000000000000020.json"}
    # Replay begins at a checkpoint: earlier commits are not needed.
    for n in range(1, 20):
        files.remove(spark, commits._place(root, n))
    assert ids_of(tables.scan(spark, root)) == list(range(23)) and ids_of(tables.scan(spark, root, 21)) == list(range(21))
    with pytest.raises(FileNotFoundError):
        tables.scan(spark, root, 99)


def test_half_written_is_invisible(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.append_snapshot(rows(spark, [1, 2]), root)
    rows(spark, [3]).write.parquet(f"{root}/data/snapshot=lost")  # a writer that stopped before its commit
    folder = next(n for n in files.children(spark, f"{root}/data") if n != "snapshot=lost")
    rows(spark, [4]).write.mode("append").parquet(f"{root}/data/{folder}")  # a file that no commit lists
    assert ids_of(tables.scan_snapshots(spark, root)) == [1, 2]
    assert tables.scan_snapshots(spark, root).columns == ["id", "v"]


def test_replaced_scope(spark, tmp_path):
    root = str(tmp_path / "t")
    for snapshot, scope, ids in (("a", "d1", [1]), ("b", "d2", [2]), ("c", "d1", [3, 4])):
        commits.append(rows(spark, ids), root, snapshot, scope)
    assert ids_of(commits.scan(spark, root)) == [2, 3, 4] and ids_of(commits.scan(spark, root, 2)) == [1, 2]


def test_exclusive_create(spark, tmp_path):
    """Of many writers of one number exactly one gets it."""
    path, won = str(tmp_path / "_log" / "n.json"), []
    start = threading.Barrier(8)

    def write(i):
        start.wait()
        if commits.create_exclusive(spark, path, f"writer {i}"):
            won.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and files.read_text(spark, path) == f"writer {won[0]}" and files.children(spark, str(tmp_path / "_log")) == ["n.json"]


def test_racing_writers_lose_nothing(spark, tmp_path):
    """Two blind and two keyed writers at once: every row is there, and every key once."""
    blind, own = str(tmp_path / "blind"), str(tmp_path / "keyed")
    start, counts, errors = threading.Barrier(4), [], []

    def run(f):
        try:
            start.wait()
            f()
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    jobs = [lambda k=k: [commits.append(rows(spark, [k * 10 + i]), blind, f"w{k}-{i}") for i in range(3)] for k in range(2)]
    jobs += [lambda k=k: counts.append(keyindex.append_new(keyed(rows(spark, range(k * 50, k * 50 + 100), f"w{k}-")), own, ["id"], f"w{k}", 4)) for k in range(2)]
    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert ids_of(tables.scan(spark, blind)) == [0, 1, 2, 10, 11, 12] and commits.replay(spark, blind).version == 6
    assert ids_of(tables.scan(spark, own)) == list(range(150)) and sorted(counts) == [50, 100]


def test_a_lost_race_is_settled(spark, tmp_path, monkeypatch):
    """Another append is committed between this one's reading and its commit: only the other's keys are compared."""
    root = str(tmp_path / "t")
    keyindex.append_new(keyed(rows(spark, range(10))), root, ["id"], "first", 4)
    real, done = commits.commit, []

    def late(spark_, root_, entry, read, settle=None):
        if entry.get("snapshot") == "mine" and not done:
            done.append(1)
            keyindex.append_new(keyed(rows(spark, range(5, 20), "other")), root, ["id"], "other", 4)
        return real(spark_, root_, entry, read, settle)

    monkeypatch.setattr(commits, "commit", late)
    assert keyindex.append_new(keyed(rows(spark, range(15, 30), "mine")), root, ["id"], "mine", 4) == 10
    assert ids_of(tables.scan(spark, root)) == list(range(30))
    assert tables.scan(spark, root).filter("v LIKE 'mine%'").count() == 10
    done.clear()
    monkeypatch.setattr(commits, "commit", lambda s, r, e, v, f=None: (done or done.append(1) or keyindex.append_new(keyed(rows(spark, range(30, 40), "other")), root, ["id"], "other2", 4)) and real(s, r, e, v, f) if e.get("snapshot") == "mine2" else real(s, r, e, v, f))
    assert keyindex.append_new(keyed(rows(spark, range(30, 40), "mine")), root, ["id"], "mine2", 4) == 0
    assert ids_of(tables.scan(spark, root)) == list(range(40))


def test_filters_hold_every_key(spark, tmp_path):
    root = str(tmp_path / "t")
    made = keyindex.write_segment(keyed(rows(spark, range(5000))), root, 8)
    assert made["keys"] == 5000
    pairs = keyindex.may_hold(keyed(rows(spark, range(0, 5000, 100))), root, [made], 8)
    want = {r["b"] for r in keyed(rows(spark, range(0, 5000, 100))).select(keyindex.bucket_of(8).alias("b")).distinct().collect()}
    assert {b for _, b in pairs} >= want
    each = [bool(keyindex.may_hold(keyed(rows(spark, [i])), root, [made], 8)) for i in range(4990, 5010)]
    assert all(each[:10]) and sum(each[10:]) <= 2


def test_an_append_opens_few_buckets_and_moves_no_old_key(spark, tmp_path):
    root = str(tmp_path / "t")
    for k in range(3):
        keyindex.append_new(keyed(rows(spark, range(k * 1000, k * 1000 + 1000))), root, ["id"], f"s{k}", 16)
    segments = commits.replay(spark, root).segments
    incoming = keyed(rows(spark, [5, 1005, 9001]))
    assert len(keyindex.may_hold(incoming, root, segments, 16)) <= 4
    with keyindex.unknown(incoming, root, segments, 16) as left:
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert ids_of(left) == [9001]
        left.write.format("noop").mode("overwrite").save()
        assert metric(spark, "number of files read") and sum(metric(spark, "number of files read")) <= 4  # of 48
    old = plan[plan.index("FileScan") :]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in old and plan.index("Exchange") < plan.index("FileScan")


def test_ten_appends(spark, tmp_path):
    """Segments are merged, so an append meets a few of them; the rows are right, and a repeat adds none."""
    root, met = str(tmp_path / "t"), []
    for k in range(12):
        assert keyindex.append_new(keyed(rows(spark, range(k * 40, k * 40 + 60))), root, ["id"], f"s{k}", 4) == (60 if k == 0 else 40)
        state = commits.replay(spark, root)
        met.append(len(state.segments))
        assert sum(s["keys"] for s in state.segments) == sum(s["rows"] for s in state.snapshots)
    assert max(met) <= keyindex.SEGMENTS and ids_of(tables.scan(spark, root)) == list(range(500))
    assert keyindex.append_new(keyed(rows(spark, range(500))), root, ["id"], "again", 4) == 0


def test_tables_from_before_the_log(spark, tmp_path):
    root = str(tmp_path / "t")
    rows(spark, [1, 2]).write.parquet(f"{root}/data/snapshot=old")
    assert ids_of(tables.scan_snapshots(spark, root)) == [1, 2]
    assert keyindex.append_new(keyed(rows(spark, [2, 3])), root, ["id"], "new", 4) == 1
    assert ids_of(tables.scan_snapshots(spark, root)) == [1, 2, 3]


def test_a_run_reads_its_source_once(spark, tmp_path):
    """Of all executions of a run one scans the delimited file, but for counting its lines, and one the stored rows of the origin."""
    from test_mapping import request

    from lodestone.plans import worker

    path = tmp_path / "in.csv"
    path.write_text("id;n;t\n" + "".join(f"{i};{i if i % 3 else 'x'};t{i}\n" for i in range(50)))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = worker.run(spark, request(tmp_path, path, rules=[{"column": "n", "op": ">", "value": 10}]))
    assert (out.ori_rows, out.dest_rows) == (50, 33) and len(out.error_samples) == 17 + 7
    listed, plans = store.executionsList(), []
    for i in range(before, listed.size()):
        plans.append(listed.apply(i).physicalPlanDescription())
    assert sum("/ns/b/data/snapshot=" in p and "Scan parquet" in p and "__row" in p for p in plans) == 1
    assert [s["row_no"] for s in out.error_samples] == list(range(24))


def test_observed_totals(spark):
    from lodestone.operators import quality

    frame = spark.range(100).selectExpr("id AS __row", "id % 3 > 0 AS __accept", "IF(id % 5 > 0, id, NULL) AS k", "id % 7 = 0 AS __v_0", "CAST(NULL AS boolean) AS __v_1")
    watched = quality.Observed(frame, 2, ["k"])
    watched.frame.write.format("noop").mode("overwrite").save()
    assert watched.totals() == quality.totals(frame, 2, ["k"]) == {"rows": 100, "accepted": 66, "complete": 53, "violations": [15, 0]}
    assert {tuple(r) for r in quality.summary(frame, ["a", "b"]).collect()} == {("a", 15, 100), ("b", 0, 100)}
    stored = frame.select("__row", quality.sample_text(2, ["k"]).alias("__sample"))
    first = quality.invalid_samples(stored, 3)
    assert [(s["row_no"], s["source_values"]["k"]) for s in first] == [(0, None), (1, 3), (2, 6)]
    assert "TakeOrderedAndProject" in quality.first_samples(stored, 3)._jdf.queryExecution().executedPlan().toString()
