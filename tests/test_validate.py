"""Bronze to Silver to Gold on hand-made rows, one for each rule."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest

from lodestone import schemas as S
from lodestone.cli import main
from lodestone.plans import local, validate
from lodestone.plans.validate import validate as run
from lodestone.sources import quoted
from lodestone.sources.delimited import read_bronze, read_numbered

GOOD = {"id_mutation": "M1", "date_mutation": "2023-05-17", "numero_disposition": "1", "nature_mutation": "Vente", "valeur_fonciere": "250000", "surface_reelle_bati": "50", "longitude": "2.3522", "latitude": "48.8566", "code_postal": "1000", "nom_commune": "paris", "code_departement": "75", "type_local": "Maison"}


def row(**changes):
    return {**GOOD, **changes}


def write_csv(path, rows, tail=""):
    def field(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"'

    with open(path, "w") as f:
        f.write(",".join(S.RAW_COLUMNS) + "\n")
        for r in rows:
            f.write(",".join(field(r.get(c)) for c in S.RAW_COLUMNS) + "\n")
        f.write(tail)
    return str(path)


CASES = {
    "good": (row(), None, {"prix_m2": 5000.0, "year_mutation": 2023, "month_start": dt.date(2023, 5, 1), "geohash6": "u09tvw", "code_postal": "01000", "nom_commune": "PARIS"}),
    "blank id": (row(id_mutation="  "), S.SCHEMA_MISSING, None),
    "date layout": (row(date_mutation="17/05/2023"), S.DATE_INVALID, None),
    "no such day": (row(date_mutation="2023-02-30"), S.DATE_INVALID, None),
    "old year": (row(date_mutation="1989-12-31"), S.DATE_INVALID, None),
    "negative": (row(valeur_fonciere="-1"), S.VALUE_NEGATIVE, None),
    "no number": (row(valeur_fonciere="abc"), S.VALUE_NEGATIVE, None),
    "nan": (row(valeur_fonciere="nan"), S.VALUE_NEGATIVE, None),
    "suffix": (row(valeur_fonciere="1d"), S.VALUE_NEGATIVE, None),
    "rounds to zero": (row(valeur_fonciere="-0.001"), None, {"valeur_fonciere": Decimal("0.00"), "prix_m2": None}),
    "zero": (row(valeur_fonciere="0"), None, {"valeur_fonciere": Decimal("0.00"), "prix_m2": None}),
    "comma": (row(valeur_fonciere="1234,565"), None, {"valeur_fonciere": Decimal("1234.57")}),
    "one coordinate": (row(latitude=None), S.COORD_OOB, None),
    "overseas": (row(longitude="55.5", latitude="-21.1"), S.COORD_OOB, None),
    "small": (row(surface_reelle_bati="9"), None, {"prix_m2": None}),
    "just enough": (row(surface_reelle_bati="10"), None, {"prix_m2": 25000.0}),
    "decimal surface": (row(surface_reelle_bati="120.0"), None, {"surface_reelle_bati": None}),
    "negative surface": (row(surface_reelle_bati="-3"), None, {"surface_reelle_bati": None}),
    "lots overflow": (row(nombre_lots="40000"), None, {"nombre_lots": None}),
    "no department": (row(code_departement=None), None, {"code_departement": None}),
    "no nature": (row(nature_mutation=None), None, {"nature_mutation": ""}),
    "carrez": (row(lot1_surface_carrez="-1"), None, {"lot1_surface_carrez": None}),
    "first rule wins": (row(date_mutation="x", valeur_fonciere="-1"), S.DATE_INVALID, None),
}


def bronze(spark, rows):
    data = [tuple([*(r.get(c) for c in S.RAW_COLUMNS), "2024-01-01", "f", i + 1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in S.RAW_COLUMNS) + ", ingest_date string, source_file string, row_number long")


def test_rules(spark):
    rows = [{**r, "adresse_numero": str(i)} for i, (r, _, _) in enumerate(CASES.values())]
    made = run(bronze(spark, rows))
    silver = {int(r["adresse_numero"]): r for r in made.silver.collect()}
    rejects = {int(r["adresse_numero"]): r for r in made.rejects.collect()}
    for i, (name, (_, code, want)) in enumerate(CASES.items()):
        if code:
            assert rejects[i]["error_code"] == code and rejects[i]["validation_stage"] == "silver", name
            assert i not in silver, name
        else:
            assert i not in rejects, name
            for k, v in want.items():
                assert silver[i][k] == v, (name, k)
    assert made.silver.schema.fieldNames() == S.SILVER.fieldNames()
    assert [f.dataType for f in made.silver.schema] == [f.dataType for f in S.SILVER]
    assert made.rejects.columns == S.REJECTS.fieldNames()


def test_duplicates(spark):
    rows = [row(), row(), row(adresse_numero="7"), row(id_mutation=" M1 ")]
    made = run(bronze(spark, rows))
    assert made.silver.count() == 2 and made.rejects.count() == 0  # copies are neither
    assert run(bronze(spark, rows), legacy_key=True).silver.count() == 1
    assert run(bronze(spark, rows), legacy_key=True, legacy_batch=1).silver.count() == 4
    assert run(bronze(spark, rows), max_year=2020).rejects.count() == 4


def test_missing_columns_and_empty(spark):
    with pytest.raises(ValueError, match="missing column"):
        run(bronze(spark, [row()]).drop("id_parcelle"))
    made = run(bronze(spark, []))
    assert made.silver.count() == made.rejects.count() == 0


def test_ragged_csv(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [row(nom_commune=" two\nlines ")], tail="M2,2023-01-01\n" + ",".join(["x"] * 45) + "\n")
    rows = read_bronze(spark, path, "2024-01-01").orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [1, 2, 3]
    assert rows[0]["nom_commune"] == "two\nlines" and rows[1]["latitude"] is None and rows[2]["latitude"] == "x"
    assert rows[0]["source_file"] == path and rows[0]["ingest_date"] == "2024-01-01"


def test_row_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = read_bronze(spark, str(path), "d", multiline=False)
        assert rows.rdd.getNumPartitions() > 1
        assert rows.filter("row_number <> CAST(a AS LONG) + 1").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_pipeline(spark, tmp_path, capsys):
    rows = [row(adresse_numero=str(i), code_departement=None if i == 3 else "01", date_mutation=f"202{i % 3}-03-04") for i in range(9)] + [row(adresse_numero="0", code_departement="01", date_mutation="2020-03-04"), row(id_mutation=None)]
    source, root = write_csv(tmp_path / "in.csv", rows), str(tmp_path / "data")
    common = ["--dataset", "dvf", "--root", root]
    main(["ingest", *common, "--source", f"file://{source}", "--ingest-date", "2024-01-01"], spark)
    main(["validate", *common, "--ingest-date", "2024-01-01"], spark)
    main(["curate", *common, "--ingest-date", "2024-01-01", "--snapshot-date", "2024-02-01"], spark)
    main(["refresh", *common, "--sql", "SELECT * FROM dvf_summary"], spark)
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0]["rows"] == 11
    assert (said[1]["rows_in"], said[1]["rows_out"], said[1]["rejects"], said[1]["duplicates"]) == (11, 9, 1, 1)
    assert said[2]["rows"] == 9 and "dvf_price_metrics" in said[3]["views"]
    assert sorted(os.listdir(f"{root}/gold/dvf/snapshot_date=2024-02-01/year=2020")) == ["dept=01", "dept=UNK"]
    commit = json.load(open(f"{root}/manifests/dvf/2024-02-01/commit.json"))
    assert sum(f["rows"] for f in commit["files"]) == 9 and commit["dataset"] == "dvf"
    assert json.load(open(f"{root}/manifests/dvf/latest.json")) == {"snapshot_date": "2024-02-01"}
    assert {r["code_departement"] for r in spark.table("dvf_summary").collect()} == {"01", "UNK"}
    assert {r["dept"] for r in local.gold(spark, "dvf", root).collect()} == {"01", "UNK"}
    with pytest.raises(FileNotFoundError):
        local.validate(spark, "dvf", "1999-01-01", root)
    with pytest.raises(FileNotFoundError):
        local.gold(spark, "other", root)


def test_key_ignores_nothing_but_blanks(spark):
    assert len(validate.key_parts()) == 7 and len(validate.key_parts(legacy=True)) == 6


FIELDS = ["plain", '"with, comma"', '"two\nlines"', '""', "", '"a ""quoted"" b"', '"{}\n\n,end"', '5" pipe', '"abc"def', ' "x"', '"\n"', '"\r\n"']


@pytest.mark.parametrize("split", [1 << 27, 4000, 300])
def test_quoted_breaks_over_many_splits(spark, tmp_path, split):
    """Records equal those of the reader that keeps each file in one task, wherever splits cut them."""
    import random

    r = random.Random(split)
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            out.write("a,b,c d\n")
            for i in range(400):
                out.write(",".join(r.choice(FIELDS).replace("{}", "long " * r.randrange(120)) if k else f"{f}-{i}" for k in range(r.choice([3, 3, 3, 2, 4]))) + r.choice(["\n", "\n\n"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        names, df = read_numbered(spark, str(tmp_path))
        got = [tuple(x) for x in df.orderBy("row_number").collect()]
        want = [tuple(x) for x in read_numbered(spark, str(tmp_path), multiline=True)[1].orderBy("row_number").collect()]
        tasks = quoted.lines_of(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == ["a", "b", "c d"] and got == want and len(got) == 800
    assert tasks == 2 if split == 1 << 27 else tasks > 10


def test_open_quote_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,"never closed\n3,4\n')
    names, df = read_numbered(spark, str(tmp_path))
    assert [tuple(r) for r in df.orderBy("row_number").collect()] == [("1", "x\r\ny", 1), ("2", "never closed\n3,4", 2)]


@pytest.mark.parametrize("line,after_out,after_in", [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a""', True, False), ('"a""b",c', False, False), ('x,"', True, False), ('","', False, True), ('"a"b,"c', True, True)])
def test_line_states(line, after_out, after_in):
    """The state after a line, from outside and from inside quotes; the reader's expressions and Java's agree."""
    import pyarrow as pa

    states = quoted.States(",")
    assert [states.opens(pa.array([line.encode()]), s)[1] for s in (False, True)] == [after_out, after_in]


def test_more_splits_than_are_broadcast(spark, tmp_path, monkeypatch):
    """The split table is joined then, and lines are put in order again."""
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x{i}\n\n,{i}"\n' for i in range(300)))
    monkeypatch.setattr(quoted, "BROADCAST_SPLITS", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = [tuple(r) for r in read_numbered(spark, str(tmp_path))[1].orderBy("row_number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(str(i), f"x{i}\n\n,{i}", i + 1) for i in range(300)]
