"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mapping as M
from .functions import text as X
from .functions.keys import pk_key
from .operators import keyindex, quality
from .operators.dedup import append_unique, keep_first
from .operators.spatial import points_in_polygons, polygons
from .plans import clustered, local, serving, validate, views, worker
from .plans.canonical import TX_SQL, geohash_sql, table, transactions
from .plans.incremental import IncrementalViews
from .sources import commits, files, tables
from .sources.delimited import read_bronze
from .streaming.keyed import first_of_keys

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: Keeps rounded values away from ties, on which engines differ.
BIAS = 3.14159e-8


def query(sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a query and its SQL. Columns in ``text`` (dates, and flags and whole numbers with NULLs) are compared as text."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in text}) if text else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            own = re.sub(r"\bround\((median|quantile_cont|avg|CASE|prix_m2_winsor|med_p2)", rf"round({BIAS} + \1", sql)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in text)}) FROM ({own})" if text else own
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Values that follow from sums or interpolation, to digits on which any order of addition agrees."""
    return df.withColumns({c: F.round(F.col(c) + BIAS, digits) for c in columns})


#: Flats and houses beside the bounds of their year, department and kind, taken over a window.
RESIDENTIAL = f"""{TX_SQL}, res AS (
  SELECT * EXCLUDE (edge), least(edge[2], greatest(edge[1], prix_m2)) AS prix_m2_winsor
  FROM (SELECT *, quantile_cont(prix_m2, [0.01, 0.99]) OVER (PARTITION BY type_local, code_departement, year_mutation) AS edge
        FROM tx WHERE prix_m2 > 0 AND surface_reelle_bati >= 10 AND type_local <> 'DEPENDANCE')
)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transaction_latest(transactions(spark, sf_dir))


def _residential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.residential_latest(_latest(spark, sf_dir))


# -- views ---------------------------------------------------------------------------------------------------

LATEST_COLUMNS = "id_mutation, numero_disposition, nature_mutation, date_mutation, valeur_fonciere, surface_reelle_bati, nombre_pieces_principales, code_type_local, type_local, code_postal, code_commune, nom_commune, code_departement, longitude, latitude, geohash6, prix_m2, year_mutation, month_start"


@query(f"WITH {TX_SQL} SELECT {LATEST_COLUMNS} FROM tx", text=('date_mutation', 'month_start'))
def transaction_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@query(f"WITH {TX_SQL} SELECT id_mutation, date_mutation, year_mutation, month_start, code_departement, type_local, valeur_fonciere, prix_m2, latitude, longitude FROM tx WHERE longitude IS NOT NULL AND latitude IS NOT NULL", text=('date_mutation', 'month_start'))
def points_ll(spark, sf_dir):
    return views.points_ll(_latest(spark, sf_dir))


@query(f"WITH {TX_SQL} SELECT year_mutation, code_departement, count(*) AS n_rows FROM tx GROUP BY ALL ORDER BY 1, 2")
def summary(spark, sf_dir):
    return views.summary(_latest(spark, sf_dir))


@query(f"WITH {RESIDENTIAL} SELECT id_mutation, numero_disposition, date_mutation, code_departement, type_local, prix_m2, round(prix_m2_winsor, 6) AS prix_m2_winsor FROM res", text=('date_mutation',))
def residential_winsor(spark, sf_dir):
    rows = _residential(spark, sf_dir).select("id_mutation", "numero_disposition", "date_mutation", "code_departement", "type_local", "prix_m2", "prix_m2_winsor")
    return rounded(rows, "prix_m2_winsor")


@query(f"WITH {RESIDENTIAL} SELECT year_mutation, code_departement, type_local, count(*) AS n, round(median(valeur_fonciere), 6) AS median_valeur_fonciere, round(median(prix_m2), 6) AS median_prix_m2 FROM res GROUP BY ALL")
def price_metrics(spark, sf_dir):
    return rounded(views.price_metrics(_latest(spark, sf_dir)), "median_valeur_fonciere", "median_prix_m2")


@query(f"WITH {RESIDENTIAL} SELECT month_start, code_departement, type_local, count(*) AS n, round(median(prix_m2_winsor), 6) AS median_prix_m2_w FROM res GROUP BY ALL", text=('month_start',))
def monthly_price(spark, sf_dir):
    return rounded(views.monthly_price(_latest(spark, sf_dir)), "median_prix_m2_w")


@query(
    f"""WITH {RESIDENTIAL}, now AS (
  SELECT type_local, code_departement, year_mutation, median(prix_m2_winsor) AS med_p2 FROM res GROUP BY ALL
), before AS (SELECT type_local, code_departement, year_mutation, med_p2 AS was FROM now)
SELECT now.year_mutation, now.code_departement, now.type_local, round(med_p2, 6) AS med_p2, round(CASE WHEN was <> 0 THEN (med_p2 - was) / was END, 6) AS yoy_med_p2
FROM now ASOF LEFT JOIN before ON now.type_local = before.type_local AND now.code_departement = before.code_departement AND now.year_mutation > before.year_mutation"""
)
def price_yoy(spark, sf_dir):
    return rounded(views.price_metrics_yoy(_latest(spark, sf_dir)), "med_p2", "yoy_med_p2")


@query(f"WITH {RESIDENTIAL} SELECT year_mutation, geohash6, count(*) AS n, round(median(prix_m2_winsor), 6) AS median_prix_m2_w FROM res WHERE geohash6 IS NOT NULL GROUP BY ALL")
def geohash_tiles(spark, sf_dir):
    return rounded(views.tiles_gh64(files.materialize(_residential(spark, sf_dir), "residential")), "median_prix_m2_w")


def _refreshed(spark: SparkSession, sf_dir: str, *only: str) -> IncrementalViews:
    """All transactions, counted in as three snapshots."""
    kept = IncrementalViews(spark, files.scratch_path(spark, "incremental"))
    rows = files.materialize(_latest(spark, sf_dir), "transactions")
    for k in range(3):
        kept.add(rows.filter(F.pmod(F.month("date_mutation"), F.lit(3)) == k), f"s{k}", only)
    return kept


@query(ORACLE_SQL["price_metrics"])
def refreshed_metrics(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir, "months").price_metrics(), "median_valeur_fonciere", "median_prix_m2")


@query(ORACLE_SQL["price_yoy"])
def refreshed_yoy(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir, "months").price_metrics_yoy(), "med_p2", "yoy_med_p2")


@query(f"WITH {RESIDENTIAL} SELECT month_start, code_departement, type_local, count(*) AS n, round(median(prix_m2_winsor), 6) AS median_prix_m2_w FROM res GROUP BY ALL", text=('month_start',))
def refreshed_monthly(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir, "months").monthly_price(), "median_prix_m2_w")


@query(ORACLE_SQL["geohash_tiles"])
def refreshed_tiles(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir).tiles_gh64(), "median_prix_m2_w")


AREAS = [("A", "west", -5.5, 41.0, 0.0, 46.0), ("B", "east", 0.0, 41.0, 5.0, 46.0), ("C", "north", -2.0, 46.5, 8.0, 51.0)]


@query(
    f"""WITH {RESIDENTIAL}, areas(code_departement, nom_departement, x0, y0, x1, y1) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {f})" for a, b, c, d, e, f in AREAS)}),
m AS (SELECT a.code_departement, a.nom_departement, id_mutation, count(*) AS m FROM areas a JOIN tx ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 GROUP BY ALL),
fan AS (SELECT m.code_departement, m.nom_departement, prix_m2_winsor, unnest(range(m.m)) AS i FROM m JOIN res USING (id_mutation))
SELECT code_departement, nom_departement, count(*) AS n, round(median(prix_m2_winsor), 6) AS median_prix_m2_w FROM fan GROUP BY ALL"""
)
def by_dept(spark, sf_dir):
    boxes = polygons(spark, [(a, b, f"POLYGON(({x0} {y0},{x1} {y0},{x1} {y1},{x0} {y1},{x0} {y0}))") for a, b, x0, y0, x1, y1 in AREAS], ["code_departement", "nom_departement"])
    latest = _latest(spark, sf_dir)
    return rounded(views.by_dept(boxes, views.points(latest), views.residential_latest(latest)), "median_prix_m2_w")


# -- serving -------------------------------------------------------------------------------------------------

PAGE_TIES = ("id_mutation", "numero_disposition", "l_partkey", "l_suppkey", "valeur_fonciere", "l_discount", "l_tax")


@query(f"WITH {TX_SQL} SELECT id_mutation, numero_disposition, date_mutation, valeur_fonciere FROM tx WHERE code_departement = '07' AND date_mutation BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY date_mutation DESC, {', '.join(PAGE_TIES)} LIMIT 50 OFFSET 50", text=('date_mutation',))
def filter_page(spark, sf_dir):
    page = serving.paginate(serving.filter_rows(transactions(spark, sf_dir), "07", "1996-01-01", "1999-12-31"), 2, 50, PAGE_TIES)
    return page.rows.select("id_mutation", "numero_disposition", "date_mutation", "valeur_fonciere")


@query(ORACLE_SQL["filter_page"])
def seek_page(spark, sf_dir):
    """The same page by its place in a table kept in page order."""
    kept = clustered.PagedTable(spark, files.scratch_path(spark, "paged"), PAGE_TIES)
    kept.write(transactions(spark, sf_dir), 8)
    return kept.page("07", 2, 50, "1996-01-01", "1999-12-31").select("id_mutation", "numero_disposition", "date_mutation", "valeur_fonciere")


@query(f"WITH {TX_SQL} SELECT d AS code_departement, count(*) FILTER (code_departement = d) AS total FROM tx, (SELECT unnest(['03', '07', '24', 'none']) AS d) GROUP BY d")
def seek_totals(spark, sf_dir):
    """Totals of filters from the counts of the paged table."""
    kept = clustered.PagedTable(spark, files.scratch_path(spark, "paged"), PAGE_TIES)
    kept.write(transactions(spark, sf_dir), 8)
    return spark.createDataFrame([(d, kept.total(d)) for d in ("03", "07", "24", "none")], "code_departement string, total long")


@query(f"WITH {TX_SQL} SELECT id_mutation, numero_disposition, longitude, latitude, prix_m2 FROM tx WHERE longitude BETWEEN -1.5 AND 3.25 AND latitude BETWEEN 43.0 AND 47.5 AND year = 1997")
def clustered_bbox(spark, sf_dir):
    """The box query on rows laid out along a Z-curve."""
    path = files.scratch_path(spark, "by-place")
    clustered.write_by_place(transactions(spark, sf_dir), path, 8)
    return serving.geo_bbox(spark.read.parquet(path), -1.5, 43.0, 3.25, 47.5, 1997).select("id_mutation", "numero_disposition", "longitude", "latitude", "prix_m2")


@query(f"WITH {TX_SQL} SELECT nom_commune, round(avg(prix_m2), 4) AS avg_prix_m2, round(quantile_cont(prix_m2, 0.5), 4) AS median_prix_m2, count(*) AS n FROM tx WHERE code_departement = '07' AND year = 1997 AND prix_m2 IS NOT NULL GROUP BY nom_commune ORDER BY avg(prix_m2) DESC, nom_commune LIMIT 100")
def agg_commune(spark, sf_dir):
    return rounded(serving.agg_commune(transactions(spark, sf_dir), "07", 1997), "avg_prix_m2", "median_prix_m2", digits=4)


@query(f"WITH {TX_SQL} SELECT nom_commune, round(avg(prix_m2), 4) AS avg_prix_m2, count(*) AS n FROM tx WHERE code_departement = '03' AND year = 1998 AND prix_m2 IS NOT NULL GROUP BY nom_commune ORDER BY avg(prix_m2) DESC, nom_commune LIMIT 3")
def topn(spark, sf_dir):
    return rounded(serving.top_n(transactions(spark, sf_dir), "03", 1998, 3), "avg_prix_m2", digits=4)


@query(f"WITH {TX_SQL} SELECT id_mutation, numero_disposition, longitude, latitude, prix_m2 FROM tx WHERE longitude BETWEEN -1.5 AND 3.25 AND latitude BETWEEN 43.0 AND 47.5 AND year = 1997")
def geo_bbox(spark, sf_dir):
    return serving.geo_bbox(transactions(spark, sf_dir), -1.5, 43.0, 3.25, 47.5, 1997).select("id_mutation", "numero_disposition", "longitude", "latitude", "prix_m2")


@query(
    """SELECT event_id, CASE WHEN lower(trim(s)) IN ('', 'na', 'n/a', 'null') THEN NULL ELSE regexp_replace(trim(s), '\\s+', ' ', 'g') END AS norm,
  CASE WHEN regexp_matches(s, '^[0-9.-]+$') THEN CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) END AS whole,
  CASE WHEN regexp_matches(s, '^[0-9.,-]+$') THEN TRY_CAST(replace(s, ',', '.') AS DOUBLE) END AS number
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '  two   words ' WHEN 1 THEN 'N/A' WHEN 2 THEN CAST(user_id AS VARCHAR) || '.75' WHEN 3 THEN '2A' WHEN 4 THEN CAST(user_id AS VARCHAR) || ',5' WHEN 5 THEN '' END AS s FROM events)""",
    text=('whole',))
def serving_clean(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 7
    s = F.when(n == 0, "  two   words ").when(n == 1, "N/A").when(n == 2, F.concat(F.col("user_id").cast("string"), F.lit(".75"))).when(n == 3, "2A").when(n == 4, F.concat(F.col("user_id").cast("string"), F.lit(",5"))).when(n == 5, "")
    return e.select("event_id", X.norm_text(s).alias("norm"), X.norm_int(s).alias("whole"), X.norm_float(s).alias("number"))


# -- mapping language and quality ----------------------------------------------------------------------------


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 6
    user = F.col("user_id").cast("string")
    return e.select(
        "event_id",
        "user_id",
        F.round("value", 3).alias("value"),
        F.when(n == 0, user).when(n == 1, "x").when(n == 2, "").when(n == 4, F.concat(F.lit("-"), user)).when(n == 5, "12.5").alias("s"),
        F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("day"),
    )


DIRTY = """dirty AS (SELECT event_id, user_id, round(value, 3) AS value,
  CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 4 THEN '-' || CAST(user_id AS VARCHAR) WHEN 5 THEN '12.5' END AS s,
  CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE strftime(ts, '%d/%m/%Y') END AS day FROM events)"""
WHOLE = "CASE WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN CAST(s AS BIGINT) END"
DECIMAL = "CASE WHEN regexp_matches(s, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN CAST(s AS DOUBLE) END"


def _ir(spark, sf_dir, **exprs) -> DataFrame:
    df = _dirty(spark, sf_dir)
    compile_ = M.Compiler(df)
    return df.select("event_id", *[compile_(e).alias(n) for n, e in exprs.items()])


def fn(name: str, *args, **more) -> dict:
    return {"fn_": name, "args": [a if isinstance(a, dict) else {"lit": a} for a in args], **more}


USER, VALUE, TEXT, DAY = {"col": "user_id"}, {"col": "value"}, {"col": "s"}, {"col": "day"}


@query(f"WITH {DIRTY} SELECT event_id, user_id + 5 AS plus, user_id - 1000 AS minus, round(value * 2.5, 6) AS times, round(value / nullif(user_id % 3, 0), 6) AS over_user, s || 'z' AS joined FROM dirty")
def ir_arith(spark, sf_dir):
    df = _dirty(spark, sf_dir).withColumn("m", F.col("user_id") % 3)
    c = M.Compiler(df)
    return df.select("event_id", c(fn("+", USER, 5)).alias("plus"), c(fn("-", USER, 1000)).alias("minus"), F.round(c(fn("*", VALUE, 2.5)), 6).alias("times"), F.round(c(fn("/", VALUE, {"col": "m"})), 6).alias("over_user"), c(fn("+", TEXT, "z")).alias("joined"))


@query(f"WITH {DIRTY}, d AS (SELECT *, {WHOLE} AS w FROM dirty) SELECT event_id, user_id = 7 AS eq, user_id <> 7 AS ne, value > 50 AS gt, value >= 50 AS ge, w < 100 AS lt, s <= 'a' AS le FROM d", text=('lt', 'le'))
def ir_compare(spark, sf_dir):
    return _ir(spark, sf_dir, eq=fn("==", USER, 7), ne=fn("!=", USER, 7), gt=fn(">", VALUE, 50), ge=fn(">=", VALUE, 50), lt=fn("<", TEXT, 100), le=fn("<=", TEXT, "a"))


@query(f"WITH {DIRTY} SELECT event_id, {WHOLE} AS i, {DECIMAL} AS f, CAST(user_id AS VARCHAR) AS t, CASE WHEN day <> 'bad' THEN CAST(strptime(day, '%d/%m/%Y') AS DATE) END AS d FROM dirty", text=('i', 'd'))
def ir_cast(spark, sf_dir):
    return _ir(spark, sf_dir, i=fn("cast", TEXT, to="i64"), f=fn("cast", TEXT, to="f64"), t=fn("cast", USER, to="str"), d=fn("cast", DAY, to="date"))


@query(f"WITH {DIRTY} SELECT event_id, CAST(TRY_STRPTIME(day, '%d/%m/%Y') AS DATE) AS d FROM dirty", text=('d',))
def ir_to_date(spark, sf_dir):
    return _ir(spark, sf_dir, d=fn("to_date", DAY, fmt="%d/%m/%Y"))


@query(f"WITH {DIRTY} SELECT event_id, CASE WHEN length(CAST(user_id AS VARCHAR)) >= 6 THEN CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 6, '0') END AS z, CASE WHEN s IS NULL THEN NULL WHEN length(s) >= 5 THEN s WHEN s LIKE '-%' THEN '-' || lpad(substr(s, 2), 4, '0') ELSE lpad(s, 5, '0') END AS t FROM dirty")
def ir_zfill(spark, sf_dir):
    return _ir(spark, sf_dir, z=fn("zfill", USER, len=6), t=fn("zfill", TEXT, len=5))


@query(f"WITH {DIRTY} SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, CASE WHEN s = 'x' THEN 1 END AS mark FROM dirty", text=('mark',))
def ir_when(spark, sf_dir):
    return _ir(spark, sf_dir, band={"fn_": "when", "pred": fn(">", VALUE, 50), "then": {"lit": "high"}, "else": {"lit": "low"}}, mark={"fn_": "when", "pred": fn("==", TEXT, "x"), "then": {"lit": 1}})


@query(f"WITH {DIRTY} SELECT event_id, s IS NULL AS none, s IS NOT NULL AS some FROM dirty")
def ir_nulls(spark, sf_dir):
    return _ir(spark, sf_dir, none=fn("is_null", TEXT), some=fn("is_not_null", TEXT))


def _request() -> worker.RunRequest:
    fields = [{"name": n, "type": t} for n, t in (("event_id", "i64"), ("amount", "i64"), ("day", "date"), ("label", "str"))]
    columns = [
        {"target": "event_id", "expr": {"col": "event_id"}},
        {"target": "amount", "expr": TEXT},
        {"target": "day", "expr": fn("to_date", DAY, fmt="%d/%m/%Y")},
        {"target": "label", "expr": fn("zfill", USER, len=5)},
    ]
    rules = [{"column": "amount", "op": ">", "value": 0}, {"column": "day", "op": "is_not_null"}, {"column": "label", "op": "=="}]
    return worker.RunRequest("n", "w", worker.Dataset("Silver", "o", [], []), worker.Dataset("Silver", "t", ["event_id"], fields), columns, [fn(">", VALUE, 10)], rules)


def _plan(spark, sf_dir) -> worker.Plan:
    return worker.build_plan(_dirty(spark, sf_dir), _request())


PLAN = f"""{DIRTY}, t AS (SELECT *, CASE WHEN s <> '' THEN {WHOLE} END AS amount, CAST(TRY_STRPTIME(day, '%d/%m/%Y') AS DATE) AS d,
  CASE WHEN length(CAST(user_id AS VARCHAR)) >= 5 THEN CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 5, '0') END AS label FROM dirty),
  p AS (SELECT *, coalesce(length(s) > 0, false) AND amount IS NULL AS failed FROM t)"""


@query(f"WITH {PLAN} SELECT event_id, amount, d AS day, label FROM p WHERE value > 10 AND NOT failed", text=('amount', 'day'))
def mapping_project(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return plan.frame.filter("__accept").select(*[F.col(f"__t_{n}").alias(n) for n in plan.targets])


@query(f"WITH {PLAN} SELECT event_id, s FROM p WHERE failed")
def parse_fail(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return plan.frame.filter(F.col(f"__v_{plan.codes.index('PARSE_FAIL_amount')}")).select("event_id", "s")


@query(
    f"""WITH {PLAN}, v AS (SELECT count(*) AS n, count(*) FILTER (NOT amount > 0) AS a, count(*) FILTER (d IS NULL) AS b, count(*) FILTER (failed) AS c FROM p)
SELECT unnest(['DQ_amount_>', 'DQ_day_is_not_null', 'DQ_label_==', 'PARSE_FAIL_event_id', 'PARSE_FAIL_amount', 'PARSE_FAIL_day']) AS rule_code,
  CAST(unnest([a, b, 0, 0, c, 0]) AS BIGINT) AS violations, CAST(unnest([n, n, n, n, n, n]) AS BIGINT) AS checked_rows FROM v"""
)
def dq_summary(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return quality.summary(plan.frame, plan.codes)


@query(f"WITH {PLAN} SELECT event_id, user_id, value, s, day FROM p WHERE NOT (value > 10 AND NOT failed) OR amount <= 0 OR d IS NULL")
def invalid_samples(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return plan.frame.filter(quality.invalid(len(plan.codes))).select(*plan.sources)


@query(
    f"""WITH {PLAN}, bad AS (SELECT * FROM p WHERE NOT (value > 10 AND NOT failed) OR amount <= 0 OR d IS NULL)
SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_no, event_id, user_id, s, day FROM bad ORDER BY event_id LIMIT 1000"""
)
def dq_samples(spark, sf_dir):
    """The first thousand refused rows by row number, as JSON and read back from it."""
    plan = _plan(spark, sf_dir)
    rules = len(plan.codes)
    stored = files.materialize(plan.frame.select(F.col("event_id").alias("__row"), quality.sample_text(rules, plan.sources).alias("__sample")), "samples")
    read = F.from_json("source_values", "event_id long, user_id long, value double, s string, day string").alias("j")
    return quality.first_samples(stored, worker.SAMPLES).select(F.col("row_no").cast("long").alias("row_no"), read).select("row_no", "j.event_id", "j.user_id", "j.s", "j.day")


@query(
    f"""WITH {PLAN}, v AS (SELECT count(*) AS n, count(*) FILTER (NOT failed AND value > 10) AS a, count(*) FILTER (NOT amount > 0) AS x, count(*) FILTER (failed) AS f FROM p)
SELECT unnest(['rows', 'accepted', 'complete', 'DQ_amount_>', 'PARSE_FAIL_amount']) AS name, CAST(unnest([n, a, a, x, f]) AS BIGINT) AS value FROM v"""
)
def dq_observed(spark, sf_dir):
    """The same counts, taken while the judged rows were written."""
    plan = _plan(spark, sf_dir)
    watched = quality.Observed(plan.frame, len(plan.codes), ["__t_event_id"])
    files.materialize(watched.frame.select("__accept", *[f"__t_{n}" for n in plan.targets]), "observed")
    t = watched.totals()
    named = {"rows": t["rows"], "accepted": t["accepted"], "complete": t["complete"], **{c: t["violations"][plan.codes.index(c)] for c in ("DQ_amount_>", "PARSE_FAIL_amount")}}
    return spark.createDataFrame(list(named.items()), "name string, value long")


# -- deduplication and incremental load ----------------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT {', '.join(LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE)}) = 1", text=('l_shipdate',))
def dedup_first(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "lineitem").select(*LINE), ["l_orderkey", "l_linenumber"], LINE)


@query("SELECT event_id, length(event_type) || ':' || event_type || '|' || length(CAST(user_id AS VARCHAR)) || ':' || user_id || '|' || CASE WHEN event_id % 3 = 0 THEN '6:<NULL>|' ELSE '1:v|' END AS key FROM events")
def pk_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("third", F.when(F.col("event_id") % 3 != 0, "v"))
    return e.select("event_id", pk_key(["event_type", "user_id", "third"]).alias("key"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 4 < 3 AND NOT o_orderkey % 4 < 2")
def append_unique_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("_pk_hash", pk_key(["o_orderkey"]))
    # The incoming batch is the whole table; the earlier load holds all that the SQL does not call new.
    known = orders.filter("NOT o_orderkey % 4 <=> 2")
    return append_unique(keep_first(orders, ["_pk_hash"], ["o_orderkey"]), known).drop("_pk_hash")


@query("""SELECT o_orderkey % 4 AS run, count(*) AS dest_rows, count(*) AS offered FROM orders GROUP BY ALL
UNION ALL SELECT 4, 0, count(*) FROM orders""")
def key_index_append(spark, sf_dir):
    """Four loads that bring a quarter of the orders each, and one that offers all of them again, over a bucketed key index."""
    root = files.scratch_path(spark, "keyed")
    orders = table(spark, sf_dir, "orders").withColumn(keyindex.KEY, pk_key(["o_orderkey"]))
    loads = [*(orders.filter(F.col("o_orderkey") % 4 == k) for k in range(4)), orders]
    made = [(k, keyindex.append_new(rows, root, ["o_orderkey"], f"load{k}", 16), rows.count()) for k, rows in enumerate(loads)]
    return spark.createDataFrame(made, "run long, dest_rows long, offered long")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts < TIMESTAMP '2024-01-10', ts, event_id) AS k FROM events) WHERE k = 1""")
def stream_first_seen(spark, sf_dir):
    """The first event of each user and type, by a stream that is given the later events, stops, and goes on with all of them."""
    root, events = files.scratch_path(spark, "first-seen"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for rows in (events.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")), events):
        rows.write.mode("append").parquet(f"{root}/in")
        seen = first_of_keys(spark.readStream.schema(events.schema).parquet(f"{root}/in"), ["user_id", "event_type"], ["ts", "event_id"], "ts", ttl_seconds=10_000 * 86400, late="10000 days")
        seen.writeStream.format("parquet").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out").select("event_id", "user_id", "event_type", "value")


@query("""SELECT v AS version, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders, (SELECT unnest([1, 2, 3, 4]) AS v)
WHERE (v >= 1 AND o_orderstatus = 'F') OR (v >= 2 AND o_orderstatus = 'O') OR (v >= 3 AND o_orderstatus = 'P' AND v < 4) OR (v = 4 AND o_orderstatus = 'P' AND o_totalprice > 1000) GROUP BY ALL""")
def time_travel(spark, sf_dir):
    """Orders committed by status, one status replaced by the fourth commit; every version is read by its number."""
    root = files.scratch_path(spark, "versions")
    orders = table(spark, sf_dir, "orders")
    for i, status in enumerate("FOP"):
        commits.append(orders.filter(F.col("o_orderstatus") == status), root, f"s{i}", scope=status)
    commits.append(orders.filter("o_orderstatus = 'P' AND o_totalprice > 1000"), root, "s3", scope="P")
    # A snapshot that no commit names stays out of sight.
    orders.write.parquet(f"{root}/data/snapshot=unfinished")
    each = [tables.scan(spark, root, v).groupBy(F.lit(v).alias("version"), "o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers")) for v in range(1, 5)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


# -- validation ----------------------------------------------------------------------------------------------

FAULT = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 23"


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the raw layout made of lineitem, with faults in about a third of them."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # The table's file is one or two row groups; text of this size would come in as many splits as there are cores. The
    # lines are dealt by the join's key, so that they are shuffled once, for the join as well.
    rows = line.repartition("l_orderkey").join(orders, line.l_orderkey == orders.o_orderkey)
    m = F.expr(FAULT)
    text = lambda c: F.col(c).cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    made: dict[str, Column] = {
        "id_mutation": F.when(m == 0, "  ").otherwise(text("l_orderkey")),
        "date_mutation": F.when(m.isin(1, 7), "17/05/2023").when(m == 2, "1989-12-31").otherwise(F.concat(F.year("l_shipdate").cast("string"), F.lit("-01-01"))),
        "numero_disposition": (F.col("l_linenumber") % 2).cast("string"),
        "nature_mutation": F.lower("l_linestatus"),
        "valeur_fonciere": F.when(m == 3, "abc").when(m.isin(4, 7), "-1").otherwise(F.concat(F.expr(f"CAST(round(l_extendedprice * 100) AS BIGINT) div 100").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))),
        "code_postal": text("l_suppkey"),
        "nom_commune": F.lower("o_orderpriority"),
        "code_departement": F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0"),
        "surface_reelle_bati": F.col("l_quantity").cast("int").cast("string"),
        "longitude": F.when(m == 5, "2.5").when(m == 6, "55.5").when(m < 12, "2.25"),
        "latitude": F.when(m == 6, "-21.1").when((m != 5) & (m < 12), "48.5"),
    }
    number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100003 + F.col("l_partkey")) * 1009 + F.col("l_suppkey")
    return rows.select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in validate.S.RAW_COLUMNS], F.lit("2024-01-01").alias("ingest_date"), F.lit("lineitem").alias("source_file"), number.alias("row_number"))


BRONZE = f"""b AS (
  SELECT {FAULT} AS m, CAST(l_orderkey AS VARCHAR) AS id_mutation, CAST(year(l_shipdate) AS VARCHAR) || '-01-01' AS date_text, CAST(l_linenumber % 2 AS VARCHAR) AS numero_disposition,
    upper(l_linestatus) AS nature_mutation, round(l_extendedprice * 100) AS cents, CASE WHEN length(CAST(l_suppkey AS VARCHAR)) < 5 THEN lpad(CAST(l_suppkey AS VARCHAR), 5, '0') ELSE CAST(l_suppkey AS VARCHAR) END AS code_postal,
    upper(o_orderpriority) AS nom_commune, lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS code_departement, CAST(l_quantity AS INTEGER) AS surface_reelle_bati,
    ((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 1009 + l_suppkey AS row_number
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), s AS (
  SELECT *, CAST(date_text AS DATE) AS date_mutation, CASE WHEN m < 12 THEN 2.25 END AS longitude, CASE WHEN m < 12 THEN 48.5 END AS latitude
  FROM b WHERE m > 7 QUALIFY row_number() OVER (PARTITION BY id_mutation, date_text, numero_disposition, code_postal ORDER BY row_number) = 1
)"""


@query(
    f"""WITH {BRONZE} SELECT CASE WHEN m = 0 THEN 'DVF_SCHEMA_MISSING' WHEN m IN (1, 2, 7) THEN 'DVF_DATE_INVALID' WHEN m IN (3, 4) THEN 'DVF_VALUE_NEGATIVE' ELSE 'DVF_COORD_OOB' END AS error_code,
  CASE WHEN m = 0 THEN 'required field missing' WHEN m IN (1, 7) THEN 'date parse failed' WHEN m = 2 THEN 'year out of expected bounds' WHEN m IN (3, 4) THEN 'value negative or not a number' WHEN m = 5 THEN 'longitude and latitude must be both present or both null' ELSE 'coordinates out of FR bbox' END AS error_detail,
  count(*) AS n FROM b WHERE m <= 7 GROUP BY ALL"""
)
def reject_classify(spark, sf_dir):
    return validate.validate(_bronze(spark, sf_dir)).rejects.groupBy("error_code", "error_detail").agg(F.count("*").alias("n"))


@query(
    f"""WITH {BRONZE} SELECT id_mutation, date_mutation, numero_disposition, nature_mutation, cents / 100 AS valeur_fonciere, code_postal, nom_commune, code_departement, surface_reelle_bati, CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude,
  CAST(year(date_mutation) AS SMALLINT) AS year_mutation, CASE WHEN longitude IS NOT NULL THEN {geohash_sql("longitude", "latitude")} END AS geohash6,
  round(CASE WHEN surface_reelle_bati > 9 AND cents > 0 THEN cents / 100 / surface_reelle_bati END, 6) AS prix_m2, CAST(date_trunc('month', date_mutation) AS DATE) AS month_start FROM s""",
    text=('date_mutation', 'month_start'))
def silver_typed(spark, sf_dir):
    made = validate.validate(_bronze(spark, sf_dir)).silver.withColumn("valeur_fonciere", F.col("valeur_fonciere").cast("double"))
    return rounded(made, "prix_m2").select("id_mutation", "date_mutation", "numero_disposition", "nature_mutation", "valeur_fonciere", "code_postal", "nom_commune", "code_departement", "surface_reelle_bati", "longitude", "latitude", "year_mutation", "geohash6", "prix_m2", "month_start")


@query(f"WITH {BRONZE} SELECT CAST(year(date_mutation) AS SMALLINT) AS year, code_departement AS dept, count(*) AS rows FROM s GROUP BY ALL")
def partition_counts(spark, sf_dir):
    """Silver written as partitioned Gold and read back by its folders."""
    path = files.scratch_path(spark, "gold")
    silver = validate.validate(_bronze(spark, sf_dir)).silver
    tables.write_partitioned(silver.withColumn("year", F.col("year_mutation")).withColumn("dept", F.coalesce("code_departement", F.lit("UNK"))), path, ["year", "dept"])
    return tables.scan_partitioned(spark, path).groupBy(F.col("year").cast("short").alias("year"), F.col("dept").cast("string").alias("dept")).agg(F.count("*").alias("rows"))


# -- files and whole runs -------------------------------------------------------------------------------------


def _orders_csv(spark: SparkSession, sf_dir: str) -> str:
    path = files.scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority").write.option("header", True).csv(path)
    return path


@query("SELECT * FROM (VALUES ('o_orderkey', 'i64', true), ('o_custkey', 'i64', true), ('o_totalprice', 'f64', true), ('o_orderdate', 'date', true), ('o_orderpriority', 'str', true)) AS t(name, type, nullable)")
def infer_schema(spark, sf_dir):
    fields = worker.infer_schema(spark, _orders_csv(spark, sf_dir), {"Csv": {}}, 200)["fields"]
    return spark.createDataFrame([(f["name"], f["type"], f["nullable"]) for f in fields], "name string, type string, nullable boolean")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS o_orderpriority, row_number() OVER (ORDER BY orders.o_orderkey) AS row_number, '2024-01-01' AS ingest_date FROM orders")
def bronze_csv(spark, sf_dir):
    """A table written as delimited text with blanks around its values, and read as Bronze."""
    path = files.scratch_path(spark, "bronze-csv")
    padded = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", padded.alias(" o_orderpriority"))
    rows.orderBy("o_orderkey").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_bronze(spark, path, "2024-01-01").drop("source_file")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || chr(10) || chr(10) || ', "' || o_custkey || '"' ELSE '5" pipe' END AS note,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders""")
def bronze_quoted(spark, sf_dir):
    """Line breaks, delimiters and quotes inside quoted fields, in several files, read as Bronze by lines."""
    path = files.scratch_path(spark, "bronze-quoted")
    note = F.when(F.col("o_orderkey") % 3 > 0, F.concat("o_orderpriority", F.lit('\n\n, "'), "o_custkey", F.lit('"'))).otherwise('5" pipe')
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    rows.repartitionByRange(clustered.dealt_over(rows, 4), "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).option("escape", '"').csv(path)
    return read_bronze(spark, path, "2024-01-01").drop("source_file", "ingest_date")


@query(f"WITH {BRONZE} SELECT CASE WHEN m > 0 THEN id_mutation END AS id_mutation, row_number, CASE WHEN m = 0 THEN 'DVF_SCHEMA_MISSING' WHEN m IN (1, 2, 7) THEN 'DVF_DATE_INVALID' WHEN m IN (3, 4) THEN 'DVF_VALUE_NEGATIVE' ELSE 'DVF_COORD_OOB' END AS error_code, 'silver' AS validation_stage FROM b WHERE m <= 7", text=("row_number",))
def rejects_rows(spark, sf_dir):
    return validate.validate(_bronze(spark, sf_dir)).rejects.select(X.blank_to_null(F.col("id_mutation")).alias("id_mutation"), "row_number", "error_code", "validation_stage")


def _wavy(x: float, y: float, size: float, n: int) -> list[tuple[float, float]]:
    """Vertices of a ring with five lobes."""
    far = [size * (0.8 + 0.2 * math.sin(10 * math.pi * i / n)) for i in range(n)]
    return [(round(x + far[i] * math.cos(2 * math.pi * i / n), 9), round(y + far[i] * math.sin(2 * math.pi * i / n), 9)) for i in range(n)]


RINGS = {"centre": _wavy(2.3, 46.4, 2.9, 400), "west": _wavy(-1.1, 47.2, 1.4, 120), "south": _wavy(3.3, 43.8, 2.2, 90)}
RING_EDGES = ", ".join(f"('{k}', {a[0]!r}, {a[1]!r}, {b[0]!r}, {b[1]!r})" for k, ring in RINGS.items() for a, b in zip(ring, ring[1:] + ring[:1]))


@query(
    f"""WITH {TX_SQL}, edges(name, x1, y1, x2, y2) AS (VALUES {RING_EDGES}), spots AS (SELECT DISTINCT longitude AS x, latitude AS y FROM tx WHERE longitude IS NOT NULL),
crossed AS (SELECT name, x, y, count(*) AS n FROM edges JOIN spots ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT c.name, count(*) AS n, count(DISTINCT t.id_mutation) AS mutations FROM crossed c JOIN tx t ON t.longitude = c.x AND t.latitude = c.y WHERE c.n % 2 = 1 GROUP BY ALL"""
)
def curved_areas(spark, sf_dir):
    """Rows and mutations within areas of many edges."""
    areas = polygons(spark, [(k, "POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))") for k, ring in RINGS.items()], ["name"])
    located = views.points(_latest(spark, sf_dir)).select("id_mutation", "longitude", "latitude")
    return points_in_polygons(areas, located).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("id_mutation").alias("mutations"))


@query(f"WITH {TX_SQL} SELECT count(*) AS total FROM tx WHERE code_departement = '07' AND date_mutation >= DATE '1996-01-01' AND date_mutation <= DATE '1999-12-31'")
def page_total(spark, sf_dir):
    page = serving.paginate(serving.filter_rows(transactions(spark, sf_dir), "07", "1996-01-01", "1999-12-31"), 2, 50, PAGE_TIES)
    return page.source.agg(F.count("*").alias("total"))


def _layered(spark: SparkSession, sf_dir: str) -> tuple[str, tuple]:
    """The raw rows as text through ingest, validate and curate; the folder and each stage's numbers."""
    work = files.scratch_path(spark, "layers")
    _bronze(spark, sf_dir).select(*validate.S.RAW_COLUMNS).write.option("header", True).option("compression", "gzip").csv(f"{work}/raw")
    root = files.resolve_uri(f"{work}/out")
    a = local.ingest(spark, "dvf", f"{work}/raw", "2024-01-01", root)
    b = local.validate(spark, "dvf", "2024-01-01", root)
    c = local.curate(spark, "dvf", "2024-01-01", "2024-02-01", root)
    return root, (a, b, c)


@query(f"WITH {BRONZE} SELECT CAST(year(date_mutation) AS SMALLINT) AS year, code_departement AS dept, count(*) AS rows, count(DISTINCT id_mutation) AS mutations FROM s GROUP BY ALL")
def layered_gold(spark, sf_dir):
    """The latest Gold snapshot as its commit lists it, after all stages over files."""
    root, _ = _layered(spark, sf_dir)
    return local.gold(spark, "dvf", root).groupBy(F.col("year").cast("short").alias("year"), "dept").agg(F.count("*").alias("rows"), F.countDistinct("id_mutation").alias("mutations"))


@query(
    f"""WITH {BRONZE}, v AS (SELECT (SELECT count(*) FROM b) AS n, (SELECT count(*) FROM b WHERE m <= 7) AS bad, (SELECT count(*) FROM s) AS good)
SELECT unnest(['ingest rows', 'rows_in', 'rows_out', 'rejects', 'duplicates', 'curate rows', 'commit.json rows']) AS name, CAST(unnest([n, n, good, bad, n - good - bad, good, good]) AS BIGINT) AS value FROM v"""
)
def layered_stats(spark, sf_dir):
    """What the stages report, and the rows of the files in the manifest that latest.json points to."""
    root, (a, b, c) = _layered(spark, sf_dir)
    date = tables.latest_snapshot(spark, root, "dvf")
    listed = spark.read.option("multiLine", True).json(tables.manifest_path(root, "dvf", f"{date}/commit.json")).select(F.explode("files.rows").alias("rows"))
    told = {"ingest rows": a.rows, "rows_in": b.rows_in, "rows_out": b.rows_out, "rejects": b.rejects, "duplicates": b.duplicates, "curate rows": c.rows}
    return spark.createDataFrame(list(told.items()), "name string, value long").unionByName(listed.agg(F.lit("commit.json rows").alias("name"), F.sum("rows").alias("value")))


def _serving_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw serving rows made of events: dates in four layouts, prices with commas, names with blanks, faults."""
    n, user = F.col("event_id") % 8, F.col("user_id").cast("string")
    day = F.when(n == 0, F.date_format("ts", "dd/MM/yyyy")).when(n == 1, F.date_format("ts", "dd-MM-yyyy")).when(n == 2, F.date_format("ts", "yyyy/MM/dd")).when(n == 3, "31/13/2020").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id_mutation"), day.alias("date_mutation"), F.when(n == 4, "-5").when(n == 5, F.concat(user, F.lit(",5"))).otherwise(user).alias("valeur_fonciere"),
        F.when(n == 6, "-1").when(n == 7, "0").otherwise("20").alias("surface_reelle_bati"), F.concat(F.lit(" "), F.col("event_type"), F.lit("  x ")).alias("nom_commune"),
        F.when(n == 5, "0").otherwise(F.col("event_type")).alias("type_local"), F.when(n == 1, "200").otherwise("2.5").alias("longitude"), F.when(n == 2, "-91").otherwise("48").alias("latitude"),
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id_mutation, CAST(ts AS DATE) AS date_mutation, user_id + CASE WHEN event_id % 8 = 5 THEN 0.5 ELSE 0 END :: DOUBLE AS valeur_fonciere,
  upper(event_type) || ' X' AS nom_commune, CASE WHEN event_id % 8 <> 5 THEN upper(event_type[1]) || lower(event_type[2:]) END AS type_local,
  CASE WHEN event_id % 8 <> 1 THEN 2.5 END :: DOUBLE AS longitude, CASE WHEN event_id % 8 <> 2 THEN 48.0 END :: DOUBLE AS latitude, CAST(year(ts) AS SMALLINT) AS year,
  round(CASE WHEN event_id % 8 <> 7 THEN (user_id + CASE WHEN event_id % 8 = 5 THEN 0.5 ELSE 0 END) / 20.0 END :: DOUBLE, 6) AS prix_m2
FROM events WHERE event_id % 8 NOT IN (3, 4, 6) AND (user_id > 0 OR event_id % 8 = 5)""",
    text=("date_mutation",),
)
def serving_rows(spark, sf_dir):
    """The typed rows, written to the serving table's files and read back."""
    path = files.scratch_path(spark, "serving")
    serving.write_rows(serving.serving_rows(_serving_raw(spark, sf_dir))[0], path)
    rows = spark.read.parquet(path).withColumns({"year": F.col("year").cast("short"), "prix_m2": F.round("prix_m2", 6)})
    return rows.select("id_mutation", "date_mutation", "valeur_fonciere", "nom_commune", "type_local", "longitude", "latitude", "year", "prix_m2")


@query("SELECT CAST(event_id AS VARCHAR) AS id_mutation FROM events WHERE event_id % 8 IN (3, 4, 6) OR (user_id <= 0 AND event_id % 8 <> 5)")
def serving_rejects(spark, sf_dir):
    return serving.serving_rows(_serving_raw(spark, sf_dir))[1].select("id_mutation")


@query("SELECT r AS run, CASE WHEN r = 1 THEN count(*) ELSE 0 END AS dest_rows, count(*) AS ori_rows FROM orders, (SELECT unnest([1, 2]) AS r) GROUP BY r")
def run_pipeline(spark, sf_dir):
    """The same load twice: the second run has nothing to add."""
    names = {"o_orderkey": "i64", "o_custkey": "i64", "o_totalprice": "f64", "o_orderdate": "date", "o_orderpriority": "str"}
    fields = [{"name": n, "type": t, "nullable": True} for n, t in names.items()]
    request = {
        "project": {"namespace": "demo", "warehouse_uri": files.scratch_path(spark, "warehouse")},
        "datasets": [{"Bronze": {"uri": _orders_csv(spark, sf_dir), "source": {"Csv": {}}, "inner": {"name": "raw", "primary_key": [], "schema": {"fields": fields}}}}, {"Silver": {"name": "orders", "primary_key": ["o_orderkey"], "schema": {"fields": fields}}}],
        "mapping": {"transforms": {"columns": M.identity_mapping(fields, fields)}},
    }
    made = [worker.run(spark, request) for _ in range(2)]
    return spark.createDataFrame([(i + 1, r.dest_rows, r.ori_rows) for i, r in enumerate(made)], "run int, dest_rows long, ori_rows long")
