"""Bronze to Silver: typing, rules, deduplication, rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.geo import with_geohash
from ..functions.keys import digest, joined_key
from ..operators.dedup import keep_first


@dataclass
class Classified:
    """One pass over Bronze: what becomes Silver, what is rejected, and how many rows were seen."""

    silver: DataFrame
    rejects: DataFrame
    accepted: DataFrame  # before deduplication


def parsed(bronze: DataFrame) -> DataFrame:
    """Bronze with the cleaned text columns as _c_<name> and the values that the rules judge as _day, _cents, _lon, _lat.

    They are generated as one row each, so that the optimizer keeps them as finished values instead of writing
    their expressions anew into every rule and filter that uses them.
    """
    clean = {n: X.blank_to_null(F.col(n)) for n in S.RAW_COLUMNS}
    once = lambda df, columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    c = lambda n: F.col(f"_c_{n}")
    rows = once(bronze, {f"_c_{n}": e for n, e in clean.items()})
    return once(rows, {"_day": X.parse_iso_date(c("date_mutation"), True), "_cents": X.parse_cents(c("valeur_fonciere"), True), "_lon": X.parse_number(c("longitude"), True), "_lat": X.parse_number(c("latitude"), True)})


def reject_reason(max_year: int | None = None) -> Column:
    """struct(code, detail) of the first rule that a parsed row breaks; NULL for a good row."""
    why = lambda code, detail: F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))
    year = F.year("_day")
    lon, lat = F.col("_lon"), F.col("_lat")
    missing = F.col("_c_id_mutation").isNull() | F.col("_c_date_mutation").isNull() | F.col("_c_numero_disposition").isNull()
    late = (year > max_year) if max_year is not None else F.lit(False)
    # An amount that decimal(12,2) cannot hold is refused as well.
    bad_value = F.col("_c_valeur_fonciere").isNotNull() & (F.col("_cents").isNull() | (F.col("_cents") < 0) | (F.col("_cents") >= 1e12))
    return (
        F.when(missing, why(S.SCHEMA_MISSING, "required field missing"))
        .when(F.col("_day").isNull(), why(S.DATE_INVALID, "date parse failed"))
        .when((year < 1990) | late, why(S.DATE_INVALID, "year out of expected bounds"))
        .when(bad_value, why(S.VALUE_NEGATIVE, "value negative or not a number"))
        .when(lon.isNull() != lat.isNull(), why(S.COORD_OOB, "longitude and latitude must be both present or both null"))
        .when((lon < -5.5) | (lon > 9.9) | (lat < 41.0) | (lat > 51.5), why(S.COORD_OOB, "coordinates out of FR bbox"))
    )


def typed(rows: DataFrame) -> DataFrame:
    """Silver columns and row_number from parsed rows, in steps that each refer to finished columns."""
    out: dict[str, Column] = {}
    for f in S.SILVER.fields[: len(S.RAW_COLUMNS)]:
        c, kind = F.col(f"_c_{f.name}"), f.dataType.simpleString()
        if f.name == "nature_mutation":
            out[f.name] = F.coalesce(F.upper(c), F.lit(""))
        elif f.name in S.UPPER:
            out[f.name] = F.upper(c)
        elif f.name == "code_postal":
            out[f.name] = X.pad_left(c, 5)
        elif f.name == "date_mutation":
            out[f.name] = F.col("_day")
        elif f.name == "valeur_fonciere":
            out[f.name] = (F.col("_cents") / 100).try_cast("decimal(12,2)")
        elif f.name in ("longitude", "latitude"):
            out[f.name] = F.col("_lon" if f.name == "longitude" else "_lat")
        elif kind == "double":
            value = X.parse_number(c, True)
            out[f.name] = F.when(value >= 0, value)
        elif kind in ("smallint", "int"):
            out[f.name] = X.parse_whole(c, "short" if kind == "smallint" else "int", non_negative=True, trimmed=True)
        else:
            out[f.name] = c
    base = rows.select(*[c.alias(n) for n, c in out.items()], "row_number", "mutation_key")
    price = F.when(F.col("surface_reelle_bati") > 9, F.col("valeur_fonciere").cast("double") / F.col("surface_reelle_bati"))
    priced = base.withColumns({"year_mutation": F.year("date_mutation").cast("short"), "month_start": F.trunc("date_mutation", "month"), "_price": price})
    return with_geohash(priced.withColumn("prix_m2", F.when((F.col("_price") > 0) & (F.col("_price") < float("inf")), F.col("_price"))), "longitude", "latitude")


def key_parts(legacy: bool = False) -> list[Column]:
    """What tells two transactions apart, of parsed rows. ``legacy`` leaves the house number out."""
    names = ["id_mutation", "date_mutation", "numero_disposition", "id_parcelle", "adresse_numero", "adresse_nom_voie", "code_postal"]
    own = {"date_mutation": F.col("_day"), "code_postal": X.pad_left(F.col("_c_code_postal"), 5)}
    return [own.get(n, F.col(f"_c_{n}")) for n in names if not (legacy and n == "adresse_numero")]


def validate(bronze: DataFrame, max_year: int | None = None, legacy_key: bool = False, legacy_batch: int = 65_536, keep=lambda marked: marked) -> Classified:
    """Classify Bronze rows. The first of equal good rows by row_number goes to Silver.

    ``keep`` may store the parsed and judged rows, so that Silver and Rejects do not parse Bronze each.

    ``legacy_key`` reproduces deduplication within blocks of ``legacy_batch`` rows and without the house number.
    """
    missing = [c for c in S.RAW_COLUMNS + S.LINEAGE if c not in bronze.columns]
    if missing:
        raise ValueError(f"missing column in Bronze: {', '.join(missing)}")
    held = [*[f"_c_{n}" for n in S.RAW_COLUMNS], "_day", "_cents", "_lon", "_lat", "row_number"]
    # Rows are told apart by the key's text, which packs well beside its parts; its digest, which does not, is made after.
    keys = {"_key": joined_key(key_parts())}
    if legacy_key:
        keys["_dedup"] = joined_key([*key_parts(legacy=True), F.floor((F.col("row_number") - 1) / legacy_batch)])
    # A refused row keeps its text as it came; a good one needs the cleaned text alone.
    raw = F.struct(*[F.col(c).cast("string").alias(c) for c in S.RAW_COLUMNS + S.LINEAGE])
    judged = parsed(bronze).withColumn("_why", reject_reason(max_year))
    marked = keep(judged.select(*held, *[k.alias(n) for n, k in keys.items()], "_why", F.when(F.col("_why").isNotNull(), raw).alias("_raw")))
    good = marked.filter("_why IS NULL").select(*held, *keys)
    # The first of equal rows is found before they are typed: that costs more than the key, and runs on what is left.
    first = keep_first(good, ["_dedup" if legacy_key else "_key"], ["row_number"]).withColumn("mutation_key", digest(F.col("_key")))
    silver = typed(first).select(*S.SILVER.fieldNames())
    rejects = marked.filter("_why IS NOT NULL").select("_raw.*", F.col("_why.code").alias("error_code"), F.col("_why.detail").alias("error_detail"), F.lit("silver").alias("validation_stage"))
    return Classified(silver, rejects, good)
