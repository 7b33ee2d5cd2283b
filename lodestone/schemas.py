"""Fixed schemas of the real-estate transaction dataset."""

from __future__ import annotations

from pyspark.sql import types as T

#: The raw file's columns, in order.
RAW_COLUMNS = [
    "id_mutation", "date_mutation", "numero_disposition", "nature_mutation", "valeur_fonciere", "adresse_numero", "adresse_suffixe",
    "adresse_nom_voie", "adresse_code_voie", "code_postal", "code_commune", "nom_commune", "code_departement", "ancien_code_commune",
    "ancien_nom_commune", "id_parcelle", "ancien_id_parcelle", "numero_volume", "lot1_numero", "lot1_surface_carrez", "lot2_numero",
    "lot2_surface_carrez", "lot3_numero", "lot3_surface_carrez", "lot4_numero", "lot4_surface_carrez", "lot5_numero",
    "lot5_surface_carrez", "nombre_lots", "code_type_local", "type_local", "surface_reelle_bati", "nombre_pieces_principales",
    "code_nature_culture", "nature_culture", "code_nature_culture_speciale", "nature_culture_speciale", "surface_terrain",
    "longitude", "latitude",
]
LINEAGE = ["ingest_date", "source_file", "row_number"]
DERIVED = ["year_mutation", "geohash6", "mutation_key", "prix_m2", "month_start"]
REJECT_COLUMNS = ["error_code", "error_detail", "validation_stage"]

#: Reject codes.
SCHEMA_MISSING, DATE_INVALID, VALUE_NEGATIVE, COORD_OOB = "DVF_SCHEMA_MISSING", "DVF_DATE_INVALID", "DVF_VALUE_NEGATIVE", "DVF_COORD_OOB"

UPPER = {"nature_mutation", "nom_commune", "type_local", "nature_culture", "nature_culture_speciale"}
CARREZ = [f"lot{i}_surface_carrez" for i in range(1, 6)]
REQUIRED = {"id_mutation", "date_mutation", "numero_disposition", "nature_mutation"}


def _kind(name: str) -> T.DataType:
    if name == "date_mutation":
        return T.DateType()
    if name == "valeur_fonciere":
        return T.DecimalType(12, 2)
    if name in CARREZ or name in ("longitude", "latitude"):
        return T.DoubleType()
    if name in ("nombre_lots", "nombre_pieces_principales"):
        return T.ShortType()
    if name in ("surface_reelle_bati", "surface_terrain"):
        return T.IntegerType()
    return T.StringType()


SILVER = T.StructType(
    [T.StructField(n, _kind(n), n not in REQUIRED) for n in RAW_COLUMNS]
    + [
        T.StructField("year_mutation", T.ShortType(), False),
        T.StructField("geohash6", T.StringType()),
        T.StructField("mutation_key", T.BinaryType(), False),
        T.StructField("prix_m2", T.DoubleType()),
        T.StructField("month_start", T.DateType(), False),
    ]
)
REJECTS = T.StructType([T.StructField(n, T.StringType()) for n in RAW_COLUMNS + LINEAGE + REJECT_COLUMNS])
