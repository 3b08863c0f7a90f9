"""Column names and types of the declaration table.

The names are the export's own once blanks have become underscores, so results
can be matched with existing extracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Export column names (after blanks became "_").
SESSION = "Heure_debut_session"
SIZE = "Taille_MM"
WEIGHT = "Poids_g"
DURATION = "Durée_de_la_session"
NO_KILL = "Nokill"
CATCH_ID = "Id_Prise"
STAMP = "Horodate"
LATITUDE = "Latitude"
LONGITUDE = "Longitude"
PHOTO = "Lien_photo"
ZONE_ID = "ID_ZoneDePeche"
ZONE = "Nom_ZoneDePeche"
SUBZONE_ID = "ID_SousZoneDePeche"
SUBZONE = "Nom_SousZoneDePeche"
TECHNIQUE = "Technique"
FEDERATION = "Nom_Fédération"
VERNACULAR = "NomVernaculaire"
SPECIES = "NomScientifique"
FAO_CODE = "CodeFAO"
CATCHES = "Nb_de_prises"
KEPT = "Nb_conservées"
RELEASED = "Nb_relâchées"
ANGLERS = "Nb_de_pêcheurs"
ANGLER = "Id_Abonné"

# Derived column names.
WEEKDAY = "jour_semaine"
MONTH = "mois"
MONTH_NUMBER = "mois_num"
YEAR = "annee"
NOTE = "modification_main"
MODE = "Mode_peche"
MEMBER = "adhesion_fede"
OUTING = "ID_sortie_corrige"
SIZE_MAX = "Taille_max_mm"
WEIGHT_MAX = "Poids_max_g"
LEGAL_SIZE = "TMC_Med"
FINAL_WEIGHT = "poids_final"
LINE_WEIGHT = "poids_final_total"

# Position of a row in its export; every "first row" rule orders by it.
ROW_ID = "_row_id"
# Path of the export a row comes from, where several are read as one.
FILE = "_file"
# Text of a line that could not be read as a row.
UNREADABLE = "_unreadable"

# Raw header -> type. Columns not listed are read as text.
RAW_TYPES: dict[str, T.DataType] = {
    "Heure debut session": T.TimestampNTZType(),
    "Taille (mm)": T.DoubleType(),
    "Poids (g)": T.DoubleType(),
    "Durée de la session": T.DoubleType(),
    "Nokill": T.DoubleType(),
    "Id Prise": T.StringType(),
    "Id_Prise": T.StringType(),
    "Horodate": T.StringType(),
    "Latitude": T.DoubleType(),
    "Longitude": T.DoubleType(),
    "Lien photo": T.StringType(),
    "ID_ZoneDePeche": T.LongType(),
    "Nom_ZoneDePeche": T.StringType(),
    "ID_SousZoneDePeche": T.LongType(),
    "Nom_SousZoneDePeche": T.StringType(),
    "Technique": T.StringType(),
    "Nom Fédération": T.StringType(),
    "NomVernaculaire": T.StringType(),
    "NomScientifique": T.StringType(),
    "CodeFAO": T.StringType(),
    "Nb de prises": T.DoubleType(),
    "Nb conservées": T.DoubleType(),
    "Nb relâchées": T.DoubleType(),
    "Nb de pêcheurs": T.DoubleType(),
    "Id Abonné": T.StringType(),
}

# Columns a file must have to count as a raw export.
RAW_REQUIRED = ("Heure debut session", "Taille (mm)", "Poids (g)")
TOP_REQUIRED = (SPECIES, CATCHES, FAO_CODE, VERNACULAR, LINE_WEIGHT)

# Two headers whose name changes beyond blanks.
RENAMED = {"Taille (mm)": SIZE, "Poids (g)": WEIGHT}


class MissingColumnsError(ValueError):
    """The table lacks columns that an operator needs."""


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumnsError("missing columns: " + ", ".join(missing))
    return df


def require_rows(df: DataFrame, what: str = "selection") -> DataFrame:
    """Raise when nothing was selected (runs a one-row job)."""
    if df.isEmpty():
        raise ValueError(f"no rows in the {what}")
    return df


def normalise_names(df: DataFrame) -> DataFrame:
    """Rename the two unit-bearing headers, then turn every blank into ``_``."""
    return df.toDF(*(RENAMED.get(n, n).replace(" ", "_") for n in df.columns))
