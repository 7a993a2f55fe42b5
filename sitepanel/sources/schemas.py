"""Declared schemas of the survey files, in file order, and the names used after loading.

Column order matters: the CSV reader binds a declared schema by position, so
the header text (with its spaces and dots) never reaches a query.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_INT, _NUM, _TEXT = T.IntegerType(), T.DoubleType(), T.StringType()

# Column order of the site list with monitoring years.
MONITORED_SITES = _schema(
    object_id=_INT, site=_TEXT, first_year=_INT, last_year=_INT,
    elevation=_NUM, site_lon=_NUM, site_lat=_NUM,
)

# Column order of the site list with release years.
RELEASE_SITES = _schema(
    site=_TEXT, site_code=_TEXT, county=_TEXT, site_lon=_NUM, site_lat=_NUM,
    elevation=_NUM, release_year=_INT,
)

# Column order of the site list without release years.
PLAIN_SITES = _schema(
    site=_TEXT, site_code=_TEXT, county=_TEXT, site_lon=_NUM, site_lat=_NUM, elevation=_NUM,
)

# Daily weather by coordinate.
DAILY_WEATHER = _schema(
    lon=_NUM, lat=_NUM, year=_INT, month=_INT, day=_INT,
    tmax=_NUM, tmin=_NUM, pr=_NUM, srad=_NUM, swe=_NUM, soil=_NUM,
)

# Release events, several rows per site.
RELEASES = _schema(site=_TEXT, release_year=_INT)

# Files whose column order varies are bound by header: header text to (name, type).
# Headers of the survey, weather and release files.
SURVEY_HEADERS = {
    "SITE_NAME": ("site", "string"),
    "DATE": ("survey_date", "string"),
    "YEAR": ("year", "int"),
    "longitude": ("survey_lon", "double"),
    "latitude": ("survey_lat", "double"),
    "TargetWeed": ("target_weed", "double"),
    "OtherWeed": ("other_weed", "double"),
    "Forbs": ("forbs", "double"),
    "Grass": ("grass", "double"),
    "BareGround": ("bare_ground", "double"),
    "Litter": ("litter", "double"),
    "Moss": ("moss", "double"),
    "NumStems": ("stems", "double"),
    "HeightTall": ("height", "double"),
    "Insects": ("insects", "double"),
}
WEATHER_HEADERS = {
    "Longitude": ("lon", "double"),
    "Latitude": ("lat", "double"),
    "year": ("year", "int"),
    "month": ("month", "int"),
    "day": ("day", "int"),
    "tmax": ("tmax", "double"),
    "tmin": ("tmin", "double"),
    "pr": ("pr", "double"),
    "srad": ("srad", "double"),
    "swe": ("swe", "double"),
    "soil": ("soil", "double"),
}
RELEASE_HEADERS = {"SITE_NAME": ("site", "string"), "ReleaseYear": ("release_year", "int")}
# Prefixes of the numbered replicate columns of a plot survey.
REPLICATE_PREFIXES = {
    "bare_ground": "B_GROUND",
    "litter": "LITTER",
    "moss": "MOSS",
    "target_weed": "T_WEED",
    "other_weed": "O_WEED",
    "stems": "NU_STEM",
    "forbs": "FORB",
    "grass": "GRASS",
    "insects": "INSECTS",
}
