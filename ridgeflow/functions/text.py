"""Text functions: cleaning, identifiers, positions, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEGMENT_ID = r"^(flat|climb|long_climb|loop)-[0-9a-f]{12}(-[0-9]+)?$"
KINDS = ("flat", "climb", "long_climb", "loop")


def is_segment_id(value: Column) -> Column:
    return value.rlike(SEGMENT_ID)


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for."""
    return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def clean_text(value: Column, multiline: bool, compose: bool = False) -> Column:
    """No control characters (line breaks stay in a body), no runs of blanks, trimmed."""
    s = F.coalesce(value, F.lit(""))
    s = F.regexp_replace(nfc(s) if compose else s, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[\p{Cc}&&[^\n]]" if multiline else r"\p{Cc}", " ")
    s = F.regexp_replace(s, r"[\s\p{Z}&&[^\n]]+", " ")
    if multiline:
        s = F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def link_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"(?i)https?://|www\."))


_POSITION = r"^\s*(-?\d+(?:\.\d+)?)\s*[,;\s]\s*(-?\d+(?:\.\d+)?)\s*$"


def parse_lat_lon(value: Column) -> Column:
    """Struct of ``lon`` and ``lat`` from "lat, lon"; null if it is none."""
    lat = F.regexp_extract(value, _POSITION, 1).try_cast("double")
    lon = F.regexp_extract(value, _POSITION, 2).try_cast("double")
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lon.alias("lon"), lat.alias("lat")))


def url_search(segment_id: Column, kind: Column) -> Column:
    """Query string of a page state; the default kind is left out."""
    parts = F.array(F.concat(F.lit("id="), segment_id), F.when(kind != "flat", F.concat(F.lit("kind="), kind)))
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def url_kind(url: Column) -> Column:
    kind = F.regexp_extract(url, r"[?&]kind=([^&]*)", 1)
    return F.when(kind.isin(*KINDS), kind)


def parse_bbox(value: Column) -> Column:
    """Struct of four numbers from "minLon,minLat,maxLon,maxLat"; null unless they make a box."""
    n = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("double"))
    box = F.struct(*(F.get(n, F.lit(i)).alias(k) for i, k in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))))
    fine = (F.size(n) == 4) & (box["min_lon"] < box["max_lon"]) & (box["min_lat"] < box["max_lat"])
    return F.when(fine, box)


#: Short names of the months.
MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")


def relative_date(when: Column, now: Column) -> Column:
    """Today, yesterday or days ago in French, from a week on the date; empty if there is none."""
    days = F.datediff(now, when)
    written = F.concat_ws(" ", F.dayofmonth(when).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(when)), F.year(when).cast("string"))
    return (
        F.when(when.isNull(), "")
        .when(days <= 0, "aujourd'hui")
        .when(days == 1, "hier")
        .when(days < 7, F.concat(F.lit("il y a "), days.cast("string"), F.lit(" jours")))
        .otherwise(written)
    )


def iso_utc(when: Column) -> Column:
    """A timestamp as ISO 8601 text in the session's zone, to the second."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
