"""Points on the map."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from oreline.functions.core import number
from oreline.operators.scalars import color_scale
from oreline.sources.tables import stride_sample


def guess_coordinates(df: DataFrame) -> tuple[str, str]:
    """The first columns named like latitude and longitude."""
    lat = next(c for c in df.columns if re.search(r"^lat|latitude", c, re.I))
    lon = next(c for c in df.columns if re.search(r"^lon|^lng|longitude", c, re.I))
    return lat, lon


def valid_geo(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Rows whose coordinates are numbers on the globe, as doubles."""
    if lat is None or lon is None:
        lat, lon = guess_coordinates(df)
    rows = df.withColumns({lat: number(df, lat), lon: number(df, lon)})
    return rows.filter(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def geo_points(df: DataFrame, lat: str, lon: str, value: str, index: str, cap: int = 2000) -> DataFrame:
    """Points to draw: at most about ``cap``, evenly spread over the index, with a colour value."""
    return color_scale(stride_sample(valid_geo(df, lat, lon), cap, index), value).select(index, lat, lon, value, "color")


def geo_center(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return valid_geo(df, lat, lon).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(F.lit(1)).alias("n"))
