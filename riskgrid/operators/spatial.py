"""Point-in-box join by grid cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: kilometres per degree of latitude.
KM_PER_DEGREE = 111.32


def box_half_sizes(lat: Column | float, km: float) -> tuple[Column, Column]:
    lat = lat if isinstance(lat, Column) else F.lit(lat)
    return F.lit(km / KM_PER_DEGREE), F.lit(km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def match_points(
    points: DataFrame,
    places: DataFrame,
    km: float = 20.0,
    cell_degrees: float | None = None,
    lat: str = "latitude",
    lon: str = "longitude",
    place_lat: str = "Latitude",
    place_lon: str = "Longitude",
    within_circle: bool = False,
) -> DataFrame:
    """Each point with every place whose box around it holds the point.

    A place is listed once per grid cell its box touches and a point sits in
    exactly one cell, so the equi-join on the cell finds every pair once and the
    exact test runs on candidates only.  The places side is small enough for an
    adaptive broadcast in practice; if it is not, the shuffle is on fine cells,
    not on places.  A hot cell is split by the skew-join rule.  A place column
    whose name (case aside) a point column already has is left out.
    """
    cell = cell_degrees or 2 * km / KM_PER_DEGREE
    half_lat, half_lon = box_half_sizes(F.col(place_lat), km)
    boxes = places.select(
        "*",
        (F.col(place_lat) - half_lat).alias("__s"),
        (F.col(place_lat) + half_lat).alias("__n"),
        (F.col(place_lon) - half_lon).alias("__w"),
        (F.col(place_lon) + half_lon).alias("__e"),
    )
    index = lambda c: F.floor(F.col(c) / cell)
    boxes = boxes.withColumn("__r", F.explode(F.sequence(index("__s"), index("__n"))))
    boxes = boxes.withColumn("__c", F.explode(F.sequence(index("__w"), index("__e"))))
    taken = {c.lower() for c in points.columns}
    extra = [c for c in places.columns if c.lower() not in taken]
    boxes = boxes.select("__r", "__c", "__s", "__n", "__w", "__e", F.col(place_lat).alias("__plat"), F.col(place_lon).alias("__plon"), *extra)
    gridded = points.select("*", index(lat).alias("__r"), index(lon).alias("__c"))
    hit = F.col(lat).between(F.col("__s"), F.col("__n")) & F.col(lon).between(F.col("__w"), F.col("__e"))
    out = gridded.join(boxes, ["__r", "__c"]).filter(hit)
    if within_circle:
        out = out.filter(haversine_km(F.col(lat), F.col(lon), F.col("__plat"), F.col("__plon")) <= km)
    return out.select(*points.columns, *extra)


def cells_per_box(km: float, cell_degrees: float, max_lat: float) -> int:
    """Upper bound of the cells one place is listed in; a sizing aid for ``cell_degrees``."""
    tall = math.ceil(2 * km / KM_PER_DEGREE / cell_degrees) + 1
    wide = math.ceil(2 * km / (KM_PER_DEGREE * math.cos(math.radians(max_lat))) / cell_degrees) + 1
    return tall * wide
