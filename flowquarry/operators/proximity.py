"""Points near other points, and the region that contains a point.

Points are hashed to grid cells sized by the radius; a point looks into its own cell and those around it, and what it
meets is measured exactly. Cells are rows of equal latitude cut into cells of longitude; the number of cells in a row falls towards
the poles, so a cell is never narrower than a few radii.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.geo import EARTH_KM, haversine_km, point_in_polygon
from flowquarry.operators.skew import hot_keys, salted_join
from flowquarry.session import cut


#: Cells are so many radii wide: a point then looks into two cells and a quarter on average, not into nine.
WIDTH = 4.0
#: Keys of one place that one task meets at a time.
KEYS = 500


def _bands(radius_km: float) -> tuple[float, float, int]:
    """The radius in degrees of latitude, a little over it, the height of a row, and the number of rows."""
    reach = math.degrees(radius_km / EARTH_KM) * 1.000001
    return reach, reach * WIDTH, max(1, math.ceil(180.0 / (reach * WIDTH)))


def _band(lat: Column, radius_km: float) -> Column:
    _, height, n = _bands(radius_km)
    return F.greatest(F.lit(0), F.least(F.floor((lat + 90.0) / height), F.lit(n - 1))).cast("int")


def _reach(band: Column, radius_km: float) -> Column:
    """Degrees of longitude that the radius spans at most between points of which one lies in ``band``; 180 near a pole."""
    reach, height, _ = _bands(radius_km)
    # Between two points of latitudes p, q the span obeys sin^2(span/2) cos p cos q <= sin^2(r/2R); neither is further out than the row's edge and the radius.
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0)) + reach)
    c = F.cos(F.radians(edge))
    s = math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2))
    return F.when(c > s * 1.000001, F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(s) / c))) * 1.000001).otherwise(180.0)


def _cells(band: Column, radius_km: float) -> Column:
    return F.greatest(F.lit(1), F.floor(360.0 / (_reach(band, radius_km) * WIDTH))).cast("bigint")


def _at(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180.0) * n / 360.0)


def placed(points: DataFrame, key: str = "node", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(k, lat, lon), distinct: the key as text, and one name for each place. Rows with a null are left out."""
    rows = points.select(F.col(key).cast("string").alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    rows = rows.filter("k is not null and lat is not null and lon is not null")
    # -0.0 and 0.0, and both names of the antimeridian, are one place each.
    return rows.select("k", (F.col("lat") + 0.0).alias("lat"), F.when(F.col("lon") == -180.0, 180.0).otherwise(F.col("lon") + 0.0).alias("lon")).distinct()


def place_links(places: DataFrame, radius_km: float) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b, km) of different places (lat, lon) at most ``radius_km`` apart, each pair once, the lower place first."""
    here = places.select("lat", "lon", _band(F.col("lat"), radius_km).alias("band"))
    home = here.withColumn("n", _cells(F.col("band"), radius_km)).select("lat", "lon", "band", F.pmod(_at(F.col("lon"), F.col("n")), F.col("n")).alias("cell"))
    reach, _, _ = _bands(radius_km)
    look = here.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.sequence(_band(F.col("lat") - reach, radius_km), _band(F.col("lat") + reach, radius_km))).alias("band"))
    look = look.withColumns({"n": _cells(F.col("band"), radius_km), "far": _reach(F.col("band"), radius_km)})
    first, last = _at(F.col("lon_a") - F.col("far"), F.col("n")), _at(F.col("lon_a") + F.col("far"), F.col("n"))
    # A reach right round the row takes each of its cells once.
    cells = F.transform(F.sequence(first, F.least(last, first + F.col("n") - 1)), lambda c: F.pmod(c, F.col("n")))
    look = look.select("lat_a", "lon_a", "band", F.explode(cells).alias("cell"))
    met = salted_join(look, home, ["band", "cell"])
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon"))
    ordered = (F.col("lat_a") < F.col("lat")) | ((F.col("lat_a") == F.col("lat")) & (F.col("lon_a") < F.col("lon")))
    return met.filter(ordered).select("lat_a", "lon_a", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), km.alias("km")).filter(F.col("km") <= radius_km)


def near_places(points: DataFrame, radius_km: float, key: str = "node", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(lat, lon, n_keys, n_places, n_near): a row a place, the class of all keys there, with the places and the keys of other places at most ``radius_km`` away.

    It says what ``near_pairs`` does without a row for each pair of keys: keys of one place are near each other, and links are between places. A key of
    several places counts at each of them.
    """
    n = placed(points, key, lat, lon).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n_keys"))
    links = place_links(n.select("lat", "lon"), radius_km)
    both = links.select(F.explode(F.array(F.struct("lat_a", "lon_a", "lat_b", "lon_b"), F.struct(F.col("lat_b").alias("lat_a"), F.col("lon_b").alias("lon_a"), F.col("lat_a").alias("lat_b"), F.col("lon_a").alias("lon_b")))).alias("x")).select("x.*")
    other = n.select(F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("n_keys").alias("k"))
    sums = both.join(other, ["lat_b", "lon_b"]).groupBy(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")).agg(F.count(F.lit(1)).alias("n_places"), F.sum("k").alias("n_near"))
    return n.join(sums, ["lat", "lon"], "left").select("lat", "lon", "n_keys", F.coalesce("n_places", F.lit(0)).alias("n_places"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def near_pairs(points: DataFrame, radius_km: float, key: str = "node", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """All pairs (key_a < key_b as text, km) of different keys that have points at most ``radius_km`` apart.

    ``points`` has a key and finite coordinates, which may repeat; rows with a null key are left out. Keys at the very same place are first
    folded into one place, so copies meet once and not once for every row; cells that hold many places, and places that hold many keys, are split by their load.
    The result itself holds every pair, as it is asked for; ``near_places`` counts them by place. km is the least distance of the two keys.
    """
    rows = cut(placed(points, key, lat, lon), "placed")
    hot, k = hot_keys(rows, ["lat", "lon"], KEYS)
    a = rows.select(F.col("k").alias("k_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = rows.select(F.col("k").alias("k_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    links = place_links(rows.select("lat", "lon").distinct(), radius_km)
    ends = salted_join(links, a, ["lat_a", "lon_a"], KEYS, (hot.withColumnsRenamed({"lat": "lat_a", "lon": "lon_a"}), k))
    # Keys of one place meet those of the same place; between two places the keys may stand in either order.
    same = a.select("k_a", F.col("lat_a").alias("lat_b"), F.col("lon_a").alias("lon_b"), F.lit(0.0).alias("km"), F.lit(True).alias("one"))
    left = ends.select("k_a", "lat_b", "lon_b", "km", F.lit(False).alias("one")).unionByName(same)
    pairs = salted_join(left, b, ["lat_b", "lon_b"], KEYS, (hot.withColumnsRenamed({"lat": "lat_b", "lon": "lon_b"}), k)).filter((F.col("k_a") < F.col("k_b")) | (~F.col("one") & (F.col("k_a") > F.col("k_b"))))
    pairs = pairs.select(F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"), "km")
    return pairs.groupBy("key_a", "key_b").agg(F.min("km").alias("km"))


def _cover(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))


def in_boxes(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon", cell_deg: float = 1.0) -> DataFrame:
    """Each point with each box that holds it (min included, max excluded); points in no box are left out.

    ``boxes`` has min_lat, max_lat, min_lon, max_lon. Other columns of both sides come along; where names clash, those
    of the boxes are dropped. Points in cells are joined with the boxes' cells and then compared exactly. Boxes with a null edge hold nothing.
    """
    edges = ("min_lat", "max_lat", "min_lon", "max_lon")
    b = boxes.drop(*[c for c in boxes.columns if c in points.columns and c not in edges])
    b = b.withColumnsRenamed({c: f"__{c}" for c in edges}).filter("__min_lat < __max_lat and __min_lon < __max_lon")
    b = b.withColumn("__y", F.explode(_cover(F.col("__min_lat"), F.col("__max_lat"), cell_deg))).withColumn("__x", F.explode(_cover(F.col("__min_lon"), F.col("__max_lon"), cell_deg)))
    p = points.withColumns({"__y": F.floor(F.col(lat) / cell_deg).cast("int"), "__x": F.floor(F.col(lon) / cell_deg).cast("int")})
    la, lo = F.col(lat), F.col(lon)
    held = (la >= F.col("__min_lat")) & (la < F.col("__max_lat")) & (lo >= F.col("__min_lon")) & (lo < F.col("__max_lon"))
    return p.join(b, ["__y", "__x"]).filter(held).drop("__y", "__x", *[f"__{c}" for c in edges])


def in_polygons(points: DataFrame, regions: DataFrame, ring: str = "ring", lat: str = "lat", lon: str = "lon", cell_deg: float = 1.0) -> DataFrame:
    """Each point with each region whose ``ring`` (array of struct(lat, lon)) holds it, found through the ring's bounding box."""
    r = regions.withColumns(
        {
            "min_lat": F.array_min(F.transform(ring, lambda x: x["lat"])),
            "max_lat": F.array_max(F.transform(ring, lambda x: x["lat"])) + 1e-9,
            "min_lon": F.array_min(F.transform(ring, lambda x: x["lon"])),
            "max_lon": F.array_max(F.transform(ring, lambda x: x["lon"])) + 1e-9,
        }
    )
    return in_boxes(points, r, lat, lon, cell_deg).filter(point_in_polygon(F.col(lat), F.col(lon), F.col(ring)))
