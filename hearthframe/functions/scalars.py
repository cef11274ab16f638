"""Numbers, missing values, units, angles and map coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilowatt hours of one unit (fixed values).
ENERGY_TO_KWH = {"J": 1.0 / 3_600_000.0, "kJ": 1.0 / 3_600.0, "MJ": 1.0 / 3.6, "GJ": 1_000.0 / 3.6, "Wh": 0.001, "kWh": 1.0, "MWh": 1_000.0}
EARTH_M = 6_371_000.0


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def is_missing(x: Column, kind: str = "string") -> Column:
    """Null, NaN or blank."""
    if kind in ("double", "float"):
        return x.isNull() | F.isnan(x)
    return x.isNull() | (F.trim(x.cast("string")) == "")


def whole_or_null(x: Column) -> Column:
    """An identifier as bigint; null when missing, not finite or not whole."""
    number = x.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.2e18) & (number == F.floor(F.when(F.abs(number) < 9.2e18, number)))
    return F.when(ok, number.try_cast("bigint"))


def number_or_null(x: Column) -> Column:
    """A number from text, comma decimals allowed."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def parse_number(x: Column) -> Column:
    """A number from text with thousands separators; null when blank or no number."""
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def to_kwh(value: Column, unit: Column) -> Column:
    """Null for an unknown unit."""
    return value * F.try_element_at(literal_map(ENERGY_TO_KWH), unit)


def percent(part: Column, whole: Column) -> Column:
    """Zero where the whole is zero."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def positive_shares(weights: Column) -> Column:
    """A map's entries with positive shares, keys lower-cased and collapsed, equal keys summed: array of (key, share) by key."""
    entries = F.transform(F.map_entries(weights), lambda e: F.struct(F.trim(F.regexp_replace(F.lower(e["key"]), r"\s+", " ")).alias("key"), e["value"].cast("double").alias("share")))
    good = F.filter(entries, lambda e: (e["share"] > 0) & (e["key"] != "") & (e["key"] != "nan"))
    keys = F.array_sort(F.array_distinct(F.transform(good, lambda e: e["key"])))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(good, lambda e: e["key"] == k), F.lit(0.0), lambda a, e: a + e["share"]).alias("share")))


def floor_estimate(height: Column, lowest: float = 2.6, highest: float = 3.4, middle: float | None = None) -> Column:
    """Struct (levels, level_height) of a building height in metres; null for heights that are missing or not positive."""
    middle = (lowest + highest) / 2 if middle is None else middle
    least, most, near = F.ceil(height / highest).cast("double"), F.floor(height / lowest).cast("double"), F.rint(height / middle)
    closest = F.greatest(F.lit(1.0), near)
    low, high = F.when(least > most, closest).otherwise(least), F.when(least > most, closest).otherwise(most)
    levels = F.greatest(F.least(F.greatest(near, low), high), F.lit(1.0)).cast("int")
    tall = F.least(F.greatest(F.round(height / levels, 1), F.lit(2.0)), F.lit(5.0))
    return F.when(height > 0, F.struct(levels.alias("levels"), tall.alias("level_height")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bbox_around(lat: Column, lon: Column, radius_m: float) -> Column:
    dlat = F.lit(radius_m / 111_000.0)
    dlon = radius_m / (111_000.0 * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest((F.floor((lon + 180) / 6) + 1).cast("int"), F.lit(1)), F.lit(60))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def metric_epsg(pairs: list[tuple[Column, Column]], default: int = 32633) -> Column:
    """The metric system at the first pair (lat, lon) that is whole, else the default."""
    return F.coalesce(*[F.when(la.isNotNull() & lo.isNotNull(), utm_epsg(la, lo)) for la, lo in pairs], F.lit(default))


def utm_forward(lat: Column, lon: Column) -> Column:
    """Struct (x, y) in metres in the point's own UTM zone, by Krüger's series to the fourth order in n (WGS 84)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (utm_zone(lon) * 6 - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * big * x).alias("x"), (F.when(lat >= 0, 0.0).otherwise(1.0e7) + 0.9996 * big * y).alias("y"))


def segment_length(x1, y1, x2, y2) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def azimuth(x1, y1, x2, y2) -> Column:
    """Degrees in [0, 360), counter-clockwise from east."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(360.0))


def angle_between(x1, y1, x2, y2, undirected: bool = False) -> Column:
    """Degrees between two vectors; a zero vector gives 180, or 90 if undirected."""
    size = F.hypot(x1, y1) * F.hypot(x2, y2)
    dot = F.try_divide(x1 * x2 + y1 * y2, size)
    dot = F.abs(dot) if undirected else dot
    return F.when(size == 0, F.lit(90.0 if undirected else 180.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))


def parallel_difference(a: Column, b: Column) -> Column:
    """Degrees between two directions taken without sense, in [0, 90]."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def edge_normal_form(x1, y1, x2, y2) -> Column:
    """Struct (alpha, rho): the line's direction in [0, 180) and its signed distance from the origin."""
    alpha = F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))
    return F.struct(alpha.alias("alpha"), (x1 * -F.sin(F.radians(alpha)) + y1 * F.cos(F.radians(alpha))).alias("rho"))
