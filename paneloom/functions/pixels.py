"""Column expressions over coordinates, names, rings and missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pixel_id(lat: str | Column, lon: str | Column, digits: int = 5) -> Column:
    """18-digit number of a rounded coordinate; halves go to the even neighbour."""
    scale = 10.0**digits
    return F.rint((_col(lat) + 90) * scale).cast("long") * 10 ** (digits + 4) + F.rint((_col(lon) + 180) * scale).cast("long")


def ring_of(value: str | Column) -> Column:
    """Ring 0 to 5 from a number within 0.01 of one or the first number of a text; -1 otherwise."""
    number = F.regexp_extract(_col(value).cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    whole = F.rint(number)
    return F.when((F.abs(number - whole) <= 0.01) & whole.between(0, 5), whole.cast("int")).otherwise(-1)


def name_key(name: str | Column) -> Column:
    """Names as compared: lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(F.trim(_col(name))), "[^a-z0-9]+", "")


def no_data(value: str | Column, zero_is_missing: bool = True, negatives: str = "keep", tolerance: float = 0.0) -> Column:
    """Null for non-finite values, fills of -100 and below, the clamp -10, and zeros within the tolerance; what is still
    negative is kept, floored to zero or missing."""
    v = _col(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | (v <= -100) | (v == -10)
    if zero_is_missing:
        bad = bad | (F.abs(v) <= tolerance)
    kept = {"keep": v, "floor": F.greatest(v, F.lit(0.0)), "missing": F.when(v >= 0, v)}[negatives]
    return F.when(~bad, kept)


def block_id(lat: str | Column, lon: str | Column, degrees: float = 0.01) -> Column:
    """A square of about a kilometre."""
    return F.floor((_col(lat) + 90) / degrees).cast("long") * 100_000 + F.floor((_col(lon) + 180) / degrees).cast("long")


METRES_LAT, METRES_LON = 110_574.0, 111_320.0


def local_metres(lat: str | Column, lon: str | Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north metres from an origin on the local plane."""
    return (_col(lon) - lon0) * METRES_LON * math.cos(math.radians(lat0)), (_col(lat) - lat0) * METRES_LAT


def transverse_mercator(lat: str | Column, lon: str | Column, lon0: float, k0: float = 0.9996, east0: float = 500_000.0) -> tuple[Column, Column]:
    """Easting and northing on the WGS 84 ellipsoid by the Krueger series to third order."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon) - lon0)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east0 + k0 * big_a * east, k0 * big_a * north


def cleaned_number(text: str | Column) -> Column:
    """A number written with separators or a unit behind it."""
    return F.regexp_extract(F.regexp_replace(_col(text), r"[,\s]", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
