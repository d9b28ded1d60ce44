"""Vegetation, water-stress, drought and erosion columns from bands and weather."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(value: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def normalized(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (a + b), within -1 and 1; null where the sum is zero."""
    return clamp(ratio(_col(a) - _col(b), _col(a) + _col(b)), -1, 1)


def indices(blue, green, red, edge, nir, swir) -> dict[str, Column]:
    """The index columns of one observation."""
    b, g, r, e, n, s = map(_col, (blue, green, red, edge, nir, swir))
    ndvi = normalized(n, r)
    return {
        "ndvi": ndvi,
        "savi": clamp(ratio(1.5 * (n - r), n + r + 0.5), -1, 1),
        "evi": clamp(ratio(2.5 * (n - r), n + 6 * r - 7.5 * b + 1), -1, 1),
        "lswi": normalized(n, s),
        "ndwi": normalized(g, n),
        "ndre": normalized(n, e),
        "lai": clamp(3.618 * ndvi - 0.118, 0, 6),
    }


#: Scene classes that are clear land or water.
CLEAR_SCL = (4, 5, 6, 7)


def clear_scl(scl: str | Column) -> Column:
    return _col(scl).isin(*CLEAR_SCL)


def clear_qa60(qa: str | Column) -> Column:
    """Neither opaque cloud (bit 10) nor cirrus (bit 11)."""
    q = _col(qa)
    return (q.bitwiseAND(1 << 10) == 0) & (q.bitwiseAND(1 << 11) == 0)


def clear_pixel_qa(qa: str | Column) -> Column:
    """None of fill, dilated cloud, cirrus, cloud, shadow, snow (bits 0 to 5)."""
    return _col(qa).bitwiseAND(0b111111) == 0


def clear_state(qa: str | Column) -> Column:
    """Cloud state (bits 0-1) clear and no shadow (bit 2)."""
    q = _col(qa)
    return (q.bitwiseAND(3) == 0) & (F.shiftright(q, 2).bitwiseAND(1) == 0)


def condition(value: Column, low: Column, high: Column, n: Column, least: int = 3) -> Column:
    """Place between the extremes of the baseline in per cent; null with too few observations."""
    return F.when((n >= least) & (high > low), clamp(100 * (value - low) / (high - low), 0, 100))


def evaporative_stress(et: str | Column, pet: str | Column) -> Column:
    return clamp(ratio(_col(et), _col(pet)), 0, 1.5)


def water_stress(rain: str | Column, et: str | Column) -> Column:
    return clamp(ratio(_col(rain) - _col(et), _col(rain) + _col(et)), -1, 1)


def cover_factor(ndvi: Column) -> Column:
    """exp(-2 n / (1 - n)), between 0 and 1."""
    return F.when(ndvi < 1, clamp(F.exp(-2 * ndvi / (1 - ndvi)), 0, 1)).otherwise(F.when(ndvi.isNotNull(), 0.0))


def soil_loss(r: Column, k: Column, ls: Column, c: Column, p: Column) -> Column:
    return clamp(r * k * ls * c * p, 0, 500)


def biomass(lai: Column, sar: Column, ndvi: Column, slope: Column, base: Column) -> Column:
    """Mean of the candidates that are there: linear in leaf area by land class, radar, and linear in NDVI; 0 to 500."""
    found = F.filter(F.array(base + slope * lai, sar, 120 * ndvi), lambda x: x.isNotNull())
    return clamp(ratio(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.size(found).cast("double")), 0, 500)


def kelvin(counts: Column) -> Column:
    """Kelvin of a product that stores counts of 0.02."""
    return counts * 0.02
