"""Potential evapotranspiration, unit conversion and angles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Solar constant and conversion of radiation to millimetres; coefficient of the temperature range.
RADIATION, RANGE_FACTOR = 15.342618001389575, 0.002295


def _clamped_acos(c: Column) -> Column:
    """Sunset angle; polar days and nights stay within range."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def hargreaves(day: Column, latitude: Column, t_min: Column, t_max: Column, t_avg: Column) -> Column:
    """From day of year, latitude in degrees and temperatures; never negative; null if t_max < t_min."""
    lat, year = F.radians(latitude), 2 * math.pi * day / 365
    declination = 0.409 * F.sin(year - 1.39)
    sunset = _clamped_acos(-F.tan(lat) * F.tan(declination))
    radiation = RADIATION * (1 + 0.033 * F.cos(year)) * (sunset * F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.sin(sunset))
    return F.greatest(F.lit(0.0), RANGE_FACTOR * radiation * F.sqrt(F.when(t_max >= t_min, t_max - t_min)) * (t_avg + 17.8))


def oudin(t_avg: Column, date: Column, latitude: Column) -> Column:
    """From mean temperature, date and latitude in radians; zero below -5 degrees."""
    year, month = F.year(date), F.month(date)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    shift = F.when(month < 3, 30).when(leap, 31).otherwise(32)
    angle = 2 * math.pi * (275.0 * month / 9.0 - shift + F.dayofmonth(date)) / 365
    delta = 0.409 * F.sin(angle - 1.39)
    omega = _clamped_acos(-F.tan(latitude) * F.tan(delta))
    energy = 37.6 * (1 + 0.033 * F.cos(angle)) * (omega * F.sin(latitude) * F.sin(delta) + F.sin(omega) * F.cos(latitude) * F.cos(delta))
    return F.when(t_avg < -5, 0.0).otherwise(energy / 2260.0 * (t_avg + 5) * 0.01)


def degrees(text: Column) -> Column:
    """Decimal degrees of text like 48-30-36: degrees, minutes, seconds."""
    part = lambda i: F.try_element_at(F.split(text, "-"), F.lit(i)).try_cast("double")
    return part(1) + part(2) / 60 + part(3) / 3600


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def per_day(per_second: Column) -> Column:
    return per_second * 86400
