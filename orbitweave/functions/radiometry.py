"""Radiometry: band calibration, digital numbers, gamma curves, sun glint, spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WorldView-3 calibration, and its band responses by wavelength in nm.
ABS_CAL_FACTOR = 9.295654e-3
BANDS = [("WV3", "red", 0.945, -1.350, 5.85e-2), ("WV3", "green", 0.907, -3.287, 6.18e-2), ("WV3", "blue", 0.905, -4.189, 5.40e-2)]
PLANCK, LIGHT = 6.62607015e-34, 299_792_458.0
GAMMA = 2.2
WATER_INDEX, AIR_INDEX = 1.3330, 1.000277


def band_table(spark: SparkSession, satellite: str | None = None) -> DataFrame:
    """``satellite, band, gain, offset, eff_bw, abs_cal``; an unknown satellite is an error."""
    rows = [(*b, ABS_CAL_FACTOR) for b in BANDS if satellite in (None, b[0])]
    if not rows:
        raise ValueError(f"no calibration for satellite {satellite!r}")
    return spark.createDataFrame(rows, "satellite string, band string, gain double, offset double, eff_bw double, abs_cal double")


def _limited(x: Column, top: float) -> Column:
    """Clamped above only, then cut towards zero."""
    return F.least(x, F.lit(top)).cast("int")


def radiance_to_dn2047(radiance: Column, gain: Column, offset: Column, eff_bw: Column, abs_cal: Column) -> Column:
    """Cut towards zero, not clamped."""
    return ((radiance - offset) / gain / (abs_cal / eff_bw)).cast("int")


def dn2047_to_radiance(dn: Column, gain: Column, offset: Column, eff_bw: Column, abs_cal: Column) -> Column:
    return gain * dn * (abs_cal / eff_bw) + offset


def dn255_to_linear(dn: Column) -> Column:
    return F.pow(dn / 255.0, F.lit(GAMMA))


def linear_to_dn255(x: Column) -> Column:
    return _limited(255.0 * F.pow(x, F.lit(1.0 / GAMMA)), 255.0)


def dn2047_to_linear(dn: Column) -> Column:
    return F.least(F.lit(1.0), F.pow(dn / 2047.0, F.lit(GAMMA)))


def linear_to_dn2047(x: Column) -> Column:
    return _limited(2047.0 * F.pow(x, F.lit(1.0 / GAMMA)), 2047.0)


def dn255_to_dn2047(dn: Column) -> Column:
    return (dn / 255.0 * 2047.0).cast("int")


def dn2047_to_dn255(dn: Column) -> Column:
    return (dn / 2047.0 * 255.0).cast("int")


def display_value(x: Column) -> Column:
    """Linear value to a display value in [0, 1]."""
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(1.0 / GAMMA))


def clip_byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int")))


def slope_variance(wind_m_s: float) -> float:
    """Sea-surface slope variance by wind speed (Cox and Munk 1954)."""
    return 0.003 + 0.00512 * wind_m_s


def photon_flux_to_irradiance(flux: Column, wl_nm: Column) -> Column:
    """Photons / (cm2 s nm) to W / (m2 nm)."""
    return flux * (PLANCK * LIGHT) / (wl_nm * 1e-9) * 1e4


def ground_irradiance(irradiance: Column, cos_zenith: Column) -> Column:
    return irradiance * F.greatest(cos_zenith, F.lit(0.0))


def per_micrometre(x: Column) -> Column:
    return x * 1000.0


def fresnel_water(cos_incidence: Column) -> Column:
    """Unpolarised reflectance of a water surface."""
    n = WATER_INDEX / AIR_INDEX
    sin_t = F.sqrt(1.0 - cos_incidence * cos_incidence) / n
    cos_t = F.sqrt(1.0 - sin_t * sin_t)
    s = F.pow((cos_incidence - n * cos_t) / (cos_incidence + n * cos_t), 2.0)
    p = F.pow((n * cos_incidence - cos_t) / (n * cos_incidence + cos_t), 2.0)
    return (s + p) / 2.0


def glint_reflectance(sun_zenith: Column, view_zenith: Column, relative_azimuth: Column, wind_m_s: float) -> Column:
    """Analytic sun glint: slope density x Fresnel / (4 cos(view) cos^4(tilt)), an average in place of a ray-traced image."""
    variance = slope_variance(wind_m_s)
    cos_2w = F.cos(sun_zenith) * F.cos(view_zenith) + F.sin(sun_zenith) * F.sin(view_zenith) * F.cos(relative_azimuth)
    cos_w = F.sqrt((1.0 + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_2w))) / 2.0)
    cos_tilt = (F.cos(sun_zenith) + F.cos(view_zenith)) / (2.0 * cos_w)
    tan2 = 1.0 / (cos_tilt * cos_tilt) - 1.0
    density = F.exp(-tan2 / variance) / (math.pi * variance)
    return math.pi * density * fresnel_water(cos_w) / (4.0 * F.cos(view_zenith) * F.pow(cos_tilt, 4.0))
