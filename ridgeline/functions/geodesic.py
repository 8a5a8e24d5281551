"""Lengths on the WGS84 ellipsoid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_A, _F = 6378137.0, 1 / 298.257223563


def inverse(lon1, lat1, lon2, lat2):
    """Metres between points in degrees by Vincenty's inverse formula; NaN where it does not settle (near antipodes)."""
    b = _A * (1 - _F)
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    u1, u2, big = np.arctan((1 - _F) * np.tan(lat1)), np.arctan((1 - _F) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2, lam = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), big.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca = 1 - sa**2
            cm = np.where(ca == 0, 0.0, cs - 2 * s1 * s2 / ca)
            c = _F / 16 * ca * (4 + _F * (4 - 3 * ca))
            new = big + (1 - c) * _F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | ~np.isfinite(lam)):
                break
        q = ca * (_A**2 - b**2) / b**2
        k1 = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        k2 = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        d = k2 * ss * (cm + k2 / 4 * (cs * (2 * cm**2 - 1) - k2 / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        return np.where(done, b * k1 * (sigma - d), np.nan)


@F.pandas_udf(T.DoubleType())
def _metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    out = pd.Series(inverse(lon1, lat1, lon2, lat2))
    return out.where(out.notna(), None)


def geodesic_metres(lon1, lat1, lon2, lat2) -> Column:
    """inverse() as a column."""
    return _metres(lon1, lat1, lon2, lat2)
