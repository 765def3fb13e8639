"""Rounding of arrays as the ``round`` of SQL does it."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def half_up(values: np.ndarray, digits: int = 8) -> np.ndarray:
    """Doubles rounded by their shortest decimal form, halves away from zero; for values below a million."""
    scaled = np.abs(values) * 10.0**digits
    whole = np.floor(scaled)
    out = np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, values)
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-5):  # too near to a half for the product above
        out[i] = float(Decimal(repr(float(values[i]))).quantize(unit, ROUND_HALF_UP))
    return out
