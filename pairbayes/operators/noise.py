"""Feature noise for augmentation (P28): seeded, per-row, JVM-side except
Poisson, which needs a Poisson draw per value (vectorised pandas UDF)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _poisson_draw(lam: pd.Series, seed: pd.Series) -> pd.Series:
    out = np.empty(len(lam))
    for k, (l, s) in enumerate(zip(lam.to_numpy(), seed.to_numpy())):
        out[k] = np.random.default_rng(int(s) & 0x7FFFFFFF).poisson(max(float(l), 0.0))
    return pd.Series(out)


def _poisson():
    # built on first use: a pandas UDF needs an active session
    return F.pandas_udf(_poisson_draw, "double")


def add_noise(x: Column, kind: str, level: float, seed: int, row_key: Column | None = None, clip: bool = True) -> Column:
    """P28 noise kinds: gaussian, salt_pepper, poisson, speckle, rayleigh,
    exponential, uniform; values clipped to [0, 1]."""
    if kind == "gaussian":
        v = x + F.randn(seed) * F.lit(level)
    elif kind == "salt_pepper":
        u = F.rand(seed)
        v = F.when(u < F.lit(level / 2), F.lit(0.0)).when(u > F.lit(1 - level / 2), F.lit(1.0)).otherwise(x)
    elif kind == "speckle":
        v = x + x * F.randn(seed) * F.lit(level)
    elif kind == "rayleigh":
        v = x + F.lit(level) * F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - F.rand(seed)))
    elif kind == "exponential":
        v = x + F.lit(-level) * F.ln(F.lit(1.0) - F.rand(seed))
    elif kind == "uniform":
        v = x + (F.rand(seed) * F.lit(2.0) - F.lit(1.0)) * F.lit(level)
    elif kind == "poisson":
        lam = F.lit(1.0 / max(level, 1e-12))
        key = row_key if row_key is not None else F.monotonically_increasing_id()
        v = _poisson()(x * lam, F.xxhash64(key, F.lit(seed))) / lam
    else:
        raise ValueError(kind)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if clip else v
