"""Photometric colours (P17-P19) and survey-style selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed candidate column names per band, in the order they are tried.
BANDS = ["u", "g", "r", "i", "z"]
NAME_PATTERNS = ["modelMag_{b}", "psfMag_{b}", "{b}", "modelMag{b}", "psfMag{b}"]
COLOUR_LIMITS = (-1.0, 3.0)
# Fixed redshift colour-shift factors and clip ranges.
UG_HIGH_Z, UG_LOW_Z, GR_F, RI_F, IZ_F = 0.7, 0.3, 0.2, 0.1, 0.05
CLIPS = {"u_g": (-0.5, 3.0), "g_r": (-0.5, 2.0), "r_i": (-0.5, 1.0), "i_z": (-0.5, 0.8)}
NOISE_SD = {"u_g": 0.15, "g_r": 0.1, "r_i": 0.08, "i_z": 0.06}


def magnitude_columns(columns) -> dict[str, str]:
    """First candidate name present per band."""
    found = {}
    for b in BANDS:
        for p in NAME_PATTERNS:
            name = p.format(b=b)
            if name in columns:
                found[b] = name
                break
    return found


def colour_indices(df: DataFrame, keep=(), redshift: str | None = None) -> DataFrame:
    """U-g, g-r, r-i, i-z from the resolved magnitude columns; rows kept
    only when every colour is non-null and strictly inside (-1, 3)."""
    m = magnitude_columns(df.columns)
    cols = []
    for a, b in (("u", "g"), ("g", "r"), ("r", "i"), ("i", "z")):
        if a in m and b in m:
            cols.append((F.col(m[a]) - F.col(m[b])).alias(f"{a}_{b}"))
    out = df.select(*keep, *cols, *([F.col(redshift).alias("redshift")] if redshift else []))
    cond = F.lit(True)
    lo, hi = COLOUR_LIMITS
    for name in [n for n in ("u_g", "g_r", "r_i", "i_z") if n in out.columns]:
        cond = cond & F.col(name).isNotNull() & (F.col(name) > lo) & (F.col(name) < hi)
    return out.where(cond)


def redshift_shift(colours: DataFrame, target_z: float, noise_seed: int | None = None) -> DataFrame:
    """Shift colours by dz = target_z - redshift (or target_z without a
    redshift column) with the fixed factors; optional seeded normal noise;
    clipped to the per-colour ranges."""
    dz = (F.lit(target_z) - F.col("redshift")) if "redshift" in colours.columns else F.lit(target_z)
    ug = UG_HIGH_Z if target_z > 2.0 else UG_LOW_Z
    shifts = {"u_g": ug, "g_r": GR_F, "r_i": RI_F, "i_z": IZ_F}
    out = colours
    for i, (c, f) in enumerate(shifts.items()):
        v = F.col(c) + F.lit(f) * dz
        if noise_seed is not None:
            v = v + F.randn(noise_seed + i) * F.lit(NOISE_SD[c])
        lo, hi = CLIPS[c]
        out = out.withColumn(c, F.least(F.lit(hi), F.greatest(F.lit(lo), v)))
    return out
