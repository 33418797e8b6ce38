"""Feature-table shape used by the learner: ``(row_id, label, x array<double>)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_frame(
    df: DataFrame,
    row_id: str | Column,
    label: str | Column | None,
    cols: Sequence[str] | None = None,
    array_col: str | None = None,
    n_dims: int | None = None,
    balance: bool = True,
) -> DataFrame:
    """Project ``df`` to ``(row_id long, label string, x array<double>)``.

    Either ``cols`` (one double per feature) or ``array_col`` (optionally the
    first ``n_dims`` positions) supplies the features.  Column pruning reaches
    the scan because only the named columns are selected.
    """
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    if array_col is not None:
        x = F.col(array_col).cast("array<double>")
        if n_dims is not None:
            x = F.slice(x, 1, n_dims)
    elif cols:
        x = F.array(*[F.col(c).cast("double") for c in cols])
    else:
        raise ValueError("give cols or array_col")
    out = [rid.cast("long").alias("row_id")]
    if label is not None:
        lab = F.col(label) if isinstance(label, str) else label
        out.append(lab.cast("string").alias("label"))
    out.append(x.alias("x"))
    res = df.select(*out)
    if balance:
        from pairbayes.session import spread

        res = spread(res, "row_id")
    return res


def n_features_of(fx: DataFrame) -> int:
    """Feature count, read from one row (the array width is fixed per table)."""
    row = fx.select(F.size("x").alias("n")).head(1)
    if not row:
        raise ValueError("empty feature table")
    return int(row[0]["n"])
