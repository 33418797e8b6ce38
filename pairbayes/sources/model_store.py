"""Model save/load (S15) and encoder tables.

A model is a folder of parquet tables plus a one-line JSON manifest, all
written through Spark (so it works on any shared file system or object
store).  Each save goes to a fresh version folder; the ``_LATEST`` pointer is
written last, and never overwritten, so readers never see a half-written model."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.operators.binning import BinSpec
from pairbayes.operators.likelihood import HistogramModel

FORMAT_VERSION = 2


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).collect()
    if not rows:
        raise FileNotFoundError(path)
    return rows[0]["value"]


def save_model(model: HistogramModel, base: str, feature_names=None, encoders: DataFrame | None = None,
               stats: dict[str, tuple[float, float]] | None = None, options: dict | None = None) -> str:
    """Write one version: counts, weights, encoders and a manifest with bins, pairs,
    classes, overlap flag, scaler statistics (column -> mean, std) and options."""
    spark = model.counts.sparkSession
    version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    path = f"{base.rstrip('/')}/{version}"
    manifest = {
        "format_version": FORMAT_VERSION,
        "n_bins": model.spec.n_bins,
        "lo": list(model.spec.lo),
        "width": list(model.spec.width),
        "n_features": model.n_features,
        "pairs": None if model.pairs is None else [list(p) for p in model.pairs],
        "classes": list(model.classes),
        "class_counts": list(model.class_counts),
        "w0": model.w0,
        "eps": model.eps,
        "lr": model.lr,
        "overlap_mask": model.overlap_mask,
        "stats": {k: [float(m), float(s)] for k, (m, s) in (stats or {}).items()},
        "options": options or {},
        "feature_names": list(feature_names) if feature_names else None,
        "has_weights": model.weights is not None,
        "has_encoders": encoders is not None,
    }
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    if model.weights is not None:
        model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    if encoders is not None:
        encoders.write.mode("overwrite").parquet(f"{path}/encoders")
    _write_text(spark, f"{path}/manifest", json.dumps(manifest))
    # pointers are only ever added; the latest is the one with the largest name
    _write_text(spark, f"{base.rstrip('/')}/_LATEST/{version}", version)
    return path


def stored_measure(spark: SparkSession, base: str) -> float | None:
    """The ``measure`` that the latest version was saved with; None where nothing is stored yet."""
    try:
        return load_model(spark, base)[1]["options"].get("measure")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_model(spark: SparkSession, base: str) -> tuple[HistogramModel, dict, DataFrame | None]:
    """Read the latest version; every component named in the manifest must
    exist (a missing one raises), and the format version must be >= 2."""
    version = max(r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(f"{base.rstrip('/')}/_LATEST").collect())
    path = f"{base.rstrip('/')}/{version}"
    m = json.loads(_read_text(spark, f"{path}/manifest"))
    if int(m.get("format_version", 0)) < 2:
        raise ValueError("model format version < 2")
    counts = spark.read.parquet(f"{path}/counts")
    weights = spark.read.parquet(f"{path}/weights") if m["has_weights"] else None
    enc = spark.read.parquet(f"{path}/encoders") if m["has_encoders"] else None
    spec = BinSpec(tuple(m["lo"]), tuple(m["width"]), int(m["n_bins"]))
    pairs = None if m["pairs"] is None else tuple(tuple(p) for p in m["pairs"])
    model = HistogramModel(spec, pairs, int(m["n_features"]), tuple(m["classes"]), tuple(m["class_counts"]),
                           counts, weights, float(m["w0"]), float(m["eps"]), float(m["lr"]),
                           bool(m.get("overlap_mask", False)))
    return model, m, enc


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    from pairbayes.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/pairbayes-{name}-{uuid.uuid4().hex[:10]}"
