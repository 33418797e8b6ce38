"""Run configuration (S18, S19): comment-tolerant JSON, defaults merged
top-level only (a nested section given by the user replaces the default
section whole)."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field

# Fixed defaults of the classifier configuration.
DEFAULTS = {
    "separator": ",",
    "has_header": True,
    "modelType": "Histogram",
    "likelihood_config": {"feature_group_size": 2, "max_combinations": 90000000, "bin_sizes": [128]},
    "active_learning": {"similarity_threshold": 0.25, "min_divergence": 0.1, "max_class_addition_percent": 99,
                        "strong_margin_threshold": 0.01, "marginal_margin_threshold": 0.01},
    "training_params": {"learning_rate": 0.1, "epochs": 1000, "test_fraction": 0.2, "random_seed": 42,
                        "cardinality_threshold": 0.9, "cardinality_tolerance": 8, "trials": 100},
    "anomaly_detection": {"posterior_threshold": 0.01, "missing_value_penalty": 0.1},
    "execution_flags": {"train": True, "predict": True},
}


def strip_comments(text: str) -> str:
    """Remove ``// ...`` line comments, ``/* ... */`` blocks and lines whose
    key starts with ``_comment``; strings are left intact."""
    out, i, n, in_str = [], 0, len(text), False
    while i < n:
        ch = text[i]
        if in_str:
            out.append(ch)
            if ch == "\\" and i + 1 < n:
                out.append(text[i + 1])
                i += 2
                continue
            if ch == '"':
                in_str = False
            i += 1
            continue
        if ch == '"':
            in_str = True
            out.append(ch)
            i += 1
        elif text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = n if j < 0 else j + 2
        else:
            out.append(ch)
            i += 1
    lines = [ln for ln in "".join(out).splitlines() if not re.match(r'\s*"_comment', ln)]
    cleaned = "\n".join(lines)
    return re.sub(r",(\s*[}\]])", r"\1", cleaned)


def load_config(text: str) -> dict:
    user = json.loads(strip_comments(text))
    cfg = copy.deepcopy(DEFAULTS)
    cfg.update(user)  # top-level merge: nested sections are replaced whole
    return cfg


def clean_config(cfg: dict) -> dict:
    """Drop top-level likelihood keys when a likelihood_config exists."""
    out = dict(cfg)
    if "likelihood_config" in out:
        for k in ("feature_group_size", "max_combinations", "bin_sizes"):
            out.pop(k, None)
    return out


@dataclass(frozen=True)
class LearnerConfig:
    n_bins: int = 128
    max_combinations: int | None = None
    learning_rate: float = 0.1
    epochs: int = 1000
    similarity_threshold: float = 0.25
    min_divergence: float = 0.1
    test_fraction: float = 0.2
    seed: int = 42
    model_type: str = "Histogram"
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(cfg: dict) -> "LearnerConfig":
        lc = cfg.get("likelihood_config", {})
        al = cfg.get("active_learning", {})
        tp = cfg.get("training_params", {})
        bins = lc.get("bin_sizes", [128])
        return LearnerConfig(
            n_bins=int(bins[0] if len(bins) == 1 else max(bins)),
            max_combinations=lc.get("max_combinations"),
            learning_rate=float(tp.get("learning_rate", 0.1)),
            epochs=int(tp.get("epochs", 1000)),
            similarity_threshold=float(al.get("similarity_threshold", 0.25)),
            min_divergence=float(al.get("min_divergence", 0.1)),
            test_fraction=float(tp.get("test_fraction", 0.2)),
            seed=int(tp.get("random_seed", 42)),
            model_type=str(cfg.get("modelType", "Histogram")),
            extra=cfg,
        )
