"""Column-expression helpers (JVM-side built-ins only; no Python UDFs)."""

from pairbayes.functions.columns import *  # noqa: F401,F403
