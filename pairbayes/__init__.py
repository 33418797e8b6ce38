"""pairbayes — pairwise-histogram Bayesian classification and table analytics on Spark.

Everything is DataFrame in, DataFrame out.  Only scalars that are bounded by the
schema (feature count, class count, bin edges) ever reach the driver.
"""

from pairbayes.session import get_spark, ensure_checkpoint_dir, table

__all__ = ["get_spark", "ensure_checkpoint_dir", "table"]
