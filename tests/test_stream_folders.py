"""Streams over tables stored as one file or as a folder of files give the same rows."""

import pytest
from pyspark.sql import functions as F

from pairbayes.plans.io_queries import emb_stream_counts, emb_stream_scores, events_stream_vote


@pytest.mark.parametrize("query,name", [(emb_stream_counts, "embeddings"), (emb_stream_scores, "embeddings"), (events_stream_vote, "events")])
def test_table_in_a_folder(spark, tmp_path, query, name):
    if name == "embeddings":
        rows = spark.range(24).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    else:
        rows = spark.range(24).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 5 AS user_id", "concat('t', id % 2) AS event_type", "1D AS value", "'' AS props")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / f"{name}.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / f"{name}.parquet").write_bytes(next((tmp_path / "made").glob("part-*")).read_bytes())
    folder, file = ({tuple(r) for r in query(spark, str(tmp_path / kind)).collect()} for kind in ("many", "one"))
    assert folder and folder == file
