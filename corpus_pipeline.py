"""A training-data pipeline over ``documents``: five stages, each written and read again.

Every stage works on all rows that the one before it kept.  All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.llm import curve_pack, hyperminhash, mixing, pii_crf, quality
from pairbayes.llm.common import stash
from pairbayes.llm.queries import remainder
from pairbayes.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays unless its quality score is below this.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    docs = docs.select(*COLUMNS)
    net = quality.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return quality.classify(docs, net).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, similarity 0.8);
    rows with the same id and text are one document."""
    docs = docs.select(*COLUMNS)
    found = hyperminhash.near_duplicates(docs, shingle=5, percent=80)
    stay = found.where("kept").select("id", "text_hash").distinct()
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["id"]) & (rows["_hash"] == stay["text_hash"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind's mark."""
    found = pii_crf.find(docs.select(*COLUMNS))
    return found.withColumns({"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: each run of words that a shard takes is a row, and
    the rows stand shard after shard, each in its own order."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixing.in_shard_order(mixing.mixed_rows(mixed, chars_col="n_chars")).select("record.*").select(*COLUMNS)


def pack_neighbours(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack everything into sequences of 2048 ids along the curve."""
    import public_tokenizers

    pieces = curve_pack.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("packing", pack_neighbours)]

#: The stages hold a trained network, registers and token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
