"""Helpers shared by the operators: words, 64-bit mixing, written tables, input sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbayes.session import ensure_checkpoint_dir

#: Characters that part words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, in a compressed columnar form, and a
    lost executor costs no recomputation.  The cluster owns that folder and
    its clean-up."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_stats(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts, from one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_array(col: Column) -> Column:
    """Words of a text as an array (JVM side); null and blank texts give an empty array."""
    return F.array_remove(F.split(F.trim(F.coalesce(col, F.lit("")), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+"), "")


def word_count(col: Column) -> Column:
    return F.size(word_array(col)).cast("long")


def crc_of_id(col: Column) -> Column:
    """crc32 of the id written as text; null ids have none."""
    return F.crc32(col.cast("string").cast("binary"))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lower-cased (``bytes`` methods know ASCII only)."""
    return text.lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows; at the end of the task its memory is given back."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    give_back()


def give_back() -> None:
    """Return memory that is no longer used: Python workers live on for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def pieces_of(n_bytes: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Cut consecutive rows into runs of about ``limit`` bytes (at least one row each)."""
    out, start, total = [], 0, 0
    for i, b in enumerate(n_bytes.tolist()):
        if total and total + b > limit:
            out.append((start, i))
            start, total = i, 0
        total += b
    if start < len(n_bytes):
        out.append((start, len(n_bytes)))
    return out
