"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII controls that separate words; bytes.split() splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, folds: int) -> Column:
    """True where crc32 of the id as text leaves remainder 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == 1, F.lit(False))


@lru_cache(1)
def steady() -> None:
    """Has this process give large arrays back to the system when they are freed; its allocators keep them in pieces else.

    Workers call it, as several kinds of them follow each other in one process.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies fn to every Arrow batch, SLICE rows at a time; nothing is kept between slices."""
    return df.mapInArrow(lambda batches: map(fn, slices(batches)), schema)


#: Rows whose texts a worker holds as Python objects at once.
SLICE = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steady()
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def pieces_of(texts: list, budget: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about budget characters each, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text or "") > budget:
            yield start, i
            start, total = i, 0
        total += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def hash_sample(df: DataFrame, key: str, n: int, per: str | None = None, seed: int = 7) -> DataFrame:
    """The n rows (of each value of per) whose salted hash of key is least: a bounded uniform sample that reruns repeat.

    Ranks only what df selects, so pass ids here and join wide columns afterwards.
    """
    from pyspark.sql import Window

    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    if per is None:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
