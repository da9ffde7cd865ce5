"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a 5-bit vector; mask v of 1..31 keeps the bits whose vector has odd overlap with v. Four bits
cannot span all five dimensions, so for any two fingerprints that differ in four bits or fewer some mask keeps none
of the differing bits, and the two meet in that mask's table. No pair within the radius is missed.

Copies meet first: only distinct fingerprints go to the tables. A bucket larger than LIMIT is dealt out again by masks
over the bits that its mask left free, which covers the radius just so; after three levels at most 2**LEAST_FREE
fingerprints can share a bucket. Inside buckets distances are compared exactly, and a bucket yields a star for each of
its linked groups rather than pairs.

Results for odd input: null texts and texts without words have the fingerprint zero and link like any other; texts of
fewer than four words hash as one sequence; a null doc_id never names a component unless all ids there are null;
repeated rows each have a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..operators.components import connected_components
from ..operators.durable import written
from .common import map_batches

WORDS, SEED, RADIUS = 4, 42, 4
TABLES = (1 << (RADIUS + 1)) - 1
LIMIT, LEAST_FREE = 2_048, 11


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the text's word shingles, A-Z lower-cased; bit j is set if over half the hashes set it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    first, last = starts[: 1 - WORDS].tolist(), (ends[WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), 65_536):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(first), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_py()) for t in batch.column("text")]
        fps = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fps], ["doc_id", "text_hash", "fp"])

    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id bigint, text_hash bigint, fp bigint")


@lru_cache(100_000)
def mask(path: int) -> int:
    """The bits that all fingerprints of a bucket share. path holds the level's mask numbers as digits to base 32."""
    above, v = divmod(path, 32)
    if not v:
        return 0
    base = mask(above)
    free = [i for i in range(64) if not base >> i & 1]
    # 13 k + 5 runs through all 5-bit vectors in an order whose every stretch is mixed
    return base | sum(1 << i for k, i in enumerate(free) if ((13 * k + 5) % 32 & v).bit_count() & 1)


def _deal(rows: DataFrame) -> DataFrame:
    """(path, key, fp): each row of (path, fp) in the tables below its path."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = batch.column("path").to_numpy()
        fps = batch.column("fp").to_numpy()
        out = []
        for path in np.unique(paths).tolist():
            own = fps[paths == path]
            for v in range(1, TABLES + 1):
                below = 32 * path + v
                out.append((np.full(len(own), below, np.int64), own & np.uint64(mask(below)).astype(np.int64), own))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["path", "key", "fp"])

    return map_batches(rows, run, "path bigint, key bigint, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as bitwise_count takes absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least one of its group, for groups linked within the radius."""
    near = distance(fps[:, None], fps[None, :]) <= RADIUS
    label = np.arange(len(fps), dtype=np.int32)
    while True:
        after = np.where(near, label[None, :], np.int32(len(fps))).min(axis=1)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (path, key, fp) with equal path and key in one stretch; yields edges (-1, a, b) or, for rows of a bucket
    beyond LIMIT, (path, fp, null). Holds one bucket's first LIMIT rows at most, besides the batch."""
    names = ["path", "a", "b"]

    def rows(path, a, b=None):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), path, np.int64)), pa.array(a), b], names)

    def close(bucket, held, spilled):
        fps = np.concatenate(held) if held else np.zeros(0, np.int64)
        if not spilled and len(fps) > 1:
            a, b = stars(fps)
            if len(a):
                yield rows(-1, a, b)

    current, held, spilled = None, [], False
    for batch in batches:
        path, key, fp = (batch.column(c).to_numpy() for c in ("path", "key", "fp"))
        cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1
        first, last = np.r_[0, cuts], np.r_[cuts, len(fp)]
        sizes = last - first
        # Buckets of two that lie inside the batch, all at once.
        inside = np.ones(len(first), bool)
        inside[[0, -1]] = False
        two = first[inside & (sizes == 2)]
        near = two[distance(fp[two], fp[two + 1]) <= RADIUS]
        if len(near):
            yield rows(-1, fp[near], fp[near + 1])
        for a, b in zip(first[~inside | (sizes > 2)].tolist(), last[~inside | (sizes > 2)].tolist(), strict=True):
            bucket = (path[a], key[a])
            if bucket != current:
                yield from close(current, held, spilled)
                current, held, spilled = bucket, [], False
            part = fp[a:b]
            if not spilled and sum(map(len, held)) + len(part) > LIMIT and 64 - mask(int(path[a])).bit_count() > LEAST_FREE:
                spilled = True
                for x in held:
                    yield rows(path[a], x)
                held = []
            if spilled:
                yield rows(path[a], part)
            else:
                held.append(part)
    yield from close(current, held, spilled)


def link(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of distinct (fp, without repeats) that links within the radius connect."""
    rows = distinct.select(F.lit(0).cast("bigint").alias("path"), "fp")
    edges = None
    while True:
        dealt = _deal(rows).repartition("path", "key").sortWithinPartitions("path", "key")
        found = written(dealt.mapInArrow(_link, "path bigint, a bigint, b bigint"), "links")
        own = found.filter("path = -1").select("a", "b")
        edges = own if edges is None else edges.union(own)
        rows = found.filter("path >= 0").select("path", F.col("a").alias("fp"))
        if rows.isEmpty():
            return edges


def components(rows: DataFrame) -> DataFrame:
    """rows of fingerprints(), which must be a written table, with component_id: the least doc_id of each group."""
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected_components(link(firsts.select("fp"))).withColumnRenamed("node", "fp")
    joined = written(firsts.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "roots")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(joined.join(least, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    rows = written(fingerprints(docs).select("doc_id", "fp"), "documents")
    out = components(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row, that of the least doc_id, stays whole.

    Rows are told apart by doc_id and text; of rows that agree in both, the one whose other columns hash least stays.
    """
    rows = written(fingerprints(docs), "documents")
    none, number = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    order = F.struct(none.alias("none"), number.alias("id"), F.col("text_hash").alias("hash"))
    chosen = components(rows).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    chosen = written(chosen.agg(F.min(order).alias("o")).select("o.*"), "chosen")
    doc_id = docs["doc_id"].cast("bigint")
    names = [f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    full = docs.select(
        F.struct(*(docs[f"`{n}`"] for n in docs.columns)).alias("row"),
        doc_id.isNull().alias("none"),
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.xxhash64(docs["text"].cast("string")).alias("hash"),
        F.xxhash64(*(docs[n] for n in names)).alias("rest"),
    )
    # joined and grouped by the same keys, so texts are shuffled once
    key = ["none", "id", "hash"]
    return full.join(chosen, key).groupBy(*key).agg(F.min_by("row", "rest").alias("row")).select("row.*")
