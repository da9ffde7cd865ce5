"""Mixing sources to target weights by a splitting tree.

A hash deals the documents of a source into blocks of about block_words words. A source's quota is the number of blocks
that its target needs: as many whole passes over its blocks as fit, then the first blocks of a permuted order up to the
target. The tree halves the set of output shards again and again; at each node a multivariate hypergeometric draw
decides how many blocks of each source go left, so every shard gets a random composition and all quotas are met
exactly. A leaf owns a stretch of each source's draws, disjoint from the others'; a seeded Feistel permutation, one for
each source and pass, turns draws into block numbers. A document is taken once for every leaf that drew its block. In
the last block drawn of a source, only as many documents are taken as bring its words near the target. Shards order their documents
by a hash.

Every choice follows from hashes of the seed, so reruns and retries agree. The driver holds one row for each source and
the upper FRONTIER nodes of the tree; executors grow the rest, and draws meet documents in a join on block numbers.

Results for odd input: a null text has size 0; documents of size 0 are never taken; a null source is a source of its
own, the last; rows that repeat an id and a text are taken or left together; columns of any name are carried along; an
empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import written
from .common import WORD

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS, SHARD_WORDS = 4_096, 1_000_000
#: Nodes of the tree that the driver expands before executors go on.
FRONTIER = 256
#: Blocks grow beyond this number in all, which the hypergeometric draw can still take.
MOST_BLOCKS = 1 << 28
#: Sources whose table, some numbers for each, is broadcast.
MOST_BROADCAST = 10_000
#: Slots of a source whose words are added up together on the way to its quota.
BIN = 4_096


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Words to take of each source: shares of all words by weight, none above cap times its source's words.

    The sources that reach their cap are those with the least cap * size / weight; what they leave is shared by weight.
    """
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    for k, i in enumerate(order):
        if cap * sizes[i] * weight >= weights[i] * left:
            for j in order[k:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = float(cap * sizes[i])
        left -= cap * sizes[i]
        weight -= weights[i]
    return out


def permuted(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of range(n) that key selects, at x; or its inverse. A Feistel network that walks back into range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    rounds = np.random.default_rng([key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]).integers(0, 2**63, 6, np.uint64)

    def mixed(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v + k) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return v >> np.uint64(32) & low

    def step(v: np.ndarray) -> np.ndarray:
        a, b = v >> half, v & low
        for k in rounds[::-1] if inverse else rounds:
            a, b = (b ^ mixed(a, k), a) if inverse else (b, a ^ mixed(b, k))
        return a << half | b

    out = step(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = step(out[far])
    return out.astype(np.int64)


Node = tuple[int, int, np.ndarray, np.ndarray]  # first shard, last shard + 1, blocks of each source, their first draws


def halves(node: Node, seed: int) -> tuple[Node, Node]:
    """The two children: blocks go left by a multivariate hypergeometric draw, in number by the share of the shards."""
    first, last, has, low = node
    middle = (first + last) // 2
    blocks = int(has.sum())
    goes = round(Fraction(blocks * (middle - first), last - first))
    left = has.copy()
    if blocks:
        left[:] = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(has, goes, method="marginals")
    return (first, middle, left, low), (middle, last, has - left, low + left)


def leaves(node: Node, seed: int) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            stack.extend(halves(node, seed)[::-1])


def frontier(quotas: list[int], shards: int, seed: int, nodes: int = FRONTIER) -> list[Node]:
    """The widest nodes of the tree over all shards, about so many of them."""
    out = [(0, shards, np.array(quotas, np.int64), np.zeros(len(quotas), np.int64))]
    while len(out) < nodes and any(n[1] - n[0] > 1 for n in out):
        out = [c for n in out for c in (halves(n, seed) if n[1] - n[0] > 1 else (n,))]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard: rows are shards; columns sum to the quotas, rows are equal within one."""
    return np.array([leaf[2] for node in frontier(quotas, shards, seed, 1) for leaf in leaves(node, seed)]).reshape(shards, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(s, key, size, more) of every row: its source under a name that is never null, its random order, its words."""
    source, text = docs["source"].cast("string"), docs["text"].cast("string")
    s = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))
    return docs.select(s.alias("s"), F.xxhash64(F.lit(seed), docs["doc_id"], source, text).alias("key"), word_count(text).alias("size"), *more)


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of sources and their block; rows of size 0 have negative blocks, which nothing draws."""
    block = F.when(F.col("size") > 0, F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(-1 - F.pmod("key", F.lit(1 << 20)))
    return rows.join(sources, "s").withColumn("block", block)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of some rows of numbers, broadcast where that is sure to be small."""
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def _fit(inside):
    """Of a source's last block, in random order, every document that fits; at the end one more, if nearer to the target."""
    inside = inside.sort_values("key")
    left, taken, over = float(inside["room"].iloc[0]), [], []
    for key, size in zip(inside["key"], inside["size"], strict=True):
        if size <= left:
            taken.append(key)
            left -= size
        else:
            over.append((size, key))
    if over and min(over)[0] < 2 * left:
        taken.append(min(over)[1])
    return inside[["s"]].head(1).assign(cut=[taken])


def _draws(rows: DataFrame, shards: int | None, block_words: int, weights: tuple, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(s, blocks, source_size, target) of every source, and (s, block, draws) of every block that a leaf drew.

    draws: an array of (pass, shard, part, cut); with part, only documents whose key is in cut are taken.
    """
    spark = rows.sparkSession
    found = rows.groupBy("s").agg(F.sum("size").alias("words")).collect()
    found = sorted(((r["s"], r["words"]) for r in found), key=lambda r: (r[0] == "", r[0]))  # code points, null last
    sizes = [n for _, n in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap)
    block_words = max(block_words, ceil(sum(sizes) / MOST_BLOCKS))
    blocks = [max(1, round(n / block_words)) for n in sizes]
    full = [int(t // n) if n else 0 for t, n in zip(wanted, sizes, strict=True)]
    rest = [t - f * n for t, f, n in zip(wanted, full, sizes, strict=True)]
    schema = "s string, blocks bigint, source_size bigint, target double, pass int, rest double"
    sources = spark.createDataFrame([(s, b, n, t, f, r) for (s, n), b, t, f, r in zip(found, blocks, wanted, full, rest, strict=True)], schema)
    sources = _small(sources, len(found))

    @F.pandas_udf("bigint")
    def slot(name, block, blocks):
        out = np.zeros(len(block), np.int64)
        for k in name.unique():
            own = (name == k).to_numpy()
            out[own] = permuted(block[own].to_numpy(), int(blocks[own].iloc[0]), int(k))
        return name.__class__(out)

    def name(pass_: Column) -> Column:
        """The key of a source's permutation in a pass."""
        return F.xxhash64(F.lit(seed), F.col("s"), pass_)

    # The last pass goes on in the permuted order up to the target: first to the right bin, then to the right slot.
    words = _in_blocks(rows.filter("size > 0"), _small(sources.filter("rest > 0"), len(found))).groupBy("s", "block", "blocks", "rest", "pass").agg(F.sum("size").alias("words"))
    words = written(words.withColumn("slot", slot(name(F.col("pass")), "block", "blocks")).withColumn("bin", F.floor(F.col("slot") / BIN)), "blocks")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = words.groupBy("s", "bin").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("base", before)
    bins = bins.filter("base < rest and rest <= base + words").select("s", "bin", "base")
    inner = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = words.join(bins, ["s", "bin"]).withColumn("start", F.col("base") + inner).filter("start < rest")
    last = slots.groupBy("s").agg(F.max(F.struct("slot", "block", (F.col("rest") - F.col("start")).alias("room"))).alias("x")).select("s", "x.*").collect()
    last = {r["s"]: r for r in last}
    # The last block of each source, document by document: block_words words or about that.
    edge = _small(spark.createDataFrame([(s, r["block"], r["room"]) for s, r in last.items()], "s string, block bigint, room double"), len(last))
    inside = _in_blocks(rows, sources).join(edge, ["s", "block"]).groupBy("s", "key", "room").agg(F.sum("size").alias("size"))
    fitted = inside.groupBy("s").applyInPandas(_fit, "s string, cut array<bigint>").collect()
    cuts = {r["s"]: r["cut"] for r in fitted}

    quotas = [f * b + (last[s]["slot"] + 1 if s in last else 0) for (s, _), f, b in zip(found, full, blocks, strict=True)]
    shards = shards or max(1, ceil(sum(sizes) / SHARD_WORDS))
    nodes = [(a, b, has.tolist(), low.tolist()) for a, b, has, low in frontier(quotas, shards, seed)] if found else []

    def grow(batches):
        for batch in batches:
            for r in batch.to_pylist():
                node = (r["first"], r["last"], np.array(r["has"], np.int64), np.array(r["low"], np.int64))
                for shard, _, has, low in leaves(node, seed):
                    who = np.repeat(np.arange(len(has)), has)
                    draw = np.arange(len(who)) - np.repeat(np.cumsum(has) - has, has) + low[who]
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(draw), pa.array(np.full(len(who), shard, np.int64))], ["i", "draw", "shard"])

    tree = spark.createDataFrame(nodes, "first bigint, last bigint, has array<bigint>, low array<bigint>")
    tree = tree.repartition(max(1, min(len(nodes), 64))).mapInArrow(grow, "i bigint, draw bigint, shard bigint")
    ends = [(i, s, b, f, last[s]["slot"] if s in last else -1, cuts.get(s)) for i, ((s, _), b, f) in enumerate(zip(found, blocks, full, strict=True))]
    ends = _small(spark.createDataFrame(ends, "i bigint, s string, blocks bigint, full int, slot bigint, cut array<bigint>"), len(ends))

    @F.pandas_udf("bigint")
    def block_of(name, slot, blocks):
        out = np.zeros(len(slot), np.int64)
        for k in name.unique():
            own = (name == k).to_numpy()
            out[own] = permuted(slot[own].to_numpy(), int(blocks[own].iloc[0]), int(k), inverse=True)
        return name.__class__(out)

    drawn = tree.join(ends, "i").withColumn("pass", F.floor(F.col("draw") / F.col("blocks")).cast("int")).withColumn("at", F.pmod("draw", F.col("blocks")))
    drawn = drawn.withColumn("part", (F.col("pass") == F.col("full")) & (F.col("at") == F.col("slot")))
    drawn = drawn.withColumn("block", block_of(name(F.col("pass")), "at", "blocks"))
    one = F.struct("pass", "shard", "part", F.when(F.col("part"), F.col("cut")).alias("cut"))
    drawn = drawn.groupBy("s", "block").agg(F.array_sort(F.collect_list(one)).alias("draws"))  # cap entries at most
    return _small(sources.drop("pass", "rest"), len(found)), written(drawn, "draws")


def _taken(rows: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """rows with what their source has, and the draws that took them."""
    met = _in_blocks(rows, sources).join(draws, ["s", "block"], "left")
    fits = F.filter("draws", lambda d: ~d["part"] | F.coalesce(F.array_contains(d["cut"], F.col("key")), F.lit(False)))
    none = F.array().cast("array<struct<pass: int, shard: bigint, part: boolean, cut: array<bigint>>>")
    return met.withColumn("draws", F.coalesce(fits, none))


def plan(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) of every row of docs.

    taken is size times the number of shards listed: those of the leaves that drew the document's block. A source's
    taken words miss its target by half of a document that was left at most. Without a number there is a shard for every SHARD_WORDS
    words of the mix.
    """
    rows = written(_keyed(docs, seed, docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source")), "sizes")
    out = _taken(rows, *_draws(rows, shards, block_words, weights, cap, seed))
    out = out.withColumn("shards", F.col("draws.shard"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix_documents(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """The mixed rows of docs, repeats included, with docs' columns: each shard whole in one partition, shuffled inside."""
    rows = written(_keyed(docs, seed), "sizes")
    sources, draws = _draws(rows, shards, block_words, weights, cap, seed)
    row = F.struct(*(docs[f"`{n}`"] for n in docs.columns)).alias("row")
    full = _taken(_keyed(docs, seed, row), sources, draws).select("row", "key", F.explode("draws").alias("draw"))
    full = full.select("row", F.col("draw.shard").alias("shard"), F.xxhash64(F.lit(seed), "key", "draw.pass").alias("order"))
    return full.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")
