"""Language-model scoring by a weighted backoff automaton.

The states of the automaton are the root and the contexts of one to ORDER - 1 words that training texts go on from, a
text's start being a word too. A state's arcs are the words that followed it in training, with the log probability of a
Dirichlet-smoothed n-gram, and lead to the longest suffix of context and word that is a state. Every state but the root
has a failure arc, of weight log10(mu / (c + mu)), to its suffix without the first word; the root's arcs are add-a-half
unigrams with one class for unknown words, so that each state's probabilities sum to one. A text is read once from left
to right: at each word the state fails until it has the arc, takes it, and adds up the weights on the way.

Counts come from all training texts, whatever their number. No machine holds the whole model:

1. Texts become blocks of word numbers with each block's own list of distinct words (a written table).
2. Each block sends its distinct n-grams with its own training counts to the reducer that owns their hash range: words
   and word pairs as sorted hashes, longer ones as a trie below the pairs. A hot n-gram is one entry of a block at most,
   so ranges stay even.
3. A reducer adds up the counts and answers every block with the totals of just what it sent.
4. A block builds its slice of the automaton from the answers, and many readers traverse it at once, each a stretch of
   the block's texts, from ORDER - 1 words before the stretch, which bring a reader into the right state.

Words and pairs are told apart by 64-bit hashes, longer n-grams by their pair and 32 bits of each further word.

Results for odd input: null and empty texts are the end token alone; with no training text every word is unknown and
the one class has probability one; repeated rows score, and count, each; a null doc_id is in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import written
from .common import steady

#: Smoothing of words after one word, after two, and so on; one more than their number is the order.
MU = (300.0, 10.0)
#: Tokens of a block, and hashes of one order that a reducer holds, about; and readers of a block at once.
BLOCK_TOKENS, REDUCER_KEYS, READERS = 1_500_000, 1_000_000, 4_096
_32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(values: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers together, then all second ones, and so on."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending hashes: their number, the first one, then the steps between them, their widest bytes compressed."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = steps.view(np.uint8).reshape(-1, 8)
    head = np.array([width, len(keys)], np.uint32).tobytes() + keys[:1].tobytes()
    return head + np.ascontiguousarray(planes[:, : width - 1]).tobytes() + _pack(planes[:, width - 1])


def _unpack_sorted(raw: bytes) -> np.ndarray:
    width, n = np.frombuffer(raw[:8], np.uint32).tolist()
    if not n:
        return np.zeros(0, np.uint64)
    planes, end = np.zeros((n - 1, 8), np.uint8), 16 + (n - 1) * (width - 1)
    planes[:, : width - 1] = np.frombuffer(raw[16:end], np.uint8).reshape(n - 1, width - 1)
    planes[:, width - 1] = _unpack(raw[end:], np.uint8)
    return np.cumsum(np.r_[np.frombuffer(raw[8:16], np.uint64), planes.view(np.uint64).reshape(-1)], dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their beginnings and last words."""
    with np.errstate(over="ignore"):
        x = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: ids, training flags, token counts, word numbers and the hashes of the words."""
    steady()
    task, number = TaskContext.get().partitionId(), 0

    def empty():
        return {}, [], [], [], []

    def block(words, ids, train, sizes, tokens):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        flat = np.concatenate(tokens)
        columns = [
            pa.array([f"{task}-{number}"]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([train], pa.list_(pa.bool_())),
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([_pack(flat)], pa.binary()),
            pa.array([hashes.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "train", "sizes", "tokens", "hashes"])

    words, ids, train, sizes, tokens = empty()
    held = 0
    for batch in batches:
        for i, t, text in zip(*(batch.column(c) for c in ("doc_id", "train", "text")), strict=True):
            found = (text.as_py() or b"").lower().split()
            for w in set(found).difference(words):
                words[w] = len(words)
            ids.append(i.as_py())
            train.append(t.as_py())
            sizes.append(len(found))
            tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            held += len(found) + 1
            if held >= BLOCK_TOKENS:
                yield block(words, ids, train, sizes, tokens)
                words, ids, train, sizes, tokens = empty()
                number, held = number + 1, 0
    if ids:
        yield block(words, ids, train, sizes, tokens)


class Block:
    """A block's tokens, with the start before and the end after each text, and its distinct n-grams of each order."""

    def __init__(self, row: dict, order: int) -> None:
        self.ids, self.train, self.order = row["ids"], np.array(row["train"], bool), order
        self.sizes = np.array(row["sizes"], np.int64) + 2
        words = np.r_[np.frombuffer(row["hashes"], np.uint64), END, START]
        token = _unpack(row["tokens"], np.int32)
        stop = np.cumsum(self.sizes)
        self.first = stop - self.sizes
        word = np.empty(int(stop[-1]), np.int32)
        edge = np.zeros(len(word), bool)
        edge[stop - 1] = edge[self.first] = True
        word[~edge] = token
        word[stop - 1], word[self.first] = len(words) - 2, len(words) - 1
        order_ = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[order_] = np.arange(len(words), dtype=np.int32)
        self.words, self.word = words[order_], rank[word]
        self.place = (np.arange(len(word)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        self.learned = np.repeat(self.train, self.sizes)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the distinct n-grams, ascending, and the number of the one that ends at each token, or -1.

        Words and pairs are hashes; a longer n-gram is the number of what stands before its last word, and 32 bits of
        that word's hash.
        """
        yield self.words, self.word
        last, number = self.words[self.word], self.word
        for k in range(1, self.order):
            at = np.flatnonzero(self.place >= k)
            keys = _mix(last[at - 1], last[at]) if k == 1 else number[at - 1].astype(np.uint64) << _32 | last[at] & _LOW
            distinct, inverse = np.unique(keys, return_inverse=True)
            number = np.full(len(last), -1, np.int32)
            number[at] = inverse
            yield distinct, number

    def counts(self, distinct: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Training counts of the n-grams of one order."""
        return np.bincount(number[self.learned & (number >= 0)], minlength=len(distinct))


def _ranges(keys: np.ndarray, reducers: int) -> np.ndarray:
    """Where each reducer's range of hashes begins in keys, and the end of keys."""
    edges = np.array([(r << 64) // reducers for r in range(1, reducers)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _sender(reducers: int, order: int):
    names = ["reducer", "n", "block", "keys", "counts"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, order)
                parents = None
                for n, (keys, number) in enumerate(block.grams(), 1):
                    counts, out = block.counts(keys, number).astype(np.uint32), []
                    # a reducer that owns a pair owns all longer n-grams that begin with it
                    cuts = _ranges(keys, reducers) if n < 3 else np.searchsorted(keys, parents.astype(np.uint64) << _32)
                    children = np.bincount((keys >> _32).astype(np.int64), minlength=int(parents[-1])).astype(np.uint32) if n > 2 else None
                    for r in range(reducers):
                        a, b = cuts[r], cuts[r + 1]
                        if n < 3:
                            sent = _pack_sorted(keys[a:b])
                        else:
                            below = _pack(children[parents[r] : parents[r + 1]])
                            sent = np.uint32(len(below)).tobytes() + below + (keys[a:b] & _LOW).astype(np.uint32).tobytes()
                        if a < b:
                            out.append((r, n, row["block"], sent, _pack(counts[a:b])))
                    parents = cuts
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _reduce(sent: pa.Table) -> pa.Table:
    """Totals for each block of what it sent, and (without a block) the training tokens and distinct words seen here."""
    steady()
    out = []
    reducer = sent.column("reducer")[0].as_py()
    orders = sent.column("n").to_numpy()
    above: dict[str, np.ndarray] = {}  # by block, the numbers of its n-grams of the order before
    for n in np.unique(orders).tolist():
        rows = sent.take(np.flatnonzero(orders == n)).select(["block", "keys", "counts"]).to_pylist()
        if n < 3:
            keys = [_unpack_sorted(r["keys"]) for r in rows]
        else:
            keys = []
            for r in rows:
                size = 4 + int(np.frombuffer(r["keys"][:4], np.uint32)[0])
                before = np.repeat(above[r["block"]], _unpack(r["keys"][4:size], np.uint32))
                keys.append(before.astype(np.uint64) << _32 | np.frombuffer(r["keys"][size:], np.uint32))
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]), len(distinct)).astype(np.int64)
        stop, above = np.cumsum([len(k) for k in keys]), {}
        for r, own in zip(rows, np.split(inverse, stop[:-1]), strict=True):
            above[r["block"]] = own
            out.append((reducer, n, r["block"], _pack(total[own]), 0, 0))
        if n == 1:
            real = total[distinct != START]
            out.append((reducer, 0, "", b"", int(real.sum()), int((real > 0).sum())))
    names = ["reducer", "n", "block", "totals", "tokens", "distinct"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


class Automaton:
    """The slice of the automaton that a block needs.

    A state is a context of some order that ends at a token; its number is that order and that token. For the arc of
    each order into each token: whether training has it, its weight, and the weight of failing there; and, for each
    order, whether the n-gram that ends at a token is a state. All logarithms are to base 10.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], tokens: int, distinct: int, mu: tuple[float, ...]) -> None:
        """totals: training counts of the distinct n-grams of each order, in the block's numbering."""
        n = len(block.word)
        self.place = block.place
        self.has_arc, self.is_state = np.zeros((block.order, n), bool), np.zeros((block.order, n), bool)
        self.arc, self.fail = np.zeros((block.order, n)), np.zeros((block.order, n))
        before = probability = None
        for k, (_, number) in enumerate(block.grams()):
            seen = np.where(number >= 0, totals[k][number], 0)
            if k == 0:
                probability = (seen + 0.5) / (tokens + 0.5 * (distinct + 1))
                self.known = seen > 0
                self.has_arc[0] = True  # the root has an arc for every word
                self.arc[0] = np.log10(probability)
            else:
                context = np.r_[0, before[:-1]]
                self.has_arc[k] = seen > 0
                probability = np.where(seen > 0, (seen + mu[k - 1] * probability) / (context + mu[k - 1]), probability)
                np.log10(probability, out=self.arc[k])
                np.log10(mu[k - 1] / (context + mu[k - 1]), out=self.fail[k])
            if k + 1 < block.order:
                self.is_state[k + 1] = seen > 0
            before = seen

    def run(self, readers: int = READERS) -> np.ndarray:
        """The weight of every token; start tokens weigh 0 and put a reader into the state of a text's beginning."""
        n, top = len(self.place), len(self.arc) - 1
        weight = np.zeros(n)
        stretch = max(1, ceil(n / readers))
        begin = np.arange(0, n, stretch)
        state = np.zeros(len(begin), np.int64)  # the order of the context that ends before the next token
        for step in range(-top, stretch):
            at = begin + step
            who = np.flatnonzero((at >= 0) & (at < n))
            at, now = at[who], state[who]
            total = np.zeros(len(at))
            for k in range(top, 0, -1):
                stuck = np.flatnonzero((now == k) & ~self.has_arc[k, at])
                total[stuck] += self.fail[k, at[stuck]]
                now[stuck] = k - 1
            total += self.arc[now, at]
            now = np.minimum(now + 1, top)
            new = self.place[at] == 0
            now[new] = min(1, top)
            total[new] = 0
            for k in range(top, 0, -1):
                now[(now == k) & ~self.is_state[k, at]] = k - 1
            state[who] = now
            if step >= 0:
                weight[at] = total
        return weight


_COLUMNS = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
_EMPTY = pa.schema([(n, pa.float64() if "score" in n else pa.int64()) for n in _COLUMNS]).empty_table()


def _scorer(tokens: int, distinct: int, mu: tuple[float, ...]):
    order = len(mu) + 1

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        steady()
        out = []
        for row in blocks.to_pylist():
            block = Block(row, order)
            totals: list[list[np.ndarray]] = [[] for _ in range(order)]
            for r in sorted(answers.select(["reducer", "n", "totals"]).to_pylist(), key=lambda r: r["reducer"]):
                totals[r["n"] - 1].append(_unpack(r["totals"], np.int64))
            automaton = Automaton(block, [np.concatenate(t) if t else np.zeros(1, np.int64) for t in totals], tokens, distinct, mu)
            token = block.place > 0
            columns = [
                pa.array(block.ids, pa.int64()),
                pa.array(block.sizes - 1),
                pa.array(np.add.reduceat((automaton.known & token).astype(np.int64), block.first)),
                pa.array(np.full(len(block.first), tokens, np.int64)),
                pa.array(np.add.reduceat(np.where(token, automaton.arc[0], 0.0), block.first), pa.float64()),
                pa.array(np.add.reduceat(automaton.run(), block.first), pa.float64()),
            ]
            out.append(pa.Table.from_arrays(columns, list(_COLUMNS)))
        return pa.concat_tables(out) if out else _EMPTY

    return run


def score_documents(docs: DataFrame, training: Column, mu: tuple[float, ...] = MU) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; training is a Column of docs.

    mu holds one number for each length of context, so n-grams have up to one word more than it has numbers.
    """
    text = docs["text"].cast("string").cast("binary")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), training.alias("train"), text.alias("text"))
    schema = "block string, ids array<bigint>, train array<boolean>, sizes array<int>, tokens binary, hashes binary"
    blocks = written(rows.mapInArrow(_blocks, schema), "blocks")
    sizes = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).first()
    reducers = max(1, ceil((sizes["n"] or 0) / REDUCER_KEYS))
    sent = blocks.mapInArrow(_sender(reducers, len(mu) + 1), "reducer int, n int, block string, keys binary, counts binary")
    answers = "reducer int, n int, block string, totals binary, tokens bigint, distinct bigint"
    answers = written(sent.groupBy("reducer").applyInArrow(_reduce, answers), "answers")
    found = answers.filter("n = 0").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    own = answers.filter("n > 0").select("block", "reducer", "n", "totals")
    schema = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_scorer(found["n"] or 0, found["v"] or 0, mu), schema)
