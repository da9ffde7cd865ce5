"""SentencePiece BPE encoding and decoding by a table of last tokens.

For BPE the tokens of a text are valid exactly if each token encodes to itself and each two neighbours encode to
themselves when their strings are joined: merges at one boundary never depend on what stands beyond the neighbours.
So every prefix has one possible last token. The encoder walks the vocabulary's trie automaton from every position,
keeps for each prefix the match that is compatible with the last token of the prefix before it, and then reads the
ids backwards from the end.

A text is first cut where no vocabulary piece has the two characters side by side, which is before spaces, so no merge
can cross the cut. The units of many texts fill their tables together, column by column, in numpy; units are
remembered in a bounded cache.

Results for odd input: null and empty texts give only begin and end ids; characters outside the vocabulary become
byte pieces; a U+2581 in the text decodes to a space, as in the library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import map_batches, pieces_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and types of a sentencepiece model file."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        model_type, normalizer = 1, b""
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                normalizer = value
        spec = dict(_fields(normalizer))
        self.dummy_prefix = bool(spec.get(3, 1))
        if model_type != 2 or spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or {USER_DEFINED, UNUSED} & set(self.types):
            raise NotImplementedError("only BPE models with the identity normalizer and plain pieces are supported")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        if len(self.bytes) != 256:
            raise NotImplementedError("only models with byte fallback are supported")


class _Hashed:
    """Open-addressed map of non-negative 64-bit keys to int32 values, read by arrays of keys."""

    def __init__(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not there yet, each once."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old, kept = self.keys, self.values
            bits = self.bits + 1
            while 2 * (self.n + len(keys)) > 1 << bits:
                bits += 1
            self.__init__(bits)
            self.put(old[old >= 0], kept[old >= 0])
        self.n += len(keys)
        at, mask = self._home(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys  # of those that met in one slot, one stays
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at, mask = self._home(keys), len(self.keys) - 1
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        rest = np.flatnonzero(~hit & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Encoder:
    """Encodes and decodes; one per worker process."""

    #: Units longer than this go through the table one by one. Inside tables, a character without a piece is the token
    #: len(pieces) + its code point; it never merges.
    LONG = 160

    def __init__(self, raw: bytes, cache: int = 200_000) -> None:
        v = self.vocabulary = Vocabulary(raw)
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.types[i] == NORMAL}
        self.alone = np.array([v.types[i] == NORMAL and self._merge(p) == [p] for i, p in enumerate(v.pieces)])
        self.pairs = _Hashed(18)
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.words: dict[str, bytes] = {}  # by the word after a space mark
        self.others: dict[str, bytes] = {}  # by the unit itself
        self.limit = cache
        self._trie()
        out = [p.replace(SPACE, " ").encode("utf-8") for p in v.pieces]
        for b, i in v.bytes.items():
            out[i] = bytes([b])
        for i, kind in enumerate(v.types):
            if kind == CONTROL:
                out[i] = b""
            elif kind == UNKNOWN:
                out[i] = " \u2047 ".encode()
        self.spelled = out

    def _trie(self) -> None:
        chars = sorted({c for p in self.ids for c in p})
        self.char = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.char[ord(c)] = k
        edges: dict[int, int] = {}
        token = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                key = node << 20 | int(self.char[ord(c)])
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        self.edges = _Hashed(18)
        self.edges.put(np.fromiter(edges, np.int64), np.fromiter(edges.values(), np.int32))
        self.token = np.array(token, np.int32)
        self.longest = max(map(len, self.ids))

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best-scored, leftmost pair merges first."""
        ids, scores = self.ids, self.vocabulary.scores
        symbols, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(symbols)
            if a >= 0 and b < len(symbols) and (i := ids.get(joined := symbols[a] + symbols[b])) is not None:
                heappush(agenda, (-scores[i], a, b, joined))

        for a in range(len(symbols) - 1):
            offer(a)
        while agenda:
            _, a, b, joined = heappop(agenda)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined or after[a] != b:
                continue
            symbols[a], symbols[b] = joined, ""
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [s for s in symbols if s]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens left and right, side by side, stay as they are. What is found is kept for later."""
        pieces, out = self.vocabulary.pieces, self.alone[right]
        known = left < len(pieces)
        keys = left[known].astype(np.int64) << 20 | right[known]
        ok = self.pairs.get(keys)
        if (unseen := ok < 0).any():
            new = np.unique(keys[unseen])
            if self.pairs.n > 2_000_000:
                self.pairs = _Hashed(18)
            both = [(pieces[k >> 20], pieces[k & 0xFFFFF]) for k in new.tolist()]
            self.pairs.put(new, np.array([self._merge(a + b) == [a, b] for a, b in both], np.int32))
            ok[unseen] = self.pairs.get(keys[unseen])
        out[known] &= ok == 1
        return out

    def _matches(self, text: np.ndarray, room: np.ndarray):
        """(end, token, length) of every piece in text; room: characters from a position to the end of its unit."""
        ends, tokens, lengths = [], [], []
        at = np.flatnonzero(text)
        node = np.zeros(len(at), np.int64)
        for length in range(1, self.longest + 1):
            fits = room[at] >= length
            at, node = at[fits], node[fits]
            if not len(at):
                break
            child = self.edges.get(node << 20 | text[at + length - 1])
            at, node = at[child >= 0], child[child >= 0].astype(np.int64)
            token = self.token[node]
            full = token >= 0
            ends.append(at[full] + length - 1)
            tokens.append(token[full])
            lengths.append(np.full(len(ends[-1]), length, np.int16))
        return np.concatenate(ends), np.concatenate(tokens), np.concatenate(lengths)

    def _many(self, units: list[str]) -> list[bytes]:
        """Ids of short units."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(sizes)
        start = stop - sizes
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        text = self.char[points]
        offset = np.arange(len(text)) - np.repeat(start, sizes)
        end, token, length = self._matches(text, np.repeat(sizes, sizes) - offset)
        rank = (offset[end] * (self.longest + 1) + (self.longest - length)).astype(np.uint16)  # by column, longest first
        order = np.argsort(rank, kind="stable")
        end, token, length, rank = end[order], token[order], length[order], rank[order]
        last, size = np.where(text > 0, -1, len(self.vocabulary.pieces) + points.astype(np.int64)), np.ones(len(text), np.int32)
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
            e, t, n = end[a:b], token[a:b], int(length[a])
            open_ = last[e] < 0
            e, t = e[open_], t[open_]
            if not len(e):
                continue
            ok = self.alone[t] if n == offset[e[0]] + 1 else self._compatible(last[e - n], t)
            last[e[ok]] = t[ok]
            size[e[ok]] = n
        who, at = np.arange(len(units)), stop - 1
        owners, found = [], []
        while len(who):  # backwards, one token of each unit at a time
            owners.append(who)
            found.append(last[at])
            at = at - size[at]
            more = at >= start[who]
            who, at = who[more], at[more]
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(found[::-1])
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        if (strange := ids >= len(self.vocabulary.pieces)).any():
            spelled = [self._bytes(i - len(self.vocabulary.pieces)) for i in ids[strange].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(x) for x in spelled]
            owner, ids, strange = np.repeat(owner, times), np.repeat(ids, times), np.repeat(strange, times)
            ids[strange] = [i for x in spelled for i in x]
        out = ids.astype("<u4").tobytes()
        bounds = (4 * np.cumsum(np.bincount(owner, minlength=len(units)))).tolist()
        return [out[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def _bytes(self, point: int) -> list[int]:
        return [self.vocabulary.bytes[b] for b in chr(point).encode("utf-8")]

    def _one(self, unit: str) -> bytes:
        """Ids of a unit of any length and any characters: the same table, filled for this unit alone."""
        n = len(unit)
        text = self.char[np.frombuffer(unit.encode("utf-32-le"), np.uint32)]
        end, token, length = self._matches(text, np.arange(n, 0, -1)) if text.any() else ([], [], [])
        by_end: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for e, t, k in zip(*map(list, (end, token, length)), strict=True):
            by_end[e].append((int(k), int(t)))
        last = [-1] * n  # -1: a character that has no piece
        size = [1] * n
        for e, found in enumerate(by_end):
            for k, t in sorted(found, reverse=True):
                p = last[e - k] if e >= k else -1
                if self._compatible(np.array([p]), np.array([t]))[0] if p >= 0 else self.alone[t]:
                    last[e], size[e] = t, k
                    break
        out, e = [], n - 1
        while e >= 0:
            out.append([last[e]] if last[e] >= 0 else self._bytes(ord(unit[e])))
            e -= size[e]
        return array("I", [i for ids in reversed(out) for i in ids]).tobytes()

    def _learn(self, known: dict[str, bytes], keys: set[str], before: str) -> None:
        new = list(keys.difference(known))
        for a in range(0, len(new), 25_000):
            part = new[a : a + 25_000]
            units = [before + k for k in part]
            short = [u for u in units if len(u) <= self.LONG]
            ids = iter(self._many(short) if short else ())
            known.update((k, next(ids) if len(u) <= self.LONG else self._one(u)) for k, u in zip(part, units, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.others) > self.limit:
            self.words, self.others = {}, {}
        begin, end = struct.pack("<I", self.vocabulary.bos), struct.pack("<I", self.vocabulary.eos)
        prefix = SPACE * self.vocabulary.dummy_prefix
        cut, plain = [], []
        for text in texts:
            # Words between single spaces are kept without their marks; what has other spacing is cut with marks.
            plain.append(bool(text and prefix and not self.whole and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " "))
            if plain[-1]:
                cut.append(text.split(" "))
            elif text:
                marked = prefix + text.replace(" ", SPACE)
                cut.append([marked] if self.whole else self.units.findall(marked))
            else:
                cut.append([])
        self._learn(self.words, set().union(*(u for u, p in zip(cut, plain, strict=True) if p)), SPACE)
        self._learn(self.others, set().union(*(u for u, p in zip(cut, plain, strict=True) if not p)), "")
        read = (self.others.__getitem__, self.words.__getitem__)
        return [b"".join([begin, *map(read[p], units), end]) for units, p in zip(cut, plain, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        out = b"".join(map(self.spelled.__getitem__, array("I", ids)))
        if self.vocabulary.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace").encode("utf-8")


@lru_cache(1)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs, in any order, one row for each input row.

    model is the model file's path on every executor; a path without a slash names a file given to addFile().
    with_ids adds the ids as array<int>.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = encoder(model if "/" in model else SparkFiles.get(model))
        texts = batch.column("text").to_pylist()
        n, ids_sha, text_sha, all_ids = [], [], [], []
        for a, b in pieces_of(texts, 1_000_000):
            for ids in tool.encode(texts[a:b]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(tool.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(array("i", ids).tolist())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)
